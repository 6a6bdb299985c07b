"""newsgraph: landed news feeds and pages to a contact-and-topic star schema."""
