"""String functions on contact and topic texts, all ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and replacement lists that decide the results.
EMAIL_PATTERN = (
    r"(?i)(([\w-]+\.)+[\w-]+|([a-zA-Z]{1}|[\w-]{2,}))@"
    r"((([0-1]?[0-9]{1,2}|25[0-5]|2[0-4][0-9])\.([0-1]?[0-9]{1,2}|25[0-5]|2[0-4][0-9])\."
    r"([0-1]?[0-9]{1,2}|25[0-5]|2[0-4][0-9])\.([0-1]?[0-9]{1,2}|25[0-5]|2[0-4][0-9])){1}|"
    r"([a-zA-Z]+[\w-]+\.)+[a-zA-Z]{2,4})"
)
LOCATION_WORD_PATTERN = r"\w(?<!\d)[\w'-]*"
UNESCAPED = [("&apos;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")]
ASCII_SPACE = " \t\n\x0b\f\r"
REMOVED = ["&nbsp;", "&raquo;", "\r", "\n", "'", ",", "."]


def _flagged(pattern: str, unicode: bool) -> str:
    return f"(?U){pattern}" if unicode else pattern


def last_email(text: Column, unicode: bool = False) -> Column:
    """The last e-mail address in the text, ``''`` when there is none.

    Texts without an ``@`` never reach the regular expression.
    """
    found = F.regexp_extract_all(text, F.lit(_flagged(EMAIL_PATTERN, unicode)), F.lit(0))
    last = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
    return F.when(F.contains(text, F.lit("@")), last).otherwise(F.lit(""))


def _replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_html(text: Column) -> Column:
    """Unescape five entities in a fixed order, then drop marks and line ends.

    The order is part of the result: ``&amp;nbsp;`` vanishes and ``&amp;lt;``
    becomes ``&lt;``.
    """
    return _replace_all(text, [*UNESCAPED, *((mark, "") for mark in REMOVED)])


def escape_xml(text: Column) -> Column:
    """XML escaping; the ampersand goes first so that nothing is escaped twice."""
    return _replace_all(text, [(char, entity) for entity, char in reversed(UNESCAPED)])


def trim_ws(text: Column, unicode: bool = False) -> Column:
    """Strip all white space at both ends (plain ``F.trim`` strips blanks only)."""
    if not unicode:
        return F.btrim(text, F.lit(ASCII_SPACE))
    lead = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.regexp_replace(lead, r"(?U)\s+$", "")


def name_before_comma(text: Column) -> Column:
    return F.substring_index(text, ",", 1)


def location_words(text: Column, unicode: bool = False) -> Column:
    """All words of a location text, in order; a word does not start with a digit."""
    pattern = _flagged(LOCATION_WORD_PATTERN, unicode)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def state_of(location: Column) -> Column:
    """First piece of ``state,country``; null for an empty location."""
    return F.when(location != "", F.try_element_at(F.split(location, ","), F.lit(1)))


def country_of(location: Column) -> Column:
    """Second piece of ``state,country``; null when there is no comma."""
    return F.try_element_at(F.split(location, ","), F.lit(2))


def title_head(title: Column) -> Column:
    """Text before the first dash (kept for reports; the full title is stored)."""
    return F.substring_index(title, "-", 1)


def publisher_of(title: Column) -> Column:
    """Text after the last dash, the whole title when there is none."""
    return F.substring_index(title, "-", -1)


def cluster_id(guid: Column) -> Column:
    """Second ``=`` piece of a story guid; null when there is no ``=``."""
    return F.try_element_at(F.split(guid, "="), F.lit(2))


def is_numeric(text: Column) -> Column:
    """Whether the text reads as a number; thousands commas are accepted.

    The shape is tested as well, since a cast to double also takes Java
    literals such as ``12d``.
    """
    plain = F.replace(text, F.lit(","), F.lit(""))
    shaped = plain.rlike(r"^\s*([-+]?[0-9.]+([eE][-+]?[0-9]+)?|NaN|-?Infinity)\s*$")
    return F.coalesce(shaped & plain.try_cast("double").isNotNull(), F.lit(False))


def link_class(href: Column) -> Column:
    """Kind of contact link: twitter, linkedin, email, or null."""
    return (
        F.when(F.contains(href, F.lit("twitter.com")), F.lit("twitter"))
        .when(F.contains(href, F.lit("linkedin.com")), F.lit("linkedin"))
        .when(F.contains(href, F.lit("mailto:")), F.lit("email"))
    )


def is_absolute_link(href: Column) -> Column:
    return F.startswith(href, F.lit("http://"))


def entry_text(tag: Column, value: Column) -> Column:
    """Display form ``tag:value``; a null value shows as an empty one."""
    return F.concat(tag, F.lit(":"), F.coalesce(value, F.lit("")))


def entry_of(text: Column) -> Column:
    """Struct (tag, value) of a ``tag:value`` text; only the first colon splits."""
    tag = F.substring_index(text, ":", 1)
    return F.struct(
        tag.alias("tag"), F.substring(text, F.length(tag) + 2, F.length(text)).alias("value")
    )
