"""Edits on the words that name a license give no label; true notices with typos do."""

from __future__ import annotations

import random

import pytest

from newsgraph.llm.license_scan import EDIT_SHARE, NOTICES, Scanner, notice_table, scan_licenses

SCANNER = Scanner(NOTICES, EDIT_SHARE)


def labels(text):
    return {m[0] for m in SCANNER(f" {text} ")}


@pytest.mark.parametrize("text", [
    "licensed under the bsd license", "licensed under the isc license", "licensed under the wtf license",
    "licensed under cc by nd 4 0", "licensed under the gnu general public license version 1",
    "licensed under the mozilla public license version 1 1", "spdx license identifier isc", "released under the zlib license",
    "licensed under the apache license version 1 1", "spdx license identifier apache 1 1", "released under the old license",
    "creative commons attribution noderivatives", "licensed under the gnu lesser public license version 3",
])
def test_other_licenses_give_no_label(text):
    assert labels(text) == set()


@pytest.mark.parametrize(("text", "label"), [
    ("licensed under cc by sa 4 0", "cc-by-sa"), ("licensed under cc by nc 3 0", "cc-by-nc"),
    ("released under the mlt license", "mit"), ("relaesed under the mit licence", "mit"),
    ("permission is herby granted free of charge to any person obtaning a copy", "mit"),
    ("licensed undr the gnu generel public license version 3", "gpl-3"),
    ("licenced under the mozila public license version 2 0", "mpl-2"),
    ("licensed under the apachee license version 2 0", "apache-2"),
])
def test_typos_keep_the_label(text, label):
    assert labels(text) == {label}


def test_random_edits_outside_names(seed=3):
    """Every notice with edits on its other words, up to the bound, is found with its place."""
    r = random.Random(seed)
    for notice, label, names in NOTICES:
        for _ in range(20):
            words = notice.split()
            free = [i for i, w in enumerate(words) if w not in names and len(w) > 4]
            for i in r.sample(free, min(len(free), max(1, int(len(notice) * EDIT_SHARE) // 2))):
                at = r.randrange(len(words[i]))
                words[i] = words[i][:at] + r.choice("xyz") + words[i][at + r.randint(0, 1):]
            text = " before it " + " ".join(words) + " after it "
            found = [m for m in SCANNER(text) if m[0] == label]
            assert found and found[0][2] >= 10 and found[0][3] <= len(text) - 9, (notice, words)


def test_notices_from_a_table(spark):
    table = spark.createDataFrame([("Covered by the Foo-Bar  license", "foo", ["foo", "bar"]), ("all rights reserved here", "none", None)],
                                  "notice string, label string, names array<string>")
    notices = notice_table(table)
    assert notices[0] == ("covered by the foo bar license", "foo", ("foo", "bar"))
    docs = spark.createDataFrame([(1, "It is coverd by the FOO bar license."), (2, "covered by the bar bar license")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(docs, notices=notices).collect()}
    assert got == {1: "foo", 2: ""}
    with pytest.raises(ValueError):
        notice_table(table, most=1)
