"""License notices in texts, exactly and with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Phrases whose exact places are counted.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Short notices that are searched with edits: (words joined by single blanks, label,
#: the words that name the license).
NOTICES = (
    ("released under the mit license", "mit", ("mit",)),
    ("licensed under the mit license", "mit", ("mit",)),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ()),
    ("licensed under the apache license version 2 0", "apache-2", ("apache", "2")),
    ("you may not use this file except in compliance with the license", "apache-2", ()),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("cc", "by", "nc")),
    ("licensed under cc by sa 4 0", "cc-by-sa", ("cc", "by", "sa")),
    ("creative commons attribution noncommercial", "cc-by-nc", ("noncommercial",)),
    ("creative commons attribution sharealike", "cc-by-sa", ("sharealike",)),
    ("licensed under the gnu general public license version 3", "gpl-3", ("gnu", "general", "3")),
    ("licensed under the gnu general public license version 2", "gpl-2", ("gnu", "general", "2")),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ()),
    ("licensed under the mozilla public license version 2 0", "mpl-2", ("mozilla", "2")),
    ("spdx license identifier mit", "mit", ("mit",)),
    ("spdx license identifier apache 2 0", "apache-2", ("apache", "2")),
    ("this is free and unencumbered software released into the public domain", "unlicense", ()),
)
#: Words that name some license: none of them is a misspelling of another.
NAMES = frozenset((
    "mit", "apache", "bsd", "isc", "gnu", "gpl", "lgpl", "agpl", "mpl", "epl", "cpl", "cddl", "eupl", "wtf", "wtfpl", "zlib", "x11",
    "boost", "mozilla", "eclipse", "artistic", "lesser", "affero", "general", "noncommercial", "noderivatives", "noderivs",
    "sharealike", "commercial", "cc", "cc0", "by", "nc", "nd", "sa", "ms", "mpl2", "ofl", "ncsa", "pil", "php", "python",
))
#: Allowed edits (characters) per length of a notice.
EDIT_SHARE = 0.1
_WORD = regex.compile(rb"[0-9a-z\x80-\xff]+")


def normalized(text: str | None) -> list[bytes]:
    """The words of a text: runs of digits, letters and non-ASCII, A-Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


#: Pieces of a notice that must stand unchanged near each other.
INTACT = 2


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + INTACT pieces (start, piece): with at most
    that many edits, INTACT pieces stand in the text unchanged."""
    n = edits + INTACT
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _near(word: str, name: str) -> bool:
    """Whether ``word`` stands for ``name``: it is the name, or one edit per
    three letters away from it and neither a number nor another name."""
    if word == name:
        return True
    most = len(name) // 3
    if not most or name.isdigit() or word.isdigit() or word in NAMES or abs(len(word) - len(name)) > most:
        return False
    row = list(range(len(name) + 1))
    for i, c in enumerate(word, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(name, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1] <= most


def names_stand(text: str, start: int, end: int, names: Sequence[str]) -> bool:
    """Whether the words of a match have the names in their order."""
    start = text.rfind(" ", 0, start + 1) + 1
    after = text.find(" ", max(start, end - 1))
    words = iter(text[start:after if after >= 0 else len(text)].split())
    return all(any(_near(word, name) for word in words) for name in names)


class Scanner:
    """Finds notices with edits in text whose words are joined by blanks.

    Edits may fall on any word of a notice but those that name the license: a
    match counts only if they stand in it (``names_stand``)."""

    def __init__(self, notices: Sequence[tuple[str, str, Sequence[str]]], share: float):
        self.names = [tuple(names) for _, _, names in notices]
        self.notices = [(notice, label, int(len(notice) * share)) for notice, label, _ in notices]
        self.reach = max((len(n) + e for n, _, e in self.notices), default=0)
        self.patterns = [regex.compile(f"(?be)(?:{regex.escape(n)}){{e<={e}}}") for n, _, e in self.notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _, edits) in enumerate(self.notices):
            for at, piece in seeds(notice, edits):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in places.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per notice the stretches of text that a match with edits can lie in."""
        found: dict[int, list[list[int]]] = {}
        recent: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for k, at in owners:
                notice, _, edits = self.notices[k]
                start = end - size + 1 - at
                # edits move the start that a piece implies by as many characters at most
                near = [x for x in recent.get(k, ()) if x[0] >= start - len(notice) - edits]
                recent[k] = [*near, (start, at)]
                if not any(abs(s - start) <= edits and a != at for s, a in near):
                    continue
                low, high = max(0, start - edits), min(len(text), start + len(notice) + edits)
                spans = found.setdefault(k, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        return found

    def __call__(self, text: str) -> list[tuple[str, str, int, int, int]]:
        """(label, notice, start, end, edits) of every match, by start."""
        out = []
        for k, spans in self.windows(text).items():
            notice, label, _ = self.notices[k]
            for low, high in _merged(spans):
                for m in self.patterns[k].finditer(text, low, high):
                    if names_stand(text, m.start(), m.end(), self.names[k]):
                        out.append((label, notice, m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(_fewest_edits(out, self.reach), key=lambda x: (x[2], x[3], x[1]))


def _fewest_edits(matches: list[tuple], reach: int) -> list[tuple]:
    """Without matches that overlap one with fewer edits, as of another version of
    the license; no match is longer than ``reach``."""
    kept: list[tuple] = []
    matches = sorted(matches, key=lambda m: m[2])
    for i, m in enumerate(matches):
        beaten = False
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(matches) and abs(matches[j][2] - m[2]) <= reach and not beaten:
                o = matches[j]
                beaten = o[4] < m[4] and o[2] < m[3] and m[2] < o[3]
                j += step
        if not beaten:
            kept.append(m)
    return kept


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


@lru_cache(maxsize=4)
def _scanner(notices: tuple, share: float) -> Scanner:
    return Scanner(notices, share)


def phrase_places(words: list[bytes], joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the words of a phrase stand consecutively.
    ``joined``: the words with a blank before, between and after them."""
    needle, out, at, word, counted = b" " + phrase + b" ", [], -1, 0, 0
    while (at := joined.find(needle, at + 1)) >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        out.append(word)
    return out


MATCH = "struct<label:string,notice:string,start:long,end:long,edits:int>"
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          f"labels string, score double, matches array<{MATCH}>")


def _scan(batches, phrases, notices, share: float) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(notices, share)
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            words = normalized(value.as_py())
            joined = b" " + b" ".join(words) + b" "
            places, base = [], set()
            for phrase, label in phrases:
                if at := phrase_places(words, joined, phrase.encode()):
                    places += at
                    base.add(label)
            matches = scanner(joined.decode("utf-8", "surrogatepass"))
            labels = base | {m[0] for m in matches}
            score = 1.0 if base else max((1 - m[4] / len(m[1]) for m in matches), default=0.0)
            rows.append((len(words), len(places), min(places, default=None), max(places, default=None),
                         ",".join(sorted(base)), ",".join(sorted(labels)), score,
                         [dict(zip(("label", "notice", "start", "end", "edits"), m, strict=True)) for m in matches]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([
            ("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("edits", pa.int32())]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


def notice_table(table: DataFrame, most: int = 10_000) -> tuple:
    """Notices from a table (notice, label, names array<string>); more than ``most`` are refused."""
    rows = table.select("notice", "label", F.coalesce("names", F.array().cast("array<string>")).alias("names")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} notices")
    return tuple((" ".join(w.decode("utf-8", "surrogatepass") for w in normalized(r["notice"])), r["label"], tuple(r["names"])) for r in rows)


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, share: float = EDIT_SHARE,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: exact phrase places and labels, labels with edits, spans.

    Words are runs of digits, letters and non-ASCII characters of the lower-cased
    (A-Z) whole text. ``n_base`` counts all places of the phrases; ``labels`` adds
    those of notices found with at most ``share`` edits per character, whose
    naming words stand in the text. Texts of any length are read whole. ``matches``
    has the spans (characters in the words joined by blanks, after a leading
    blank) and their edits; a match is left out where one with fewer edits overlaps it. ``score`` is 1 for an exact phrase, else the best
    share of a notice left unedited, else 0. Null, empty and word-less texts have
    no words, places or labels ('' and null positions). Repeated rows come back
    as often as they are; other columns are ignored.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(
        partial(_scan, phrases=tuple(phrases), notices=tuple(notices), share=share), SCHEMA)
