"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Every kind has a pattern, a check of the proposed text (checksums, digit counts,
neighbouring characters), a score without context, and words that change the
score when they stand near the span. A kind is reported from a least score on;
the base kinds have a least score of zero. Everything is column functions: the
matches of a kind are one array, the texts between them another, and positions
are running sums of their lengths, so the work is one pass over a text per kind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

#: Code points of context on either side; context ends at the next match of the kind.
CONTEXT = 48
#: Matches whose lengths are summed one by one; longer lists go by blocks of this many.
BLOCK = 256

#: Lengths of account numbers by country, of the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(digits)

    def worth(i: Column) -> Column:
        one = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        twice = one * 2
        return F.when(i % 2 == 1, one).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def passes_mod97(compact: Column) -> Column:
    """Whether an account number (no blanks) leaves 1 modulo 97, its first four
    characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _always(text: Column, before: Column, after: Column) -> Column:
    return F.lit(True)


def _ip(text: Column, before: Column, after: Column) -> Column:
    return text.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$)){4}$")


def _card(text: Column, before: Column, after: Column) -> Column:
    digits = digits_of(text)
    return F.when(F.length(digits).between(16, 19), passes_luhn(digits)).otherwise(F.lit(False))


def _phone(text: Column, before: Column, after: Column) -> Column:
    return F.length(digits_of(text)).between(8, 15)


def _iban(text: Column, before: Column, after: Column) -> Column:
    compact = F.regexp_replace(text, " ", "")
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    sized = F.length(compact) == F.try_element_at(lengths, F.substring(compact, 1, 2))
    return F.when(sized, passes_mod97(compact) & ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
                  ).otherwise(F.lit(False))


def _ssn(text: Column, before: Column, after: Column) -> Column:
    return (~text.rlike("^(000|666|9)") & ~text.rlike("-00-") & ~text.rlike("0000$")
            & ~before.rlike("[A-Za-z0-9-]$") & ~after.rlike("^[A-Za-z0-9-]"))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``pattern`` is run by the JVM; scores are percent;
    ``words`` near a span raise its score by ``more``, ``against`` lower it by
    ``less``; spans below ``least`` are not reported."""

    name: str
    pattern: str
    valid: Callable[[Column, Column, Column], Column]
    score: int
    words: tuple[str, ...]
    more: int
    against: tuple[str, ...] = ()
    less: int = 0
    least: int = 0


# The base patterns are those of the contract with possessive quantifiers and a
# left edge, which give the same matches in linear time.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         _always, 90, ("email", "mail", "contact", "write"), 10, ("example", "test"), 20),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", _ip, 60,
         ("ip", "address", "host", "server", "login"), 30, ("version", "release", "section", "chapter"), 40),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", _card, 80,
         ("card", "visa", "mastercard", "credit", "debit", "pay", "payment"), 20, ("isbn", "order", "serial"), 30),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 70,
         ("phone", "tel", "telephone", "call", "mobile", "fax"), 30),
)
ADDED = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", _iban, 90,
         ("iban", "account", "bank", "konto", "compte", "cuenta"), 10, least=80),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, 40,
         ("ssn", "social security", "tax id", "taxpayer"), 50, ("part", "serial", "order"), 20, least=80),
)


def words_pattern(words: Sequence[str]) -> str:
    """Any of the words, not inside a longer one, in lower-case text."""
    return "(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)"


def _before_all(lengths: Column, count: Column) -> Column:
    """For each block of ``lengths`` the sum of all blocks before it."""
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0).cast("long"), lambda s, x: s + x))


def _span(kind: Kind, found: Column, gaps: Column, lengths: Column, blocks: Column, i: Column) -> Column:
    text, before, after = F.get(found, i), F.get(gaps, i), F.get(gaps, i + 1)
    block = F.floor(i / BLOCK).cast("int")
    inside = F.aggregate(F.slice(lengths, block * BLOCK + 1, i % BLOCK), F.lit(0).cast("long"), lambda s, x: s + x)
    start = F.get(blocks, block) + inside + F.length(before)
    # a span that follows the one before it at once has its last character as its neighbour
    left = F.when((before == "") & (i > 0), F.lit("0")).otherwise(before)
    right = F.when((after == "") & (i + 1 < F.size(found)), F.lit("0")).otherwise(after)
    near = F.translate(F.concat(F.right(before, F.lit(CONTEXT)), F.lit("\n"), F.left(after, F.lit(CONTEXT))), UPPER, LOWER)
    score = F.lit(kind.score) + F.when(near.rlike(words_pattern(kind.words)), kind.more).otherwise(0)
    if kind.against:
        score = score - F.when(near.rlike(words_pattern(kind.against)), kind.less).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return F.struct(
        F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"),
        score.alias("score"), (kind.valid(text, left, right) & (score >= kind.least)).alias("valid"))


def personal_data(docs: DataFrame, kinds: Sequence[Kind] = BASE + ADDED, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """(doc_id, spans) per row of ``docs``: an array of (kind, start, end, text, score).

    Spans are ordered by kind as listed, then by start; positions are code
    points, ends exclusive; scores are percent. Matches of one kind do not
    overlap, those of different kinds may. Null and empty texts have no span.
    Rows are judged one by one, so repeated rows and null ids come back as they
    are; whole texts are read, a text of any length in time linear in its length
    (and in its matches times ``BLOCK``). Other columns are ignored.
    """
    names = [k.name for k in kinds]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[
        F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"found_{k.name}") for k in kinds])
    rows = rows.select("doc_id", *[f"found_{n}" for n in names], *[
        F.when(F.size(f"found_{k.name}") > 0, F.split("text", k.pattern, -1)).alias(f"gaps_{k.name}") for k in kinds])
    rows = rows.select("*", *[
        F.zip_with(f"found_{n}", F.slice(f"gaps_{n}", F.lit(1), F.size(f"found_{n}")),
                   lambda m, g: (F.length(m) + F.length(g)).cast("long")).alias(f"lengths_{n}") for n in names])
    rows = rows.select("*", *[
        F.when(F.size(f"found_{n}") > 0, _before_all(F.col(f"lengths_{n}"), F.size(f"found_{n}"))).alias(f"blocks_{n}")
        for n in names])
    spans = []
    for k in kinds:
        found, gaps, lengths, blocks = (F.col(f"{x}_{k.name}") for x in ("found", "gaps", "lengths", "blocks"))
        every = F.transform(F.sequence(F.lit(0), F.size(found) - 1), partial(_span, k, found, gaps, lengths, blocks))
        spans.append(F.when(F.size(found) > 0, F.transform(
            F.filter(every, lambda s: s["valid"]),
            lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "text", "score")]))).alias(f"spans_{k.name}"))
    rows = rows.select("doc_id", *spans)
    kept = [F.coalesce(f"spans_{n}", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,score:int>>"))
            for n in names]
    return rows.select("doc_id", F.concat(*kept).alias("spans"))


def span_digest(found: DataFrame, base: Sequence[str] = tuple(k.name for k in BASE),
                added: Sequence[str] = tuple(k.name for k in ADDED)) -> DataFrame:
    """Counts per kind, a hash of the base spans, all spans and their scores as text."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    basic = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id", *[of(n).alias(f"n_{n}") for n in base],
        F.sha2(F.array_join(F.transform(basic, named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", named), ",").alias("spans"),
        *[of(n).alias(f"n_{n}") for n in added],
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
