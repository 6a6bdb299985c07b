"""Element picks from landed HTML pages.

``pick_elements`` is the only Python on the page path: a map over the pages
that scans each text once and returns the few elements the callers name.
Everything after it (first match, scope, joins) is a DataFrame expression on
the returned array, so the page texts are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# HTML elements without content, and those with raw text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}

# ASCII, so that white space means the same here and in the JVM pre-filter. A
# quote opens a string only where an attribute value starts. Nothing is read
# twice: a comment or tag without an end takes the rest of the page.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(/?)([a-zA-Z][^\s/>]*+)
        ((?:[^>=]++ | =\s*+(?:"[^"]*+" | '[^']*+' | [^\s>"'][^\s>]*+ | (?=>)))*+)(>?)
      | <[!?][^>]*(?:>|\Z)""",
    re.S | re.A | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.A)


@dataclass(frozen=True)
class Pick:
    """A wanted element: tag and exact attribute value, optionally only inside
    (any depth) or directly below an element of another pick."""

    name: str
    tag: str | None = None
    attr: str | None = None
    value: str | None = None
    inside: str | None = None
    child_of: str | None = None


_FIELDS = [("pick", "string"), ("pos", "int"), ("scope", "int"), ("nth", "int"),
           ("href", "string"), ("cid", "string"), ("text", "string")]
_SPARK_KIND = {"string": StringType(), "int": IntegerType()}
_ARROW_KIND = {"string": pa.string(), "int": pa.int32()}
PICKED = ArrayType(StructType([StructField(n, _SPARK_KIND[k]) for n, k in _FIELDS]))
_ARROW_PICKED = pa.list_(pa.struct([(n, _ARROW_KIND[k]) for n, k in _FIELDS]))


class _Open:
    """An element whose end was not seen yet."""

    __slots__ = ("tag", "matched", "children", "text_from", "rows")

    def __init__(self, tag: str, text_from: int):
        self.tag, self.text_from = tag, text_from
        self.matched: dict[str, int] = {}
        self.children = 0
        self.rows: list[list] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


def _scope_of(pick: Pick, stack: list[_Open], inside: dict[str, list[int]]) -> int | None:
    """Position of the element that scopes the pick; -1 without a scope.
    ``inside`` has the positions of the open elements of every pick."""
    if pick.child_of:
        return stack[-1].matched.get(pick.child_of) if stack else None
    if pick.inside:
        return inside[pick.inside][-1] if inside[pick.inside] else None
    return -1


def scan(html: str | None, picks: Sequence[Pick]) -> list[list]:
    """Picked elements of one page in document order.

    Unclosed elements end with their parent, stray end tags are ignored; a tag
    that the page cuts off is none. Time is linear in the page.
    """
    by_tag: dict[str, list[Pick]] = {}
    any_tag = [pick for pick in picks if pick.tag is None]
    for pick in picks:
        if pick.tag:
            by_tag.setdefault(pick.tag, []).append(pick)
    rows: list[list] = []
    texts: list[str] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    inside: defaultdict[str, list[int]] = defaultdict(list)
    html = html or ""
    at = position = 0

    def close() -> None:
        done = stack.pop()
        opened[done.tag] -= 1
        for name in done.matched:
            inside[name].pop()
        if done.rows:
            text = "".join(texts[done.text_from:])
            for row in done.rows:
                row[-1] = text

    while (token := _TOKEN.search(html, at)) is not None:
        if token.start() > at:
            texts.append(html[at:token.start()])
        at = token.end()
        if not token[2]:
            continue
        if not token[4]:  # cut off inside a tag
            at = len(html)
            break
        tag = token[2].lower()
        if token[1]:
            if opened[tag] > 0:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if stack:
            stack[-1].children += 1
        element = _Open(tag, len(texts))
        wanted = by_tag.get(tag, ())
        if wanted or any_tag:
            attributes = _attributes(token[3])
            for pick in (*wanted, *any_tag):
                if pick.attr and attributes.get(pick.attr) != pick.value:
                    continue
                scope = _scope_of(pick, stack, inside)
                if scope is None:
                    continue
                element.matched[pick.name] = position
                element.rows.append(
                    [pick.name, position, scope, stack[-1].children if stack else 0,
                     attributes.get("href"), attributes.get("cid"), ""]
                )
            rows.extend(element.rows)
        position += 1
        if tag in VOID_TAGS:
            continue
        stack.append(element)
        opened[tag] += 1
        for name, where in element.matched.items():
            inside[name].append(where)
        if tag in RAW_TEXT and not token[3].endswith("/"):
            end = RAW_TEXT[tag].search(html, at)
            at = end.start() if end else len(html)
    texts.append(html[at:])
    while stack:
        close()
    return rows


def may_match(picks: Sequence[Pick], html: str = "html") -> Column:
    """Whether a page can hold any of the picks at all.

    Attribute values are compared as written, so an element that starts a pick
    shows ``attribute = value`` in the text. The test runs in the JVM and keeps
    all other pages away from Python; it never drops a match.
    """
    roots = [pick for pick in picks if not pick.inside and not pick.child_of]
    if any(pick.attr is None for pick in roots):
        return F.lit(True)
    by_attr: dict[str, list[str]] = {}
    for pick in roots:
        by_attr.setdefault(pick.attr, []).append(rf"\Q{pick.value}\E")
    shown = "|".join(
        rf"(?i:{attr})\s*=\s*[\"']?(?:{'|'.join(values)})" for attr, values in by_attr.items()
    )
    return F.col(html).rlike(shown)


def pick_elements(
    pages: DataFrame, picks: Sequence[Pick], key: str = "url", partitions: int | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, the columns to keep, picks): for every page the array of its picked elements.

    Pages stay in the partitions they come in, unless a caller that knows they
    are few asks for a number of ``partitions``.
    """
    wanted = tuple(picks)
    source = pages.select(key, "html", *keep)
    if partitions:
        source = source.repartition(partitions)
    names = [key, *keep]
    fields = [source.schema[name] for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [tuple(row) for row in scan(html, wanted)]
                for html in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(found, _ARROW_PICKED)], names=[*names, "picks"]
            )

    return source.mapInArrow(run, StructType([*fields, StructField("picks", PICKED)]))


def all_of(name: str, scope: Column | None = None, picks: str | Column = "picks") -> Column:
    """Array of the elements of one pick, in document order."""

    def same(element: Column) -> Column:
        hit = element["pick"] == name
        return hit if scope is None else hit & (element["scope"] == scope)

    return F.filter(picks, same)


def first_of(name: str, scope: Column | None = None, picks: str | Column = "picks") -> Column:
    """First element of one pick, null when the page has none."""
    return F.try_element_at(all_of(name, scope, picks), F.lit(1))
