"""Block and allow decisions on pages, carried over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.llm.common import written
from newsgraph.llm.components import components

Rule = tuple[str, str, str]  # verdict, host, path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))


def with_host_and_path(df: DataFrame, url: str) -> DataFrame:
    """Adds ``_url``, ``_host`` (A-Z lower-cased) and ``_path``; both empty for null or no ``://``."""
    return (
        df.withColumn("_url", F.col(url).cast("string"))
        .withColumn("_rest", _rest(F.col("_url")))
        .withColumn("_rest", F.coalesce("_rest", F.lit("")))
        .withColumn("_host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0),
                                         "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .withColumn("_path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
    )


def ruled(host: Column, path: Column, rules: Sequence[Rule], field: int) -> Column:
    """The longest rule that fits (``field`` 1) or its verdict (0); null if none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit(verdict if field == 0 else rule_host + rule_path)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _node(url: Column, host: Column) -> Column:
    """The address that stands for a page: no scheme, no fragment, no utm_ parameters."""
    tail = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", ""), r"(?s)#.*$", "")
    tail = F.regexp_replace(tail, r"(?<=[?&])utm_[^&]*&?", "")
    return F.concat(host, F.regexp_replace(tail, r"[?&]$", ""))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    size = F.size(parts)

    def step(kept: Column, i: Column) -> Column:
        part = F.get(parts, i)
        last = i == size - 1
        up = F.slice(kept, F.lit(1), F.greatest(F.lit(1), F.size(kept) - 1))  # the empty part before the first slash stays
        end = F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(part == "..", F.concat(up, end)).when(part == ".", F.concat(kept, end)).otherwise(F.concat(kept, F.array(part)))

    folded = F.aggregate(F.sequence(F.lit(0), size - 1), F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.array_join(folded, "/")).otherwise(path)


def _target(link: Column, base: Column) -> Column:
    """The address that a link means on a page of address ``base``; null for
    other schemes than those with ``://``, and for a place on the page itself."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    own = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (F.when((link == "") | link.startswith("#"), F.lit(None))
            .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(site, _without_dots(own), rest))
            .when(link.startswith("?"), F.concat(site, path, link))
            .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), rest)))


#: What is no markup of the page, and the tags that can name another address.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea|title)\b.*?(?:</\1\s*>|\z)"
TAG = r"(?is)<(?:link|meta|base)(?=[\s/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: Character references that addresses are written with.
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"),
              ("&#38;", "&"), ("&#x26;", "&"), ("&#038;", "&"), ("&amp;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, with references resolved; '' without one."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for written_as, meant in REFERENCES:
        value = F.replace(value, F.lit(written_as), F.lit(meant))
    return F.trim(F.regexp_replace(value, r"[\t\r\n]", ""))


def page_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target) addresses from all canonical links and meta refreshes of a page.

    ``rel`` is a list of words; relative addresses are resolved against the
    page or its ``<base>``; comments, scripts and other raw text are no markup.
    """
    text, at = F.coalesce(F.col(html).cast("string"), F.lit("")), F.col(url).cast("string")
    # the cheap test keeps pages without such an element away from the patterns
    may = F.lower(text).rlike(r"canonical|http-equiv")
    tags = pages.where(may & at.contains("://")).select(
        at.alias("source"), F.regexp_extract_all(F.regexp_replace(text, HIDDEN, " "), F.lit(TAG), F.lit(0)).alias("tags"))
    of = lambda name: F.filter("tags", lambda t: F.lower(F.substring(t, 2, len(name))) == name)
    base = F.get(F.filter(F.transform(of("base"), lambda t: _attribute(t, "href")), lambda h: h != ""), F.lit(0))
    words = lambda t: F.split(F.lower(_attribute(t, "rel")), r"\s+")
    canonical = F.transform(F.filter(of("link"), lambda t: F.array_contains(words(t), F.lit("canonical"))), lambda t: _attribute(t, "href"))
    refresh = F.transform(
        F.filter(of("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"),
        lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)))
    found = tags.select("source", F.coalesce(_target(base, F.col("source")), "source").alias("base"),
                        F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("link"))
    return found.select("source", _target(F.col("link"), F.col("base")).alias("target")).where("target is not null")


def judge_pages(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None,
                id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    The longest fitting rule decides. Pages without one take the decision of
    their aliases: the pages reached over redirects (``redirects``: source and
    target addresses, if given), all canonical links and meta refreshes of a
    page (see ``page_links``), in any direction and over any number of hops. An address is compared without
    scheme, fragment and utm_ parameters, so such variants are aliases as well.
    Among aliases an explicit allow outweighs every block; without any decision
    the page is allowed. Addresses that no page has still count as aliases and
    are judged by the rules. Null addresses and such without ``://`` have no
    host, path, rule or alias and are allowed. Repeated rows are judged alike;
    other columns are ignored.
    """
    judged = with_host_and_path(pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("_in")), "_in")
    judged = judged.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
        ruled(F.col("_host"), F.col("_path"), rules, 1).alias("rule"),
        ruled(F.col("_host"), F.col("_path"), rules, 0).alias("own"),
        F.when(F.col("_host") != "", _node(F.col("_url"), F.col("_host"))).alias("node"))
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(
            F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")))
    ends = []
    for end in ("source", "target"):
        links = with_host_and_path(links, end)
        links = links.withColumn(f"{end}_host", F.col("_host")).withColumn(f"{end}_path", F.col("_path")).withColumn(
            f"{end}_node", F.when(F.col("_host") != "", _node(F.col("_url"), F.col("_host")))
        ).drop("_url", "_rest", "_host", "_path")
    links = written(links.select("source_node", "target_node", "source_host", "source_path",
                                 "target_host", "target_path").distinct(), "links")
    for end in ("source", "target"):
        host, path = F.col(f"{end}_host"), F.col(f"{end}_path")
        ends.append(links.select(F.col(f"{end}_node").alias("node"), ruled(host, path, rules, 0).alias("own")))
    joined = components(links.where("source_node is not null and target_node is not null"),
                        "source_node", "target_node")
    roots = joined.select(F.col("component").alias("node"), "component").distinct()
    members = joined.unionByName(roots).distinct()
    decided = (
        ends[0].unionByName(ends[1]).where("own is not null").distinct().join(members, "node")
        .groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed")))
    carried = members.join(decided, "component").select(
        "node", F.when(F.col("allowed"), "allow").otherwise("block").alias("carried"))
    return judged.join(carried, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", "carried", F.lit("allow")).alias("verdict"))
