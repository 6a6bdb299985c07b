"""Links of pages, and decisions carried over them, against plain Python."""

from __future__ import annotations

import random
from urllib.parse import urljoin

import pytest

from newsgraph.llm.queries import URL_RULES
from newsgraph.llm.url_aliases import judge_pages, page_links

SCHEMA = "page_id long, url string, html string"
AT = "http://x.org/a/b/c.html?q=1"


def found(spark, html, url=AT):
    return sorted(r.target for r in page_links(spark.createDataFrame([(1, url, html)], SCHEMA), "url", "html").collect())


LINKS = ["../a/p", "p", "./p", "../../../p", "/p/../q", "//y.org/z", "?r=2", "http://z.net/fr/1", "a/./b/../c?x=../y", "..", ".", "/"]


@pytest.mark.parametrize("link", LINKS)
def test_relative_links(spark, link):
    assert found(spark, f'<link rel="canonical" href="{link}">') == [urljoin(AT, link)]


def test_markup(spark):
    assert found(spark, "<LINK href='http://z.net/?a=1&amp;b=2' data-x='>' REL='alternate  Canonical'>") == ["http://z.net/?a=1&b=2"]
    assert found(spark, '<base href="/r/"><link rel=canonical href=s><link rel="canonical" href="http://t.net/">') == ["http://t.net/", "http://x.org/r/s"]
    assert found(spark, '<meta content="0; URL=\'/t\'" http-equiv="Refresh"/><meta http-equiv=refresh content="5;url=u">') == ["http://x.org/a/b/u", "http://x.org/t"]
    hidden = ['<!-- <link rel="canonical" href="/no"> -->', "<script>'<link rel=\"canonical\" href=\"/no\">'</script>",
              '<link rel="notcanonical" href="/no">', '<link rel="canonical" href="mailto:a@b">', '<link rel="canonical" href="#top">',
              '<link rel="canonical">', '<meta http-equiv="refresh" content="30">', '<title><link rel=canonical href=/no></title>',
              '<linkage rel="canonical" href="/no">', '<!-- <link rel="canonical" href="/no">']
    assert found(spark, "".join(hidden)) == []
    assert found(spark, "", None) == found(spark, None) == found(spark, '<link rel="canonical" href="/x">', "nothing") == []
    assert found(spark, "<link " + "x='y' " * 50_000 + 'rel="canonical" href="/far">') == ["http://x.org/far"]


def decisions(pages, redirects=()):
    """Union-find over addresses; hosts and paths by hand."""
    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        return rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]

    def own(url):
        host, path = split(url)
        fits = [(len(h + p), v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    node = lambda u: u.split("://", 1)[1].split("#")[0] if u and "://" in u else None
    address = {}
    for u, targets in [*((u, t) for _, u, t in pages), *((a, [b]) for a, b in redirects)]:
        for t in targets:
            if node(u) and node(t):
                address[node(u)], address[node(t)] = u, t
                root[find(node(u))] = find(node(t))
    votes = {}
    for n, u in address.items():
        if own(u):
            votes.setdefault(find(n), set()).add(own(u))
    for i, u, _ in pages:
        vote = votes.get(find(node(u)), set()) if node(u) else set()
        yield i, own(u) or ("allow" if "allow" in vote or not vote else "block")


@pytest.mark.parametrize("seed", [1, 2])
def test_carried_decisions(spark, seed):
    """Chains, cycles, a hub, blocks against allows, targets that no page has."""
    r = random.Random(seed)
    plain = [f"http://s{i}.org/p" for i in range(60)]
    block, allow = "http://k.net/fr/1", "http://ok.com/x"
    pages = [(i, u, []) for i, u in enumerate(plain)]
    link = lambda i, *to: pages.__setitem__(i, (i, plain[i], pages[i][2] + list(to)))
    for i in range(9):  # a chain of ten into a blocked address
        link(i, plain[i + 1])
    link(9, block)
    for i in range(10, 20):  # a cycle with a block and an allow
        link(i, plain[10 + (i - 9) % 10])
    link(13, block.replace("/fr/", "/es/"))
    link(17, allow)
    for i in range(21, 40):  # a hub
        link(i, plain[20])
    link(25, "https://m.net/es/hub")
    for _ in range(10):
        link(r.randrange(40, 58), plain[r.randrange(40, 58)])
    link(41, "http://www.example.com/en/1", "http://example.com/en/2")
    pages += [(100, block, []), (101, allow, []), (102, None, []), (103, "no address", []), (100, block, [])]
    redirects = [(plain[59], "http://z.net/es/q"), (plain[58], plain[59])]
    rows = [(i, u, "".join(f'<link rel="canonical" href="{t}">' for t in targets)) for i, u, targets in pages]
    got = judge_pages(spark.createDataFrame(rows, SCHEMA), URL_RULES, spark.createDataFrame(redirects, "source string, target string"))
    assert sorted((x.page_id, x.verdict) for x in got.collect()) == sorted(decisions(pages, redirects))
    verdict = {x.page_id: x.verdict for x in got.collect()}
    assert {verdict[i] for i in range(10)} == {"block"} and {verdict[i] for i in range(10, 20)} == {"allow"}
    assert {verdict[i] for i in range(20, 40)} == {"block"} and verdict[59] == verdict[58] == "block"
