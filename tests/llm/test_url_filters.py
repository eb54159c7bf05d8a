"""URL verdicts and alias groups against brute force."""

import random
import re

import duckdb
import pyarrow as pa

from tidewire.llm import queries, url_filters
from tidewire.llm.common import connected_components

from ..oracle import assert_same

PAGES = "page_id long, url string, html string, rule string, component string"


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(lower), m[2]) if m else ("", "")


def rule_of(url, rules):
    host, path = parts(url)
    fits = [(-len(r), r, d) for d, r in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return min(fits)[1:] if fits else (None, None)


def pages(seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        host = r.choice(["", "www.", "m.", "a.b."]) + r.choice(["x.example.com", "EXAMPLE.net", "example.org", "notexample.net", "example.com"])
        url = f"{r.choice(['http', 'https'])}://{host}{r.choice(['', '/', '/de/', '/en/', '/fr/'])}{r.choice(['', str(r.randint(1, 9)), '5.html', '7/'])}{r.choice(['', '?ref=x', '?a=1&utm_source=f', '#top'])}"
        html = r.choice(["", None, "<p>", f'<link rel="canonical" href="https://example.{r.choice(["net", "org", "com"])}/{r.choice(["de", "en", "fr"])}/{r.randint(1, 30)}">', '<meta http-equiv=refresh content="0; url=http://blocked.net/a">'])
        rows.append((i, r.choice([url] * 9 + [None, "no scheme", "", "x://"]), html, "r", "c"))
    return rows


def test_verdicts_equal_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES)
    edges = [tuple(r) for r in url_filters.page_edges(df).collect()]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    kinds = {}
    for node in parent:
        kinds.setdefault(root(node), set()).add(rule_of(node, url_filters.RULES)[1])
    for r in url_filters.filter_urls(df).collect():
        url = rows[r.page_id][1]
        rule, decision = rule_of(url, url_filters.RULES)
        group = kinds[root(url)] if url in parent else set()
        verdict = decision or ("allow" if "allow" in group or "block" not in group else "block")
        assert (r.host, r.path, r.rule, r.verdict) == (*parts(url), rule, verdict)
        assert r.alias_group == (root(url) if url in parent else None)


def test_many_rules_by_join(spark):
    rules = [*url_filters.RULES, *[("block", f"h{i}.test/p{i}") for i in range(100)]]
    urls = spark.createDataFrame([(u,) for u in {r[1] for r in pages(2)} | {"http://h7.test/p7x", "http://a.h7.test/p7", "http://h7.test/x"}], "url string")
    found = {r.url: (r.rule, r.decision) for r in url_filters.match_rules(urls, rules).collect() if r.url is not None}
    assert found == {u: rule_of(u, rules) for u in found} and found["http://a.h7.test/p7"] == ("h7.test/p7", "block")


def test_allow_goes_before_block(spark):
    df = spark.createDataFrame([(1, "http://a.test/1", None, "", ""), (2, "http://b.test/2", None, "", "")], PAGES)
    edge = lambda *e: spark.createDataFrame(list(e), "src string, dst string")
    verdict = lambda e: {r.page_id: r.verdict for r in url_filters.filter_urls(df, edges=e).collect()}
    assert verdict(edge(("http://a.test/1", "http://bad.net/x"))) == {1: "block", 2: "allow"}
    assert verdict(edge(("http://a.test/1", "http://bad.net/x"), ("http://bad.net/x", "http://example.net/en/y"))) == {1: "allow", 2: "allow"}
    assert verdict(edge(("http://a.test/1", "http://bad.net/x"), (None, "http://b.test/2"), ("http://b.test/2", "http://b.test/2"))) == {1: "block", 2: "allow"}


TARGETS = [
    ("http://h/a/b/c.html?q#f", "https://x/y", "https://x/y"),
    ("http://h/a/b/c.html?q#f", "//bad.net/y", "http://bad.net/y"),
    ("https://h/a/b/c.html?q#f", "/en/x", "https://h/en/x"),
    ("http://h/a/b/c.html?q#f", "d.html", "http://h/a/b/d.html"),
    ("http://h/a/b/c.html?q#f", "?p=1&amp;q=2", "http://h/a/b/c.html?p=1&q=2"),
    ("http://h/a/b/c.html?q#f", "#top", "http://h/a/b/c.html?q#top"),
    ("http://h/a/b/c.html?q#f", "../d/./e/..", "http://h/a/d/"),
    ("http://h/a/b/c.html?q#f", "../../../../z?x=../y", "http://h/z?x=../y"),
    ("http://h/a/b/c.html?q#f", "/a/.", "http://h/a/"),
    ("http://h/a/b/c.html?q#f", "javascript:x", "http://h/a/b/javascript:x"),
    ("http://h", "x", "http://h/x"),
    ("http://h?a", "x/..", "http://h/"),
    ("http://h/a..b/..c", "..d/e", "http://h/a..b/..d/e"),
]


def test_targets_as_a_browser_reads_them(spark):
    rows = [(i, u, f'<a href=z><LINK data-x=1 rel="canonical" href="{t}"/>', "r", "c") for i, (u, t, _) in enumerate(TARGETS)]
    found = {r.src: set() for r in spark.createDataFrame(rows, PAGES).selectExpr("url as src").collect()}
    for r in url_filters.page_edges(spark.createDataFrame(rows, PAGES), spellings=False).collect():
        found[r.src].add(r.dst)
    want = {u: {w for v, _, w in TARGETS if v == u and w != u} for u, _, _ in TARGETS}
    assert found == want
    from urllib.parse import urljoin

    assert [urljoin(u, t.replace("&amp;", "&")) for u, t, _ in TARGETS if t != "javascript:x"] == [w for _, t, w in TARGETS if t != "javascript:x"]


def test_sql_has_the_same_rows(spark, tmp_path):
    """Relative, escaped and several links, hot and repeated URLs, null pages and clashing columns."""
    rows = pages(3) + [(1000 + i, u, f"<link href='{t}' rel=canonical><meta http-equiv=\"Refresh\" content='0;url=/fr/{i}?a&amp;b'><link rel=canonical href=k{i}>", "r", "c") for i, (u, t, _) in enumerate(TARGETS)]
    rows += [(2000 + i, "http://hot.example.com/de/", None, "r", "c") for i in range(300)] + [(3000, None, None, None, None), (3000, None, None, None, None)]
    rows += [(3001, "http://page.test/1", '<link rel="canonical" href="//bad.net/y">', "r", "c")]
    df = spark.createDataFrame(rows, PAGES + "").repartition(3)
    con = duckdb.connect()
    con.register("pages", pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r[:3], strict=True)) for r in rows], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])))
    found = url_filters.filter_urls(df)
    assert_same(found, con, queries.oracle_sql()["op6_url_filters"])
    said = {r.page_id: r.verdict for r in found.collect()}
    assert said[3001] == "block" and said[3000] == "allow"


def test_spellings_are_an_option(spark):
    df = spark.createDataFrame([(1, "http://www.bad.net/x", None, "r", "c"), (2, "https://bad.net/x", None, "r", "c")], PAGES)
    assert url_filters.page_edges(df, spellings=False).count() == 0 and url_filters.page_edges(df).count() == 1


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], PAGES)
    assert url_filters.filter_urls(df).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(parent) and dict(rows) == {n: root(n) for n in parent}
