"""URL filters: rules by host and path, carried over to aliases of a page.

Pages reach one another by redirects and canonical links: all of a page's
``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` targets and, as an
option, the edge from each URL to the spelling that sites usually redirect
to. Known redirects can be given as a table. The edges form a graph whose
connected components are sets of aliases. A page that no rule fits takes
the decision of its aliases: an explicit allow first, then a block, and
allow where none of them has a rule.

Targets are read as a browser would: the entities ``&amp; &lt; &gt; &quot;
&#39; &apos;`` are decoded, ``//host/path`` takes the page's scheme,
``/path`` its host, ``?query`` its path, ``#fragment`` is the page itself and any
other reference lies in the folder of the page; ``.`` and ``..`` are resolved.

DataFrame functions only; no Python runs on the executors. Every distinct
URL is judged once. Pages then look up their URL in parts of the URL's
pages, so a hot URL is in no single task.

Defined cases: a null URL, or one without ``://``, has an empty host and
path, fits no rule, has no alias and is allowed. Equal URLs on several
pages share a node. An empty table gives an empty result. Only the id, URL
and HTML columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

#: Rules of the registered query: (decision, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Up to so many rules are tested as one expression; more are joined on host suffixes.
INLINE_RULES = 64
#: Up to so many rules (under 10 MB) are broadcast in that join; more are shuffled.
BROADCAST_RULES = 50_000
#: Parts in which the pages of one URL look up its verdict.
PARTS = 16


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The spelling that a site usually redirects to: scheme, ``www.`` and
    ``m.``, final slash, ``.html``, tracking parameters and fragment."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"(\.html|/)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref)="))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), host, path, tail))


# Entities in attributes, the last one last.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: What follows a target's attribute, and where targets are, each as the first group.
_QUOTE = "[\"']?"
TARGETS = (
    rf"(?is)<link\b[^>]*?\brel\s*=\s*{_QUOTE}canonical{_QUOTE}[^>]*?\bhref\s*=\s*{_QUOTE}([^\"'\s>]+)",
    rf"(?is)<link\b[^>]*?\bhref\s*=\s*{_QUOTE}([^\"'\s>]+){_QUOTE}[^>]*?\brel\s*=\s*{_QUOTE}canonical\b",
    rf"(?is)<meta\b[^>]*?http-equiv\s*=\s*{_QUOTE}refresh{_QUOTE}[^>]*?url\s*=\s*{_QUOTE}([^\"'\s>]+)",
)


def decoded(value: Column) -> Column:
    """An attribute's value without entities."""
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def resolved(target: Column, url: Column) -> Column:
    """``target`` as a whole URL, as it is meant on the page ``url``."""
    scheme, site = F.substring_index(url, "://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = url_path(url)
    folder = F.coalesce(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit(""))
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^([^#]*)", 1), target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )
    return without_dots(whole)


def without_dots(url: Column) -> Column:
    """``url`` with the segments ``.`` and ``..`` of its path resolved."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    segments = F.split(url_path(url), "/")
    last = F.element_at(segments, -1)
    step = lambda done, s: F.when(s == "..", F.regexp_replace(done, "/[^/]*$", "")).when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s))
    path = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.lit(""), step)
    path = F.concat(path, F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(url_path(url).rlike(r"/\.\.?(/|$)"), F.concat(site, path, rest)).otherwise(url)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", spellings: bool = True) -> DataFrame:
    """Edges ``(src, dst)`` of aliases: all canonical links and refreshes, and with
    ``spellings`` the usual spelling of each URL and target."""
    url, html = F.col(url_col), F.col(html_col)
    found = F.concat(*[F.coalesce(F.regexp_extract_all(html, F.lit(p), 1), F.array()) for p in TARGETS])
    named = F.transform(found, lambda t: resolved(decoded(t), url))
    if spellings:
        named = F.transform(F.concat(F.array(url), named), canonical_url)
    return (
        pages.where(url.contains("://"))
        .select(url.alias("src"), F.explode(F.array_compact(named)).alias("dst"))
        .where("src <> dst")
        .distinct()
    )


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    inside = (host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))
    return inside & path.startswith(rule_path)


def match_rules(urls: DataFrame, rules) -> DataFrame:
    """``urls(url)`` with the longest rule that fits: ``(url, rule, decision)``.

    ``rules``: pairs (decision, host and path), or a DataFrame
    ``(decision, rule)`` for lists of any length. A rule fits its host and
    all subdomains if the URL's path starts with the rule's; of equally long
    rules the smallest by (rule, decision) wins.
    """
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) <= INLINE_RULES:
            host, path = url_host(F.col("url")), url_path(F.col("url"))
            tests = []
            for decision, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
                at = rule.index("/")
                fit = _fits(host, path, F.lit(rule[:at]), F.lit(rule[at:]))
                tests.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(decision).alias("decision"))))
            none = F.lit(None).cast("struct<rule:string,decision:string>")
            return urls.withColumn("_m", F.coalesce(*tests, none)).select("url", "_m.rule", "_m.decision")
        rules = spark.createDataFrame(rules, "decision string, rule string")
    rules = rules.select("decision", "rule", F.substring_index("rule", "/", 1).alias("suffix"))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels = F.split(url_host(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        urls.select("url", F.explode(suffixes).alias("suffix"))
        .join(rules, "suffix")
        .where(url_path(F.col("url")).startswith(F.expr("substring(rule, length(suffix) + 1)")))
        .groupBy("url")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "decision")).alias("m"))
        .select("url", "m.rule", "m.decision")
    )
    return urls.join(found, "url", "left")


def filter_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", spellings: bool = True) -> DataFrame:
    """Verdict of every page: ``(id, host, path, rule, verdict, alias_group)``.

    ``edges(src, dst)`` adds known redirects to the edges read from the
    pages. ``alias_group`` is the smallest URL among the aliases, null for
    a page without any.
    """
    found = page_edges(pages, url_col, html_col, spellings)
    if edges is not None:
        found = found.union(edges.select("src", "dst")).distinct()
    groups = written(connected_components(found, "url-aliases"), "url-groups")
    judged = match_rules(groups.select(F.col("node").alias("url")), rules)
    decided = (
        groups.join(judged.withColumnRenamed("url", "node"), "node")
        .groupBy("component")
        .agg(F.max(F.col("decision") == "allow").alias("any_allow"), F.max(F.col("decision") == "block").alias("any_block"))
    )
    inherited = groups.join(decided, "component").select(
        F.col("node").alias("url"),
        F.col("component").alias("alias_group"),
        F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block").otherwise("allow").alias("inherited"),
    )
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.pmod(F.xxhash64(id_col), F.lit(PARTS)).alias("part"))
    # Distinct by part first: that is also all that looks a URL up.
    asked = own.where("url is not null").select("url", "part").distinct()
    ruled = match_rules(asked.select("url").distinct(), rules).join(inherited, "url", "left")
    told = asked.join(ruled, "url")
    named = own.where("url is not null").join(told, ["url", "part"], "left")
    nameless = own.where("url is null").select("page_id", "url", *[F.lit(None).cast("string").alias(c) for c in ("rule", "decision", "inherited", "alias_group")])
    return named.select("page_id", "url", "rule", "decision", "inherited", "alias_group").union(nameless).select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("decision", "inherited", F.lit("allow")).alias("verdict"),
        "alias_group",
    )
