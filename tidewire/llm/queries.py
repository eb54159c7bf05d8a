"""The registered queries of this subpackage, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, language_id, license_scan, minhash, secret_scan, sharding, syncmers, token_shards, url_filters, warc, whitening
from .common import new_folder, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).drop("row_key")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.roundtrip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Arrivals that the documents are appended in.
ARRIVALS = 4


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended in several arrivals and compacted, as read from the
    committed shards, with what the manifest says of each shard."""
    store = sharding.ShardStore(spark, new_folder(spark, "shards"), target_bytes=64 << 20, rows_per_shard=20_000)
    docs = table(spark, sf_dir, "documents")
    for i in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == i))
    version = store.compact_fully()
    said = store.manifest(version).select(F.col("path").alias(sharding.SHARD), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.col("level").alias("shard_level"))
    rows = store.read(version, with_shard=True)
    return rows.join(said, sharding.SHARD).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"),
        F.substring_index(sharding.SHARD, "/", -1).alias("shard"),
        "shard_rows",
        "shard_bytes",
        "shard_level",
        F.lit(version).cast("long").alias("version"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    return language_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shard_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_roundtrip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_bpe, op3_minhash, op4_decontamination, op5_sharding, op6_url_filters, op7_language_id, op8_syncmers, op9_token_shards, op10_warc, op11_alignment, op12_whitening, op13_license_scan)}


SQL_OP10 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


SQL_OP3 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node
), comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _sql_op6() -> str:
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

    def canonical(u: str) -> str:
        kept = f"list_sort(list_filter(string_split(regexp_extract({u}, '(?s)^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)=')))"
        tail = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
        return f"CASE WHEN contains({u}, '://') THEN 'https://' || regexp_replace({host(u)}, '^(www|m)[.]', '') || regexp_replace({path(u)}, '([.]html|/)$', '') || {tail} END"

    links = [p.replace("'", "''") for p in url_filters.TARGETS]
    path_of = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    site = lambda u: f"regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1)"
    clean = "t"
    for entity, char in url_filters.ENTITIES:
        clean = f"replace({clean}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    folder = f"regexp_extract({path_of('src')}, '(?s)^(.*/)', 1)"
    whole = f"""CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN t WHEN starts_with(t, '//') THEN split_part(src, '://', 1) || ':' || t
      WHEN starts_with(t, '/') THEN {site('src')} || t WHEN starts_with(t, '?') THEN {site('src')} || {path_of('src')} || t
      WHEN starts_with(t, '#') THEN regexp_extract(src, '(?s)^([^#]*)', 1) || t ELSE {site('src')} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || t END"""
    segments = f"string_split({path_of('w')}, '/')"
    dots = f"""CASE WHEN regexp_matches({path_of('w')}, '/[.][.]?(/|$)') THEN {site('w')}
      || list_reduce({segments}[2:], lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN s = '.' THEN a ELSE a || '/' || s END, '')
      || CASE WHEN {segments}[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract(w, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) ELSE w END"""
    raw = " UNION ALL ".join(f"SELECT url AS src, unnest(regexp_extract_all(html, '{p}', 1)) AS t FROM pages WHERE contains(url, '://')" for p in links)
    targets = f"""SELECT url AS src, url AS target FROM pages UNION ALL
      SELECT src, {dots} FROM (SELECT src, {whole} AS w FROM (SELECT src, {clean} AS t FROM ({raw})))"""
    tests = sorted(url_filters.RULES, key=lambda r: (-len(r[1]), r[1], r[0]))

    def fit(u: str, n: int) -> str:
        out = []
        for rule in tests:
            at = rule[1].index("/")
            h = rule[1][:at]
            out.append(f"WHEN ({host(u)} = '{h}' OR ends_with({host(u)}, '.{h}')) AND starts_with({path(u)}, '{rule[1][at:]}') THEN '{rule[n]}'")
        return f"CASE {' '.join(out)} END"

    return f"""
WITH RECURSIVE edge AS (SELECT DISTINCT src, dst FROM (SELECT src, {canonical('target')} AS dst FROM ({targets}) WHERE contains(src, '://')) WHERE src <> dst
), both_ways AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge
), reach AS (SELECT a AS node, a AS low FROM both_ways UNION SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node
), comp AS (SELECT node, min(low) AS alias_group FROM reach GROUP BY node
), kind AS (SELECT alias_group, bool_or(coalesce(d = 'allow', false)) AS any_allow, bool_or(coalesce(d = 'block', false)) AS any_block FROM (SELECT alias_group, {fit('node', 0)} AS d FROM comp) GROUP BY alias_group)
SELECT page_id, {host('url')} AS host, {path('url')} AS path, {fit('url', 1)} AS rule,
       coalesce({fit('url', 0)}, CASE WHEN any_allow THEN 'allow' WHEN any_block THEN 'block' END, 'allow') AS verdict, alias_group
FROM pages LEFT JOIN comp ON comp.node = url LEFT JOIN kind USING (alias_group)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash": SQL_OP3, "op6_url_filters": _sql_op6(), "op10_warc": SQL_OP10, "op13_license_scan": license_scan.sql()}
