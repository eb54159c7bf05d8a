"""Stories: landed records, extraction, ranking, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import first_of, spread, with_index
from ..schemas import RANKED_IDS, RAW_ITEM, require

LIMIT_LEAST, LIMIT_MOST, LIMIT_STEP, LIMIT_DEFAULT = 10, 100, 5, 30


def story_limit(limit: int = LIMIT_DEFAULT) -> int:
    """A valid number of stories: 10 to 100 in steps of 5."""
    if not LIMIT_LEAST <= limit <= LIMIT_MOST or limit % LIMIT_STEP:
        raise ValueError(f"limit must be {LIMIT_LEAST} to {LIMIT_MOST} in steps of {LIMIT_STEP}, not {limit}")
    return limit


def read_ranked_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, id)`` from a landed JSON list of ids; an empty folder gives no rows."""
    return spark.read.schema(RANKED_IDS).json(path).select(F.posexplode("ids").alias("rank", "id"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, id)`` from landed JSON rows, as ``land`` writes them."""
    return spark.read.schema("rank INT, id LONG").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Landed item records, one JSON object a line. Broken lines, bare nulls and items without an id are left out."""
    raw = spark.read.schema(f"{RAW_ITEM}, _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)
    return raw.where("_corrupt_record is null and id is not null").drop("_corrupt_record")


def first_ranked(ranked: DataFrame, limit: int) -> DataFrame:
    """The first ids by rank, taken before their details are read."""
    return ranked.where(F.col("rank") < limit)


def attach_details(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """Items of the ranked ids; ids without an item are skipped."""
    return ranked.join(items, "id", "inner")


def extract(items: DataFrame, keep_null_titles: bool = False) -> DataFrame:
    """Item records as stories, with defaults for absent fields.

    In an explicit schema an absent title and a null title are both null;
    both are dropped unless ``keep_null_titles`` is set.
    """
    kept = items if keep_null_titles else items.where("title is not null")
    return kept.select(
        "id",
        "title",
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce(F.col("descendants").cast("long"), F.lit(0)).alias("descendants"),
        F.timestamp_seconds(F.coalesce("time", F.lit(0))).alias("time"),
        F.coalesce("url", F.lit("")).alias("url"),
    )


def by_score(stories: DataFrame) -> DataFrame:
    """Best score first; ties by id."""
    return require(stories, "score", "id").orderBy(F.desc("score"), "id")


def stories_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories made from the tables at hand: the whole texts of all documents as
    titles, values of events as scores, addresses of pages. A document
    without an event has score 0, no comments and no time. Of events or pages
    of one id, the first by time or address counts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    e = first_of(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value", "props"), "event_id", "ts")
    p = first_of(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "page_id", "url")
    return (
        d.join(e, d.doc_id == e.event_id, "left")
        .join(p, d.doc_id == p.page_id, "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("title"),
            F.coalesce(F.floor("value").cast("int"), F.lit(0)).alias("score"),
            F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("descendants"),
            F.col("ts").alias("time"),
            F.coalesce("url", F.lit("")).alias("url"),
        )
    )


def whole_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a story ``(id, title)`` with its whole text, whether it has an event or not."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("title")))


def land(stories: DataFrame, folder: str) -> tuple[str, str]:
    """Write stories as landed JSON: all ranked ids, a row each, and the item records."""
    with_index(stories.select("id", "score"), F.desc("score"), F.col("id"), name="rank").select("rank", "id").write.json(f"{folder}/ranked")
    items = stories.select("id", "title", "score", "descendants", F.unix_timestamp(F.col("time").cast("timestamp")).alias("time"), "url", F.lit("story").alias("type"))
    items.write.json(f"{folder}/items")
    return f"{folder}/ranked", f"{folder}/items"


def export_csv(stories: DataFrame, path: str) -> None:
    stories.write.option("header", True).csv(path)


def export_json(stories: DataFrame, path: str) -> None:
    """JSON Lines with ISO dates."""
    stories.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
