"""Schemas of the story tables, fixed and explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame

RAW_ITEM = "id LONG, title STRING, score INT, descendants INT, time LONG, url STRING, by STRING, type STRING"
RANKED_IDS = "ids ARRAY<LONG>"
STORY = "id LONG, title STRING, score INT, descendants LONG, time TIMESTAMP, url STRING"
LEXICON = "token STRING, valence DOUBLE"
QUERY = "query_id LONG, query STRING, embedding ARRAY<FLOAT>"
MANIFEST = "timestamp DOUBLE, `limit` INT, analysis_type STRING, stories_count LONG, columns ARRAY<STRING>, cache_key STRING, version LONG, path STRING"
HISTORY = "id LONG, title STRING, score INT, sentiment_score DOUBLE, topic_keyword STRING, timestamp TIMESTAMP"

#: Labels of topics that are none.
OUTLIER_TOPIC, NO_TOPIC, TOO_FEW = "Outlier/No Topic", "No Data", "Insufficient Data"
OUTLIER_ID = -1


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def present(df: DataFrame, *wanted: str) -> list[str]:
    """Those of the wanted columns that ``df`` has; all of its own if it has none."""
    return [c for c in wanted if c in df.columns] or df.columns
