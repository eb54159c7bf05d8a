"""Words of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = r"[^\p{L}0-9]+"


def terms(text: Column) -> Column:
    """Lower-cased words of a text, a row each; with empty ones at its ends."""
    return F.explode(F.split(F.lower(text), TERM))


def tokens(texts: DataFrame, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """``(id, token)``: a row for each word of each text."""
    return texts.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("token")).where("token <> ''")
