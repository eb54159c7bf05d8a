"""Column functions: labels, display forms, ids and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE, NEUTRAL, NEGATIVE = "Positive", "Neutral", "Negative"
BOUND, STRONG = 0.05, 0.5


def sentiment_label(score: Column) -> Column:
    """Three bands with strict bounds: exactly 0.05 and -0.05 are neutral."""
    return F.when(score > BOUND, POSITIVE).when(score < -BOUND, NEGATIVE).otherwise(NEUTRAL)


def sentiment_band(score: Column) -> Column:
    """Five bands; here -0.05 itself is negative."""
    return (
        F.when(score > STRONG, "Very Positive")
        .when(score > BOUND, POSITIVE)
        .when(score > -BOUND, NEUTRAL)
        .when(score > -STRONG, NEGATIVE)
        .otherwise("Very Negative")
    )


def document_id(index: Column, title: Column) -> Column:
    """``story_{index}_{first ten hex digits of the title's md5}``."""
    return F.concat_ws("_", F.lit("story"), index.cast("string"), F.substring(F.md5(F.encode(title, "utf-8")), 1, 10))


def minute_format(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def iso_format(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def clock_format(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss")


def link(title: Column, url: Column) -> Column:
    """``[title](url)``, or the title where the url is null or empty."""
    return F.when(url != "", F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")"))).otherwise(title)


def shortened(title: Column, limit: int = 80) -> Column:
    return F.when(F.length(title) > limit, F.concat(F.substring(title, 1, limit), F.lit("..."))).otherwise(title)


def topic_display(keyword: Column) -> Column:
    """Underscores as spaces, words capitalised at white space."""
    return F.initcap(F.replace(keyword, F.lit("_"), F.lit(" ")))


def similarity(distance: Column) -> Column:
    return F.bround(1 - distance, 3)


def explanation(score: Column) -> Column:
    """``Similarity: 81.2%``, rounded half to even as the number is."""
    return F.format_string("Similarity: %.1f%%", F.bround(score * 100, 1))


def snapshot_key(limit: Column, analysis_type: Column) -> Column:
    return F.md5(F.encode(F.concat_ws("_", limit.cast("string"), analysis_type), "utf-8"))
