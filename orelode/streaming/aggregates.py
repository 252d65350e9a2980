"""Keyed aggregations over streams: the same plans as in batch, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import word_tokens


def running_word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """(word, n) of all lines so far; for complete or update mode."""
    return lines.select(F.explode(word_tokens(F.lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def running_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, n) of all rows so far."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def windowed_mean(rows: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, mean, n) by tumbling windows; rows later than ``late`` are dropped, so state stays bounded."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, size), key)
    return grouped.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("window.start").alias("start"), key, "mean", "n")
