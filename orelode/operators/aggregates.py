"""Keyed aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import word_tokens


def word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """(word, n) of lower-cased tokens, by word."""
    words = lines.select(F.explode(word_tokens(F.lower(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy("word")


def mean_by(df: DataFrame, key: str, value: str, out: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(out))


def mean_by_tag(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, rating_avg), by tag descending: every rating counts once for each time its item has the tag.

    Ratings are summed by item before the join, so the join's many side is the tags.
    """
    by_item = ratings.groupBy("item_id").agg(F.sum("rating").alias("s"), F.count("rating").alias("c"))
    joined = tags.join(by_item, "item_id").groupBy("tag").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return joined.select("tag", (F.col("s") / F.col("c")).alias("rating_avg")).orderBy(F.col("tag").desc())


def item_sets(df: DataFrame, key: str, item: str, out: str = "items") -> DataFrame:
    """(key, items) with the distinct items in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias(out))


def subtract_bag(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without any match in right; repeated rows of left stay repeated."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def keep_members(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_semi")


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs (low, high)."""
    return df.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low < high").distinct()
