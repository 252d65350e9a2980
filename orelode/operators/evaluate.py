"""Prediction errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Joined on the key; truth without a prediction drops out."""
    return truth.select("user_id", "item_id", "rating").join(predicted, ["user_id", "item_id"]).select((F.col("rating") - F.col("prediction")).alias("e"))


def rmse(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(n, rmse)."""
    return _errors(truth, predicted).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def error_histogram(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(bucket, n): absolute errors by whole units, four and more together; all five buckets are listed."""
    counts = _errors(truth, predicted).groupBy(F.least(F.floor(F.round(F.abs("e"), 9)), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    every = truth.sparkSession.range(5).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def report(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row with the count, the root mean squared error and the five buckets, from one pass over the predictions."""
    e = F.round(F.abs("e"), 9)
    buckets = [F.count_if((e >= k) & (e < k + 1) if k < 4 else e >= 4).alias(f"from_{k}") for k in range(5)]
    return _errors(truth, predicted).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), *buckets)
