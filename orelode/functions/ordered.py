"""Global ranks and running sums without a single-task window.

Rows are dealt in ranges of the order and numbered inside each range; the ranges'
totals, a row for each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.operators.components import ensure_checkpoint_dir


def running_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its values over all rows up to each row in the order, which must be total."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = {f"__v{k}": v for k, v in enumerate(values.values())}
    dealt = df.withColumns(inner).repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("__p").agg(*[F.sum(v).alias(v) for v in inner])
    offsets = totals.select("__p", *[(F.sum(v).over(Window.orderBy("__p")) - F.col(v)).alias(f"__o{v}") for v in inner])
    inside = Window.partitionBy("__p").orderBy(*order)
    summed = dealt.withColumns({out: F.sum(v).over(inside) for out, v in zip(values, inner)}).join(F.broadcast(offsets), "__p")
    return summed.withColumns({out: F.col(out) + F.col(f"__o{v}") for out, v in zip(values, inner)}).drop("__p", *inner, *[f"__o{v}" for v in inner])


def running(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with the sum of ``value`` over all rows up to each row in the order, which must be total."""
    return running_sums(df, order, {out: value})


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """df with each row's place in the order, from 1."""
    return running(df, order, F.lit(1).cast("bigint"), out)
