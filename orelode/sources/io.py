"""Readers and writers of text and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.text import last_field, naive_fields

RATINGS = "user_id bigint, item_id bigint, rating double, ts bigint"
TAGS = "user_id bigint, item_id bigint, tag string, ts bigint"
MOVIES = "item_id bigint, title string, genres string"
KEYS = "user_id bigint, item_id bigint"
PAIRS = "id1 bigint, id2 bigint"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per line."""
    return spark.read.text(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, lenient: bool = False) -> DataFrame:
    """Typed CSV with quoting; a bad value raises unless lenient, which gives null."""
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE" if lenient else "FAILFAST")


def read_naive(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV cut at every comma, as if quotes had no meaning; lines equal to the header are dropped."""
    rows = spark.read.text(path)
    if header:
        first = rows.first()
        rows = rows.where(F.col("value") != first["value"]) if first else rows
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cols = naive_fields(F.col("value"), *[t for _, t in fields])
    return rows.select([c.alias(n) for c, (n, _) in zip(cols, fields)])


def read_genres(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, genres): the first field and the last, whatever commas the title holds."""
    rows = read_lines(spark, path)
    first = rows.first()
    rows = rows.where(F.col("value") != first["value"]) if first else rows
    return rows.select(naive_fields(F.col("value"), "bigint")[0].alias("item_id"), F.split(last_field(F.col("value")), r"\|").alias("genres"))


def in_memory(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str, header: bool = True, single: bool = False) -> None:
    """CSV folder; fails if it exists. ``single`` makes one part, for results that are small."""
    (df.coalesce(1) if single else df).write.option("header", header).mode("errorifexists").csv(path)


def write_text(df: DataFrame, line: Column, path: str, single: bool = False) -> None:
    """One formatted line per row, in the frame's order if single."""
    out = df.select(line.cast("string").alias("value"))
    (out.coalesce(1) if single else out).write.mode("errorifexists").text(path)


def edge_line(src: str, dst: str, value: str) -> Column:
    return F.format_string("(%s,%s,%s)", F.col(src).cast("string"), F.col(dst).cast("string"), F.col(value).cast("string"))


def tuple_line(*cols: str) -> Column:
    return F.concat_ws(", ", *[F.col(c).cast("string") for c in cols])


def list_line(members: str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(F.col(members), lambda x: x.cast("string"))), F.lit("]"))
