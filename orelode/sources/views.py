"""Domain views over the benchmark tables: ratings, tags, genres, baskets and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating): a customer's largest quantity of a part, in tenths."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    return joined.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg((F.max("l_quantity") / 10.0).alias("rating"))


def is_test() -> F.Column:
    return F.pmod(F.col("user_id") * 31 + F.col("item_id"), F.lit(10)) == 0


def test_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where(is_test()).select("user_id", "item_id")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.explode(F.split("p_name", " ")).alias("tag"))


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, genre): the words of a part's name and its type."""
    p = table(spark, sf_dir, "part")
    words = F.array_union(F.split("p_name", " "), F.array("p_type"))
    return p.select(F.col("p_partkey").alias("item_id"), F.explode(words).alias("genre"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item): the brands and sizes that a customer bought."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    joined = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return joined.select(F.col("o_custkey").alias("user_id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("item")).distinct()


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): the brands in an order."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): the documents' lines."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, token): the distinct lower-cased words of each row of documents."""
    d = table(spark, sf_dir, "documents")
    found = F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+")))
    return d.select(F.col("doc_id").alias("id"), found.alias("token")).where("token <> ''")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, token): the distinct lower-cased words of a document."""
    return words(spark, sf_dir).distinct()
