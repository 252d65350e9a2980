"""Exact duplicates with a heavy-hitter split (operator 12).

Texts are equal when they are identical after every run of white space became one
space; a text is known by the SHA-256 of that form. Narrow rows of id and digest
are checkpointed once. A Misra-Gries summary, Spark's mergeable frequent-items
sketch, is taken in every task and merged as a tree: by task, by groups of tasks,
and the few groups' at last. It has at most ``TRACKED`` digests, among them all
that have more than ``7 / TRACKED`` of the rows. One pass counts these exactly and
finds the row of each that stays, combined map-side. This verified table, of at
most ``TRACKED`` rows whatever the input, is broadcast, and rows of frequent digests
are settled where they are read. All others are shuffled by digest, where no group
is larger than that share of the rows.

Only DataFrame functions are used; no Python runs on executors.

Cases: a null text is an empty one, and equal to it. A null id is greater than any
other; a group of null ids alone has a null keep_id, and one of its rows stays. Of
repeated rows, equal in id and text, one stays. Other columns, whatever their
names, are kept by ``keep_one``. An empty table gives an empty result. Texts are
read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.llm.common import cut_lineage, table

#: Digests that a summary follows; also the most rows of the broadcast.
TRACKED = 4096
#: Summaries that one task merges.
FAN_IN = 64

ORACLE = r"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
row_number() over (partition by norm order by doc_id nulls last) = 1 as kept, sha256(norm) as text_sha256 from t"""


def digest(text: Column) -> Column:
    """SHA-256, as bytes, of a text with single spaces for its white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def frequent_digests(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(digest): at most ``tracked`` of the column's values, all of those with over 7 / tracked of the rows among them."""
    summary = F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary")
    own = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.expr(f"approx_top_k_accumulate(hex(digest), {tracked})").alias("summary"))
    groups = own.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).agg(summary)
    merged = groups.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).agg(summary).groupBy(F.lit(0).alias("all")).agg(summary)  # no row for no rows
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {tracked})")).alias("found"))
    return found.select(F.unhex("found.item").alias("digest"))


def groups(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(digest, id, ...) with keep_id, group_size and kept; the columns must not have these names, nor ``place`` and ``first``."""
    placed = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("place").alias("place"))
    likely = F.broadcast(frequent_digests(placed.select("digest"), tracked))
    verified = placed.select("digest", "id", "place").join(likely, "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    verified = cut_lineage(verified)
    hot = placed.join(F.broadcast(verified), "digest").withColumn("keep_id", F.col("first.id")).withColumn("kept", F.col("place") == F.col("first.place"))
    same = Window.partitionBy("digest")
    rest = placed.join(F.broadcast(verified.select("digest")), "digest", "left_anti")
    rest = rest.withColumns({"first": F.min(order).over(same), "group_size": F.count("*").over(same)})
    rest = rest.withColumn("keep_id", F.col("first.id")).withColumn("kept", F.col("place") == F.col("first.place"))
    return hot.unionByName(rest).drop("place", "first")


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their exact copies, with all their columns: of equal texts, the row with the least id."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_).alias("id"), digest(F.col(text)).alias("digest"))
    return groups(rows).where("kept").select("row.*")


def op12_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    docs = table(spark, sf_dir, "documents")
    found = groups(docs.select(F.col("doc_id").alias("id"), digest(F.col("text")).alias("digest")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
