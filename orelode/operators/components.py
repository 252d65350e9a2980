"""Connected components of an edge list, by alternating star contractions.

Large-star links every larger neighbour of a node to the least label near it,
small-star links the smaller ones; a few rounds leave one star per component.
Each round is two aggregations and two equi-joins: neighbour lists are never
collected, so a hub is combined map-side and its join can be split. Lineage is
cut after every round by a table in the shared folder.

Cases: null ends and loops are dropped; repeated and reversed edges count once;
an empty edge list gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; sets one of this session's own only where none is set."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at and jsc.getCheckpointDir().isDefined():
        at = jsc.getCheckpointDir().get()
    if not at:
        at = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not jsc.getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


class Rounds:
    """What the rounds of a loop leave, as Parquet tables in the shared folder.

    A table's size is known, where a checkpoint hands on the estimate for its plan:
    that of a join is the product of its sides, so after some rounds the number has
    more digits than planning can bear. Of each name the last ``keep`` tables stay.
    """

    def __init__(self, spark: SparkSession, keep: int = 3):
        self.spark, self.keep = spark, keep
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
        self.count: dict[str, int] = defaultdict(int)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and to be read from there."""
        at, self.count[name] = f"{self.folder}/{name}-{self.count[name]}", self.count[name] + 1
        df.write.parquet(at)
        if self.count[name] > self.keep:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-{self.count[name] - self.keep - 1}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        """All tables go; nothing may read them any more."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = edges.join(least, edges["u"] == least["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable."""
    rounds = Rounds(edges.sparkSession, 2)
    e = rounds.put("edges", edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct())
    before = None
    for _ in range(most_rounds):
        e = rounds.put("edges", _small_star(_large_star(e)))
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
