"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators.components import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return ensure_checkpoint_dir(spark)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Forest:
    """Groups of numbered items under batches of links, and a spanning forest of real links."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.used: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.append(True, high[order][1:] != high[order][:-1])]  # one link for each group that joins a lower one
            self.label[high[first]] = low[first]
            self.used.append((a[first], b[first]))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The links that joined two groups; they span all groups."""
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + [u[0] for u in self.used]), np.concatenate(none + [u[1] for u in self.used])


def release_memory() -> None:
    """Gives memory that a finished task has freed back to the system, as workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
