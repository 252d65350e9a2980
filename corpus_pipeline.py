"""A corpus pipeline of five stages over the documents table.

Language identification, toxicity, near-duplicates, mixing and BPE encoding, in
this order; each stage works on all that the stage before kept, and all but the
last return the columns of documents, whatever other columns these have.

Cases: null, empty and letterless texts are rejected by the first stage, as no
language can be told in them; the other stages take them as their operators do.
Repeated rows are near-duplicates, of which one stays, and the mixture may repeat
a document. Ties of a group go to the least id, a null one first. Texts are read
whole, whatever their length. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm import bpe, langid, mixing, neardup, simhash, toxicity
from orelode.llm.common import cut_lineage, delete_folder, shared_dir, table
from orelode.operators.components import connected_components


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language can be told."""
    return langid.keep_identified(docs, langid.learn_from(docs))


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that aren't toxic."""
    return toxicity.keep_civil(docs, toxicity.learn_from(docs, table(spark, sf_dir, "labels")))


def _node(kind: str, name: str) -> Column:
    """A set's or a fingerprint's node among those of both kinds."""
    return F.xxhash64(F.lit(kind), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that operator 9's fingerprints or an exact Jaccard similarity of 0.8 or more, which those miss, join: links of both count."""
    prints, (sets, similar) = simhash.marked(docs), neardup.links(docs)
    alike = simhash.near_links(cut_lineage(prints.select("fp").distinct()))
    both = cut_lineage(sets.join(prints.select("text_hash", "fp").distinct(), "text_hash").select("id", "text_hash", _node("jaccard", "set").alias("src"), _node("simhash", "fp").alias("dst")))
    edges = both.select("src", "dst")
    for kind, found in (("jaccard", similar), ("simhash", alike)):
        edges = edges.unionByName(found.select(_node(kind, "src").alias("src"), _node(kind, "dst").alias("dst")))
    groups = connected_components(edges).toDF("src", "component")
    return simhash.keep_first(docs, cut_lineage(both.join(groups, "src").select("id", "text_hash", "component")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources reach their target weights."""
    return mixing.apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of the mixture, as counts and digests."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language", language),
    ("toxicity", civility),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("bpe", encoding),
]

#: Learned models, fingerprints and sampling draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next, and deleted once that is written."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = f"{folder}/{k}-{name}"
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if before is not None:
                delete_folder(spark, before)
            before = at
    return docs
