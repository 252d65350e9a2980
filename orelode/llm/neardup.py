"""Near-duplicates by exact Jaccard similarity of five-word shingles (the pipeline's stage).

Two texts are linked if their sets of lower-cased five-word shingles have a
Jaccard similarity of ``SIMILARITY`` or more. Candidates share a band of MinHash
values; every link is verified by the exact sets. A pair at the very threshold is
missed with a chance of (1 - 0.8^ROWS)^BANDS, 7 in a million, and closer pairs
with less.

Equal sets are merged first. In each bucket of a band the member with the most
company over all bands is compared with the others, one row each. Buckets whose
other members are then still in different components are compared in full, in
one task each: components are joined by exact comparisons and only a spanning
forest leaves the task. Buckets over ``BLOCK`` members are dealt out as pairs of
blocks. No member is dropped.

Cases: null, empty and blank texts have the empty set and are equal. Texts of
fewer words than a shingle are one shingle. Texts are read whole. Rows with a
null id take part; repeated rows are linked, and one of a group stays, that of
the least id. A similarity of exactly the threshold links. An empty table gives
no rows. Extra columns, whatever their names, are kept by keep_one. Sets are
named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import cut_lineage, partitions, release_memory
from orelode.llm.simhash import keep_first
from orelode.llm.textcore import LOWER, mix, runs, segment_sums, span_hashes, utf8_column, word_spans
from orelode.operators.components import connected_components

SHINGLE = 5
#: The threshold as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 30, 5
BLOCK = 1024
_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)
SKETCH = "set bigint, n int, bands array<bigint>"


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts in order: the sorted distinct shingle hashes of each, end to end, and their offsets."""
    buf, offs = utf8_column(texts)
    for i, j in runs(offs):
        text = LOWER[buf[offs[i] : offs[j]]]
        starts, ends, at = word_spans(text, offs[i : j + 1] - offs[i])
        words = np.append(span_hashes(text, starts, ends), _U(0))
        n = np.diff(at)
        n = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        doc = np.repeat(np.arange(j - i), n)
        at_word = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        last = at[1:][doc]
        h = words[at_word]
        for k in range(1, width):
            h = mix(h * _C + np.where(at_word + k < last, words[np.minimum(at_word + k, len(words) - 1)], _U(k)))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
        yield h[first], np.searchsorted(doc[first], np.arange(j - i + 1))


def band_keys(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts x BANDS keys of sets that aren't empty, each of ROWS MinHash values."""
    rng = np.random.default_rng(42)
    key = np.zeros((len(offs) - 1, BANDS), _U)
    for b in range(BANDS):
        key[:, b] = _U(b + 1)
        for _ in range(ROWS):
            xor, times = rng.integers(0, 1 << 64, 2, dtype=_U)
            key[:, b] = mix(key[:, b] * _C + np.minimum.reduceat((h ^ xor) * (times | _U(1)), offs[:-1]))
    return key


def sketch(text: Column) -> Column:
    """The name and size of a text's shingle set and its band keys."""

    @F.arrow_udf(SKETCH)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, sizes, keys = [np.zeros(0, _U)], [np.zeros(0, np.int32)], [np.zeros(0, _U)]
            for h, offs in shingle_sets(texts):
                n = np.diff(offs)
                names.append(mix(segment_sums(mix(h), offs) + n.astype(_U)))
                sizes.append(n.astype(np.int32))
                full = n > 0
                if full.any():
                    keys.append(band_keys(h, np.append(offs[:-1][full], len(h))).ravel())
            n = np.concatenate(sizes)
            ends = np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(n), bands], names=["set", "n", "bands"])
        release_memory()

    return of(text)


def shingle_bytes(text: Column) -> Column:
    """A text's shingle set as sorted 64-bit hashes."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([h[a:z].tobytes() for h, offs in shingle_sets(texts) for a, z in zip(offs, offs[1:])], pa.binary())
        release_memory()

    return of(text)


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with so many common members reach the threshold."""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def sets_similar(a: Column, b: Column) -> Column:
    """Whether two columns of shingle bytes reach the threshold."""

    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                out.append(bool(similar(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y))))
            yield pa.array(out, pa.bool_())
        release_memory()

    return of(a, b)


def bucket_links(component: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join all components of one bucket that a similar pair joins; sets aren't empty."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, ends = np.repeat(np.arange(len(sets)), size), np.cumsum(size)
    group = np.unique(component, return_inverse=True)[1]
    mark = np.zeros(len(code), bool)
    left = np.arange(len(sets))
    rest = code
    while len(left):
        joined, queue = group[left[:1]], []
        while True:
            if len(joined):  # these groups are reached whole
                new = np.isin(group[left], joined)
                queue += left[new].tolist()
                rest = rest[np.repeat(~new, size[left])]
                left = left[~new]
            if not queue or not len(left):
                break
            i = queue.pop()
            own = code[ends[i] - size[i] : ends[i]]
            mark[own] = True
            common = np.add.reduceat(mark[rest], np.cumsum(size[left]) - size[left], dtype=np.int64)
            mark[own] = False
            hit = left[similar(common, size[i], size[left])]
            joined, first = np.unique(group[hit], return_index=True)
            yield from ((i, int(j)) for j in hit[first])


def full_links(dealt: DataFrame) -> DataFrame:
    """(src, dst) links within each bucket of (key, set, component, shingles), in one task a bucket."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            name = np.array([h[0] for h in held], np.int64)
            found = list(bucket_links(np.array([h[1] for h in held], np.int64), [np.frombuffer(h[2], _U) for h in held]))
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_pydict({"src": name[a], "dst": name[b]})

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "set", "component", "shingles"))):
                if k != key:
                    if held:
                        yield out()
                    key, held = k, []
                held.append(row)
        if held:
            yield out()
        release_memory()

    placed = dealt.repartition(partitions(dealt.sparkSession), "key").sortWithinPartitions("key")
    return placed.select("key", "set", "component", "shingles").mapInArrow(link, "src bigint, dst bigint")


def dealt_blocks(rest: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, set, component) of (key, set, component, size): buckets over ``block`` as all pairs of blocks, so that any two members meet."""
    parts = F.ceil(F.col("size") / block).cast("int")
    placed = rest.withColumn("own", F.pmod(F.xxhash64("set"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = F.when(parts == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return placed.select(key.alias("key"), "set", "component")


def links(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((id, text_hash, set) of every row, (src, dst)): links of sets, each of the threshold or more, that join all sets which such pairs join."""
    content = F.col(text).cast("string")
    sketched = cut_lineage(docs.select(F.col(key).alias("id"), F.xxhash64(content).alias("text_hash"), sketch(content).alias("s")))
    marked = sketched.select("id", "text_hash", F.col("s.set").alias("set"))
    nodes = sketched.groupBy(F.col("s.set").alias("set")).agg(F.min(F.struct("id", "text_hash")).alias("least"), F.first("s.n").alias("n"), F.first("s.bands").alias("bands"))
    nodes = cut_lineage(nodes)
    rows = nodes.select("set", "n", F.explode("bands").alias("key"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = cut_lineage(rows.join(crowded, "key"))

    # each bucket's others against the member with the most company
    company = members.groupBy("set").agg(F.sum("m").alias("company"))
    heads = members.join(company, "set").groupBy("key").agg(F.max(F.struct("company", "set", "n")).alias("h")).select("key", F.col("h.set").alias("head"), F.col("h.n").alias("head_n"))
    headed = cut_lineage(members.join(heads, "key").where(F.col("set") != F.col("head")))
    in_reach = SIMILARITY[1] * F.least("n", "head_n") >= SIMILARITY[0] * F.greatest("n", "head_n")
    pairs = headed.where(in_reach).select(F.col("head").alias("src"), F.col("set").alias("dst")).distinct()
    picked = members.select("set").distinct().join(nodes, "set").select("set", F.col("least.id").alias("__id"), F.col("least.text_hash").alias("__hash"))
    whole = docs.select(F.col(key).alias("id"), content.alias("content"), F.xxhash64(content).alias("own"))
    whole = whole.join(picked, whole["id"].eqNullSafe(picked["__id"]) & (whole["own"] == picked["__hash"]))
    shingles = cut_lineage(whole.select("set", shingle_bytes(F.col("content")).alias("shingles"))).dropDuplicates(["set"])
    src, dst = (shingles.select(F.col("set").alias(c), F.col("shingles").alias(f"{c}_shingles")) for c in ("src", "dst"))
    near = cut_lineage(pairs.join(dst, "dst").join(src, "src").where(sets_similar(F.col("src_shingles"), F.col("dst_shingles"))).select("src", "dst"))

    # buckets whose other members are still apart, in full; those of the same members once
    found = connected_components(near).withColumnRenamed("node", "set")
    apart = headed.select("key", "set").join(found, "set", "left").withColumn("component", F.coalesce("component", "set"))
    bucket = apart.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("who"))
    bucket = bucket.where("low < high").groupBy("who", "size").agg(F.min("key").alias("key")).select("key", "size")
    dealt = dealt_blocks(apart.join(bucket, "key"), block).join(shingles, "set")
    return marked, near.unionByName(cut_lineage(full_links(dealt)))


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(id, text_hash, component) of every row; rows of one component are joined by pairs of the threshold or more."""
    marked, edges = links(docs, text, key, block)
    labelled = connected_components(edges).withColumnRenamed("node", "set")
    return marked.join(labelled, "set", "left").select("id", "text_hash", F.coalesce("component", "set").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the least id, with all its columns."""
    return keep_first(docs, cut_lineage(components(docs)))
