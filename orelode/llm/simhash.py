"""SimHash near-duplicates by the general pigeonhole principle (operator 9).

A fingerprint's 64 bits are grouped into partitions, correlated bits together.
If two fingerprints differ in at most T bits and the partitions' thresholds add
up to T - m + 1, then they differ in some partition by no more than its
threshold (-1 leaves a partition out). Thresholds need not be equal: dynamic
programming over the partitions finds those of least estimated cost, from the
exact number of pairs that share a partition's value. Candidates are probed by
partition value and verified by the exact distance.

Work per bucket is linear for large buckets: links are found by looking up all
values within T bits (for T over 3, which has too many, by comparing rows), and
only a spanning forest is emitted, never all pairs. Buckets over ``HOT_ROWS`` are
dealt out again by the bits not yet used, split in T + 1 blocks of which a near
pair must share one, until no bucket is that large.
Equal fingerprints are merged before any of this, with a partial aggregation.

Cases: null, empty and blank texts have fingerprint zero and are linked like any
other. Texts of fewer words than a shingle are one shingle. Texts are read
whole. Rows with a null id take part; a group's component_id is the least id
that is not null. Repeated rows are linked. A share of exactly half leaves a bit
0. An empty table gives no rows. Extra columns, whatever their names, are kept by
keep_one and keep_first.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import Forest, cut_lineage, partitions, release_memory, table
from orelode.llm.textcore import LOWER, mix, one_spaced, runs, segment_sums, utf8_column, word_spans, xxh64_spans
from orelode.operators.components import connected_components

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 2
HOT_ROWS = 20_000
#: Buckets of more rows than this are searched by looking up neighbours instead of by comparing rows.
PAIRWISE_ROWS = 256
_U = np.uint64


def bit_majority(h: np.ndarray, offs: np.ndarray, most: int = 60_000) -> np.ndarray:
    """For each segment, the bits that are set in over half of its values.

    Four counters of 16 bits share a word, so segments are summed in pieces of ``most`` values.
    """
    n = np.diff(offs)
    pieces = -(-n // most)
    first = np.repeat(offs[:-1] - most * (np.cumsum(pieces) - pieces), pieces) + most * np.arange(int(pieces.sum()))
    ones = np.zeros((len(first), BITS), np.int64)
    for b in range(16 if len(first) else 0):
        four = np.add.reduceat((h >> _U(b)) & _U(0x0001000100010001), first)
        ones[:, b::16] = four.astype("<u8").view("<u2").reshape(-1, 4)
    over = 2 * segment_sums(ones, np.concatenate([[0], np.cumsum(pieces)])) > n[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: pa.Array, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text; null counts as empty."""
    buf, offs = utf8_column(texts)
    out = [np.zeros(0, _U)]
    for i, j in runs(offs):
        text, at = one_spaced(LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i])
        starts, ends, words = word_spans(text, at)
        n = np.diff(words)
        n = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        segments = np.concatenate([[0], np.cumsum(n)])
        doc = np.repeat(np.arange(j - i), n)
        first = words[:-1][doc] + np.arange(len(doc)) - segments[:-1][doc]
        last = np.minimum(first + width, words[1:][doc]) - 1
        out.append(bit_majority(xxh64_spans(text, starts[first], ends[last], seed), segments))
    return np.concatenate(out)


def simhash(text: Column, width: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of a text column, as a bigint of the same bits."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(fingerprints(texts, width, seed).view(np.int64))
        release_memory()

    return of(text)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have each pair of bits set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float32)
            for k in range(0, len(x), 1 << 16):
                total += (x[k : k + (1 << 16)].T @ x[k : k + (1 << 16)]).astype(np.int64)
            rows += len(x)
        if rows:
            yield pa.RecordBatch.from_pydict({"i": np.arange(BITS * BITS + 1, dtype=np.int32), "n": np.append(total.ravel(), rows)})

    got = fps.select("fp").mapInArrow(count, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BITS * BITS + 1, np.int64)
    total[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return int(total[-1]), total[:-1].reshape(BITS, BITS)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(part[0])
        while len(part) < width:
            nxt = max(left, key=lambda b: corr[b, part].sum())
            part.append(nxt)
            left.remove(nxt)
        parts.append(sorted(part))
    return parts


def partition_value(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The partition's bits, packed."""
    out = np.zeros(len(fp), _U)
    for k, b in enumerate(part):
        out |= ((fp >> _U(b)) & _U(1)) << _U(k)
    return out


@dataclass(frozen=True)
class Allocation:
    parts: list[list[int]]
    thresholds: list[int]
    cost: float


def allocate(sharing: list[float], agree: np.ndarray, parts: list[list[int]], n: int, distance: int) -> Allocation:
    """Thresholds of least estimated cost, by dynamic programming over the partitions.

    sharing: pairs that agree in the whole partition; agree: for each bit, the
    chance that it agrees in a random pair. The cost is probes plus candidates.
    """
    target = distance - len(parts) + 1

    def cost(i: int, e: int) -> float:
        if e < 0:
            return 0.0
        odds = sorted((1 - agree[b]) / max(agree[b], 1e-6) for b in parts[i])
        grown, total = 1.0, 1.0
        for k in range(1, e + 1):
            grown *= sum(odds) / k
            total += grown
        probes = sum(math.comb(len(parts[i]), k) for k in range(e + 1))
        return n * probes + sharing[i] * total * 0.2

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(parts)):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for e in range(-1, distance + 1):
                if s + e not in nxt or c + cost(i, e) < nxt[s + e][0]:
                    nxt[s + e] = (c + cost(i, e), [*chosen, e])
        best = nxt
    c, chosen = best[target]
    return Allocation(parts, chosen, c)


def plan(fps: DataFrame, distance: int = DISTANCE) -> Allocation:
    """The cheapest of the allocations over one to distance + 2 partitions, from statistics of all fingerprints."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    options = [group_bits(n, both, m) for m in range(1, distance + 3)]
    flat = [part for parts in options for part in parts]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(_U)
            for i, part in enumerate(flat):
                if len(part) < BITS:
                    v, c = np.unique(partition_value(fp, part), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"i": np.full(len(v), i, np.int32), "v": v.view(np.int64), "n": c.astype(np.int64)})

    seen = fps.select("fp").mapInArrow(values, "i int, v bigint, n bigint").groupBy("i", "v").agg(F.sum("n").alias("n"))
    pairs = {r["i"]: float(r["c"]) for r in seen.groupBy("i").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("c")).collect()}
    at, found = 0, []
    for parts in options:
        found.append(allocate([pairs.get(at + i, 0.0) for i in range(len(parts))], agree, parts, n, distance))
        at += len(parts)
    return min(found, key=lambda a: a.cost)


def _keys(fp: np.ndarray, how: Allocation, hot: list[np.ndarray], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket key, fingerprint, is probe) of all partitions; hot buckets are split by further bits."""
    for i, (part, e) in enumerate(zip(how.parts, how.thresholds)):
        if e < 0:
            continue
        value = partition_value(fp, part)
        for k in range(e + 1):
            for flips in itertools.combinations(range(len(part)), k):
                mask = _U(sum(1 << f for f in flips))
                key = mix((value ^ mask) * _U(0x9E3779B97F4A7C15) + _U(i + 1))
                yield from _split(key, fp, k > 0, [b for b in range(BITS) if b not in part], hot, distance)


def _split(key: np.ndarray, fp: np.ndarray, probe: bool, left: list[int], hot: list[np.ndarray], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not hot or len(left) <= distance:  # so few bits hold few values
        yield key, fp, np.full(len(fp), probe)
        return
    is_hot = np.isin(key, hot[0])
    yield key[~is_hot], fp[~is_hot], np.full(int((~is_hot).sum()), probe)
    if is_hot.any():
        for j, block in enumerate(np.array_split(left, distance + 1)):
            sub = mix(key[is_hot] ^ (partition_value(fp[is_hot], block.tolist()) * _U(0xC2B2AE3D27D4EB4F) + _U(j + 1)))
            yield from _split(sub, fp[is_hot], probe, [b for b in left if b not in block], hot[1:], distance)


def bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int, pairwise: int = PAIRWISE_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of the near pairs in each bucket of rows sorted by key."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(edge, len(key)))
    small = np.repeat(size <= pairwise, size)
    k, f, q = key[small], fp[small], probe[small]
    forest, d = Forest(len(k)), 1
    while len(k) > d:
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        near = same[(np.bitwise_count(f[same] ^ f[same + d]) <= distance) & ~(q[same] & q[same + d]) & (f[same] != f[same + d])]
        forest.link(near, near + d)
        d += 1
    x, y = forest.edges()
    yield f[x], f[y]
    if (size <= pairwise).all():
        return
    masks = [_U(sum(1 << b for b in c)) for r in range(1, distance + 1) for c in itertools.combinations(range(BITS), r)]
    for a, n in zip(edge[size > pairwise], size[size > pairwise]):
        rows = np.unique(fp[a : a + n])
        forest, here = Forest(len(rows)), np.arange(len(rows))
        for mask in masks:
            other = rows ^ mask
            at = np.minimum(np.searchsorted(rows, other), len(rows) - 1)
            hit = (rows[at] == other) & (at > here)
            forest.link(here[hit], at[hit])
        x, y = forest.edges()
        yield rows[x], rows[y]


def near_links(fps: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(src, dst) links that join all distinct fingerprints of at most ``distance`` differing bits into their components."""
    if not 0 <= distance < BITS // 2:
        raise ValueError("the distance is under half of the bits")
    spark = fps.sparkSession
    pairwise = PAIRWISE_ROWS if distance <= 3 else BITS * hot_rows  # no bucket is that large
    how = plan(fps, distance)
    hot: list[np.ndarray] = []

    def rows(hot_keys: list[np.ndarray]) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                whole = b.column(0).to_numpy().view(_U)
                for at in range(0, len(whole), 1 << 16):
                    for key, fp, probe in _keys(whole[at : at + (1 << 16)], how, hot_keys, distance):
                        if len(key):
                            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "fp": fp.view(np.int64), "probe": probe})

        return fps.select("fp").mapInArrow(emit, "key bigint, fp bigint, probe boolean")

    while True:
        big = rows(hot).groupBy("key").count().where(F.col("count") > hot_rows).select("key").toArrow().column(0).to_numpy().view(_U)
        fresh = np.setdiff1d(big, np.concatenate([np.zeros(0, _U), *hot]))
        if not len(fresh):
            break
        hot.append(np.sort(fresh))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, bool)]

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in bucket_links(*cols, distance, pairwise):
                if len(a):
                    yield pa.RecordBatch.from_pydict({"src": a.view(np.int64), "dst": b.view(np.int64)})

        for b in batches:
            new = [b.column(0).to_numpy().view(_U), b.column(1).to_numpy().view(_U), b.column(2).to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]):
                cut = int(np.argmax(held[0] == held[0][-1]))  # the last bucket may go on
                yield from out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        yield from out(held)

    dealt = rows(hot).repartition(partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(link, "src bigint, dst bigint")


def marked(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp) of every row."""
    content = F.col(text).cast("string")
    return cut_lineage(docs.select(F.col(key).alias("id"), F.xxhash64(content).alias("text_hash"), simhash(content, width).alias("fp")))


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id, text_hash, fp, component_id) of every row; component_id is the group's least id."""
    rows = marked(docs, text, key, width)
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(near_links(fps, distance)).withColumnRenamed("node", "fp")
    labelled = fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.select("fp", "component").join(least, "component").select("fp", "component_id", "component")
    return rows.join(by_fp, "fp").select("id", "text_hash", "fp", "component_id", "component")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the least id, with all its columns."""
    return keep_first(docs, components(docs))


#: Rows of two numbers that are broadcast at most: 32 MB.
BROADCAST_ROWS = 2_000_000


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The document with the least id of each component of found (id, text_hash, component), with all its columns.

    The rows to remove are told by id and text, and broadcast where they are at
    most ``BROADCAST_ROWS``, so that texts stay where they are. Of rows that
    repeat a kept id and text, that with the least hash of all its columns stays.
    """
    own = "__own"
    while own in docs.columns:
        own = f"_{own}"
    first = cut_lineage(found.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("f")).select("f.*"))
    same = found["id"].eqNullSafe(first["id"]) & found["text_hash"].eqNullSafe(first["text_hash"])
    removed = cut_lineage(found.join(first, same, "left_anti").select(F.col("id").alias(f"{own}_id"), F.col("text_hash").alias(f"{own}_hash")).distinct())
    twice = cut_lineage(found.groupBy("id", "text_hash").count().where("count > 1").select(F.col("id").alias(f"{own}_id"), F.col("text_hash").alias(f"{own}_hash")))
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))

    def match(rows: DataFrame) -> tuple[DataFrame, Column]:
        rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
        return rows, marked["doc_id"].eqNullSafe(rows[f"{own}_id"]) & (marked[own] == rows[f"{own}_hash"])

    kept = marked.join(*match(removed), "left_anti")
    if twice.isEmpty():
        return kept.drop(own)
    every = [F.col(f"`{c}`") for c in docs.columns]
    one = kept.join(*match(twice), "left_semi").groupBy("doc_id", own).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("r")).select("r.*")
    return kept.join(*match(twice), "left_anti").drop(own).unionByName(one)
