"""Embedding near-duplicates by random hyperplanes (operator 10).

Each of several tables signs every vector against its own random hyperplanes.
What travels to the buckets is a sketch of ``SKETCH_BITS`` signs against other
hyperplanes: vectors without another sketch in reach (see sketch_reach)
in a bucket have no link there and stay away. The others are fetched and compared by
exact cosine in double precision. A pair is counted in the first table in which
its vectors share a bucket, so links are counted once although no pair is ever
emitted: a bucket gives link counts and a spanning forest of its links.
Components are found on the forests' edges.

The number of bits follows the number of vectors, so buckets keep their size,
and the number of tables follows from the bits such that a pair at exactly the
threshold is missed with a chance of at most ``miss``; closer pairs are missed
far less often, and a sketch hides a pair at the threshold once in a million.
Equal vectors are one class from the start. Buckets over ``HOT_ROWS`` are cut in
blocks and every pair of blocks is a task of its own.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are their own component. Vectors of unequal length don't
link; long ones are compared whole. Rows with a null id take part and never give
a component its id; without any other id it is null. Repeated rows are other
vectors and link with each other; a cosine of exactly the threshold links. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from orelode.llm.common import Forest, cut_lineage, partitions, table
from orelode.llm.textcore import mix, segment_sums
from orelode.operators.components import connected_components

COSINE = 0.9
MISS = 0.005
BUCKET_ROWS = 400
HOT_ROWS = 8192
#: Signs of a sketch.
SKETCH_BITS = 256
_U = np.uint64


def tables_for(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = max(3, round(math.log2(max(n, 1) / BUCKET_ROWS))) if n > BUCKET_ROWS else 3
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-hit))


def bucket_keys(x: np.ndarray, bits: int, tables: int, seed: int = 5) -> np.ndarray:
    """Bucket keys, rows x tables."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    code = (signs.astype(_U) << np.arange(bits, dtype=_U)).sum(axis=2, dtype=_U)
    return mix(code * _U(0x9E3779B97F4A7C15) + np.arange(tables, dtype=_U) + _U(x.shape[1]) * _U(1 << 32))


def sketches(x: np.ndarray, seed: int = 6) -> np.ndarray:
    """Signs against hyperplanes that no table has, rows x words."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], SKETCH_BITS))
    return np.packbits(x @ planes > 0, axis=1, bitorder="little").view("<u8")


def sketch_reach(cosine: float) -> int:
    """The most differing signs of a link's sketches: five deviations over the mean at the threshold."""
    p = math.acos(cosine) / math.pi
    return min(SKETCH_BITS, math.ceil(SKETCH_BITS * p + 5 * math.sqrt(SKETCH_BITS * p * (1 - p))))


def stored_type(vectors: DataFrame, vector: str) -> str:
    """Single precision for vectors that have no more, else double; sums are double in any case."""
    return "<f4" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "<f8"


def packed_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): components as little-endian numbers, null where the vector can't link."""
    kind = stored_type(vectors, vector)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            n = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(n)])
            with np.errstate(over="ignore", invalid="ignore"):
                norm = segment_sums(x * x, offs)
            good = (norm > 0) & (norm < np.inf)  # not a number isn't either
            raw = x.astype(kind).tobytes()
            size = np.dtype(kind).itemsize
            out = [raw[a * size : z * size] if ok else None for a, z, ok in zip(offs[:-1].tolist(), offs[1:].tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    cast = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return cast.mapInArrow(pack, "id bigint, vec binary")


def _by_length(vecs: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their matrix in double precision, for each vector length."""
    raw = vecs.to_pylist()
    lengths = np.array([len(v) for v in raw], np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64)


def compare(x: np.ndarray, y: np.ndarray | None, kx: np.ndarray, ky: np.ndarray | None, t: int, cosine: float, block: int = 1024) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of the link matrix between x and y (y None: within x, both halves)."""
    within = y is None
    y, ky = (x, kx) if within else (y, ky)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    for a in range(0, len(x), block):
        for b in range(0, len(y), block):
            link = (x[a : a + block] @ y[b : b + block].T) / np.outer(nx[a : a + block], ny[b : b + block]) >= cosine
            if within and a == b:
                np.fill_diagonal(link, False)
            i, j = np.nonzero(link)
            if t and len(i):
                seen = (kx[a + i, :t] == ky[b + j, :t]).any(axis=1)
                link[i[seen], j[seen]] = False
            yield a, b, link


def of_buckets(batches: Iterator[pa.RecordBatch], per_rows) -> Iterator[pa.RecordBatch]:
    """per_rows(table) on rows sorted by key, never with a part of a bucket."""
    held: pa.Table | None = None
    for b in batches:
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new])
        key = held.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield from per_rows(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from per_rows(held)


def edges_of(key: np.ndarray) -> list[tuple[int, int]]:
    """Spans of equal keys with more than one row."""
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    return [(a, z) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()) if z - a > 1]


def sketched_pairs(sketch: np.ndarray, side: np.ndarray, reach: int, block: int = 1024) -> np.ndarray:
    """Which rows of a bucket have another sketch in reach that they are to be compared with."""
    found = np.zeros(len(sketch), bool)
    one = (side == 2).all()
    left, right = (np.arange(len(side)),) * 2 if one else (np.flatnonzero(side != 1), np.flatnonzero(side == 1))
    for a in range(0, len(left), block):
        for b in range(a if one else 0, len(right), block):
            i, j = left[a : a + block], right[b : b + block]
            apart = np.zeros((len(i), len(j)), np.uint16)
            for w in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[i, w][:, None] ^ sketch[j, w][None, :])
            near = apart <= reach
            if one and a == b:
                np.fill_diagonal(near, False)
            found[i[near.any(axis=1)]] = True
            found[j[near.any(axis=0)]] = True
    return found


def link_classes(classes: DataFrame, n: int, cosine: float = COSINE, hot_rows: int = HOT_ROWS, kind: str = "<f8") -> DataFrame:
    """Rows (src, dst, links): spanning links between classes, and with dst null a class's links to vectors of other classes."""
    bits, tables = tables_for(n, cosine)
    spark, reach = classes.sparkSession, sketch_reach(cosine)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _by_length(b.column(0), kind):
                yield pa.RecordBatch.from_pydict({"key": bucket_keys(x, bits, tables).ravel().view(np.int64)})

    big = classes.select("vec").mapInArrow(keys, "key bigint").groupBy("key").count().where(F.col("count") > hot_rows).toArrow()
    blocks = {k: -(-c // (hot_rows // 2)) for k, c in zip(big.column(0).to_pylist(), big.column(1).to_pylist())}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(blocks), np.int64)
        for b in batches:
            cid = b.column(0).to_numpy()
            for rows, x in _by_length(b.column(1), kind):
                key, sketch = bucket_keys(x, bits, tables).view(np.int64), sketches(x)
                for t in range(tables):
                    is_hot = np.isin(key[:, t], hot)
                    take, to, side = [np.flatnonzero(~is_hot)], [key[~is_hot, t]], [np.full(int((~is_hot).sum()), 2, np.int8)]
                    for i in np.flatnonzero(is_hot):
                        nb = blocks[int(key[i, t])]
                        own, other = int(cid[rows[i]] % nb), np.arange(nb)
                        low, high = np.minimum(own, other), np.maximum(own, other)
                        take.append(np.full(nb, i))
                        to.append(mix(key[i, t : t + 1].view(_U) ^ (low * nb + high + 1).astype(_U)).view(np.int64))
                        side.append(np.where(low == high, 2, (own > other).astype(int)).astype(np.int8))
                    take = np.concatenate(take)
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH_BITS // 8), len(take), [None, pa.py_buffer(np.ascontiguousarray(sketch[take]).tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(np.full(len(take), t, np.int16)), pa.array(np.concatenate(side)), pa.array(cid[rows[take]]), raw.cast(pa.binary())], names=["key", "t", "side", "cid", "sketch"])

    def survivors(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, side = rows.column("key").to_numpy(), rows.column("side").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u8").reshape(len(key), -1)
        near = np.zeros(len(key), bool)
        for a, z in edges_of(key):
            near[a:z] = sketched_pairs(sketch[a:z], side[a:z], reach)
        if near.any():
            yield from rows.select(["key", "t", "side", "cid"]).filter(pa.array(near)).combine_chunks().to_batches()

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cid, n = (rows.column(c).to_numpy() for c in ("key", "cid", "n"))
        t, side = rows.column("t").to_numpy(), rows.column("side").to_numpy()
        vecs = rows.column("vec").combine_chunks()
        src, dst, count = [], [], []
        for a, z in edges_of(key):
            for at, x in _by_length(vecs.slice(a, z - a), kind):
                at = at + a
                k = bucket_keys(x, bits, tables)
                left = side[at] != 1
                one = (side[at] == 2).all()
                forest, total = Forest(len(at)), np.zeros(len(at), np.int64)
                p, q = (np.arange(len(at)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
                for i, j, link in compare(x[p], None if one else x[q], k[p], None if one else k[q], int(t[a]), cosine):
                    u, v = np.nonzero(link)
                    u, v = p[i + u], q[j + v]
                    total += np.bincount(u, n[at[v]], minlength=len(at)).astype(np.int64)
                    if not one:
                        total += np.bincount(v, n[at[u]], minlength=len(at)).astype(np.int64)
                    forest.link(u, v)
                f, g = forest.edges()
                some = np.flatnonzero(total)
                src += [cid[at[f]], cid[at[some]]]
                dst += [cid[at[g]], np.full(len(some), -1)]
                count += [np.zeros(len(f), np.int64), total[some]]
        if src:
            s, d = np.concatenate(src), np.concatenate(dst)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d, mask=d < 0), pa.array(np.concatenate(count))], names=["src", "dst", "links"])

    placed = max(partitions(spark), 3 * tables)
    dealt = classes.select("cid", "vec").mapInArrow(deal, "key bigint, t smallint, side tinyint, cid bigint, sketch binary")
    dealt = dealt.repartition(placed, "key").sortWithinPartitions("key")
    near = dealt.mapInArrow(lambda batches: of_buckets(batches, survivors), "key bigint, t smallint, side tinyint, cid bigint")
    fetched = near.join(classes.select("cid", "n", "vec"), "cid").select("key", "t", "side", "cid", "n", "vec")
    fetched = fetched.repartition(placed, "key").sortWithinPartitions("key")
    return fetched.mapInArrow(lambda batches: of_buckets(batches, links), "src bigint, dst bigint, links bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id) of every row."""
    rows = cut_lineage(packed_vectors(vectors, key, vector).withColumn("cls", F.unhex(F.sha2("vec", 256))))
    grouped = rows.where("vec is not null").groupBy("cls").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("least"))
    classes = cut_lineage(grouped.withColumn("cid", F.monotonically_increasing_id()))
    found = cut_lineage(link_classes(classes, classes.count(), cosine, kind=stored_type(vectors, vector)))
    counts = found.where("dst is null").groupBy("src").agg(F.sum("links").alias("links")).withColumnRenamed("src", "cid")
    comp = connected_components(found.where("dst is not null")).withColumnRenamed("node", "cid")
    told = classes.select("cid", "cls", "n", "least").join(counts, "cid", "left").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(least, "component").select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.select("id", "cls").join(told, "cls", "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: All pairs by brute force; the operator finds the same links as long as no table misses one.
ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select vec_id, e, sqrt(list_inner_product(e, e)) as norm from v where list_inner_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from w a join w b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
cc(n, c) as (select vec_id, vec_id from embeddings union select links.b, cc.c from cc join links on links.a = cc.n),
least_ as (select n, min(c) as component_id from cc group by n),
counts as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least_ on least_.n = e.vec_id left join counts on counts.a = e.vec_id
"""
