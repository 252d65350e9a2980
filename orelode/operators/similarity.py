"""Pairwise similarity by equi-joins on what two sides share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.numeric import ratio
from orelode.functions.ordered import ranked
from orelode.functions.pairs import BLOCK_IDS, _runs, alike_codes, blocks_met, blocks_of, code_lists, distinct, id_lists, own_pairs, pairs_around, pairs_with, pairs_within, shared_classes, spread
from orelode.operators.components import Rounds, ensure_checkpoint_dir


def pearson(ratings: DataFrame, side: str, shared: str, value: str = "rating", asked: DataFrame | None = None) -> DataFrame:
    """(id1, id2, n, sim) for id1 < id2 with anything in common; means over the common part, 0 without variance.

    Pairs are summed in the task of their lesser id, to which only lists of others
    travel, and a hot key's are made in many tasks. With ``asked`` (id), only pairs
    with one of these ids are made.
    """
    rows = ratings.select(F.col(side).alias("id"), F.col(shared).alias("k"), F.col(value).alias("v"))
    return _correlated(pairs_around(rows, "k", "id", ["v"], half=True) if asked is None else pairs_with(rows, asked, "k", "id", ["v"]))


def _correlated(pairs: DataFrame) -> DataFrame:
    spread = F.stddev_pop("v1") * F.stddev_pop("v2")
    flat = (F.min("v1") == F.max("v1")) | (F.min("v2") == F.max("v2"))
    sim = F.when(flat, 0.0).otherwise(ratio(F.covar_pop("v1", "v2"), spread))
    return pairs.groupBy("id1", "id2").agg(F.count("*").alias("n"), sim.alias("sim"))


def pearson_nearest(ratings: DataFrame, side: str, shared: str, k: int, universe: int, value: str = "rating", asked: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(id, other, n, sim): ``nearest`` of ``pearson``, for all ids or those of ``asked`` (id).

    A pair is summed once, in the task of its lesser id. Most share a single key and
    have similarity 0, which takes a place without being listed, so only what is left
    is dealt in both directions, to the ids where the k nearest are cut.
    """
    rows = ratings.select(F.col(side).alias("id"), F.col(shared).alias("k"), F.col(value).alias("v"))
    pairs = _correlated(pairs_around(rows, "k", "id", ["v"], half=True, asked=asked)).withColumn("r", F.round(F.round("sim", 9), digits)).where("r <> 0")
    ways = F.explode(F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("other")) for a, b in (("id1", "id2"), ("id2", "id1"))]))
    signed = pairs.select(ways.alias("w"), "n", "sim", "r").select("w.*", "n", "sim", "r")
    if asked is not None:
        signed = signed.join(asked.select(F.col(asked.columns[0]).alias("id")).distinct(), "id", "left_semi")
    ranks = Window.partitionBy("id").orderBy(F.col("r").desc(), "other")
    placed = signed.withColumn("rank", F.row_number().over(ranks)).withColumn("listed", F.count("*").over(Window.partitionBy("id")))
    place = F.when(F.col("r") > 0, F.col("rank")).otherwise(F.lit(universe - 1) - F.col("listed") + F.col("rank"))
    return placed.where(place <= k).select("id", "other", "n", "sim")


def directed(pairs: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """Both directions of every pair, as (id, other)."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(F.col(a).alias("id"), F.col(b).alias("other"), *rest).unionByName(pairs.select(F.col(b).alias("id"), F.col(a).alias("other"), *rest))


def nearest(pairs: DataFrame, k: int, universe: int, digits: int = 6, asked: DataFrame | None = None) -> DataFrame:
    """(id, other, sim): the k most similar others of each id, or of those of ``asked`` (id), ties by id.

    Others that share nothing have similarity 0 and take places before negative
    ones without being listed. Positive ones are cut to k before they are dealt by
    id; negative ones are fetched only for ids with fewer than k others that are
    positive, zero or not listed.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    both = directed(pairs.select("id1", "id2", "sim").checkpoint()).withColumn("r", F.round("sim", digits))
    if asked is not None:
        both = both.join(asked.select(F.col(asked.columns[0]).alias("id")).distinct(), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("r").desc(), "other"))
    first = both.where("r > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    left = both.groupBy("id").agg((F.count_if(F.col("r") < 0) - (universe - 1) + k).alias("left")).where("left > 0")
    last = both.where("r < 0").join(left, "id").withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("rank") <= F.col("left")))
    return first.select("id", "other", "sim").unionByName(last.select("id", "other", "sim"))


#: Words of 64 bits in the parity bitmap of a set.
WORDS = 32


def rarity_sets(rows: DataFrame) -> DataFrame:
    """(id, s) of distinct (id, t): each set's items as numbers in ascending order, rare items first."""
    ensure_checkpoint_dir(rows.sparkSession)
    often = rows.groupBy("t").agg(F.count("*").alias("df"))
    numbers = ranked(often, [F.col("df"), F.col("t")], "x").select("t", F.col("x").cast("int").alias("x"))
    return rows.join(numbers, "t").groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("s"))


def equal_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, s), (rep, id)): one row for each different set, named by its least id, and which ids have it."""
    named = sets.withColumn("name", F.unhex(F.sha2(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), 256))).checkpoint()
    reps = named.groupBy("name").agg(F.min("id").alias("rep")).checkpoint()
    members = named.select("id", "name").join(reps, "name").select("rep", "id").checkpoint()
    first = reps.select(F.col("rep").alias("id"))
    few = F.broadcast if reps.count() <= BROADCAST_ROWS else lambda rows: rows
    return named.join(few(first), "id", "left_semi").select(F.col("id").alias("rep"), "s"), members


#: Rows of two numbers that are broadcast at most: 32 MB.
BROADCAST_ROWS = 2_000_000


def among_members(pairs: DataFrame, members: DataFrame, one: str) -> DataFrame:
    """(id1, id2, value) from (id1, id2, value) of representatives: all members of both, and the members of one set with value ``one``.

    This is as large as the answer; ask for pairs of representatives and the members where groups of copies are large.
    """
    value = next(c for c in pairs.columns if c not in ("id1", "id2"))
    large = members.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep")
    copies = members.join(large, "rep", "left_semi").checkpoint()
    few = F.broadcast if copies.count() <= BROADCAST_ROWS else lambda rows: rows  # so pairs stay where they were found
    within = pairs_within(copies, "rep", "id").select("id1", "id2", F.expr(one).alias(value))
    a, b = copies.select(F.col("rep").alias("id1"), F.col("id").alias("a")), copies.select(F.col("rep").alias("id2"), F.col("id").alias("b"))
    ends = F.coalesce("a", "id1"), F.coalesce("b", "id2")
    across = pairs.join(few(a), "id1", "left").join(few(b), "id2", "left").select(F.least(*ends).alias("id1"), F.greatest(*ends).alias("id2"), value)
    return across.unionByName(within)


#: Items of the prefixes of a block of sets, and places where two prefixes meet that are looked at together.
PREFIX_ITEMS, MEETS = 1 << 23, 1 << 22


def _overlap(least: float, total: np.ndarray) -> np.ndarray:
    """Items that two sets of so many items in sum must share for a similarity of ``least``."""
    return np.ceil(np.round(least / (1 + least) * total, 6)).astype(np.int64)


class _Prefixes:
    """Sets of a block (s) with sizes and bitmaps (parities of items by number modulo the bitmap's length) by row, and their prefixes: items (x) with their rows and places from 1, by row."""

    def __init__(self, t: pa.Table, least: float):
        lists = t.column("s").combine_chunks()
        many = lists.value_lengths().to_numpy().astype(np.int64)
        self.size, self.s = many, lists.flatten().to_numpy()
        self.ends = np.append(0, np.cumsum(many))
        row = np.repeat(np.arange(len(many), dtype=np.int32), many)
        bits = np.zeros(len(many) * WORDS, np.uint64)
        np.bitwise_xor.at(bits, row * np.int64(WORDS) + (self.s >> 6) % WORDS, np.uint64(1) << (self.s & 63).astype(np.uint64))
        self.bits = bits.reshape(len(many), WORDS)
        place = (np.arange(len(self.s)) - self.ends[row] + 1).astype(np.int32)
        first = place <= (many - np.ceil(np.round(least * many, 6)) + 1)[row]
        self.x, self.row, self.place = self.s[first], row[first], place[first]
        self.short = many - _overlap(least, 2 * many) + 1


def _alike(small: _Prefixes, large: _Prefixes, least: float, same: bool, ties: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and similarities of pairs of a set and one as large or larger that reach ``least``, each once; of equal sizes only with ``ties``, and of the ``same`` block by order."""
    top = int(max(large.size.max(), small.size.max())) + 1
    of = large.x.astype(np.int64) * top + large.size[large.row]
    order = np.argsort(of, kind="stable")
    of, row, place = of[order], large.row[order], large.place[order]
    asks = small.place <= small.short[small.row]
    x, r, i = small.x[asks].astype(np.int64) * top, small.row[asks], small.place[asks]
    n = small.size[r]
    first = np.searchsorted(of, x + n + (0 if ties else 1), "left")
    size = np.maximum(np.searchsorted(of, x + np.minimum(np.floor(n / max(least, 1e-9) + 1e-6), top - 1).astype(np.int64), "right") - first, 0)
    own = np.append(0, np.cumsum(size))
    cut = np.searchsorted(r, np.arange(len(small.size) + 1))
    for lo, hi in _runs(own[cut[1:]], MEETS):
        a, b = cut[lo], cut[hi]
        at = np.repeat(first[a:b] - own[a:b], size[a:b]) + np.arange(own[a], own[b])
        u, v, iu = np.repeat(r[a:b], size[a:b]), row[at], np.repeat(i[a:b], size[a:b])
        need = _overlap(least, small.size[u] + large.size[v])
        met = (iu <= small.size[u] - need + 1) & (place[at] <= large.size[v] - need + 1)
        if same:
            met &= (small.size[u] < large.size[v]) | (u < v)
        u, v = np.divmod(distinct(u[met].astype(np.int64) * len(large.size) + v[met]), len(large.size))
        yield from _shared_enough(small, large, u, v, least)


def _shared_enough(one: _Prefixes, two: _Prefixes, u: np.ndarray, v: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs of rows, by u, those that reach ``least``, and their similarities: bitmaps tell most others apart, and whole sets are counted for what is left."""
    for k in range(0, len(u), 1 << 16):
        x, y = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
        total = one.size[x] + two.size[y]
        need = _overlap(least, total)
        near = np.minimum(one.size[x], two.size[y]) >= need
        x, y, total, need = (c[near] for c in (x, y, total, need))
        near = np.bitwise_count(one.bits[x] ^ two.bits[y]).sum(axis=1, dtype=np.int64) <= total - 2 * need
        x, y, total = (c[near] for c in (x, y, total))
        if not len(x):
            continue
        mark, shared = np.zeros(int(max(one.s.max(), two.s.max())) + 1, bool), np.zeros(len(x), np.int64)
        heads = np.flatnonzero(np.append(True, np.diff(x) != 0))
        for lo, hi in zip(heads, np.append(heads[1:], len(x))):
            mine = one.s[one.ends[x[lo]] : one.ends[x[lo] + 1]]
            mark[mine] = True
            sizes = two.size[y[lo:hi]]
            begin = np.append(0, np.cumsum(sizes))
            for a, b in _runs(begin[1:], MEETS):
                at = np.repeat(two.ends[y[lo + a : lo + b]] - begin[a:b], sizes[a:b]) + np.arange(begin[a], begin[b])
                shared[lo + a : lo + b] = np.add.reduceat(mark[two.s[at]], begin[a:b] - begin[a], dtype=np.int64)
            mark[mine] = False
        like = shared / (total - shared)
        yield x[like >= least], y[like >= least], like[like >= least]


def jaccard_classes_exact(sets: DataFrame, least: float = 0.5, key: str = "id", item: str = "token") -> tuple[DataFrame, DataFrame]:
    """((id1, id2, jaccard), (rep, id)): all pairs of different sets with a similarity of at least ``least``, and who has each set.

    Prefix filter: with items in order of rarity, two sets of n and m items that
    reach the threshold share at least some number of items, so the first that they
    share is among the first n - overlap + 1 of one and m - overlap + 1 of the
    other. Sets are dealt in blocks, and every two blocks meet in a task, which finds
    where their prefixes meet at such places, tells pairs there apart by bitmaps
    (what differs in these differs in the sets), and counts what the whole sets of
    the others share. So no pair is moved but those of the answer, and a set is
    written once for all blocks. The result is exact.
    """
    spark = sets.sparkSession
    rows = Rounds(spark).put("rows", sets.select(F.col(key).alias("id"), F.col(item).alias("t")).distinct())
    unlike, members = equal_sets(rarity_sets(rows))
    placed = unlike.where("rep is not null").select(F.col("rep").alias("id"), "s")
    n = F.size("s")
    many, items = placed.agg(F.count("*"), F.sum(n - F.ceil(F.round(F.lit(least) * n, 6)) + 1)).first()

    def meet(t: pa.Table, cut: int, same: bool) -> Iterator[pa.RecordBatch]:
        ids = t.column("id").combine_chunks()
        if same:
            both = [(_Prefixes(t, least),) * 2]
            offsets = [(0, 0)]
        else:
            a, b = _Prefixes(t.slice(0, cut), least), _Prefixes(t.slice(cut), least)
            both, offsets = [(a, b), (b, a)], [(0, cut), (cut, 0)]
        for ties, (small, large), (to_u, to_v) in zip((True, False), both, offsets):
            for u, v, like in _alike(small, large, least, same, ties):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(u + to_u)), ids.take(pa.array(v + to_v)), pa.array(like)], names=["id1", "id2", "jaccard"])

    return _met(placed, blocks_of(spark, many, items or 0, BLOCK_IDS, PREFIX_ITEMS), meet), members


def _met(rows: DataFrame, blocks: int, meet) -> DataFrame:
    """(id1, id2, jaccard) of blocks that meet, id1 < id2."""
    kind = rows.schema["id"].dataType.simpleString()
    met = blocks_met(rows, blocks, meet, f"id1 {kind}, id2 {kind}, jaccard double")
    return met.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "jaccard")


def _jaccard(joined: DataFrame, least: float) -> DataFrame:
    both = F.size(F.array_intersect("s1", "s2"))
    sized = joined.select("id1", "id2", (both / (F.size("s1") + F.size("s2") - both)).alias("jaccard"))
    return sized.where(F.col("jaccard") >= least)


def jaccard_pairs_exact(sets: DataFrame, least: float = 0.5, key: str = "id", item: str = "token") -> DataFrame:
    """(id1, id2, jaccard) of all pairs of ids with Jaccard similarity of at least ``least``."""
    return among_members(*jaccard_classes_exact(sets, least, key, item), "1.0d")


def jaccard_in_buckets(sets: DataFrame, buckets: DataFrame, least: float = 0.5, block: int = BLOCK_IDS) -> DataFrame:
    """(id1, id2, jaccard) of all pairs of ids of at least ``least`` that share a bucket; sets: (id, t), distinct; buckets: (id, k).

    Equal sets are one, in the buckets of their least id: their ids must have the
    same buckets. Blocks of at most ``block`` ids meet in tasks, where pairs that share
    a bucket are told apart by sizes and bitmaps, and the others by their whole sets:
    only pairs of the answer leave a task.
    """
    spark = sets.sparkSession
    unlike, members = equal_sets(rarity_sets(sets))
    rows = unlike.select(F.col("rep").alias("id"), "s").join(code_lists(buckets.toDF("id", "k"), "k", "id"), "id").checkpoint()
    many, items = rows.agg(F.count("*"), F.sum(F.size("s"))).first()

    def meet(t: pa.Table, cut: int, same: bool) -> Iterator[pa.RecordBatch]:
        ids, own = t.column("id").combine_chunks(), _Prefixes(t, least)
        for u, v in alike_codes(t, cut, same, MEETS):
            for x, y, like in _shared_enough(own, own, u, v, least):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(like)], names=["id1", "id2", "jaccard"])

    pairs = _met(rows, blocks_of(spark, many, items or 0, block, 2 * PREFIX_ITEMS), meet)
    return among_members(pairs, members, "1.0d")


def verify_jaccard(candidates: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Exact similarity of candidate pairs; rows: (id, t)."""
    of = rows.groupBy("id").agg(F.collect_set("t").alias("s"))
    return _jaccard(candidates.join(of.select(F.col("id").alias("id1"), F.col("s").alias("s1")), "id1").join(of.select(F.col("id").alias("id2"), F.col("s").alias("s2")), "id2"), least)


def binary_cosine(sets: DataFrame, key: str = "item_id", item: str = "genre", digits: int | None = None) -> DataFrame:
    """(id1, id2, cosine) of one-hot vectors that share anything, rounded by way of nine places where ``digits`` says so.

    Cosines are found, and rounded, between different sets; all ids with these are put in last.
    """
    pairs, members = shared_classes(sets, item, key)
    cosine = F.col("shared") / F.sqrt(F.col("n1") * F.col("n2"))
    found = pairs.select("id1", "id2", (cosine if digits is None else F.round(F.round(cosine, 9), digits)).alias("cosine"))
    lists, few, crowded = id_lists(members)
    if lists.isEmpty():
        return found
    across = spread(found, lists, few, crowded).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "cosine")
    return across.unionByName(own_pairs(lists).select("id1", "id2", F.lit(1.0).alias("cosine")))


def inverse_user_frequency(ratings: DataFrame) -> DataFrame:
    """(item_id, iuf): log10 of all users over the item's users."""
    users = ratings.agg(F.countDistinct("user_id").alias("users"))
    of = ratings.groupBy("item_id").agg(F.countDistinct("user_id").alias("n"))
    return of.join(F.broadcast(users)).select("item_id", F.log10(F.col("users") / F.col("n")).alias("iuf"))
