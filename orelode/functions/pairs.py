"""Pairs of rows that share a key, with keys of any number of rows.

Rows are checkpointed once, narrow, and both sides of a join read them there. A
key of more than ``block`` rows is cut in blocks by a hash of the id, and every
two blocks meet under a key of their own, so no task gets a whole hot key, and
each pair is made once. Rows with a null key or id have no pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators.components import ensure_checkpoint_dir

#: Rows of a key that are joined with each other in one task.
BLOCK = 2048


def _narrow(rows: DataFrame, key: str, id_: str, values: Sequence[str]) -> DataFrame:
    """(__k, __i, __0, __1, ...) of the rows that have a key and an id."""
    ensure_checkpoint_dir(rows.sparkSession)
    named = rows.select(F.col(key).alias("__k"), F.col(id_).alias("__i"), *[F.col(v).alias(f"__{n}") for n, v in enumerate(values)])
    return named.where("__k is not null and __i is not null").checkpoint()


def _hot(rows: DataFrame, block: int) -> DataFrame:
    """(__k, __blocks) of keys with more than ``block`` rows."""
    return rows.groupBy("__k").agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks")).where("__blocks > 1")


def _side(rows: DataFrame, name: str, *also: Column) -> DataFrame:
    values = [c for c in rows.columns if c[2:].isdigit()]
    return rows.select("__k", *also, F.col("__i").alias(f"__{name}"), *[F.col(v).alias(f"__{name}{v}") for v in values])


def pairs_within(rows: DataFrame, key: str, id_: str, values: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(key, id1, id2, {value}1, {value}2) for every two rows of one key with id1 < id2."""
    narrow = _narrow(rows, key, id_, values)
    hot = _hot(narrow, block).checkpoint()
    if hot.isEmpty():
        met = _side(narrow, "a").join(_side(narrow, "b"), "__k").where("__a < __b")
        return met.select(F.col("__k").alias(key), F.col("__a").alias("id1"), F.col("__b").alias("id2"), *[F.col(f"__{s}__{n}").alias(f"{v}{k}") for n, v in enumerate(values) for k, s in ((1, "a"), (2, "b"))])
    dealt = narrow.join(hot, "__k", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    dealt = dealt.withColumn("__own", F.when(F.col("__blocks") > 1, F.pmod(F.xxhash64("__i"), F.col("__blocks"))).otherwise(0).cast("int")).checkpoint()
    low = _side(dealt, "a", F.col("__own").alias("__low"), F.explode(F.sequence(F.col("__own"), F.col("__blocks") - 1)).alias("__high"))
    high = _side(dealt, "b", F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("__low"), F.col("__own").alias("__high"))
    met = low.join(high, ["__k", "__low", "__high"]).where("__a < __b or (__low < __high and __a > __b)")
    straight = F.col("__a") < F.col("__b")
    both = [F.when(straight, F.col(f"__{x}__{n}")).otherwise(F.col(f"__{y}__{n}")).alias(f"{v}{k}") for n, v in enumerate(values) for k, x, y in ((1, "a", "b"), (2, "b", "a"))]
    return met.select(F.col("__k").alias(key), F.least("__a", "__b").alias("id1"), F.greatest("__a", "__b").alias("id2"), *both)


def pairs_between(left: DataFrame, right: DataFrame, key: str, id_: str, values: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(key, id1, id2, {value}1, {value}2) for every row on the left and every one on the right with its key; ids of the two are apart."""
    a, b = _narrow(left, key, id_, values), _narrow(right, key, id_, values)
    hot = _hot(a, block).toDF("__k", "__left").join(_hot(b, block).toDF("__k", "__right"), "__k", "full").checkpoint()
    if hot.isEmpty():
        met = _side(a, "a").join(_side(b, "b"), "__k")
    else:
        def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
            of = rows.join(hot, "__k", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__left", "__right")})
            return of.withColumns({"__own": F.pmod(F.xxhash64("__i"), F.col(own)).cast("int"), "__other": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})

        one, two = dealt(a, "__left", "__right"), dealt(b, "__right", "__left")
        met = _side(one, "a", F.col("__own").alias("__low"), F.col("__other").alias("__high")).join(_side(two, "b", F.col("__other").alias("__low"), F.col("__own").alias("__high")), ["__k", "__low", "__high"])
    straight = F.col("__a") < F.col("__b")
    both = [F.when(straight, F.col(f"__{x}__{n}")).otherwise(F.col(f"__{y}__{n}")).alias(f"{v}{k}") for n, v in enumerate(values) for k, x, y in ((1, "a", "b"), (2, "b", "a"))]
    return met.select(F.col("__k").alias(key), F.least("__a", "__b").alias("id1"), F.greatest("__a", "__b").alias("id2"), *both)


def pairs_with(rows: DataFrame, asked: DataFrame | None, key: str, id_: str, values: Sequence[str] = ()) -> DataFrame:
    """As ``pairs_within``, for the pairs with at least one of the ids of ``asked`` (id): no other is made."""
    if asked is None:
        return pairs_within(rows, key, id_, values)
    ensure_checkpoint_dir(rows.sparkSession)
    wanted = asked.select(F.col(asked.columns[0]).alias("__asked")).distinct().withColumn("__is", F.lit(True))
    marked = rows.select(key, id_, *values).join(wanted, F.col(id_) == F.col("__asked"), "left").withColumn("__is", F.coalesce("__is", F.lit(False))).drop("__asked").checkpoint()
    these, others = marked.where("__is").drop("__is"), marked.where("not __is").drop("__is")
    pairs = pairs_within(these, key, id_, values)
    return pairs if others.isEmpty() else pairs.unionByName(pairs_between(these, others, key, id_, values))


#: Rows of pairs that a task takes, which its sums hold at once, and of how many such tasks one makes the lists.
TASK_PAIRS, TASK_LISTS = 1 << 19, 8


def pairs_around(rows: DataFrame, key: str, id_: str, values: Sequence[str] = (), half: bool = False, asked: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(id1, id2, {value}1, {value}2) for every row and every other one of its key, dealt by id1; with ``half``, only id1 < id2.

    A row travels to its id's task with the list of its key's others, so a pair costs
    no more than one id and its values there, and what is grouped by id1, or by id1
    and id2, has no further exchange. Tasks get about ``TASK_PAIRS`` pairs, and those
    that send lists have so many of them that what they send isn't spilled. With
    ``asked`` (id), id1 is one of these, or with ``half`` one of the two is; rows are
    marked for that while they are narrow, so no list is dealt but to its id.
    """
    narrow = _narrow(rows, key, id_, values)
    names = [c for c in narrow.columns if c[2:].isdigit()]
    sizes = narrow.groupBy("__k").agg(F.count("*").alias("__n"))
    met, most = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__n")), F.max("__n")).first()
    tasks = max(narrow.sparkSession.sparkContext.defaultParallelism, int((met or 0) / (2 if half else 1) / TASK_PAIRS) + 1)
    mark = [] if asked is None else ["__asked"]
    if mark:
        wanted = asked.select(F.col(asked.columns[0]).alias("__i")).distinct().withColumn("__asked", F.lit(True))
        narrow = narrow.join(wanted, "__i", "left").withColumn("__asked", F.coalesce("__asked", F.lit(False)))

    def carriers(of: DataFrame) -> DataFrame:
        return of if half or not mark else of.where("__asked")

    def listed(of: DataFrame, *by: str) -> DataFrame:
        return of.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__i", *names, *mark))).alias("__l"))

    def company_of(others: Column, own: Column) -> Column:
        """Those of a list that a row of an id that isn't asked for meets."""
        return F.when(own, others).otherwise(F.filter(others, lambda x: x["__asked"])) if half and mark else others

    lists = [F.col(f"__l.{c}").alias(f"__{c}s") for c in ("__i", *names)]
    hot = (most or 0) > block
    if hot:
        blocks = sizes.where(F.col("__n") > block).select("__k", F.ceil(F.col("__n") / block).cast("int").alias("__blocks")).checkpoint()
        dealt = narrow.join(blocks, "__k").withColumn("__own", F.pmod(F.xxhash64("__i"), F.col("__blocks")).cast("int")).checkpoint()
        every = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
        cut = listed(dealt, "__k", "__own", "__blocks").select("__k", every.alias("__low"), F.col("__own").alias("__high"), "__l")
        crowd = carriers(dealt).select("__k", F.col("__own").alias("__low"), every.alias("__high"), "__i", *names, *mark).join(cut, ["__k", "__low", "__high"])
        crowd = crowd.withColumn("__l", F.filter("__l", lambda x: x["__i"] > F.col("__i"))) if half else crowd
        crowd = crowd.withColumn("__l", company_of(F.col("__l"), F.col("__asked"))) if half and mark else crowd
        crowd = crowd.where(F.size("__l") > 0).select("__i", *names, *lists)
        narrow = narrow.join(blocks.select("__k"), "__k", "left_anti")
    each = listed(narrow.repartition(max(narrow.sparkSession.sparkContext.defaultParallelism, tasks // TASK_LISTS), "__k"), "__k").where(F.size("__l") > 1)
    if half and mark:
        each = each.select("__l", F.posexplode("__l").alias("__p", "__r"))
        rest = company_of(F.slice("__l", F.col("__p") + 2, F.size("__l")), F.col("__r.__asked"))
        company = each.select("__r.*", rest.alias("__l")).where(F.size("__l") > 0).select("__i", *names, *lists)
    else:
        each = each.select(*lists, F.posexplode("__l").alias("__p", "__r"))
        rest = (lambda c: F.slice(c, F.col("__p") + 2, F.size(c))) if half else F.col
        company = each.where(F.col("__p") + 1 < F.size("____is")) if half else each
        company = carriers(company.select("__r.*", *[rest(f"__{c}s").alias(f"__{c}s") for c in ("__i", *names)])).drop(*mark)
    sent = (company.unionByName(crowd) if hot else company).repartition(tasks, "__i")
    at = sent.select(F.col("__i").alias("id1"), *[F.col(c).alias(f"{v}1") for c, v in zip(names, values)], *[f"__{c}s" for c in names], F.posexplode("____is").alias("__p", "id2"))
    return at.where("id1 < id2" if half else "id1 <> id2").select("id1", "id2", *[x for c, v in zip(names, values) for x in (F.col(f"{v}1"), F.col(f"__{c}s")[F.col("__p")].alias(f"{v}2"))])


#: Ids and keys of a block of ``shared_counts`` at most, ids that are counted at once, and columns of a matrix.
BLOCK_IDS, BLOCK_KEYS, STRIPE, COLUMNS = 65536, 1 << 22, 2048, 4096
#: A key counts as a column of a matrix where more than one in so many of a stripe's rows have it, else pair by pair.
DENSE = 128
#: Where more than one in so many places of a matrix is set, a product of matrices is faster than sums of rows.
FULL = 8


def _counted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], keys: int, columns: int, least_dense: int, full: int = FULL) -> np.ndarray:
    """Keys in common of every row of a and every one of b, which are (row, key) by row; row numbers are from 0."""
    (ra, ka), (rb, kb) = a, b
    na, nb = int(ra[-1]) + 1, int(rb[-1]) + 1
    many = np.bincount(ka, minlength=keys), np.bincount(kb, minlength=keys)
    met = many[0] * many[1]
    dense = np.flatnonzero((met > 0) & (many[1] * least_dense > nb))
    most = int(min(np.bincount(ra).max(), np.bincount(rb).max()))
    out = np.zeros((na, nb), np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
    column = np.full(keys, -1)
    column[dense] = np.arange(len(dense))
    ca, cb = column[ka], column[kb]
    for at in range(0, len(dense), columns):
        width = min(columns, len(dense) - at)
        (xa, ya), (xb, yb) = ((r[here], c[here] - at) for r, c, here in ((ra, ca, (ca >= at) & (ca < at + width)), (rb, cb, (cb >= at) & (cb < at + width))))
        if len(xa) * full < na * width:
            has = np.zeros((width, nb), out.dtype)
            has[yb, xb] = 1
            ends = np.searchsorted(xa, np.arange(na + 1))
            for row in np.unique(xa):
                out[row] += np.add.reduce(has[ya[ends[row] : ends[row + 1]]], axis=0, dtype=out.dtype)
        else:
            sides = []
            for x, y, n in ((xa, ya, na), (xb, yb, nb)):
                m = np.zeros((n, width), np.float32)
                m[x, y] = 1
                sides.append(m)
            out += (sides[0] @ sides[1].T).astype(out.dtype)
    rare = (ca < 0) & (met[ka] > 0)
    if rare.any():
        r, k = ra[rare], ka[rare]
        order = np.argsort(kb, kind="stable")
        first = np.append(0, np.cumsum(many[1]))[k]
        n = many[1][k]
        ends = np.cumsum(n)
        for lo, hi in _runs(ends, 1 << 22):
            size = n[lo:hi]
            at = np.repeat(first[lo:hi] - (ends[lo:hi] - size - (ends[lo - 1] if lo else 0)), size) + np.arange(int(size.sum()))
            np.add.at(out.reshape(-1), np.repeat(r[lo:hi], size) * nb + rb[order[at]], out.dtype.type(1))
    return out


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` in sum, by running sums."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _stripes(lists: pa.ListArray, stripe: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(first row, (row, key)) of every ``stripe`` rows."""
    for at in range(0, len(lists), stripe):
        part = lists.slice(at, stripe)
        sizes = part.value_lengths().to_numpy()
        yield at, (np.repeat(np.arange(len(sizes)), sizes), part.flatten().to_numpy())


def blocks_of(spark: SparkSession, ids: int, keys: int, block: int, block_keys: int) -> int:
    """Blocks of at most so many ids and keys, and enough for every two of them to keep the cores at work."""
    return max(1, min(int((4 * spark.sparkContext.defaultParallelism) ** 0.5), ids // 256), -(-ids // block), -(-keys // block_keys))


def blocks_met(rows: DataFrame, blocks: int, meet: Callable[[pa.Table, int, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``meet`` gives for every two blocks of rows, dealt by a hash of ``id``: their table, how many rows are the first's, and whether it is the only one.

    Blocks are written once to the shared folder, and tasks read their two from there:
    what is dealt and written doesn't grow with the number of blocks.
    """
    spark = rows.sparkSession
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")
    rows.select("*", own).repartition(blocks, "own").sortWithinPartitions("own", "id").write.partitionBy("own").parquet(at)

    def block(k: int) -> pa.Table | None:
        files, path = pafs.FileSystem.from_uri(at)
        if files.get_file_info(f"{path}/own={k}").type == pafs.FileType.NotFound:
            return None  # no row has this hash
        return pq.read_table(f"{path}/own={k}", filesystem=files, partitioning=None)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("id").to_pylist():
                high = (math.isqrt(8 * n + 1) - 1) // 2
                low = n - high * (high + 1) // 2
                first = block(low)
                second = first if low == high else block(high)
                if first is None or second is None:
                    continue
                yield from meet(first if low == high else pa.concat_tables([first, second]), len(first), low == high)

    ways = blocks * (blocks + 1) // 2
    return spark.range(0, ways, 1, ways).mapInArrow(met, schema)


def alike_codes(t: pa.Table, cut: int, same: bool, meets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two blocks that share a code of their lists ``ks``, each pair once; a code is two numbers that follow each other, met by the first."""
    lists = t.column("ks").combine_chunks()
    many = lists.value_lengths().to_numpy().astype(np.int64) // 2
    row = np.repeat(np.arange(len(many)), many)
    codes = lists.flatten().to_numpy().reshape(-1, 2)
    edge = int(many[:cut].sum())
    asks, left = row[:edge], codes[:edge]
    of, right = (asks, left) if same else (row[edge:], codes[edge:])
    order = np.argsort(right[:, 0], kind="stable")
    of, (right, second), (left, other) = of[order], right[order].T.copy(), left.T.copy()
    first = np.searchsorted(right, left, "left")
    size = np.searchsorted(right, left, "right") - first
    own = np.append(0, np.cumsum(size))
    ends = np.append(0, np.cumsum(many[:cut]))
    for lo, hi in _runs(own[ends[1:]], meets):
        a, b = ends[lo], ends[hi]
        at = np.repeat(first[a:b] - own[a:b], size[a:b]) + np.arange(own[a], own[b])
        u, v = np.repeat(asks[a:b], size[a:b]), of[at]
        met = np.repeat(other[a:b], size[a:b]) == second[at]
        if same:
            met &= u < v
        u, v = np.divmod(distinct(u[met] * len(many) + v[met]), len(many))
        if len(u):
            yield u, v


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Numbers in order, each once; numpy's own way over a table of hashes takes some forty times as long."""
    found = np.sort(numbers)
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def code_lists(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """(id, ks): each id's keys, of any type, as codes of 128 bits."""
    code = F.array(F.xxhash64(key), F.xxhash64(F.lit(1), key))
    return rows.where(F.col(key).isNotNull() & F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(F.flatten(F.collect_list(code)).alias("ks"))


#: Codes of a block of ids, and places where two blocks meet that are looked at together.
CODES, MEETS = 1 << 22, 1 << 22


def pairs_of_codes(rows: DataFrame, key: str, id_: str, block: int = BLOCK_IDS) -> DataFrame:
    """(id1, id2) for every two ids that share a key, each once, id1 < id2.

    Ids with few keys each, of which many are shared: ids meet in blocks, and no pair
    is dealt or kept, so all but the answer grows with the rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    lists = code_lists(rows, key, id_).checkpoint()
    ids, codes = lists.agg(F.count("*"), F.sum(F.size("ks") / 2).cast("bigint")).first()

    def meet(t: pa.Table, cut: int, same: bool) -> Iterator[pa.RecordBatch]:
        names = t.column("id").combine_chunks()
        for u, v in alike_codes(t, cut, same, MEETS):
            for lo in range(0, len(u), 1 << 19):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x[lo : lo + (1 << 19)])) for x in (u, v)], names=["id1", "id2"])

    kind = lists.schema["id"].dataType.simpleString()
    met = blocks_met(lists, blocks_of(rows.sparkSession, ids, codes or 0, block, CODES), meet, f"id1 {kind}, id2 {kind}")
    return met.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))


def shared_classes(rows: DataFrame, key: str, id_: str, least: int = 1, block: int = BLOCK_IDS, stripe: int = STRIPE, columns: int = COLUMNS, dense: int = DENSE, full: int = FULL, block_keys: int = BLOCK_KEYS) -> tuple[DataFrame, DataFrame]:
    """((id1, id2, shared, n1, n2), (rep, id, n)): every two different sets of keys with at least ``least`` in common, each named by its least id, and who has each set of at least ``least`` keys, of n.

    Where keys are few and common, pairs by key are many times the pairs of ids. So
    ids are dealt in blocks by a hash, and every two blocks meet in a task, which
    counts by 0/1 matrices, stripe by stripe: nothing is summed over tasks, and
    neither a common key nor an id with many changes where rows go. Blocks are as large as a task can hold, and no more
    than keep all cores at work. Repeated rows count once. Ids with equal keys are
    one: work grows with the square of different sets.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    narrow = rows.select(F.col(key).alias("k"), F.col(id_).alias("id")).where("k is not null and id is not null").distinct().checkpoint()
    from orelode.functions.ordered import ranked

    numbers = ranked(narrow.select("k").distinct(), [F.col("k")], "x").select("k", F.col("x").cast("int").alias("x"))
    lists = narrow.join(numbers, "k").groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") >= least)
    named = lists.withColumn("name", F.unhex(F.sha2(F.array_join(F.transform("xs", lambda x: x.cast("string")), ","), 256))).checkpoint()
    sets = named.groupBy("name").agg(F.min("id").alias("id"), F.min_by("xs", "id").alias("xs")).checkpoint()
    members = named.select("id", "name").join(sets.select("name", F.col("id").alias("rep"), F.size("xs").cast("bigint").alias("n")), "name").select("rep", "id", "n").checkpoint()
    sets = sets.select("id", "xs")
    blocks = blocks_of(spark, *[n or 0 for n in sets.agg(F.count("*"), F.sum(F.size("xs"))).first()], block, block_keys)

    def count(t: pa.Table, cut: int, same: bool) -> Iterator[pa.RecordBatch]:
        ids, xs = (t.column(c).combine_chunks() for c in ("id", "xs"))
        kinds, codes = np.unique(xs.flatten().to_numpy(), return_inverse=True)
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(xs.value_lengths().to_numpy())).astype(np.int32), pa.array(codes))
        sizes = lists.value_lengths().to_numpy()
        first = list(_stripes(lists.slice(0, cut), stripe))
        second = first if same else [(cut + at, s) for at, s in _stripes(lists.slice(cut), stripe)]
        for at, a in first:
            for to, b in second:
                if to < at:
                    continue
                found = _counted(a, b, len(kinds), columns, dense, full)
                i, j = np.divmod(np.flatnonzero((np.triu(found, 1) if to == at else found) >= least), found.shape[1])
                for lo in range(0, len(i), 1 << 19):
                    x, y = i[lo : lo + (1 << 19)], j[lo : lo + (1 << 19)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(x + at)), ids.take(pa.array(y + to)), pa.array(found[x, y].astype(np.int64)), pa.array(sizes[x + at].astype(np.int64)), pa.array(sizes[y + to].astype(np.int64))],
                        names=["id1", "id2", "shared", "n1", "n2"],
                    )

    kind = sets.schema["id"].dataType.simpleString()
    pairs = blocks_met(sets, blocks, count, f"id1 {kind}, id2 {kind}, shared bigint, n1 bigint, n2 bigint")
    straight = F.col("id1") < F.col("id2")
    n1, n2 = (F.when(straight, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("n1", "n2"), ("n2", "n1")))
    return pairs.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "shared", n1, n2), members


#: Ids of a class that stand in one list, and ids in lists that are broadcast at most: 64 MB.
LIST_IDS, BROADCAST_IDS = 1024, 1 << 23
#: From so many pairs of ids that a pair of classes stands for on average, pairs of classes are dealt out before these are made.
CROWDED = 16


def id_lists(members: DataFrame, lone: bool = False) -> tuple[DataFrame, bool, bool]:
    """((rep, part, ids), whether they are few, whether most are in classes of several): who is in each class of (rep, id), in lists of a bounded length; without classes of one, unless ``lone``."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("c")).checkpoint()
    classes, ids, listed = sizes.agg(F.count("*"), F.sum("c"), F.sum(F.when(F.lit(lone) | (F.col("c") > 1), F.col("c")))).first()
    placed = members.join(sizes.where(F.lit(lone) | (F.col("c") > 1)), "rep").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / LIST_IDS)))
    lists = placed.groupBy("rep", "part").agg(F.collect_list("id").alias("ids")).checkpoint()
    return lists, (listed or 0) <= BROADCAST_IDS, (ids or 0) ** 2 >= CROWDED * classes**2 > 0


def spread(pairs: DataFrame, lists: DataFrame, few: bool, crowded: bool, one: str = "id1", two: str = "id2") -> DataFrame:
    """Rows of pairs of classes as a row for every two of their ids, which are made last.

    Where ``lists`` are few, pairs stay where they are; where they are ``crowded``, a
    few pairs make most rows, so every two lists are dealt out first, without their ids.
    """
    side = F.broadcast if few else lambda rows: rows
    rest = [c for c in pairs.columns if c not in (one, two)]
    for c in (one, two):
        pairs = pairs.join(side(lists.select(F.col("rep").alias(c), F.col("part").alias(f"__part_{c}"))), c, "left")
    if crowded:
        pairs = pairs.repartition(8 * pairs.sparkSession.sparkContext.defaultParallelism)
    for c in (one, two):
        pairs = pairs.join(side(lists.select(F.col("rep").alias(c), F.col("part").alias(f"__part_{c}"), F.col("ids").alias(f"__{c}"))), [c, f"__part_{c}"], "left")
    for c in (one, two):
        pairs = pairs.withColumn(f"__{c}", F.coalesce(f"__{c}", F.array(c)))
    first = pairs.select(F.explode(f"__{one}").alias(one), f"__{two}", *rest)
    return first.select(one, F.explode(f"__{two}").alias(two), *rest)


def own_pairs(lists: DataFrame, *rest: str) -> DataFrame:
    """(id1, id2) of every two ids of one class, id1 < id2, with what else a list's row has."""
    a, b = lists.select("rep", "part", "ids", *rest), lists.select("rep", F.col("part").alias("to"), F.col("ids").alias("others"))
    met = a.join(b, "rep").where("part <= to").select(F.explode("ids").alias("x"), "others", F.expr("part = to").alias("same"), *rest)
    met = met.select("x", F.explode("others").alias("y"), "same", *rest).where("x < y or (x > y and not same)")
    return met.select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), *rest)


def shared_counts(rows: DataFrame, key: str, id_: str, least: int = 1, *how: int, **more: int) -> DataFrame:
    """(id1, id2, shared, n1, n2) for every two ids, id1 < id2, with at least ``least`` keys in common; n1 and n2 are how many each has.

    ``shared_classes`` for all their ids, which are put in last: no exchange gets them.
    """
    pairs, members = shared_classes(rows, key, id_, least, *how, **more)
    return among_classes(pairs, members)


def among_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id1, id2, shared, n1, n2) of all ids from what ``shared_classes`` gives."""
    lists, few, crowded = id_lists(members)
    if lists.isEmpty():
        return pairs
    straight = F.col("id1") < F.col("id2")
    n1, n2 = (F.when(straight, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("n1", "n2"), ("n2", "n1")))
    across = spread(pairs, lists, few, crowded).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "shared", n1, n2)
    sizes = members.groupBy("rep").agg(F.first("n").alias("n"))
    within = own_pairs(lists.join(sizes, "rep"), "n")
    return across.unionByName(within.select("id1", "id2", F.col("n").alias("shared"), F.col("n").alias("n1"), F.col("n").alias("n2")))
