"""Adaptive time partitions of a table, as sorted Parquet files (operator 11).

Rows are counted by the hour of their moment in one aggregation; a dense array of
prefix sums over the hours gives every calendar node's count as a difference. On it
the layout is found: from a run's start, ``searchsorted`` on the sums at its
siblings' borders jumps to the run's end, and nodes above the limit are split into
months, days and hours. The leaves' sorted first hours are the breakpoints that
route rows, batch by batch, by bisection. Array and breakpoints grow with the
calendar span and the number of leaves, not with the rows.

Only leaves above the limit, single hours and null moments, have several parts:
their rows are ranked over all tasks by moment, arrival, id and then all other
columns. A file is a leaf's part; files are dealt to tasks by the running sum of
their rows, so tasks get even shares, and a file is written by one task as a stream.

Rewriting keeps the files whose leaf, part and rows recur. A leaf of one part does
so where its name and its count recur, as rows are only added; parts of other leaves
are compared by count and by two sums of hashes of their rows. What other files held
is read from them, new rows from the table with the filter pushed down; stale files
go when the new ones are written.

Cases: rows without a moment are a leaf of their own; a null arrival comes before
all others and counts as not arrived by the start. Repeated rows stay repeated.
Without rows there is no file. Other columns are written with the rest; the names
of the folders avoid theirs. Long texts are written whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.ordered import running_sums
from orelode.llm.common import crc_mod, cut_lineage, partitions, shared_dir, table

#: A leaf and part of a whole table: about so many make up its rows.
SHARES = 800
NULL_LEAF = "null"
#: Units of the calendar from the top, as numpy and names write them.
UNITS = (("Y", "{0}"), ("M", "{1:02d}"), ("D", "{2:02d}"), ("h", "{3:02d}"))


@dataclass(frozen=True)
class Layout:
    """Leaves in order of time; ``starts`` are the first hours of leaves and of what lies between them, whose leaf is -1."""

    limit: int
    names: list[str]
    counts: list[int]
    edges: list[tuple[int, int]]
    starts: np.ndarray
    leaf: np.ndarray
    nulls: int

    def route(self, hours: np.ndarray) -> np.ndarray:
        return self.leaf[np.searchsorted(self.starts, hours, side="right") - 1]


class HourCounts:
    """Dense prefix sums of rows by hour since 1970."""

    def __init__(self, hours: np.ndarray, counts: np.ndarray):
        years = hours.astype("datetime64[h]").astype("datetime64[Y]")
        self.years = np.arange(years.min(), years.max() + 2) if len(hours) else np.zeros(0, "datetime64[Y]")
        edges = self.years.astype("datetime64[h]").astype(np.int64)
        self.first = int(edges[0]) if len(edges) else 0
        dense = np.zeros(int(edges[-1]) - self.first if len(edges) else 0, np.int64)
        np.add.at(dense, hours - self.first, counts)
        self.sums = np.concatenate([[0], np.cumsum(dense)])

    def upto(self, hours: np.ndarray) -> np.ndarray:
        return self.sums[hours - self.first]


def _pieces(counts: HourCounts, nodes: np.ndarray, unit: int, limit: int, above: str) -> Iterator[tuple[str, int, int, int]]:
    """(leaf, first hour, hour after the last, rows) of the runs of siblings, and of what the siblings above the limit are split into; ``nodes`` has the border after the last."""
    edges = nodes.astype("datetime64[h]").astype(np.int64)
    sums = counts.upto(edges)
    i = 0
    while i < len(nodes) - 1:
        end = int(np.searchsorted(sums, sums[i] + limit, side="right")) - 1
        if end == i and unit < len(UNITS) - 1:
            step = UNITS[unit + 1][0]
            inside = np.arange(nodes[i].astype(f"datetime64[{step}]"), nodes[i + 1].astype(f"datetime64[{step}]") + 1)
            yield from _pieces(counts, inside, unit + 1, limit, f"{above}{_member(nodes[i], unit)}/")
            i += 1
            continue
        end = max(end, i + 1)
        yield f"{above}{_member(nodes[i], unit)}-{_member(nodes[end - 1], unit)}", int(edges[i]), int(edges[end]), int(sums[end] - sums[i])
        i = end


def _member(node: np.datetime64, unit: int) -> str:
    at = node.astype("datetime64[h]")
    year, month, day = str(at.astype("datetime64[D]")).rsplit("-", 2)
    return UNITS[unit][1].format(year, int(month), int(day), int(at.astype(np.int64) % 24))


def layout(counts: HourCounts, nulls: int, limit: int) -> Layout:
    """The leaves of a table with these counts."""
    pieces = list(_pieces(counts, counts.years, 0, limit, "")) if len(counts.years) else []
    leaves = [p for p in pieces if p[3]]
    number = {p[0]: k for k, p in enumerate(leaves)}
    starts = np.array([np.iinfo(np.int64).min, *(p[1] for p in pieces)], np.int64)
    names, rows, edges = [p[0] for p in leaves], [p[3] for p in leaves], [p[1:3] for p in leaves]
    if nulls:
        names, rows, edges = [*names, NULL_LEAF], [*rows, nulls], [*edges, (0, 0)]
    return Layout(limit, names, rows, edges, starts, np.array([-1, *(number.get(p[0], -1) for p in pieces)], np.int64), nulls)


@dataclass(frozen=True)
class Files:
    """The files of a layout, in order of leaf and part."""

    of: Layout
    first: np.ndarray
    leaf: list[int]
    part: list[int]
    rows: list[int]

    @classmethod
    def of_layout(cls, of: Layout) -> Files:
        whole = [(k, p + 1, min(of.limit, n - p * of.limit)) for k, n in enumerate(of.counts) for p in range(-(-n // of.limit))]
        leaf, part, rows = ([w[k] for w in whole] for k in range(3))
        return cls(of, np.searchsorted(np.array(leaf, np.int64), np.arange(len(of.counts))), leaf, part, rows)

    def names(self) -> list[tuple[str, int]]:
        return [(self.of.names[k], p) for k, p in zip(self.leaf, self.part)]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be none of df's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _hours(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which are null, and hours with 0 for these."""
    return col.is_null().to_numpy(zero_copy_only=False), col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class TimeParts:
    """Adaptive time partitions of a table in a folder.

    ``moment`` is a timestamp without a zone, by which rows are dealt; rows of a
    leaf follow it, ``order``, and then all columns. ``limit`` is the most rows of
    a file. ``old`` says which rows are there at the start.
    """

    def __init__(self, rows: DataFrame, moment: Column, order: list[str], limit: int, folder: str, old: Column):
        self.spark, self.table, self.limit, self.folder = rows.sparkSession, rows, limit, folder
        self.moment, self.hour, self.old, self.file, self.place, self.was = free_names(rows, "moment", "hour", "old", "file", "place", "was")
        self.names = free_names(rows, "leaf", "part")
        self.of_moment, self.is_old = moment, F.coalesce(old, F.lit(False))
        self.order = [self.moment, *order, *[f.name for f in rows.schema.fields if f.name not in order and f.dataType.typeName() not in ("map", "variant")]]

    def timed(self, rows: DataFrame) -> DataFrame:
        at = F.col(self.moment)
        return rows.withColumns({self.moment: self.of_moment, self.old: self.is_old}).withColumn(self.hour, F.unix_date(at.cast("date")).cast("bigint") * 24 + F.hour(at))

    def layouts(self) -> tuple[Files, Files]:
        """The files at the start, and of all rows."""
        got = self.timed(self.table).groupBy(F.col(self.hour).alias("hour")).agg(F.count("*").alias("n"), F.count_if(self.old).alias("old")).toArrow()
        none, hour = _hours(got.column("hour").combine_chunks())
        out = []
        for rows in (got.column("old").to_numpy(), got.column("n").to_numpy()):
            some = ~none & (rows > 0)
            out.append(Files.of_layout(layout(HourCounts(hour[some], rows[some]), int(rows[none].sum()), self.limit)))
        return out[0], out[1]

    def of_many(self, after: Files) -> Column:
        """Whether a row's leaf has several parts in the layout of all rows; there are at most as many such leaves as the table has limits."""
        many = [k for k, n in enumerate(after.of.counts) if n > self.limit]
        hours = [after.of.edges[k][0] for k in many if after.of.names[k] != NULL_LEAF]
        known = F.col(self.hour).isin(hours) if hours else F.lit(False)
        return F.when(F.col(self.hour).isNull(), F.lit(len(hours) < len(many))).otherwise(known)

    def ranked(self, rows: DataFrame) -> DataFrame:
        """Rows with their places in their hour, from 1, among all and among the old; null is an hour."""
        tie, first, ahead, of = free_names(rows, "tie", "first", "ahead", "of")
        numbered = running_sums(rows.withColumn(tie, F.monotonically_increasing_id()), [F.col(c) for c in (self.hour, *self.order, tie)], {self.place: F.lit(1).cast("bigint"), self.was: F.col(self.old).cast("bigint")})
        numbered = cut_lineage(numbered.drop(tie))
        offsets = numbered.groupBy(F.col(self.hour).alias(of)).agg(F.min(F.col(self.place) - 1).alias(first), F.min(F.col(self.was) - F.col(self.old).cast("bigint")).alias(ahead))
        joined = numbered.join(F.broadcast(offsets), F.col(self.hour).eqNullSafe(F.col(of)))
        return joined.withColumns({self.place: F.col(self.place) - F.col(first), self.was: F.col(self.was) - F.col(ahead)}).drop(first, ahead, of)

    def routed(self, rows: DataFrame, files: Files, rank: str | None = None) -> DataFrame:
        """Rows with the number of their file; ``rank`` is a row's place in its leaf where that may have several parts."""
        of, first, limit = files.of, files.first, self.limit

        @F.arrow_udf("bigint")
        def file(hours: pa.Array, ranks: pa.Array) -> pa.Array:
            none, at = _hours(hours)
            leaf = np.where(none, len(of.names) - 1, of.route(at))
            return pa.array(first[leaf] + (ranks.to_numpy(zero_copy_only=False).astype(np.int64) - 1) // limit)

        ranks = F.lit(1).cast("bigint") if rank is None else F.col(rank)
        return rows.withColumn(self.file, file(F.col(self.hour), ranks)).select(self.file, self.moment, *[F.col(f"`{c}`") for c in self.table.columns])

    def write(self, rows: DataFrame, files: Files, which: list[int]) -> None:
        """Writes the files of ``which`` from routed rows."""
        if not which:
            return
        sizes = np.array([files.rows[k] for k in which], np.int64)
        tasks = min(partitions(self.spark), len(which))
        task = np.minimum((np.cumsum(sizes) - sizes) * tasks // max(int(sizes.sum()), 1), tasks - 1)
        number, to = free_names(rows, "number", "to")
        named = [(k, int(t), files.of.names[files.leaf[k]].replace("/", "."), files.part[k]) for k, t in zip(which, task)]
        plan = self.spark.createDataFrame(named, f"`{number}` bigint, `{to}` int, `{self.names[0]}` string, `{self.names[1]}` int")
        dealt = rows.join(F.broadcast(plan), F.col(self.file) == F.col(number)).repartitionById(tasks, F.col(to)).sortWithinPartitions(*self.names, *self.order)
        columns = [F.col(f"`{c}`") for c in (*self.table.columns, *self.names)]
        dealt.select(*columns).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(*self.names).parquet(self.folder)

    def paths(self) -> dict[tuple[str, int], str]:
        """The folder's data files by leaf and part."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return {}
        out = {}
        for path in self.spark.read.schema(self.table.schema).parquet(self.folder).inputFiles():
            leaf, part = (x.split("=", 1)[1] for x in path.split("/")[-3:-1])
            out[leaf.replace(".", "/"), int(part)] = path
        return out

    def delete(self, paths: list[str]) -> None:
        """Deletes files of the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for at in paths:
            fs.delete(path(at), False)

    def recurring(self, before: Files, after: Files, many: DataFrame | None) -> set[tuple[str, int]]:
        """Leaf and part of the starting files whose rows are those of a final file."""
        was = dict(zip(before.of.names, before.of.counts))
        single = {(n, 1) for n, rows in zip(after.of.names, after.of.counts) if rows <= self.limit and was.get(n) == rows}
        if many is None:
            return single
        hashes = [F.sum(F.xxhash64(F.lit(seed), *[F.col(c) for c in self.order]).cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]

        def prints(rows: DataFrame, rank: str) -> dict[tuple[int | None, int], tuple]:
            part = F.floor((F.col(rank) - 1) / self.limit) + 1
            return {(r[0], r[1]): tuple(r[2:]) for r in rows.groupBy(self.hour, part.alias("__part")).agg(F.count("*").alias("n"), *hashes).collect()}

        start, final = prints(many.where(F.col(self.old)), self.was), prints(many, self.place)
        name = {None if n == NULL_LEAF else e[0]: n for n, e, rows in zip(after.of.names, after.of.edges, after.of.counts) if rows > self.limit}
        return single | {(name[h], p) for (h, p), of in final.items() if name[h] in was and start.get((h, p)) == of}

    def write_then_rewrite(self) -> tuple[set[tuple[str, int]], dict[tuple[str, int], str]]:
        """Writes the old rows, then brings the folder to the layout of all rows; the files that stayed, and the paths of all, by leaf and part."""
        before, after = self.layouts()
        of_many = self.of_many(after)
        rows = self.timed(self.table)
        many = cut_lineage(self.ranked(rows.where(of_many))) if max(after.of.counts, default=0) > self.limit else None

        def parted(cold: DataFrame, hot: DataFrame | None, files: Files, rank: str) -> DataFrame:
            out = self.routed(cold.where(~of_many), files)
            return out if hot is None else out.unionByName(self.routed(hot, files, rank))

        old = F.col(self.old)
        self.write(parted(rows.where(old), None if many is None else many.where(old), before, self.was), before, [*range(len(before.rows))])
        stayed, start = self.recurring(before, after, many), self.paths()
        stale = [path for name, path in start.items() if name not in stayed]
        cold = rows.where(~old)
        if stale:
            cold = cold.unionByName(self.timed(self.spark.read.schema(self.table.schema).parquet(*stale)))
        self.write(parted(cold, many, after, self.place), after, [k for k, name in enumerate(after.names()) if name not in stayed])
        self.delete(stale)
        return stayed, self.paths()

    def stored(self, *columns: Column) -> DataFrame:
        """(leaf, part, row, ...): the rows in the folder with the names and order of their files."""
        inside = rf"/{self.names[0]}=([^/]*)/{self.names[1]}=(\d+)/"
        path = F.col("_metadata.file_path")
        leaf, part = F.replace(F.regexp_extract(path, inside, 1), F.lit("."), F.lit("/")), F.regexp_extract(path, inside, 2).cast("bigint")
        read = self.spark.read.schema(self.table.schema).parquet(self.folder)
        return read.select(leaf.alias("leaf"), part.alias("part"), F.col("_metadata.row_index").alias("row"), *columns)


def moment(id_: str = "click_id", ts: str = "ts") -> Column:
    """The moment of a row: its time, moved back by up to 26 years for an eighth of the ids, and to the Monday's start for another."""
    at, k = F.col(ts).cast("timestamp_ntz"), crc_mod(id_, 128).cast("int")
    day = at.cast("date")
    return F.when(k < 16, at - F.make_dt_interval(F.pow(k + 6, F.lit(3)).cast("int"))).when(k > 111, F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")).otherwise(at)


def _digest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, part, ids_sha256, n_rows, n_new) of (leaf, part, id, new) rows that are sorted by file and row."""
    key, hashed, n, new = None, None, 0, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"leaf": [key[0]], "part": pa.array([key[1]], pa.int64()), "ids_sha256": [hashed.hexdigest()], "n_rows": [n], "n_new": [new]})

    for b in batches:
        leaf, part, ids, is_new = (b.column(c) for c in ("leaf", "part", "id", "new"))
        begins = np.flatnonzero(np.concatenate([[True], _differs(leaf) | _differs(part)])) if b.num_rows else []
        for i, j in zip(begins, [*begins[1:], b.num_rows]):
            this = (leaf[i].as_py(), part[i].as_py())
            if this != key:
                if key is not None:
                    yield done()
                key, hashed, n, new = this, hashlib.sha256(), 0, 0
            hashed.update((("," if n else "") + ",".join(ids.slice(i, j - i).to_pylist())).encode())
            n, new = n + int(j - i), new + is_new.slice(i, j - i).true_count
    if key is not None:
        yield done()


def _differs(col: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before."""
    import pyarrow.compute as pc

    return pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False).astype(bool) if len(col) > 1 else np.zeros(0, bool)


def op11_timeparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of clicks, written for what had arrived by April 2024 and rewritten for all rows."""
    clicks = table(spark, sf_dir, "clicks")
    old = F.col("arrived_at") < F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")
    parts = TimeParts(clicks, moment(), ["arrived_at", "click_id"], 1 + clicks.count() // SHARES, f"{shared_dir(spark).rstrip('/')}/timeparts-{uuid.uuid4().hex}", old)
    stayed, paths = parts.write_then_rewrite()
    return described(parts, stayed, paths, "click_id")


def described(parts: TimeParts, stayed: set[tuple[str, int]], paths: dict[tuple[str, int], str], id_: str) -> DataFrame:
    """(leaf, part, columns, ids_sha256, path, n_rows, n_new, rewritten) of every file in the folder."""
    spark = parts.spark
    known = spark.createDataFrame([(*name, path, name not in stayed) for name, path in paths.items()], "leaf string, part bigint, path string, rewritten boolean")
    if not paths:
        return known.select("leaf", "part", F.lit("").alias("columns"), F.lit("").alias("ids_sha256"), "path", F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("n_new"), "rewritten")
    rows = parts.stored(F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("id"), (~parts.is_old).alias("new"))
    dealt = rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "row").drop("row")
    digests = dealt.mapInArrow(_digest_files, "leaf string, part bigint, ids_sha256 string, n_rows bigint, n_new bigint")
    return digests.join(F.broadcast(known), ["leaf", "part"]).select("leaf", "part", F.lit(",".join(parts.table.columns)).alias("columns"), "ids_sha256", "path", "n_rows", "n_new", "rewritten")
