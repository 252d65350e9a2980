"""Mixing sources to target weights by Pareto order sampling (operator 4).

Every source has a target number of words. The whole copies that it takes of all
its documents are certain. Of the words that are then missing, every document
has an inclusion probability in proportion to its size, such that the expected
words of those drawn are what is missing; documents whose probability would
exceed 1 are certain too and taken off first. The others are ranked by the odds
of a uniform draw divided by the odds of inclusion, and are taken in order of
rank while they fit. One more document, whose size is nearest to what is still
missing, closes the gap if that helps.

Nothing is gathered by source, and sources are never collected: the level that
caps the targets comes from running sums over the sources; the size from which
documents are certain, from sums over intervals of sizes and then over the sizes
of one interval; the rank at which to stop, from sums over intervals of ranks,
then over finer ones, and by single documents only in the last. What a document
gives follows from its own row and its source's line of a table with a line for
each source, so applying a mix shuffles no text but that of repeated rows.

Cases: null texts have size 0; documents of size 0 are copied like others and
never drawn. The null source is a source, last in order. Draws come from the id,
the text and the source, so reruns agree; rows that repeat all three are
numbered, and draw apart. Ties of rank are taken together. Texts are read whole.
Sources without words have target 0. An empty table gives no rows. Extra
columns, whatever their names, are kept by apply_mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions.ordered import ranked, running_sums
from orelode.llm.common import cut_lineage, table

#: Source weights by order, the share of all words that the mix takes, and the most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 17
#: Intervals of rank, and of size in a doubling.
BINS = 1024
SIZE_BINS = 32
#: The share of the words to draw that may be missing before documents that still fit are drawn.
NEAR = 0.002
#: Tables of one line per source are broadcast up to so many sources; beyond, the joins shuffle.
BROADCAST_SOURCES = 10_000
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def uniform(*cols: Column, seed: int = SEED) -> Column:
    """A draw from (0, 1) that follows from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def pareto_rank(u: Column, chance: Column) -> Column:
    """Pareto rank on (0, 1): x / (1 + x) of the odds ratio, which keeps the order."""
    x = (u / (1 - u)) * F.try_divide(1 - chance, chance)
    return x / (1 + x)


def per_source(df: DataFrame, n: int) -> DataFrame:
    """A table of at most n lines, marked for broadcast if n is small."""
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def source_targets(lines: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, s, sid, target) of lines (source, s): shares by weight, none above ``cap`` times its size, excess shared again.

    Every target is the lesser of its cap and its weight times one level. In
    order of cap over weight, sources are capped as long as the level that
    follows from capping all before them isn't under theirs.
    """
    numbered = ranked(lines, [F.col("source").isNull(), F.col("source")], "sid")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rated = cut_lineage(numbered.withColumn("weight", weight).withColumn("cap", F.lit(cap) * F.col("s")))
    summed = running_sums(rated, [F.col("cap") / F.col("weight"), F.col("sid")], {"caps": F.col("cap"), "weights": F.col("weight")})
    total, every = rated.agg(F.sum("s"), F.sum("weight")).first()
    level = (F.lit(share * (total or 0)) - F.col("caps") + F.col("cap")) / (F.lit(every or 0.0) - F.col("weights") + F.col("weight"))
    open_ = summed.select((F.col("cap") / F.col("weight")).alias("ratio"), "sid", level.alias("level")).where("level <= ratio")
    found = open_.agg(F.min(F.struct("ratio", "sid", "level")).alias("f")).first()["f"]
    return rated.select("source", "s", "sid", F.least("cap", F.col("weight") * F.lit(found["level"] if found else float("inf"))).alias("target"))


def certain_sizes(sized: DataFrame, n: int) -> DataFrame:
    """(sid, cut, scale, left): documents of sizes from ``cut`` are certain, others have the chance ``scale`` times their size; ``left`` words remain for these.

    sized: sid, size, rest. A size is certain if it is at least the squares of
    all sizes up to it, summed, over the words that all larger ones leave.
    """

    def edge(sums: DataFrame, by: str) -> DataFrame:
        """The least interval whose largest size is certain, with the words above it and the squares in it and below."""
        down = Window.partitionBy("sid").orderBy(F.col(by).desc())
        run = sums.withColumn("above", F.col("base1") + F.sum("s1").over(down) - F.col("s1")).withColumn("below", F.col("base2") - F.sum("s2").over(down) + F.col("s2"))
        return run.where(F.col("top") * (F.col("rest") - F.col("above")) >= F.col("below")).groupBy("sid").agg(F.min_by(F.struct(by, "above", "below", "s1", "s2"), by).alias("e")).select("sid", "e.*")

    size = F.col("size").cast("double")
    totals = sized.groupBy("sid").agg(F.first("rest").alias("rest"), F.sum(size * size).alias("all2"))
    interval = F.floor(F.log2(size) * SIZE_BINS)
    many = [F.sum(size).alias("s1"), F.sum(size * size).alias("s2"), F.max(size).alias("top")]
    coarse = sized.groupBy("sid", interval.alias("bin")).agg(*many).join(per_source(totals, n), "sid")
    at = per_source(edge(coarse.withColumn("base1", F.lit(0.0)).withColumnRenamed("all2", "base2"), "bin").select("sid", F.col("bin").alias("at"), F.col("above").alias("base1"), F.col("below").alias("base2")), n)
    inside = sized.join(at, "sid").where(interval == F.col("at"))
    fine = inside.groupBy("sid", "size").agg(*many, F.first("rest").alias("rest"), F.first("base1").alias("base1"), F.first("base2").alias("base2"))
    cut = edge(fine, "size").select("sid", F.col("size").alias("cut"), (F.col("above") + F.col("s1")).alias("taken"), (F.col("below") - F.col("s2")).alias("rest2"))
    both = totals.join(per_source(cut, n), "sid", "left").withColumn("left", F.col("rest") - F.coalesce("taken", F.lit(0.0)))
    return both.select("sid", "cut", F.try_divide("left", F.coalesce("rest2", "all2")).alias("scale"), "left")


def rank_stops(ranked_docs: DataFrame, n: int) -> DataFrame:
    """(sid, stop, got): documents of ranks up to ``stop`` have ``got`` words, the most that fit in ``left``; of (sid, size, left, v)."""

    def crossing(rows: DataFrame, bins: int) -> DataFrame:
        """The interval of ranks in which each source's running sum passes ``left`` (the last one where it doesn't), and the sum before it."""
        sums = rows.groupBy("sid", F.floor(F.col("v") * bins).alias("bin")).agg(F.sum("size").alias("n"), F.first("left").alias("left"), F.first("base").alias("base"))
        run = sums.withColumn("start", F.col("base") + F.sum("n").over(Window.partitionBy("sid").orderBy("bin")) - F.col("n"))
        return run.where("start <= left").groupBy("sid").agg(F.max("bin").alias("at"), F.max_by("start", "bin").alias("before"))

    rows = ranked_docs.withColumn("base", F.lit(0).cast("bigint"))
    for bins in (BINS, BINS * BINS):
        found = per_source(crossing(rows, bins), n)
        rows = rows.join(found, "sid").where(F.floor(F.col("v") * bins) == F.col("at")).select("sid", "size", "left", "v", F.col("before").alias("base"))
    run = rows.withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("sid").orderBy("v")))
    fits = F.col("upto") <= F.col("left")
    # where not even the first document of the last interval fits, the ranks before the interval do
    start = F.floor(F.min("v") * BINS * BINS) / float(BINS * BINS) * (1 - 2.0**-53)
    return run.groupBy("sid").agg(F.coalesce(F.max(F.when(fits, F.col("v"))), start).alias("stop"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("base")).alias("got"))


LINE = ("whole", "rest", "cut", "scale", "steps", "extra")
STEPS = "array<struct<limit:double,stop:double>>"


def _certain(size: Column, rest: Column, cut: Column) -> Column:
    return F.coalesce((size >= cut) & (size <= rest), F.lit(False))


def _rank(u: Column, size: Column, scale: Column) -> Column:
    """The rank of a document that isn't certain; where no document fits, all have even odds."""
    return pareto_rank(u, F.least(F.coalesce(scale * size, F.lit(0.5)), F.lit(1 - 1e-9)))


def _passed(steps: Column, size: Column, v: Column) -> Column:
    return F.coalesce(F.exists(steps, lambda s: (size <= s["limit"]) & (v <= s["stop"])), F.lit(False))


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, int]:
    """One line per source, and how many there are: its size and target, the whole copies, what is certain, the steps (documents up to a size are taken up to a rank), and the rank of the closing document.

    sized: source, size, u.
    """
    lines = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("s")))
    n = lines.count()
    sources = source_targets(lines, weights, share, cap).withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "s")), F.lit(0)))
    sources = cut_lineage(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("s")))
    need = sources.where("rest > 0").select(F.col("source").alias("of"), "sid", "rest")
    drawn = sized.where("size > 0").join(per_source(need, n), sized["source"].eqNullSafe(need["of"])).select("sid", "size", "rest", "u")
    certain = cut_lineage(certain_sizes(drawn.where("size <= rest"), n))
    others = drawn.join(per_source(certain, n), "sid", "left").where(~_certain(F.col("size"), F.col("rest"), F.col("cut")))
    others = others.select("sid", "size", F.coalesce("left", "rest").alias("left"), _rank(F.col("u"), F.col("size"), F.col("scale")).alias("v"))
    steps = certain.select("sid", F.col("left").alias("whole_left"), F.array().cast(STEPS).alias("steps"), F.lit(0).cast("bigint").alias("got"))
    steps = steps.join(per_source(need, n), "sid").select("sid", "steps", "got", "whole_left", F.col("rest").alias("limit"))
    while True:
        wide = steps.where((F.size("steps") == 0) | (F.col("whole_left") - F.col("got") > NEAR * F.col("whole_left")))
        fits = others.join(per_source(wide, n), "sid").where((F.col("size") <= F.col("limit")) & ~_passed(F.col("steps"), F.col("size"), F.col("v")))
        stops = cut_lineage(rank_stops(fits.select("sid", "size", (F.col("left") - F.col("got")).alias("left"), "v"), n))
        if stops.isEmpty():
            break
        stops = stops.withColumnRenamed("got", "more")
        step = F.struct(F.col("limit").cast("double").alias("limit"), "stop")
        got = F.col("got") + F.coalesce("more", F.lit(0))
        steps = steps.join(per_source(stops, n), "sid", "left").select("sid", F.when(F.col("stop").isNull(), F.col("steps")).otherwise(F.array_append("steps", step)).alias("steps"), got.alias("got"), "whole_left", F.when(F.col("stop").isNull(), F.col("limit")).otherwise(F.col("whole_left") - got).alias("limit"))
        steps = cut_lineage(steps)
    gap = F.col("left") - F.coalesce("got", F.lit(0))
    open_ = others.join(per_source(steps, n), "sid", "left").where(~_passed(F.col("steps"), F.col("size"), F.col("v")))
    closing = open_.where(F.abs(gap - F.col("size")) < gap).groupBy("sid").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("d"), "v")).alias("best"))
    out = sources.join(certain, "sid", "left").join(steps.select("sid", "steps"), "sid", "left").join(closing.select("sid", F.col("best.v").alias("extra")), "sid", "left")
    return out.select("source", F.col("s").alias("source_size"), "target", *LINE), n


def copies_of(u: Column, size: Column, prefix: str = "") -> Column:
    """Copies of a document from its draw, its size and its source's line, whose columns start with ``prefix``."""
    whole, rest, cut, scale, steps, extra = (F.col(prefix + c) for c in LINE)
    v = _rank(u, size, scale)
    taken = _certain(size, rest, cut) | (size > 0) & (_passed(steps, size, v) | F.coalesce(v == extra, F.lit(False)))
    return whole.cast("bigint") + taken.cast("int")


def numbered(rows: DataFrame, repeated: DataFrame, key: list[str], out: str) -> DataFrame:
    """rows with each one's number, from 0, among those that repeat its key; ``repeated`` lists the keys that occur more than once.

    Only repeated rows are shuffled, and never gathered by key: they are counted
    within their partition, and partitions are offset by a line for each.
    """
    if repeated.isEmpty():
        return rows.withColumn(out, F.lit(0).cast("bigint"))
    other = repeated.select([F.col(c).alias(f"{out}_{k}") for k, c in enumerate(key)])
    same = F.lit(True)
    for k, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"{out}_{k}"))
    placed = rows.withColumns({f"{out}_p": F.spark_partition_id(), f"{out}_at": F.monotonically_increasing_id()})
    of_key = placed.join(other, same, "left_semi")
    counts = of_key.groupBy(*key, f"{out}_p").agg(F.count("*").alias("c"))
    before = (F.sum("c").over(Window.partitionBy(*key).orderBy(f"{out}_p")) - F.col("c")).alias(f"{out}_before")
    offsets = counts.select(*[F.col(c).alias(f"{out}_{k}") for k, c in enumerate(key)], F.col(f"{out}_p").alias(f"{out}_q"), before)
    inside = F.row_number().over(Window.partitionBy(*key, f"{out}_p").orderBy(f"{out}_at")) - 1
    counted = of_key.withColumn(out, inside).join(offsets, same & (F.col(f"{out}_p") == F.col(f"{out}_q")))
    counted = counted.withColumn(out, F.col(out) + F.col(f"{out}_before")).select(*rows.columns, out)
    return rows.join(other, same, "left_anti").withColumn(out, F.lit(0).cast("bigint")).unionByName(counted)


KEY = ["doc_id", "source", "hash"]


def sized_documents(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, hash, size, u) of every row, and the keys of repeated rows."""
    text = F.col("text").cast("string")
    rows = cut_lineage(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("hash"), word_count(text).alias("size")))
    repeated = cut_lineage(rows.groupBy(*KEY).count().where("count > 1").select(*KEY))
    return numbered(rows, repeated, KEY, "ordinal").withColumn("u", uniform(*[F.col(c) for c in (*KEY, "ordinal")], seed=seed)).drop("ordinal"), repeated


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """What the mix takes of every document."""
    sized, _ = sized_documents(docs, seed)
    sized = cut_lineage(sized)
    lines, n = plan_mix(sized.select("source", "size", "u"))
    lines = lines.withColumnRenamed("source", "of")
    joined = sized.join(per_source(lines, n), sized["source"].eqNullSafe(lines["of"]))
    return joined.select("doc_id", "size", "source_size", "target", (copies_of(F.col("u"), F.col("size")) * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents with all their columns, each as many times as the mix takes it."""
    sized, repeated = sized_documents(docs, seed)
    lines, n = plan_mix(cut_lineage(sized.select("source", "size", "u")))
    lines = cut_lineage(lines)
    names = {c: f"__mix{len(docs.columns)}_{c}" for c in (*lines.columns, *KEY, "n", "copies", "size")}
    while any(x in docs.columns for x in names.values()):
        names = {c: f"_{x}" for c, x in names.items()}
    text = F.col("text").cast("string")
    marked = docs.withColumns({names["doc_id"]: F.col("doc_id"), names["source"]: F.col("source").cast("string"), names["hash"]: F.xxhash64(text), names["size"]: word_count(text)})
    keys = [names[c] for c in KEY]
    marked = numbered(marked, repeated.toDF(*keys), keys, names["n"])
    prefix = names["whole"].removesuffix("whole")
    lines = lines.withColumnRenamed("source", "of").select([F.col(c).alias(f"{prefix}{c}") for c in ("of", *LINE)])
    joined = marked.join(per_source(lines, n), marked[names["source"]].eqNullSafe(lines[f"{prefix}of"]))
    many = copies_of(uniform(*[F.col(c) for c in (*keys, names["n"])], seed=seed), F.col(names["size"]), prefix)
    return joined.withColumn(names["copies"], F.explode(F.array_repeat(F.lit(1), many.cast("int")))).select([F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_documents(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of every source."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(word_count(F.col("text").cast("string"))).alias("s"))
    found = source_targets(cut_lineage(lines))
    return found.select("source", F.col("s").alias("source_size"), F.round("target", 6).alias("target"))


#: The level that caps the targets, by window sums over the sources.
TARGETS_ORACLE = r"""
with d as (select source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
l as (select source, sum(size)::bigint as s from d group by source),
r as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight from l),
q as (select *, 2.0 * s / weight as ratio from r),
w as (select *, (1.5 * sum(s) over () - coalesce(sum(2.0 * s) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0)) as level from q),
f as (select max(level) filter (level <= ratio) as level from w)
select source, s as source_size, round(least(2.0 * s, weight * coalesce(level, 1e300)), 6) as target from q, f
"""
