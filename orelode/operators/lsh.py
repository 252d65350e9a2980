"""MinHash signatures and banded candidates from column expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.numeric import linear_hash
from orelode.functions.pairs import pairs_of_codes
from orelode.operators.components import ensure_checkpoint_dir
from orelode.operators.similarity import among_members

HASHES, ROWS, SEED = 40, 2, 42


def coefficients(n: int = HASHES, top: int = 1 << 20, seed: int = SEED) -> list[tuple[int, int]]:
    """(a, b) of each hash; a is odd."""
    rng = random.Random(seed)
    return [(rng.randint(1, top) | 1, rng.randrange(top)) for _ in range(n)]


def token_number(token: Column) -> Column:
    """A 32-bit number of a token that any engine with MD5 can give."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def signatures(sets: DataFrame, modulus: int, number: str = "x", n: int = HASHES) -> DataFrame:
    """(id, h0 .. h{n-1}): least hash values over a set's numbers, in one aggregation."""
    return sets.groupBy("id").agg(*[F.min(linear_hash(F.col(number), a, b, modulus)).alias(f"h{k}") for k, (a, b) in enumerate(coefficients(n))])


def bands(signed: DataFrame, n: int = HASHES, rows: int = ROWS) -> DataFrame:
    """(id, band, key): the set of a band's values is its key, so their order and repeats don't matter."""
    keys = [F.array_sort(F.array_distinct(F.array(*[F.col(f"h{k + r}") for r in range(rows)]))) for k in range(0, n, rows)]
    return signed.select("id", F.posexplode(F.array(*keys)).alias("band", "key"))


def candidates(banded: DataFrame) -> DataFrame:
    """(id1, id2) that share a band's key, each once, found where two blocks of ids meet."""
    return pairs_of_codes(banded.select("id", F.struct("band", "key").alias("k")), "k", "id")


def signature_classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, h0 ..), (rep, id)): one row for each different signature, named by its least id, and which ids have it."""
    ensure_checkpoint_dir(signed.sparkSession)
    values = [c for c in signed.columns if c != "id"]
    named = signed.withColumn("name", F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in values]), 256)).checkpoint()
    of = named.groupBy("name").agg(F.min("id").alias("id"), F.min_by(F.struct(*values), "id").alias("s")).checkpoint()
    members = named.select("id", "name").join(of.select("name", F.col("id").alias("rep")), "name").select("rep", "id")
    return of.select("id", "s.*"), members


def candidate_pairs(signed: DataFrame) -> DataFrame:
    """(id1, id2) of signatures that share a band: the pairs of different signatures, spread over who has them."""
    unlike, members = signature_classes(signed)
    pairs = candidates(bands(unlike)).withColumn("v", F.lit(1))
    return among_members(pairs, members, "1").select("id1", "id2")


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall) of found pairs against true ones."""
    on = ["id1", "id2"]
    f, t = found.select(*on).distinct().withColumn("f", F.lit(1)), truth.select(*on).distinct().withColumn("t", F.lit(1))
    both = f.join(t, on, "full")
    n = both.agg(F.count_if(F.expr("f = 1 and t = 1")).alias("tp"), F.count_if(F.expr("f = 1 and t is null")).alias("fp"), F.count_if(F.expr("f is null and t = 1")).alias("fn"))
    return n.select("*", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
