"""Frequent itemsets and association rules, by FP-growth or in two passes over shares of the baskets."""

from __future__ import annotations

import functools
import math
import operator
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.operators.components import ensure_checkpoint_dir

#: Baskets of a share, and the least count that an itemset has to reach in one, so that chance gives few candidates.
SHARE = 20_000
LEAST = 50


def _fit(baskets: DataFrame, support: float, confidence: float = 0.1):
    from pyspark.ml.fpm import FPGrowth

    grouped = baskets.groupBy("basket").agg(F.collect_set("item").alias("items"))
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(grouped)


def frequent_itemsets(baskets: DataFrame, support: float, longest: int | None = None) -> DataFrame:
    """(items, freq) of (basket, item); items in order."""
    sets = _fit(baskets, support).freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    return sets.where(F.size("items") <= longest) if longest else sets


def items_at(baskets: list) -> dict:
    """The baskets that have each item, as bits of a number."""
    places: dict = defaultdict(list)
    for at, items in enumerate(baskets):
        for item in set(items):
            places[item].append(at)
    out = {}
    for item, at in places.items():
        flags = np.zeros(len(baskets), np.uint8)
        flags[at] = 1
        out[item] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    return out


def local_itemsets(baskets: list[list], least: int, longest: int | None = None) -> list[tuple]:
    """Itemsets in order that at least ``least`` of the baskets have, level by level: two that differ in their last item make a longer one."""
    level = {(i,): b for i, b in sorted(items_at(baskets).items()) if b.bit_count() >= least}
    found = list(level)
    while level and (longest is None or len(found[-1]) < longest):
        heads: dict = defaultdict(list)
        for items in level:
            heads[items[:-1]].append(items)
        longer = {}
        for same in heads.values():
            for k, a in enumerate(same):
                for b in same[k + 1 :]:
                    both = level[a] & level[b]
                    if both.bit_count() >= least and all((*a[:j], *a[j + 1 :], b[-1]) in level for j in range(len(a) - 1)):
                        longer[(*a, b[-1])] = both
        level = longer
        found += level
    return found


def frequent_itemsets_by_share(baskets: DataFrame, support: float, longest: int | None = None, share: int = SHARE) -> DataFrame:
    """(items, freq) of (basket, item), as ``frequent_itemsets``, in two passes without a tree of all baskets.

    Baskets are dealt over shares of about equal size. An itemset that is frequent
    among all is so in at least one share, so what Apriori finds in the shares, each
    at its part of the support, has all that are frequent. The second pass sends the
    candidates to every share, which counts them exactly; only counts leave it.
    """
    ensure_checkpoint_dir(baskets.sparkSession)
    grouped = baskets.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items")).checkpoint()
    n = grouped.count()
    least = max(1, math.ceil(support * n - 1e-9))
    shares = max(1, n // max(share, math.ceil(LEAST / support)))
    kind = baskets.schema["item"].dataType.simpleString()

    def candidates(part: pd.DataFrame) -> pd.DataFrame:
        own = max(1, math.ceil(support * len(part) - 1e-9))
        return pd.DataFrame({"items": [list(i) for i in local_itemsets(part["items"].tolist(), own, longest)]})

    def counts(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        having = items_at(part["items"].tolist())
        freq = [functools.reduce(operator.and_, (having.get(i, 0) for i in items)).bit_count() for items in asked["items"]]
        return pd.DataFrame({"id": asked["id"], "freq": freq})

    dealt = grouped.select("items", F.pmod(F.xxhash64("basket"), F.lit(shares)).alias("share"))
    found = dealt.groupBy("share").applyInPandas(candidates, f"items array<{kind}>").distinct().withColumn("id", F.monotonically_increasing_id()).checkpoint()
    asked = found.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))))
    counted = dealt.groupBy("share").cogroup(asked.groupBy("share")).applyInPandas(counts, "id bigint, freq bigint")
    freq = counted.groupBy("id").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)
    return found.join(freq, "id").select("items", "freq")


def association_rules(baskets: DataFrame, support: float, confidence: float) -> DataFrame:
    """(antecedent, consequent, confidence, lift, support)."""
    rules = _fit(baskets, support, confidence).associationRules
    return rules.select(F.array_sort("antecedent").alias("antecedent"), F.array_sort("consequent").alias("consequent"), "confidence", "lift", "support")
