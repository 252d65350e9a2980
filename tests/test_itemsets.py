import itertools
import random

import pytest

from orelode.operators import itemsets
from orelode.plans import catalog


def test_registered_queries_give_sets_and_rules_of_any_size(spark, tmp_path):
    baskets = ["abcde"] * 6 + ["abcd"] * 3 + ["abx", "cdx", "ex", "bce"]
    brands = {b: k for k, b in enumerate("abcdex")}
    spark.createDataFrame([(k, b) for b, k in brands.items()], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, brands[b]) for o, items in enumerate(baskets) for b in items]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    n = len(baskets)
    freq = {s: m for k in range(1, 7) for s in itertools.combinations("abcdex", k) if (m := sum(set(s) <= set(b) for b in baskets))}
    got = {r["items"]: r["freq"] for r in catalog.QUERIES["freq_itemsets"](spark, str(tmp_path)).collect()}
    assert got == {",".join(s): m for s, m in freq.items() if m >= 0.005 * n} and "a,b,c,d,e" in got
    want = {}
    for s, m in freq.items():
        for y in s if len(s) > 1 and m >= 0.015 * n else ():
            x = tuple(i for i in s if i != y)
            if m / freq[x] >= 0.1:
                want[",".join(x), y] = (round(m / freq[x], 4), round(m / freq[x] / (freq[y,] / n), 4), round(m / n, 4))
    rules = catalog.QUERIES["assoc_rules"](spark, str(tmp_path)).collect()
    assert {(r["antecedent"], r["consequent"]): tuple(round(r[c], 4) for c in ("confidence", "lift", "support")) for r in rules} == want
    assert len(rules) == len(want)


@pytest.mark.parametrize(("share", "longest"), [(20, None), (75, 3), (20_000, 2)])
def test_two_passes_give_what_one_tree_gives(spark, monkeypatch, share, longest):
    """Shares of about 20 baskets find candidates; a third of the baskets are equal, one item is in all."""
    monkeypatch.setattr(itemsets, "LEAST", 1)
    rng = random.Random(7)
    baskets = [["all", "b", "c", "d"]] * 60 + [["all", *rng.sample("abcdefgh", rng.randint(0, 5))] for _ in range(120)]
    rows = [(k, i) for k, items in enumerate(baskets) for i in items] + [(0, "all"), (5000, None)]
    df = spark.createDataFrame(rows, "basket bigint, item string")
    got = [{tuple(r["items"]): r["freq"] for r in f(df, 0.08, longest).collect()} for f in (itemsets.frequent_itemsets, lambda *a: itemsets.frequent_itemsets_by_share(*a, share=share))]
    brute = {s: m for k in range(1, (longest or 6) + 1) for s in itertools.combinations(sorted({i for b in baskets for i in b}), k) if (m := sum(set(s) <= set(b) for b in baskets)) >= 0.08 * 181}
    assert got[0] == got[1] == brute


def test_two_passes_without_baskets(spark):
    assert itemsets.frequent_itemsets_by_share(spark.createDataFrame([], "basket bigint, item string"), 0.1).count() == 0
