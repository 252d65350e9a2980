"""Hand-made fixtures and invariants of the library's operators."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orelode.functions.numeric import amplify, truncate
from orelode.functions.ordered import ranked
from orelode.functions.pairs import pairs_between, pairs_within
from orelode.functions.text import word_tokens
from orelode.operators import aggregates, evaluate, forest, graph, itemsets, lsh, recommend, similarity
from orelode.operators.components import connected_components
from orelode.sources import io

RATINGS = {1: {1: 5, 2: 3, 3: 4}, 2: {1: 4, 2: 2, 3: 3, 4: 5}, 3: {1: 1, 2: 5, 4: 2}, 4: {3: 2, 4: 4}}
GENRES = {1: "AB", 2: "A", 3: "BC", 4: "AC"}
NINE = [(1, 2), (1, 3), (2, 3), (2, 4), (4, 5), (4, 6), (4, 7), (5, 6), (6, 7)]
EIGHT = [(1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (4, 6), (5, 7), (6, 7)]
EDGE = "src bigint, dst bigint"


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u, i, float(r)) for u, items in RATINGS.items() for i, r in items.items()]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double").cache()


@pytest.fixture(scope="module")
def genres(spark):
    return spark.createDataFrame([(i, g) for i, gs in GENRES.items() for g in gs], "item_id bigint, genre string")


def keys(spark, *pairs):
    return spark.createDataFrame(list(pairs), "user_id bigint, item_id bigint")


def as_map(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


@pytest.mark.parametrize(("line", "tokens"), [("Hi there. ok?", ["Hi", "there", "ok"]), ("", [""]), ("?!", []), ("?a b", ["", "a", "b"]), ("a", ["a"])])
def test_word_tokens(spark, line, tokens):
    df = spark.createDataFrame([(line,)], "v string")
    assert df.select(word_tokens(F.col("v")).alias("t")).first()["t"] == tokens


def test_readers(spark, tmp_path):
    made = io.in_memory(spark, [(1, 2), (None, 3)], io.KEYS)
    assert made.columns == ["user_id", "item_id"] and {tuple(r) for r in made.collect()} == {(1, 2), (None, 3)}
    (tmp_path / "r.csv").write_text("user_id,item_id\n1,2\nx,4\n5,\n")
    assert {tuple(r) for r in io.read_csv(spark, f"{tmp_path}/r.csv", io.KEYS, lenient=True).collect()} == {(1, 2), (None, 4), (5, None)}
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        io.read_csv(spark, f"{tmp_path}/r.csv", io.KEYS).collect()
    (tmp_path / "m.csv").write_text('movieId,title,genres\n1,"a, b",A|B\n2,c,A\n')
    assert {r["item_id"]: r["genres"] for r in io.read_genres(spark, f"{tmp_path}/m.csv").collect()} == {1: ["A", "B"], 2: ["A"]}
    (tmp_path / "n.csv").write_text("")
    assert io.read_genres(spark, f"{tmp_path}/n.csv").count() == 0 and io.read_naive(spark, f"{tmp_path}/n.csv", io.KEYS).count() == 0


def test_one_part_and_refusal_to_overwrite(spark, tmp_path):
    rows = spark.range(50).repartition(7)
    io.write_csv(rows, f"{tmp_path}/one", single=True)
    io.write_csv(rows, f"{tmp_path}/many", header=False)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1 < len(list((tmp_path / "many").glob("part-*")))
    with pytest.raises(Exception, match="exist"):
        io.write_csv(rows, f"{tmp_path}/one")


def test_word_count(spark):
    line = "Hi, how do you count words? I think the word count solution is the solution to make: add this to the test, there are many, the problem."
    got = {r["word"]: r["n"] for r in aggregates.word_count(spark.createDataFrame([(line,)], "value string")).collect()}
    assert got["the"] == 4 and got["solution"] == 2 and got["to"] == 2 and "" not in got


def test_means(spark, ratings):
    by_item = as_map(aggregates.mean_by(ratings, "item_id", "rating"), "item_id", "mean")
    assert [round(by_item[(i,)], 6) for i in (1, 2, 3, 4)] == [3.333333, 3.333333, 3.0, 3.666667]
    tags = spark.createDataFrame([(1, "fun"), (1, "fun"), (4, "fun"), (3, "dark")], "item_id bigint, tag string")
    got = [(r["tag"], round(r["rating_avg"], 6)) for r in aggregates.mean_by_tag(ratings, tags).collect()]
    assert got == [("fun", 3.444444), ("dark", 3.0)]


def test_pearson(ratings):
    users = {k: round(v, 6) for k, v in as_map(similarity.pearson(ratings, "user_id", "item_id"), "id1", "id2", "sim").items()}
    assert users == {(1, 2): 1, (1, 3): -1, (1, 4): 0, (2, 3): -0.838628, (2, 4): 1, (3, 4): 0}
    items = {k: round(v, 6) for k, v in as_map(similarity.pearson(ratings, "item_id", "user_id"), "id1", "id2", "sim").items()}
    assert items == {(1, 2): -0.838628, (1, 3): 1, (1, 4): 1, (2, 3): 1, (2, 4): -1, (3, 4): 1}


def test_jaccard_and_cosine(ratings, genres):
    got = as_map(similarity.jaccard_pairs_exact(ratings, 0.5, "item_id", "user_id"), "id1", "id2", "jaccard")
    assert got == {(1, 2): 1.0, (1, 3): 0.5, (1, 4): 0.5, (2, 3): 0.5, (2, 4): 0.5, (3, 4): 0.5}
    cosine = {k: round(v, 6) for k, v in as_map(similarity.binary_cosine(genres), "id1", "id2", "cosine").items()}
    assert cosine == {(1, 2): 0.707107, (1, 3): 0.5, (1, 4): 0.5, (2, 4): 0.707107, (3, 4): 0.5}


def test_jaccard_prefix_filter_is_exact(spark):
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(30), rng.randint(1, 12))) for i in range(60)}
    sets |= {i + 100: set(s) | {99} for i, s in sets.items()}
    rows = spark.createDataFrame([(i, f"t{x}") for i, s in sets.items() for x in s], "id bigint, token string")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = similarity.jaccard_pairs_exact(rows, 0.6)
    assert {(r["id1"], r["id2"]) for r in got.collect()} == want


def test_user_cf(spark, ratings):
    asked = keys(spark, (1, 4), (4, 1), (4, 2), (3, 3))
    got = as_map(recommend.predict_user_cf(ratings, asked), "user_id", "item_id", "prediction")
    assert {k: round(v, 6) for k, v in got.items()} == {(1, 4): 5.0, (4, 1): 3.666667, (4, 2): 1.0, (3, 3): 2.970744}
    amplified = as_map(recommend.predict_user_cf(ratings, keys(spark, (3, 3)), case_amplification=True), "user_id", "item_id", "prediction")
    assert round(amplified[3, 3], 6) == 2.927832


def test_hybrid_asks_content_only_without_neighbours(spark, ratings, genres):
    asked = keys(spark, (1, 4), (4, 1), (4, 2), (3, 3))
    plain = as_map(recommend.predict_user_cf(ratings, asked), "user_id", "item_id", "prediction")
    assert as_map(recommend.predict_user_cf(ratings, asked, genres=genres), "user_id", "item_id", "prediction") == plain
    # nobody else rated item 9: the user's mean, though content could tell
    more = genres.unionByName(spark.createDataFrame([(9, "B")], "item_id bigint, genre string"))
    got = as_map(recommend.predict_user_cf(ratings, keys(spark, (1, 9)), genres=more), "user_id", "item_id", "prediction")
    content = as_map(recommend.predict_content(ratings, keys(spark, (1, 9)), more), "user_id", "item_id", "prediction")
    assert got[1, 9] == 4.0 != content[1, 9]
    alone = ratings.where("user_id = 1")
    for train, k in ((alone, 250), (ratings, 0)):
        got = as_map(recommend.predict_user_cf(train, keys(spark, (1, 4)), k=k, genres=genres), "user_id", "item_id", "prediction")
        assert round(got[1, 4], 6) == 3.87868


def test_significance_weights(spark, ratings):
    """All neighbours share few items, so all weights shrink alike and cancel; with enough in common they don't."""
    asked = keys(spark, (3, 3), (4, 2))
    plain = as_map(recommend.predict_user_cf(ratings, asked), "user_id", "item_id", "prediction")
    weighed = as_map(recommend.predict_user_cf(ratings, asked, significance_weights=True), "user_id", "item_id", "prediction")
    assert weighed == pytest.approx(plain)
    rng = random.Random(2)
    rows = [(u, i, float(rng.randint(1, 5))) for u in (1, 2) for i in range(60)] + [(3, i, float(rng.randint(1, 5))) for i in range(10)] + [(2, 99, 5.0), (3, 99, 1.0)]
    train = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")
    sims = as_map(similarity.pearson(train, "user_id", "item_id"), "id1", "id2", "sim")
    of = {u: [r for v, i, r in rows if v == u and i != 99] for u in (1, 2, 3)}
    dev = {u: r - sum(of[u]) / len(of[u]) for u, _, r in rows[-2:]}
    w = {2: sims[1, 2], 3: sims[1, 3] / 50}
    want = sum(of[1]) / 60 + sum(w[u] * dev[u] for u in w) / sum(map(abs, w.values()))
    got = as_map(recommend.predict_user_cf(train, keys(spark, (1, 99)), significance_weights=True), "user_id", "item_id", "prediction")
    assert got[1, 99] == pytest.approx(min(want, 5.0))


def test_als_takes_large_ids(spark, ratings):
    big = 1 << 40
    moved = ratings.select((F.col("user_id") + big).alias("user_id"), (F.col("item_id") - big).alias("item_id"), "rating")
    got = as_map(recommend.predict_als(moved, keys(spark, (big + 1, 4 - big), (big + 9, 1 - big))), "user_id", "item_id", "prediction")
    want = as_map(recommend.predict_als(ratings, keys(spark, (1, 4), (9, 1))), "user_id", "item_id", "prediction")
    assert list(got) == [(big + 1, 4 - big)] and got[big + 1, 4 - big] == pytest.approx(want[1, 4], abs=1e-3)


def test_als_ranks_ids_by_runs(spark):
    """Ids with few gaps are ranked without a join, as with one; ids that are in a gap, beyond the ends or null have no rank."""
    some = [-(1 << 63), -(1 << 63) + 1, -5, -4, 0, 1, 2, 9, (1 << 62), (1 << 63) - 1]
    rows = [(u, i) for u in some for i in (1, 2, 4)]
    train = spark.createDataFrame(rows, "user_id bigint, item_id bigint")
    test = spark.createDataFrame([(u, i) for u in (*some, -6, -3, 3, 10, (1 << 62) + 1, None) for i in (0, 1, 2, 3, 4, 5, None)], "user_id bigint, item_id bigint")
    for rows in (train, train.where("user_id > -10")):
        ids = recommend._placed_ids(rows)
        runs = {c: recommend._runs(ids[c], c, 6) for c in ids}
        assert runs["item_id"].tolist() == [[1, 2, 0], [4, 4, 1]] and (runs["user_id"] is None) == (rows is train)
        assert recommend._runs(ids["item_id"], "item_id", 1) is None
        by_runs, by_joins = (recommend._at_ranks(test, ids, of) for of in (runs, dict.fromkeys(ids)))
        columns = ["user_id", "item_id", "user_id_at", "item_id_at"]
        assert sorted(map(tuple, by_runs.select(*columns).collect())) == sorted(map(tuple, by_joins.select(*columns).collect()))
    assert "Join" not in _plan(by_runs) and "Join" in _plan(by_joins)


def test_item_cf(spark, ratings):
    asked = keys(spark, (1, 4), (3, 3), (4, 1), (4, 2))
    got = as_map(recommend.predict_item_cf(ratings, asked), "user_id", "item_id", "prediction")
    assert {k: round(v, 6) for k, v in got.items()} == {(1, 4): 2.0, (3, 3): 2.666667, (4, 1): 3.0, (4, 2): -1.0}
    pairs = similarity.jaccard_pairs_exact(ratings, 0.5, "item_id", "user_id")
    jac = as_map(recommend.predict_item_jaccard(ratings, keys(spark, (1, 4), (4, 1)), pairs), "user_id", "item_id", "prediction")
    assert {k: round(v, 6) for k, v in jac.items()} == {(1, 4): 4.0, (4, 1): 3.0}


def test_content_and_iuf(spark, ratings, genres):
    got = as_map(recommend.predict_content(ratings, keys(spark, (1, 4), (4, 2)), genres), "user_id", "item_id", "prediction")
    assert {k: round(v, 6) for k, v in got.items()} == {(1, 4): 3.87868, (4, 2): 4.0}
    iuf = as_map(similarity.inverse_user_frequency(ratings), "item_id", "iuf")
    assert all(round(v, 6) == 0.124939 for v in iuf.values())


def test_zero_similarities_take_places(spark):
    pairs = spark.createDataFrame([(1, 2, -0.5), (1, 3, 0.5)], "id1 bigint, id2 bigint, sim double")
    assert {(r["id"], r["other"]) for r in similarity.nearest(pairs, 2, 5).collect()} == {(1, 3), (3, 1)}
    assert {(r["id"], r["other"]) for r in similarity.nearest(pairs, 4, 5).collect()} == {(1, 3), (3, 1), (1, 2), (2, 1)}


def test_evaluation(spark):
    rows = [(1, 1, 4.0, 3.5), (1, 2, 5.0, 2.5), (1, 3, 1.0, 4.0), (1, 4, 2.0, 2.0), (1, 5, 0.5, 5.0)]
    both = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, prediction double")
    truth, predicted = both.drop("prediction"), both.drop("rating")
    assert round(evaluate.rmse(truth, predicted).first()["rmse"], 6) == 2.673948
    assert as_map(evaluate.error_histogram(truth, predicted), "bucket", "n") == {(0,): 2, (1,): 0, (2,): 1, (3,): 1, (4,): 1}
    row = evaluate.report(truth, predicted).first()
    assert [row[f"from_{k}"] for k in range(5)] == [2, 0, 1, 1, 1] and row["n"] == 5


def test_split_and_bags(spark, ratings):
    train, test = recommend.split(ratings, keys(spark, (1, 1), (9, 9)))
    assert test.count() == 1 and train.count() == ratings.count() - 1
    left, right = spark.createDataFrame([(1,), (1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert [r["x"] for r in aggregates.subtract_bag(left, right, ["x"]).collect()] == [1, 1]


def test_band_keys_are_sets(spark):
    rows = spark.createDataFrame([(1, 3, 3, 4, 5), (2, 3, 3, 5, 4), (3, 9, 9, 9, 3)], "id int, h0 int, h1 int, h2 int, h3 int")
    got = {(r["id"], r["band"]): tuple(r["key"]) for r in lsh.bands(rows, n=4, rows=2).collect()}
    assert got[1, 0] == (3,) and got[1, 1] == got[2, 1] == (4, 5) and got[3, 1] == (3, 9)
    assert {(r["id1"], r["id2"]) for r in lsh.candidates(lsh.bands(rows, n=4, rows=2)).collect()} == {(1, 2)}


@pytest.mark.parametrize("block", [2048, 7])
def test_pairs_within_hot_keys(spark, block):
    """One key holds most rows: every pair once, whatever the blocks, as brute force has it."""
    rng = random.Random(block)
    rows = [(k, i, rng.randint(0, 9)) for k, n in ((1, 60), (2, 3), (3, 1), (4, 9)) for i in rng.sample(range(100), n)] + [(None, 1, 1), (None, 2, 2), (2, None, 5)]
    got = pairs_within(spark.createDataFrame(rows, "k int, id int, v int"), "k", "id", ["v"], block).select("k", "id1", "id2", "v1", "v2").collect()
    want = [(k, a, b, v, w) for k, a, v in rows for j, b, w in rows if k is not None and k == j and a is not None and b is not None and a < b]
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_item_in_every_basket(spark, monkeypatch):
    """Joins on a shared item give the same whether a hot item is cut in blocks or not."""
    rng = random.Random(1)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(50) for i in (0, *rng.sample(range(1, 12), 4))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")

    def all_three():
        named = df.withColumnRenamed("item_id", "item")
        return [sorted(tuple(round(x, 9) for x in r) for r in f.collect()) for f in (similarity.pearson(df, "user_id", "item_id"), similarity.binary_cosine(df, "user_id", "item_id"), graph.cooccurrence_edges(named, 3))]

    whole = all_three()
    assert len(whole[0]) == len(whole[1]) == 50 * 49 // 2
    monkeypatch.setattr(pairs_within, "__defaults__", ((), 8))
    assert all_three() == whole


def test_copies_are_one_class(spark):
    """Groups of equal sets are joined as one; their pairs come from membership."""
    sets = {k: set("abcdef") for k in range(30)} | {100 + k: set("abcdeg") for k in range(5)} | {200: set("xyz"), 201: set("xyzw")}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id bigint, token string")
    pairs, members = similarity.jaccard_classes_exact(rows, 0.5)
    assert {(r["id1"], r["id2"]) for r in pairs.collect()} == {(0, 100), (200, 201)}
    assert {r["id"]: r["rep"] for r in members.collect()} == {i: 0 if i < 100 else min(i, 100) if i < 200 else i for i in sets}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert as_map(similarity.jaccard_pairs_exact(rows, 0.5), "id1", "id2", "jaccard") == want


def test_als_factors_solve_their_normal_equations(spark):
    """A user's factors are the ridge regression of their ratings on the items' factors, weighted by their number of ratings, and a prediction is the product."""
    rng = np.random.default_rng(3)
    rows = [((1 << 40) + u, (1 << 50) + i, float(r)) for u in range(12) for i in range(9) if (r := rng.integers(0, 6))]
    train = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")
    model, ids = recommend.fit_als(train, rank=3, rounds=6, penalty=0.1)
    users, items = ({r["id"]: np.array(r["features"]) for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    at = {c: {r[c]: r[f"{c}_at"] for r in ids[c].collect()} for c in ids}
    for user, k in at["user_id"].items():
        own = [(items[at["item_id"][i]], r) for u, i, r in rows if u == user]
        v, r = np.array([x for x, _ in own]), np.array([y for _, y in own])
        assert np.allclose(np.linalg.solve(v.T @ v + 0.1 * len(r) * np.eye(3), v.T @ r), users[k], atol=1e-3)
    for r in recommend.predict_als(train, train, rank=3, rounds=6, penalty=0.1).collect():
        assert math.isclose(r["prediction"], users[at["user_id"][r["user_id"]]] @ items[at["item_id"][r["item_id"]]], abs_tol=1e-4)


@pytest.mark.parametrize("asked", [None, [3], [1, 2, 3, 4, 99]])
def test_only_pairs_that_are_asked(spark, monkeypatch, asked):
    """Every pair with an asked id and no other, hot keys or not; nearest others of the asked ids are those of all."""
    rng = random.Random(6)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(30) for i in (0, *rng.sample(range(1, 9), 4))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")
    ids = None if asked is None else spark.createDataFrame([(a,) for a in asked], "user_id bigint")
    whole = {tuple(r)[:2]: tuple(round(x, 9) for x in tuple(r)[2:]) for r in similarity.pearson(df, "user_id", "item_id").collect()}
    near = similarity.nearest(similarity.pearson(df, "user_id", "item_id"), 4, 30)
    want = sorted((r["id"], r["other"], round(r["sim"], 9)) for r in near.collect() if asked is None or r["id"] in asked)
    for block in (2048, 6):
        monkeypatch.setattr(pairs_within, "__defaults__", ((), block))
        monkeypatch.setattr(pairs_between, "__defaults__", ((), block))
        pairs = similarity.pearson(df, "user_id", "item_id", asked=ids)
        assert {tuple(r)[:2]: tuple(round(x, 9) for x in tuple(r)[2:]) for r in pairs.collect()} == {k: v for k, v in whole.items() if asked is None or set(k) & set(asked)}
        assert sorted((r["id"], r["other"], round(r["sim"], 9)) for r in similarity.nearest(pairs, 4, 30, asked=ids).collect()) == want


def test_nearest_is_cut_before_the_shuffle(spark, ratings):
    near = similarity.nearest(similarity.pearson(ratings, "user_id", "item_id"), 2, 4)
    assert "WindowGroupLimit" in near._jdf.queryExecution().toString()


def test_content_leaves_out_the_asked_item(spark, ratings, genres):
    """The asked item's own rating has no part, whether or not it was trained on: against the sum over rated items one by one."""
    rows = [(u, i, float(r)) for u, items in RATINGS.items() for i, r in items.items()]
    asked = [(u, i) for u in RATINGS for i in (1, 2, 3, 4)]
    want = {}
    for u, i in asked:
        mine = [(r, len(set(GENRES[i]) & set(GENRES[j])) / math.sqrt(len(GENRES[i]) * len(GENRES[j]))) for v, j, r in rows if v == u and j != i]
        top = [(r, w) for r, w in mine if w]
        own = [r for v, _, r in rows if v == u]
        want[u, i] = sum(r * w for r, w in top) / sum(w for _, w in top) if top else sum(own) / len(own)
    got = as_map(recommend.predict_content(ratings, keys(spark, *asked), genres), "user_id", "item_id", "prediction")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_lsh_quality(spark):
    found = spark.createDataFrame([(1, 2), (1, 3)], "id1 int, id2 int")
    truth = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "id1 int, id2 int")
    row = lsh.quality(found, truth).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 2) and row["precision"] == 0.5 and math.isclose(row["recall"], 1 / 3)


def test_numeric(spark):
    df = spark.createDataFrame([(-0.5, 1.23456)], "w double, x double")
    row = df.select(amplify(F.col("w")).alias("a"), truncate(F.col("x")).alias("t")).first()
    assert math.isclose(row["a"], -(0.5**2.5)) and row["t"] == 1.234


@pytest.mark.parametrize(
    ("edges", "want", "textbook"),
    [
        ([(1, 2)], {(1, 2): 0.5}, {(1, 2): 1.0}),
        (NINE, dict(zip(NINE, [2.5, 0.5, 2.5, 6.0, 2.25, 2.0, 2.25, 0.75, 0.75])), dict(zip(NINE, [5.0, 1.0, 5.0, 12.0, 4.5, 4.0, 4.5, 1.5, 1.5]))),
        (EIGHT, dict(zip(EIGHT, [2.0417, 2.0417, 3.0, 2.0417, 2.0417, 2.4167, 3.0, 2.4167])), dict(zip(EIGHT, [4.1667, 4.1667, 6.0, 4.1667, 4.1667, 4.6667, 6.0, 4.6667]))),
    ],
)
def test_betweenness(spark, edges, want, textbook):
    df = spark.createDataFrame(edges, EDGE)
    assert {k: round(v, 4) for k, v in as_map(graph.edge_betweenness(df), "src", "dst", "betweenness").items()} == want
    assert {k: round(v, 4) for k, v in as_map(graph.edge_betweenness(df, textbook=True), "src", "dst", "betweenness").items()} == textbook


@pytest.mark.parametrize("textbook", [False, True])
def test_betweenness_in_batches(spark, textbook):
    """More than 64 roots: words of bits and batches of roots give what all roots at once give, and levels are those of a search from each."""
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(70), 2))) for _ in range(110)} | {(500, 501)})
    df = spark.createDataFrame(edges, EDGE)
    whole, batched = (as_map(graph.edge_betweenness(df, textbook, tree_rows=n), "src", "dst", "betweenness") for n in (1 << 24, 1))
    assert whole.keys() == batched.keys() == set(edges) and all(math.isclose(whole[e], batched[e], rel_tol=1e-9) for e in whole)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for root in near:
        level, front = {root: 0}, [root]
        while front:
            front = [y for x in front for y in near[x] if y not in level and level.setdefault(y, level[x] + 1)]
        want |= {(root, n): d for n, d in level.items()}
    assert as_map(graph.bfs_levels(df), "root", "node", "level") == want
    if textbook:  # paths from each node to each other pass over as many edges as they are long
        assert math.isclose(sum(whole.values()), sum(want.values()) / 2, rel_tol=1e-9)


def test_girvan_newman_and_louvain(spark):
    df = spark.createDataFrame(NINE, EDGE)
    labels, q = graph.girvan_newman(df)
    groups = defaultdict(set)
    for r in labels.collect():
        groups[r["label"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6, 7]]
    assert round(q.first()["modularity"], 6) == 0.364198
    assert round(graph.modularity(df, labels).first()["modularity"], 6) == 0.364198
    found = graph.louvain(df)
    assert {r["node"] for r in found.collect()} == set(range(1, 8))
    assert round(graph.modularity(df, found).first()["modularity"], 6) >= 0.36
    assert [r["members"] for r in graph.community_members(labels).orderBy("label").collect()] == [[1, 2, 3], [4, 5, 6, 7]]


def louvain_moves(edges: list[tuple[int, int, float]], total: float) -> dict[int, int]:
    """Community of each node by local moves and aggregation, nodes in order; ``total`` is the whole graph's weight, an edge from a node to itself what it holds inside."""
    label = {x: x for e in edges for x in e[:2]}
    near: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    loops: dict[int, float] = defaultdict(float)
    for a, b, w in edges:
        if a == b:
            loops[a] += w
        else:
            near[a][b] += w
            near[b][a] += w
    while True:
        nodes = sorted(set(label.values()))
        own = {x: x for x in nodes}
        weight = {x: sum(near[x].values()) + 2 * loops[x] for x in nodes}
        inside = dict(weight)
        moved, changed = False, True
        while changed:  # every move raises the modularity
            changed = False
            for x in nodes:
                links: dict[int, float] = defaultdict(float)
                for y, w in near[x].items():
                    links[own[y]] += w
                old = own[x]
                inside[old] -= weight[x]
                best, gain = old, links[old] - inside[old] * weight[x] / (2 * total)
                for c in sorted(links):
                    g = links[c] - inside[c] * weight[x] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                inside[best] += weight[x]
                if best != old:
                    own[x], changed, moved = best, True, True
        if not moved:
            return label
        least: dict[int, int] = {}
        for x in nodes:
            least.setdefault(own[x], x)
        own = {x: least[c] for x, c in own.items()}
        label = {n: own[c] for n, c in label.items()}
        merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        kept: dict[int, float] = defaultdict(float)
        for x in nodes:
            kept[own[x]] += loops[x]
            for y, w in near[x].items():
                if own[x] == own[y]:
                    kept[own[x]] += w / 2
                else:
                    merged[own[x]][own[y]] += w
        near, loops = merged, kept


def _five_graphs():
    """Planted groups, a ring of cliques, a grid, a hub, and random edges, apart from each other."""
    rng = random.Random(5)
    yield sorted({(a, b) for a in range(24) for b in range(a + 1, 24) if rng.random() < (0.8 if a // 8 == b // 8 else 0.05)})
    yield [(4 * c + i, 4 * c + j) for c in range(6) for i in range(4) for j in range(i + 1, 4)] + [tuple(sorted((4 * c, 4 * ((c + 1) % 6) + 1))) for c in range(6)]
    yield [(4 * r + c, 4 * r + c + 1) for r in range(4) for c in range(3)] + [(4 * r + c, 4 * r + c + 4) for r in range(3) for c in range(4)]
    yield [(0, k) for k in range(1, 20)] + [(k, k + 1) for k in range(1, 19, 3)]
    yield sorted({tuple(sorted(rng.sample(range(16), 2))) for _ in range(40)})


def test_louvain_is_no_worse_than_one_move_after_the_other(spark):
    """Five graphs in one run: each one's share of the modularity is no less than by sequential moves, and no community is in parts."""
    fixtures = [[(1000 * k + a, 1000 * k + b) for a, b in edges] for k, edges in enumerate(_five_graphs())]
    edges = [e for f in fixtures for e in f]
    label = {r["node"]: r["label"] for r in graph.louvain(spark.createDataFrame(edges, EDGE)).collect()}
    assert set(label) == {n for e in edges for n in e} and all(label[c] == c == min(n for n in label if label[n] == c) for c in set(label.values()))
    one_by_one = louvain_moves([(a, b, 1.0) for a, b in edges], float(len(edges)))
    assert _q(edges, label) >= _q(edges, one_by_one) - 1e-9
    inside = [(a, b) for a, b in edges if label[a] == label[b]]
    parts = _parts(list(label), inside)
    for _ in range(20):
        parts = {n: parts[parts[n]] for n in parts}
    assert parts == label


def test_louvain_is_the_same_for_any_partitions(spark):
    """The least communities of a graph, and moves that leave no better single move, whatever the number of tasks."""
    edges = next(_five_graphs())
    df = spark.createDataFrame(edges, EDGE).withColumn("w", F.lit(1.0))
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts, tasks in ((1, 2), (7, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        labels, q = graph.moved_level(df.repartition(parts), float(len(edges)))
        found.append({r["node"]: r["c"] for r in labels.collect()})
        assert math.isclose(q, _q(edges, found[-1]), abs_tol=1e-12)
    spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    assert found[0] == found[1]
    assert all(_q(edges, found[0] | {n: c}) <= q + 1e-9 for n in found[0] for c in set(found[0].values()))


def test_disconnected_communities_are_split(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], EDGE)
    labels = spark.createDataFrame([(1, 1), (2, 9), (3, 1), (4, 1), (5, 1), (6, 1)], "node bigint, c bigint")
    assert as_map(graph.connected_groups(df, labels), "node", "c") == {(1,): 1, (2,): 2, (3,): 3, (4,): 3, (5,): 5, (6,): 5}


def _q(edges, label):
    m, inside, degree = len(edges), defaultdict(int), defaultdict(int)
    for a, b in edges:
        degree[label[a]] += 1
        degree[label[b]] += 1
        inside[label[a]] += label[a] == label[b]
    return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def _parts(nodes, edges):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def merge_events(rows: pd.DataFrame, m: float) -> list[tuple[int, float]]:
    """(rank, change of modularity by the split) of one component's edges, from joining them in reverse rank."""
    group: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    degree: dict[int, int] = defaultdict(int)
    between: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for s, d in zip(rows["src"], rows["dst"]):
        for x, y in ((s, d), (d, s)):
            group.setdefault(x, x)
            members.setdefault(x, [x])
            degree[x] += 1
            between[x][y] += 1
    events = []
    for s, d, r in rows.sort_values("rank", ascending=False)[["src", "dst", "rank"]].itertuples(index=False):
        a, b = group[s], group[d]
        if a == b:
            continue
        if len(between[a]) + len(members[a]) < len(between[b]) + len(members[b]):
            a, b = b, a
        events.append((int(r), -(between[a][b] / m - 2 * degree[a] * degree[b] / (2 * m) ** 2)))
        for x in members.pop(b):
            group[x] = a
            members[a].append(x)
        degree[a] += degree.pop(b)
        del between[a][b]
        for c, n in between.pop(b).items():
            if c != a:
                between[a][c] += n
                between[c][a] += n
                del between[c][b]
    return events


@pytest.mark.parametrize("seed", range(12))
def test_reverse_merging_equals_removal(seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(1, 11), 2))) for _ in range(rng.randint(5, 18))})
    order = rng.sample(edges, len(edges))
    nodes = sorted({x for e in edges for x in e})
    whole = _parts(nodes, edges)
    rows = pd.DataFrame([(a, b, order.index((a, b)) + 1, whole[a]) for a, b in edges], columns=["src", "dst", "rank", "component"])
    events = sorted(e for _, g in rows.groupby("component") for e in merge_events(g, float(len(edges))))
    q, at, merged = _q(edges, whole), whole, {}
    for r, change in events:
        q += change
        merged[r] = q
    for r in range(1, len(order) + 1):
        now = _parts(nodes, order[r:])
        if len(set(now.values())) > len(set(at.values())):
            assert math.isclose(merged.pop(r), _q(edges, now), abs_tol=1e-9)
        at = now
    assert not merged


def _ranked(edges, seed):
    order = random.Random(seed).sample(edges, len(edges))
    return [(a, b, order.index((a, b)) + 1) for a, b in edges]


@pytest.mark.parametrize(("seed", "block"), [(1, 4), (2, 16), (3, 1024)])
def test_merge_tree_equals_merging_in_order(spark, seed, block):
    """Sums by intervals of the forest's order are those of one pass over each component."""
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(1, 30), 2))) for _ in range(60)} | {(100, 101), (101, 102), (1 << 60, (1 << 60) + 1)})
    rows = _ranked(edges, seed)
    whole = _parts({x for e in edges for x in e}, edges)
    frame = pd.DataFrame([(*r, whole[r[0]]) for r in rows], columns=["src", "dst", "rank", "component"])
    want = {r: q for _, g in frame.groupby("component") for r, q in merge_events(g, float(len(edges)))}
    df = spark.createDataFrame(rows, "src bigint, dst bigint, rank bigint")
    m = len(edges)
    got = {r["rank"]: -(r["links"] / m - 2 * r["da"] * r["db"] / (2 * m) ** 2) for r in forest.merges(df, graph.node_degree(df).withColumnRenamed("degree", "d"), block).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[r], want[r], abs_tol=1e-12) for r in want)
    assert {tuple(r) for r in forest.spanning_forest(df).collect()} == {r for r in rows if r[2] in want}


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(20)], [(0, k) for k in range(1, 21)]])
def test_one_component_is_dealt_over_tasks(spark, edges):
    """A path and a star, whose merge trees may be as deep as they have edges."""
    rows = [(a, b, k + 1) for k, (a, b) in enumerate(edges)]
    df = spark.createDataFrame(rows, "src bigint, dst bigint, rank bigint")
    _, at = forest.intervals(df, graph.node_degree(df).withColumnRenamed("degree", "d"), 4)
    merges = [r["n"] for r in at.where("kind = 0").groupBy("at").agg(F.count("*").alias("n")).collect()]
    assert len(merges) >= 4 and max(merges) <= 4 and sum(merges) == 20
    assert max(r["n"] for r in at.where("kind = 2").groupBy("at").agg(F.count("*").alias("n")).collect()) <= 8
    labels, q = graph.girvan_newman(df.select("src", "dst"), df.select("src", "dst", F.col("rank").cast("double").alias("betweenness")), 4)
    whole, best = graph.girvan_newman(df.select("src", "dst"), df.select("src", "dst", F.col("rank").cast("double").alias("betweenness")))
    assert q.collect() == best.collect() and sorted(map(tuple, labels.collect())) == sorted(map(tuple, whole.collect()))


def test_no_edges_no_forest(spark):
    df = spark.createDataFrame([], "src bigint, dst bigint, rank bigint")
    assert forest.spanning_forest(df).count() == 0 and forest.merges(df, spark.createDataFrame([], "node bigint, d bigint")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(7, 7), (1000, 1001), (1001, 1002), (1002, 1003), (1003, 1004)]
    got = as_map(connected_components(spark.createDataFrame(edges, EDGE)), "node", "component")
    nodes = sorted({x for a, b in edges for x in (a, b) if a != b})
    label = _parts(nodes, [e for e in edges if e[0] != e[1]])
    for _ in range(20):
        label = {n: label[label[n]] for n in nodes}
    assert {k[0]: v for k, v in got.items()} == label
    assert connected_components(spark.createDataFrame([], EDGE)).count() == 0


def test_graph_pieces(spark):
    df = spark.createDataFrame(NINE, EDGE)
    assert graph.graph_stats(df).first().asDict() == {"edges": 9, "nodes": 7}
    assert as_map(graph.node_degree(df), "node", "degree")[(4,)] == 4
    levels = as_map(graph.bfs_levels(df, spark.createDataFrame([(1,)], "node bigint")), "root", "node", "level")
    assert levels == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 3, (1, 6): 3, (1, 7): 3}
    baskets = spark.createDataFrame([(u, f"i{k}") for u in (1, 2, 3) for k in range(9 + (u == 3)) if not (u == 2 and k == 0)], "user_id bigint, item string")
    assert [(r["src"], r["dst"], r["shared"]) for r in graph.cooccurrence_edges(baskets).collect()] == [(1, 3, 9)]
    named = graph.rank_nodes(spark.createDataFrame([(10, 30), (20, 30)], EDGE))
    assert {(r["src"], r["dst"]) for r in named.collect()} == {(1, 3), (2, 3)}


def test_global_rank(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 500)], "x int")
    got = [(r["x"], r["rank"]) for r in ranked(df, [F.col("x")]).collect()]
    assert [r for _, r in sorted(got)] == list(range(1, 501))


def test_itemsets(spark):
    rows = [(b, i) for b, items in enumerate(["abc", "abd", "ab", "cd"]) for i in items]
    df = spark.createDataFrame(rows, "basket bigint, item string")
    sets = {tuple(r["items"]): r["freq"] for r in itemsets.frequent_itemsets(df, 0.5).collect()}
    assert sets == {("a",): 3, ("b",): 3, ("c",): 2, ("d",): 2, ("a", "b"): 3}
    rules = {(tuple(r["antecedent"]), tuple(r["consequent"])): r["confidence"] for r in itemsets.association_rules(df, 0.5, 0.9).collect()}
    assert rules == {(("a",), ("b",)): 1.0, (("b",), ("a",)): 1.0}


def test_files(spark, ratings, tmp_path):
    io.write_csv(ratings.orderBy("user_id", "item_id"), f"{tmp_path}/r", single=True)
    back = io.read_csv(spark, f"{tmp_path}/r", "user_id bigint, item_id bigint, rating double")
    assert back.count() == ratings.count()
    (tmp_path / "t.csv").write_text('userId,movieId,tag,timestamp\n1,2,"a, b",3\n')
    naive = io.read_naive(spark, f"{tmp_path}/t.csv", "user_id bigint,item_id bigint,tag string")
    assert naive.first().asDict() == {"user_id": 1, "item_id": 2, "tag": '"a'}
    assert io.read_csv(spark, f"{tmp_path}/t.csv", io.TAGS).first()["tag"] == "a, b"
    (tmp_path / "m.csv").write_text('movieId,title,genres\n5,"Up, again",A|B\n')
    assert io.read_genres(spark, f"{tmp_path}/m.csv").first().asDict() == {"item_id": 5, "genres": ["A", "B"]}
    edges = spark.createDataFrame([(1, 2, 0.5)], "src bigint, dst bigint, b double")
    io.write_text(edges, io.edge_line("src", "dst", "b"), f"{tmp_path}/e", single=True)
    assert io.read_lines(spark, f"{tmp_path}/e").first()["value"] == "(1,2,0.5)"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_csv(ratings, f"{tmp_path}/r")
    (tmp_path / "bad.csv").write_text("u,i\nx,1\n")
    with pytest.raises(Exception, match="MALFORMED|CAST|parse"):
        io.read_csv(spark, f"{tmp_path}/bad.csv", io.KEYS).collect()


@pytest.mark.parametrize("block", [4, 2048])
def test_pairs_around(spark, block):
    """Every row with every other of its key, hot keys or not, one direction or both, asked or all; repeated rows count."""
    from orelode.functions.pairs import pairs_around

    rows = [(k, i, 100 * k + i) for k in range(3) for i in range(3 * k + 2)] + [(2, 1, 7), (None, 1, 0), (1, None, 0)]
    df = spark.createDataFrame(rows, "k int, id int, v int")
    live = [r for r in rows if r[0] is not None and r[1] is not None]
    want = sorted((a[1], b[1], a[2], b[2]) for a in live for b in live if a[0] == b[0] and a[1] != b[1])
    assert sorted(map(tuple, pairs_around(df, "k", "id", ["v"], block=block).collect())) == want
    assert sorted(map(tuple, pairs_around(df, "k", "id", ["v"], half=True, block=block).collect())) == [w for w in want if w[0] < w[1]]
    ids = spark.createDataFrame([(1,), (4,)], "id int")
    assert sorted(map(tuple, pairs_around(df, "k", "id", ["v"], asked=ids, block=block).collect())) == [w for w in want if w[0] in (1, 4)]
    assert pairs_around(df.limit(0), "k", "id", ["v"]).count() == 0


def test_pairs_are_not_shuffled(spark, ratings):
    """Sums of pairs, and the nearest of them, need no exchange by two ids; the nearest are those of the listed pairs."""
    pairs = similarity.pearson(ratings, "user_id", "item_id")
    near = similarity.pearson_nearest(ratings, "user_id", "item_id", 2, 4)
    for df in (pairs, near):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "id2" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    want = similarity.nearest(pairs, 2, 4)
    assert sorted((r["id"], r["other"], round(r["sim"], 9)) for r in near.where("sim <> 0").collect()) == sorted((r["id"], r["other"], round(r["sim"], 9)) for r in want.where("sim <> 0").collect())


def test_jaccard_in_buckets(spark):
    """Pairs that share a bucket and reach the threshold, copies too, and no other."""
    have = {1: "abcdef", 2: "abcdeg", 3: "abcdef", 4: "uvwxyz", 5: "abcdefg", 6: "uvwxy"}
    rows = spark.createDataFrame([(i, t) for i, s in have.items() for t in s], "id int, t string")
    shared = spark.createDataFrame([(i, k) for i, ks in {1: "pq", 2: "p", 3: "pq", 4: "r", 5: "q", 6: "s"}.items() for k in ks], "id int, k string")
    got = {(r["id1"], r["id2"]): round(r["jaccard"], 6) for r in similarity.jaccard_in_buckets(rows, shared, 0.5, 2).collect()}
    assert got == {(1, 3): 1.0, (1, 2): 0.714286, (2, 3): 0.714286, (1, 5): 0.857143, (3, 5): 0.857143}


@pytest.mark.parametrize("dense", [0, 200, 1 << 40])
def test_shared_counts(spark, dense):
    """Blocks, stripes and columns of any size, keys as columns or pair by pair: the counts of brute force, and no pair is shuffled."""
    from orelode.functions import pairs

    rng = random.Random(dense)
    rows = [(f"u{u:02}", k) for u in range(90) for k in (*rng.sample(range(40), rng.randint(0, 12)), *([99] if u % 3 else []))]
    df = spark.createDataFrame(rows + rows[:50] + [(None, 1), ("u01", None)], "id string, k int")
    own = defaultdict(set)
    for u, k in rows:
        own[u].add(k)
    want = sorted((a, b, len(own[a] & own[b]), len(own[a]), len(own[b])) for a in own for b in own if a < b and len(own[a] & own[b]) >= 3)
    got = pairs.shared_counts(df, "k", "id", 3, 30, 7, 5, dense)
    assert sorted(map(tuple, got.collect())) == want
    assert pairs.shared_counts(df.limit(0), "k", "id").count() == 0
    plan = graph.cooccurrence_edges(df.toDF("user_id", "item"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Join" not in plan


@pytest.mark.parametrize("full", [0, 8, 1 << 40])
def test_counted_by_rows_or_products(full):
    """Sums of rows and products of matrices count alike, also beyond what a byte holds."""
    from orelode.functions import pairs

    rng = np.random.default_rng(3)
    a, b = (rng.random((n, 700)) < 0.6 for n in (9, 13))
    assert (a.astype(int) @ b.T.astype(int)).max() > 200
    got = pairs._counted(np.nonzero(a), np.nonzero(b), 700, 128, 200, full)
    assert (got == a.astype(int) @ b.T.astype(int)).all()
    one = np.ones((2, 300), bool)
    assert (pairs._counted(np.nonzero(one), np.nonzero(one), 300, 128, 200, full) == 300).all()


def test_shared_counts_send_few_blocks(spark, monkeypatch):
    """Ids travel once for each block, whatever number of partitions the exchange has: blocks grow with what a task holds, and no pair is lost where Spark deals ranges anew."""
    from orelode.functions import pairs

    rows = [(u, (u * m + m) % 41) for u in range(600) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "id int, k int")
    own = defaultdict(set)
    for u, k in rows:
        own[u].add(k)
    want = sorted((a, b, len(own[a] & own[b])) for a in own for b in own if a < b and len(own[a] & own[b]) >= 11)
    ranged = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *cols: ranged(self, max(n, 23) if isinstance(n, int) else n, *cols))
    for more in ({}, {"block_keys": 1000}):
        got = pairs.shared_counts(df, "k", "id", 11, **more)
        assert sorted(map(tuple, got.select("id1", "id2", "shared").collect())) == want
    assert pairs.BLOCK_KEYS >= 1 << 20 and pairs.BLOCK_IDS >= 1 << 15


@pytest.mark.parametrize("least", [0.1, 0.5, 0.9])
def test_prefixes_meet_in_blocks(spark, monkeypatch, least):
    """All pairs of brute force, once each, in blocks of any size; no pair is dealt before it has passed. A null id is in no pair."""
    monkeypatch.setattr(similarity, "PREFIX_ITEMS", 300, raising=False)
    monkeypatch.setattr(similarity, "MEETS", 50, raising=False)
    rng = random.Random(5)
    base = [frozenset(rng.sample(range(60), rng.choice([1, 2, 5, 12, 13, 25]))) for _ in range(25)]
    have = {f"d{k}": base[k % 25] ^ frozenset(rng.sample(range(60), k % 4)) for k in range(120)}
    have = {k: s for k, s in have.items() if s}
    rows = [(k, f"t{x}") for k, s in have.items() for x in s] + [(None, "t1"), (None, "t2")]
    pairs, members = similarity.jaccard_classes_exact(spark.createDataFrame(rows, "id string, token string"), least)
    named = {}
    for k in sorted(have):
        named.setdefault(have[k], k)
    want = sorted((a, b, round(len(s & t) / len(s | t), 9)) for s, a in named.items() for t, b in named.items() if a < b and s & t and len(s & t) / len(s | t) >= least)
    assert sorted((*r[:2], round(r[2], 9)) for r in pairs.collect()) == want
    assert members.where("id is not null").count() == len(have) and members.count() == len(have) + 1
    assert "pos_explode" not in (plan := _plan(pairs).lower()) and "posexplode" not in plan and "mapinarrow" in plan


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shares_count_their_candidates(spark):
    """The second pass joins no candidate with baskets by item; empty baskets count among all."""
    rows = [(b, i) for b, items in enumerate(["abc", "abd", "ab", "cd"] * 9) for i in items] + [(99, None), (1, "a")]
    df = spark.createDataFrame(rows, "basket bigint, item string")
    got = itemsets.frequent_itemsets_by_share(df, 18 / 37, share=1)
    assert {(tuple(r["items"]), r["freq"]) for r in got.collect()} == {(("a",), 27), (("b",), 27), (("c",), 18), (("d",), 18), (("a", "b"), 27)}
    assert _plan(got).count("Join") == 1  # counts to itemsets


def test_queries_split_without_a_join(spark):
    from orelode.plans import catalog

    assert "Join" not in _plan(catalog.QUERIES["user_mean"](spark, "/root/testdata/sf0.001")).split("LogicalRDD")[0]
    df = spark.createDataFrame([(1, 9, 1.0), (1, 1, 2.0), (None, 1, 3.0)], "user_id bigint, item_id bigint, rating double")
    train, test = recommend.split_where(df, F.pmod(F.col("user_id") * 31 + F.col("item_id"), F.lit(10)) == 0)
    assert [r["rating"] for r in train.collect()] == [2.0] and [r["rating"] for r in test.collect()] == [1.0]


def test_signatures_shuffle_no_word(spark):
    """Words are cut to a document's least values before they are dealt."""
    from orelode.plans import catalog

    plan = catalog.QUERIES["minhash_signature"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD" not in plan


@pytest.mark.parametrize("block", [4, 2048])
def test_half_pairs_of_asked_ids(spark, block):
    """Pairs with an asked id once each; a list is dealt once, to its id, and meets no join on the way."""
    from orelode.functions.pairs import pairs_around

    rows = [(k, i, 100 * k + i) for k in range(3) for i in range(3 * k + 2)] + [(2, 1, 7), (None, 1, 0)]
    df, ids = spark.createDataFrame(rows, "k int, id int, v int"), spark.createDataFrame([(1,), (4,), (4,)], "id int")
    want = sorted((a[1], b[1], a[2], b[2]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1] and {a[1], b[1]} & {1, 4})
    assert sorted(map(tuple, pairs_around(df, "k", "id", ["v"], half=True, asked=ids, block=block).collect())) == want
    for half in (False, True):
        plan = _plan(pairs_around(df, "k", "id", ["v"], half=half, asked=ids))
        assert plan.index("Join") > plan.rindex("Generate")


@pytest.mark.parametrize("asked", [None, [3], [0, 5, 11, 99]])
def test_pearson_nearest_of_asked_ids(spark, asked):
    """The nearest are those of the listed pairs, for all ids or those asked for, hot keys or not."""
    rng = random.Random(8)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(24) for i in (0, *rng.sample(range(1, 9), 4))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")
    ids = None if asked is None else spark.createDataFrame([(a,) for a in asked], "user_id bigint")
    pairs = similarity.pearson(df, "user_id", "item_id").withColumn("sim", F.round("sim", 9)).checkpoint()
    want = similarity.nearest(pairs, 4, 24, asked=ids).join(similarity.directed(pairs).select("id", "other", "n"), ["id", "other"])
    got = similarity.pearson_nearest(df, "user_id", "item_id", 4, 24, asked=ids)
    assert sorted((r["id"], r["other"], r["n"], round(r["sim"], 9)) for r in got.collect()) == sorted((r["id"], r["other"], r["n"], r["sim"]) for r in want.where("sim <> 0").collect())


def test_betweenness_leaves_no_batch_behind(spark):
    """The shared folder has no table of a batch, and at most two of sums, however many batches there are."""
    import os

    from orelode.operators.components import ensure_checkpoint_dir

    at = ensure_checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    df = spark.createDataFrame([(0, n) for n in range(1, 131)], EDGE)
    rows = graph.edge_betweenness(df, textbook=True, tree_rows=1)
    left = [f for f in os.listdir(at) if f not in before and f.startswith("rounds-")]
    assert len(left) == 1 and len(os.listdir(f"{at}/{left[0]}")) <= 2
    assert {(r["dst"], r["betweenness"]) for r in rows.collect()} == {(n, 130.0) for n in range(1, 131)}


def test_tasks_of_content_and_lists_grow_with_the_rows(spark, ratings, genres, monkeypatch):
    """Ratings meet genres, and lists are made, in as many tasks as the rows ask for; an item of many ratings is dealt over some of them."""
    from orelode.functions import pairs

    asked = keys(spark, *[(u, i) for u in RATINGS for i in GENRES])
    want = as_map(recommend.predict_content(ratings, asked, genres), "user_id", "item_id", "prediction")
    cut = recommend.predict_content(ratings, asked, genres, task_ratings=1)
    got = as_map(cut, "user_id", "item_id", "prediction")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert "RepartitionByExpression [item_id" in _plan(cut) and f"], {sum(map(len, RATINGS.values())) + 1}" in _plan(cut)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 1)
    monkeypatch.setattr(pairs, "TASK_LISTS", 2)
    lists = _plan(pairs.pairs_around(ratings, "item_id", "user_id"))
    assert "RepartitionByExpression [__k" in lists and "], 18" in lists  # four items of three users: 36 pairs and 1, by two


def test_equal_baskets_are_one_class(spark, monkeypatch):
    """Users with equal baskets are one node of the work and all nodes of the answer: counts, degrees, ranks, modularity, levels and betweenness are those of the graph of all users."""
    from orelode.functions import pairs

    monkeypatch.setattr(pairs, "LIST_IDS", 2)
    rng = random.Random(8)
    kinds = [tuple(rng.sample(range(14), rng.choice([2, 3, 4, 5]))) for _ in range(26)]
    sets = {u: kinds[u % 26 if u % 26 < 20 else u % 3] for u in range(80)} | {u: (90 + u, 91 + u, 92 + u) for u in (200, 205)} | {u: (70, 71, 72) for u in (300, 301)}
    df = spark.createDataFrame([(u, k) for u, ks in sets.items() for k in ks], "user_id bigint, item int")
    want = sorted((a, b, n) for a in sets for b in sets if a < b and (n := len({*sets[a]} & {*sets[b]})) >= 3)
    assert sorted(map(tuple, graph.cooccurrence_edges(df, 3).collect())) == want
    edges, members = graph.cooccurrence_classes(df, 3)
    assert edges.count() < len(want) / 4  # nothing is made for every two users
    flat = spark.createDataFrame([w[:2] for w in want], EDGE)
    assert as_map(graph.class_degrees(edges, members).join(members, "rep"), "id", "degree") == as_map(graph.node_degree(flat), "node", "degree")
    assert sorted(map(tuple, graph.class_ranks(edges, members).collect())) == sorted(map(tuple, graph.rank_nodes(flat).collect()))
    labels = graph.class_nodes(edges, members).select(F.col("id").alias("node"), (F.col("id") % 3).alias("label"))
    assert math.isclose(graph.class_modularity(edges, members, labels).first()[0], graph.modularity(flat, labels).first()[0], rel_tol=1e-9)
    lists = graph.class_neighbours(edges, members).collect()
    assert {(r["id"], o) for r in lists for o in r["others"] if o != r["id"]} == {p for a, b, _ in want for p in ((a, b), (b, a))}
    assert as_map(graph.bfs_levels(edges, members=members), "root", "node", "level") == as_map(graph.bfs_levels(flat), "root", "node", "level")
    monkeypatch.setattr(graph, "SPREAD_ROWS", 5)
    for textbook in (False, True):
        one, all_ = (as_map(b, "src", "dst", "betweenness") for b in (graph.edge_betweenness(edges, textbook, members=members), graph.edge_betweenness(flat, textbook)))
        assert one.keys() == all_.keys() and all(math.isclose(one[e], all_[e], rel_tol=1e-9) for e in all_)


def test_trees_stay_packed(spark):
    """Shortest-path edges travel packed, 64 roots in a row: a batch's tables have no row for every root and edge."""
    from orelode.operators.components import Rounds

    put, rows = Rounds.put, []
    Rounds.put = lambda self, name, df: rows.append((out := put(self, name, df)).count()) or out
    try:
        found = as_map(graph.edge_betweenness(spark.createDataFrame([(a, a + 1) for a in range(60)] + [(0, 60)], EDGE), textbook=True), "src", "dst", "betweenness")
    finally:
        Rounds.put = put
    assert all(math.isclose(v, 15 * 31) for v in found.values()) and max(rows) < 61 * 61


def test_cosines_are_found_between_different_sets(spark):
    """Cosines of brute force, rounded, with all ids of equal sets; the tasks that count give pairs of different sets only."""
    sets = {k: {k % 4, 9 + k % 3, 20} for k in range(36)}
    df = spark.createDataFrame([(k, g) for k, s in sets.items() for g in s], "item_id bigint, genre int")
    got = similarity.binary_cosine(df, digits=6)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, round(len(sets[a] & sets[b]) / 3, 6)) for a in sets for b in sets if a < b)
    from orelode.functions import pairs

    assert pairs.shared_classes(df, "genre", "item_id")[0].count() == 12 * 11 // 2


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_blocks_are_written_once(spark, block):
    """Ids that share a code meet in blocks of any size, each pair once; a row is written once, however many blocks there are, and neither rows nor pairs are dealt after that."""
    import glob
    import os

    from orelode.functions import pairs
    from orelode.operators.components import ensure_checkpoint_dir

    at = ensure_checkpoint_dir(spark).removeprefix("file://")
    rng = random.Random(11)
    rows = [(f"d{u}", (b, [rng.randrange(9)])) for u in range(300) for b in range(3)]
    own = {f"d{u}": {(b, tuple(k)) for d, (b, k) in rows[3 * u : 3 * u + 3]} for u in range(300)}
    before = set(os.listdir(at))
    got = pairs.pairs_of_codes(spark.createDataFrame([*rows, *rows[:9], ("x", None), (None, rows[0][1])], "id string, k struct<band int, key array<int>>"), "k", "id", block)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in own for b in own if a < b and own[a] & own[b])
    folder = next(f for f in os.listdir(at) if f not in before and f.startswith("blocks-"))
    assert spark.read.parquet(f"{at}/{folder}").count() == 300 and (block > 300) == (len(glob.glob(f"{at}/{folder}/own=*")) < 8)
    assert (pairs.distinct(np.array([3, 1, 3, 2, 1])) == [1, 2, 3]).all() and not len(pairs.distinct(np.array([], int)))


def test_true_pairs_fetch_no_sets(spark):
    """Similarities are found where blocks meet: no whole set is joined to a pair, by prefixes or by buckets."""
    rows = spark.createDataFrame([(k, x) for k in range(40) for x in (*range(k % 5, k % 5 + 6), 50 + k)], "id int, token int")
    buckets = spark.createDataFrame([(k, 0) for k in range(40)], "id int, k int")
    for got in (similarity.jaccard_classes_exact(rows, 0.5)[0], similarity.jaccard_in_buckets(rows.toDF("id", "t"), buckets, 0.5)):
        plan = _plan(got)
        assert "array_intersect" not in plan and "Join" not in plan.split("MapInArrow")[0].replace("Join LeftOuter", "")
        assert {(r["id1"], r["id2"]): r["jaccard"] for r in got.collect()} == {(a, b): n / (14 - n) for a in range(40) for b in range(a + 1, 40) if (n := 6 - abs(a % 5 - b % 5)) / (14 - n) >= 0.5}
