import math

import numpy as np
import pytest

from orelode.llm import embeddings


def brute(vectors, cosine=0.9):
    n, links, comp = len(vectors), np.zeros(len(vectors), int), list(range(len(vectors)))

    def good(v):
        return v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            x, y = vectors[a], vectors[b]
            if good(x) and good(y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    p, q = root(a), root(b)
                    comp[max(p, q)] = min(p, q)
    return links.tolist(), [root(x) for x in range(n)]


def rows(seed, n, copies=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    near = base[rng.integers(0, n, n)] + rng.normal(size=(n, 16)) * 0.12
    tight = base[0] + rng.normal(size=(copies, 16)) * 0.05
    return [x.astype(np.float32).tolist() for x in np.concatenate([base, near, tight])]


ODD = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 3, [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.0], [1.0]]


@pytest.mark.parametrize(("hot", "kind"), [(4096, "float"), (30, "float"), (4096, "double")])
def test_against_brute_force(spark, monkeypatch, hot, kind):
    vectors = rows(hot, 150, 120) + ODD
    vectors += [vectors[0], vectors[0], vectors[3]]
    classes = len({tuple(v) if v else None for v in vectors})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], f"vec_id bigint, embedding array<{kind}>")
    if hot < 100:
        full = embeddings.link_classes
        monkeypatch.setattr(embeddings, "link_classes", lambda c, n, cosine, kind: full(c, n, cosine, hot, kind))
    got = sorted(embeddings.near_duplicates(df).collect(), key=lambda r: r["id"])
    links, comp = brute(vectors)
    found = [r["n_links"] for r in got]
    assert all(f <= want for f, want in zip(found, links)) and classes
    assert sum(found) >= 0.99 * sum(links)
    assert np.mean([r["component_id"] == c for r, c in zip(got, comp)]) >= 0.99


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_pairs_against_sql(spark, tables, seed):
    """Pairs of a cosine just over the threshold, under it, and exact copies, held against the registered SQL."""
    import duckdb

    rng = np.random.default_rng(seed)
    rows = []
    for k in range(300):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = (0.86, 0.905, 0.93, 0.97, 1.0)[k % 5]
        rows += [(2 * k, x.astype(np.float32).tolist()), (2 * k + 1, (3 * (c * x + math.sqrt(1 - c * c) * y)).astype(np.float32).tolist())]
    at = tables(embeddings=[(i, v, 0, None, None) for i, v in rows])
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{at}/embeddings.parquet/*.parquet'")
    want = {r[0]: r for r in con.execute(embeddings.ORACLE).fetchall()}
    got = {r["vec_id"]: tuple(r) for r in embeddings.op10_embeddings(spark, at).collect()}
    linked = [i for i, r in want.items() if r[1]]
    assert len(linked) >= 480 and set(got) == set(want) and all(got[i] == r for i, r in want.items() if not r[1])
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.99


def test_what_travels_is_short(spark):
    """Vectors without a near one reach no bucket but as sketches, and near ones survive them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 64))
    alone = embeddings.sketched_pairs(embeddings.sketches(x), np.full(400, 2, np.int8), embeddings.sketch_reach(0.9))
    assert alone.mean() < 0.02
    y = 0.9 * x / np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) / (x * x).sum(axis=1, keepdims=True) * x
    both = embeddings.sketches(np.concatenate([x, y + math.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)]))
    side = np.repeat(np.array([0, 1], np.int8), 400)
    assert embeddings.sketched_pairs(both, side, embeddings.sketch_reach(0.9)).all()


def test_repeated_null_and_clashing(spark, tables):
    rows = [(1, [1.0, 0.0], 0, "k", 9), (1, [1.0, 0.0], 0, None, None), (None, [1.0, 0.0], None, None, None), (None, [0.0, 1.0], 1, None, None), (7, None, 1, None, 1)]
    got = sorted(embeddings.op10_embeddings(spark, tables(embeddings=rows)).collect(), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False), (7, 0, 7, True)]))


def test_empty(spark, tables):
    assert embeddings.op10_embeddings(spark, tables(embeddings=[])).count() == 0


def test_tables_follow_the_size():
    for n in (10, 1000, 10**6, 10**9):
        bits, tables = embeddings.tables_for(n)
        missed = (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables
        assert missed <= embeddings.MISS and n / 2**bits < 4 * embeddings.BUCKET_ROWS
