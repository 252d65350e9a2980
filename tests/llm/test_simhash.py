import itertools
import re

import numpy as np
import pytest
import xxhash

from orelode.llm import simhash
from tests.llm.conftest import odd_documents, prose


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def label(fps, distance=2):
    out = list(range(len(fps)))

    def root(x):
        while out[x] != x:
            x = out[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = root(a), root(b)
            out[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(fps))]


def test_query(spark, tables):
    base = [prose("en", 300, k) for k in range(12)]
    rows = [(k, t, "en", "s") for k, t in enumerate(base)] + [(20 + k, t.upper(), "en", "s") for k, t in enumerate(base)]
    rows += [(40 + k, t + " one", "en", "s") for k, t in enumerate(base)] + odd_documents()
    got = sorted(simhash.op9_simhash(spark, tables(documents=rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, f"{plain(r[1]):016x}"))
    fps = [plain(t) for _, t, _, _ in rows]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    groups = label(fps)
    least = {}
    for g, r in zip(groups, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    assert [r["component_id"] for r in got] == [least.get(g) for g in groups]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_links_find_all_components(spark, hot):
    rng = np.random.default_rng(hot)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds[:8]:  # chains and dense groups
        at = int(s)
        for _ in range(60):
            at ^= 1 << int(rng.integers(64)) if rng.random() < 0.5 else (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.add(at)
        fps |= {int(s) ^ (1 << a) ^ (1 << b) for a in range(5) for b in range(a)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    links = simhash.near_links(df, hot_rows=hot).collect()
    index = {f: i for i, f in enumerate(fps)}
    out = list(range(len(fps)))
    pairs = [(index[int(np.int64(r[0]).view(np.uint64))], index[int(np.int64(r[1]).view(np.uint64))]) for r in links]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)
    for _ in range(len(fps)):
        before = list(out)
        for a, b in pairs:
            out[a] = out[b] = min(out[a], out[b])
        if out == before:
            break
    assert out == label(fps)


def test_large_buckets_equal_small():
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 12, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 400).astype(np.uint64)))
    key, probe = np.zeros(len(fp), np.uint64), np.zeros(len(fp), bool)

    def groups(pairwise):
        f = simhash.Forest(len(fp))
        for a, b in simhash.bucket_links(key, fp, probe, 2, pairwise):
            f.link(np.searchsorted(fp, a), np.searchsorted(fp, b))
        return f.label.tolist()

    assert groups(4) == groups(10_000) == label([int(x) for x in fp])


@pytest.mark.parametrize(("distance", "hot"), [(0, 20_000), (1, 5), (5, 20_000), (7, 12)])
def test_other_distances(spark, distance, hot):
    rng = np.random.default_rng(distance)
    fps = set()
    for s in rng.integers(0, 2**63, 12):
        for k in range(12):
            at = int(s)
            for b in rng.choice(64, k, replace=False):
                at ^= 1 << int(b)
            fps.add(at)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    index = {f: i for i, f in enumerate(fps)}
    f = simhash.Forest(len(fps))
    pairs = [[index[int(np.int64(x).view(np.uint64))] for x in r] for r in simhash.near_links(df, distance, hot).collect()]
    a, b = np.array(pairs, int).reshape(-1, 2).T
    f.link(a, b)
    assert f.label.tolist() == label(fps, distance)


def test_majority_of_long_segments():
    rng = np.random.default_rng(3)
    h, offs = rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 0, 7, 7, 300, 500, 500])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:z]) > z - a) for a, z in zip(offs, offs[1:])]
    assert simhash.bit_majority(h, offs).tolist() == simhash.bit_majority(h, offs, most=9).tolist() == want


def test_repeated_rows_with_other_columns(spark):
    rows = [(1, "a b c", "x", "p"), (1, "a b c", "y", "q"), (2, "A b c", "z", "r"), (3, "other words here", None, None), (None, "a b c", "w", None)]
    kept = [simhash.keep_one(spark.createDataFrame(r, "doc_id bigint, text string, __own string, fp string").repartition(3)).collect() for r in (rows, rows[::-1])]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) and sorted(str(r["doc_id"]) for r in kept[0]) in (["1", "3"], ["3", "None"])


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_allocation_keeps_the_pigeonhole_sum(m):
    parts = [p.tolist() for p in np.array_split(np.arange(64), m)]
    got = simhash.allocate([10.0 * (k + 1) for k in range(m)], np.full(64, 0.5), parts, 1000, 2)
    assert sum(got.thresholds) == 2 - m + 1 and min(got.thresholds) >= -1
    options = [e for e in itertools.product(range(-1, 3), repeat=m) if sum(e) == 3 - m]
    assert tuple(got.thresholds) in options


def test_empty(spark, tables):
    assert simhash.op9_simhash(spark, tables(documents=[])).count() == 0


def test_stage_keeps_one(spark, tables):
    text = prose("en", 200, 1)
    rows = [(5, text, "en", "s"), (3, text.upper(), "en", "s"), (4, text, "en", "s"), (3, text.upper(), "en", "s"), (8, prose("fr", 200, 2), "fr", "s"), (None, prose("de", 90, 2), None, None)]
    docs = spark.read.parquet(tables(documents=rows) + "/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "8", "None"]
