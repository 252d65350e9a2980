import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from orelode.llm import neardup
from tests.llm.conftest import odd_documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def groups(texts):
    """Components of all pairs with a Jaccard similarity of 0.8 or more, by brute force; and the pairs under 1."""
    sets, out, near = [shingles(t) for t in texts], list(range(len(texts))), []
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            near += [(a, b)] if x != y else []
            low, high = sorted((out[a], out[b]))
            out = [low if o == high else o for o in out]
    return out, near


def planted():
    """Texts with copies of which up to six words are changed or cut, chains, and a group that shares a passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 250))]
        texts.append(" ".join(base))
        for edits in range(1, 7):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - rng.choice([0, 3])]).upper())
    chain = [word() for _ in range(120)]
    for k in range(12):
        texts.append(" ".join(chain[4 * k :] + [word() for _ in range(4 * k)]))
    passage = [word() for _ in range(150)]
    texts += [" ".join(passage + [word() for _ in range(40 + k)]) for k in range(20)]
    return texts


@pytest.mark.parametrize("block", [1024, 3])
def test_components_equal_brute_force(spark, tables, block):
    texts = planted()
    want, near = groups(texts)
    assert len(near) > 100
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    docs = spark.read.parquet(tables(documents=rows) + "/documents.parquet")
    found = {}
    for r in neardup.components(docs, block=block).collect():
        found.setdefault(r["component"], []).append(r["id"])
    least = {i: min(ids) for ids in found.values() for i in ids}
    assert [least[k] for k in range(len(texts))] == want


def test_pipeline_stage_takes_near_copies(spark, tables):
    texts = planted()
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    at = tables(documents=rows)
    docs = spark.read.parquet(at + "/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, at)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups(texts)[0]))


def test_odd_and_empty(spark, tables):
    rows = odd_documents()
    docs = spark.read.parquet(tables(documents=rows) + "/documents.parquet")
    assert neardup.components(docs).count() == len(rows)
    assert neardup.keep_one(docs.limit(0)).count() == 0
    assert neardup.keep_one(docs).count() == len(set(groups([t for _, t, _, _ in rows])[0]))


def test_bucket_links_join_known_components():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a + np.uint64(5), a + np.uint64(500), a + np.uint64(505), a + np.uint64(900)]
    assert sorted(map(sorted, neardup.bucket_links(np.array([0, 1, 2, 3, 4]), sets))) == [[0, 1], [2, 3]]
    linked = list(neardup.bucket_links(np.array([0, 1, 1, 3, 4]), sets))
    assert sorted(map(sorted, linked)) == [[0, 1], [2, 3]]
    assert list(neardup.bucket_links(np.array([7, 7, 8, 8, 8]), sets)) == []
