import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orelode.llm import ngramlm
from tests.llm.conftest import odd_documents, prose


def plain(rows):
    """Scores by dictionaries: trigrams under Witten-Bell smoothing."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for _, t, _, _ in rows]
    train = [zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for i, *_ in rows]
    c, c2, c3 = Counter(), Counter(), Counter()
    for k, f in zip(tokens, train):
        if f:
            c.update(k)
            c2.update(zip([0, *k], k))
            c3.update(zip([0, 0, *k], [0, *k], k))
    n, v = sum(c.values()), len(c)
    total2, kinds2, total3, kinds3 = Counter(), Counter(), Counter(), Counter()
    for (b, _), m in c2.items():
        total2[b] += m
        kinds2[b] += 1
    for (a, b, _), m in c3.items():
        total3[a, b] += m
        kinds3[a, b] += 1
    out = []
    for k, f, (i, *_) in zip(tokens, train, rows):
        score = 0.0
        for a, b, w in zip([0, 0, *k], [0, *k], k):
            p = (c[w] or v) / (n + v) if n else 1.0
            if kinds2[b]:
                p = (c2[b, w] + kinds2[b] * p) / (total2[b] + kinds2[b])
            if kinds3[a, b]:
                p = (c3[a, b, w] + kinds3[a, b] * p) / (total3[a, b] + kinds3[a, b])
            score += np.log10(p)
        out.append((i, not f, len(k), sum(c[w] > 0 for w in k), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in k), score))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], round(r[5], 4))


@pytest.mark.parametrize(("part_tokens", "hot_tokens"), [(2_400_000, 50_000), (400, 50_000), (400, 20)])
def test_against_dictionaries(spark, tables, monkeypatch, part_tokens, hot_tokens):
    rows = [(k, prose("en", 30 + k % 50, k), "en", "s") for k in range(150)] + odd_documents()
    if part_tokens < 1000:
        monkeypatch.setattr(ngramlm, "PART_TOKENS", part_tokens)
        monkeypatch.setattr(ngramlm.write_parts, "__defaults__", (part_tokens,))
        monkeypatch.setattr(ngramlm.score_documents, "__defaults__", (None, part_tokens, hot_tokens))
    got = sorted(map(tuple, ngramlm.op6_ngramlm(spark, tables(documents=rows)).collect()), key=key)
    want = sorted(plain(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-6 * 30_000)
    each = [(g[6] - w[6]) / g[2] for g, w in zip(got, want)]
    assert max(map(abs, each)) < 0.06 and abs(np.mean(each)) < 0.01


def test_sharper_than_the_base(spark, tables):
    rows = [(k, prose("en", 80, k % 40), "en", "s") for k in range(200)]
    got = [r for r in ngramlm.op6_ngramlm(spark, tables(documents=rows)).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_and_untrained(spark, tables):
    assert ngramlm.op6_ngramlm(spark, tables(documents=[])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "a b", False)], "doc_id bigint, text string, train boolean")
    row = ngramlm.score_documents(df).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**50), max_size=6, unique=True).map(sorted), max_size=8))
def test_steps_and_planes(groups):
    counts = np.array([len(g) for g in groups], np.int64)
    v = np.array([x for g in groups for x in g], np.uint64)
    assert (ngramlm.from_steps(ngramlm.from_planes(*ngramlm.planes(ngramlm.steps(v, counts))), counts) == v).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5), st.integers(0, 2**34)), max_size=40, unique=True), st.lists(st.integers(20, 40), unique=True))
def test_messages(rows, bare):
    rows.sort()
    key, word, before = (np.array(c, np.uint64) for c in zip(*rows)) if rows else (np.zeros(0, np.uint64),) * 3
    n = np.arange(len(rows))
    got = ngramlm.asked_from(ngramlm.unpack(ngramlm.pack(ngramlm.Asked(key, word, before, n, np.array(sorted(bare), np.uint64)).arrays())))
    keys, suc_ctx, words, tri_suc, pair_ctx, befores, tri_pair, m, others = got
    assert [*zip(keys[suc_ctx[tri_suc]].tolist(), words[tri_suc].tolist(), befores[tri_pair].tolist())] == rows
    assert (pair_ctx[tri_pair] == suc_ctx[tri_suc]).all() and (m == n).all() and others.tolist() == sorted(bare)


def test_scores_do_not_depend_on_parts(spark):
    rows = [(k, prose("en", 30 + k % 50, k), k % 7 != 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean").repartition(2)
    first, *others = ({r["doc_id"]: r["score"] for r in ngramlm.score_documents(x, 4, n, 20).collect()} for x, n in ((df, 2_400_000), (df, 1), (df.coalesce(1), 2_400_000), (df.repartition(3), 300), (df.repartition(8), 2_400_000)))
    for other in others:
        assert len(first) == len(other) == 60 and np.allclose([first[k] for k in first], [other[k] for k in first], atol=1e-9)


def test_shards_follow_the_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(k, "word " * 1000) for k in range(100)], "doc_id bigint, text string")
    assert ngramlm.shards_for(df) == 4
    monkeypatch.setattr(ngramlm, "SHARD_BYTES", 10_000)
    assert ngramlm.shards_for(df) == 50


def test_equal_parts_are_two(spark, tmp_path):
    """The same file twice in a folder: twice the rows, twice the counts, as in dictionaries."""
    rows = [(k, prose("en", 30 + k % 50, k), "en", "s") for k in range(40)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").coalesce(1)
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "twice"))
    twice = spark.read.parquet(str(tmp_path / "twice")).select("doc_id", "text", ngramlm.crc_mod("doc_id", 7).alias("m")).selectExpr("doc_id", "text", "m <> 2 as train")
    got = sorted(map(tuple, ngramlm.score_documents(twice).collect()), key=lambda r: (r[0], r[5]))
    want = sorted(plain(rows * 2), key=lambda r: r[0])
    assert [(g[0], g[2], g[3], g[6]) for g in got] == [(w[0], w[2], w[3], w[4]) for w in want]
    assert np.allclose([g[4] for g in got], [w[5] for w in want]) and max(abs(g[5] - w[6]) / g[2] for g, w in zip(got, want)) < 0.06


def test_files_are_deleted(spark, tables, tmp_path):
    import glob
    import re as regex

    from orelode.llm.common import shared_dir

    rows = [(k, prose("en", 30, k), "en", "s") for k in range(10)]
    assert ngramlm.op6_ngramlm(spark, tables(documents=rows)).count() == 10
    assert not glob.glob(regex.sub("^file:/*", "/", shared_dir(spark)) + "/ngrams-*")
