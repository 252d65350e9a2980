import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orelode.llm import toxicity
from orelode.llm.textcore import mix
from tests.llm.conftest import odd_documents, prose

SLURS = ["idiot", "grubach", "zorkely"]


def corpus(n=400):
    rows, labels = [], []
    for i in range(n):
        rng, toxic = random.Random(i), i % 4 == 0
        words = prose("en", 60, i).split()
        if toxic:
            words.insert(rng.randrange(60), SLURS[0] if i % 8 else SLURS[1 + i % 3 % 2] + rng.choice("abcde"))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic), "clash"))
    return rows, labels


def test_finds_words_and_stems(spark, tables):
    rows, labels = corpus()
    at = tables(documents=rows + odd_documents(), labels=[*labels, (3, None, None, None), (None, 1, 1, None), (99_999, 1, 1, None)])
    got = toxicity.op8_toxicity(spark, at).collect()
    assert len(got) == len(rows) + len(odd_documents())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    wrong = [r for r in known if r["predicted"] != int(r["doc_id"] % 4 == 0)]
    assert any(r["held_out"] for r in known) and len(wrong) <= 0.02 * len(known), wrong[:5]
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] is not None and r["doc_id"] >= 10_000)


def test_without_labels(spark, tables):
    at = tables(documents=[(1, "you idiot", "en", "s"), (2, "a fine day", "en", "s"), (3, None, None, None)], labels=[])
    assert {r["doc_id"]: r["predicted"] for r in toxicity.op8_toxicity(spark, at).collect()} == {1: 1, 2: 0, 3: 0}


def test_empty_tables(spark, tables):
    assert toxicity.op8_toxicity(spark, tables(documents=[], labels=[])).count() == 0


def test_stage(spark, tables):
    rows, labels = corpus(200)
    at = tables(documents=rows, labels=labels)
    docs = spark.read.parquet(at + "/documents.parquet")
    kept = toxicity.keep_civil(docs, toxicity.learn_from(docs, spark.read.parquet(at + "/labels.parquet")))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {i for i in range(200) if i % 4} and len(ids & {i for i in range(200) if i % 4 == 0}) <= 4


def test_large_lexicon_keeps_rare_words():
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfghklmnprstvz") for _ in range(12)) for _ in range(150)]
    texts = [f"{prose('en', 40, i)} {words[i // 8 % 150]}" for i in range(1200)] + [prose("en", 41, 5000 + i) for i in range(3600)]
    toxic = np.arange(len(texts)) < 1200
    found = toxicity.find_voters(pa.array(texts, pa.large_string()), toxic)
    assert {toxicity.text_hash(w.encode()) for w in words} <= {int(k) for k in found}
    model = toxicity.train(pa.array(texts, pa.large_string()), toxic)
    scores = model.score(pa.array([f"{prose('en', 40, 9000 + k)} {w}" for k, w in enumerate(words)], pa.large_string()))
    assert (scores >= 0.5).all()


def test_scores_by_brute_force(spark, tables):
    """The query's scores are the weights of the voters that fire, found word by word and letter by letter."""
    rows, labels = corpus(200)
    shouting = [(900, "SHUT UP YOU GRUBACHX NOW PLEASE!!! ok", "en", "s"), (901, "sooo f*ck it a!!!b!!", "en", "s"), (902, "É IDIOT\nidiot, Zorkelya", "en", "s")]
    at = tables(documents=rows + shouting + odd_documents(), labels=labels)
    docs = spark.read.parquet(at + "/documents.parquet")
    model = toxicity.learn_from(docs, spark.read.parquet(at + "/labels.parquet"))
    place = {int(k): i for i, k in enumerate(model.keys)}

    def plain(text):
        fired = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
            fired.add(place.get(toxicity.text_hash(word)))
            for k in toxicity.STEMS:
                if len(word) > k:
                    fired.add(place.get(int(mix(np.array([toxicity.text_hash(word[:k])], np.uint64) ^ toxicity._STEM_SALT)[0])))
        raw = text or ""
        upper, lower = (sum(a <= c <= z for c in raw) for a, z in ("AZ", "az"))
        signs = [upper > 0.6 * max(upper + lower, 12), sum(raw[i : i + 2] == "!!" for i in range(len(raw))) > 2, re.search(r"[a-z]\*", raw), re.search(r"([a-z])\1\1", raw)]
        fired |= {len(model.keys) + k for k, sign in enumerate(signs) if sign}
        return 1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights[v] for v in fired - {None}), -30, 30)))

    texts = {r[0]: r[1] for r in rows + shouting + odd_documents() if r[0] is not None}
    for r in toxicity.op8_toxicity(spark, at).collect():
        if r["doc_id"] is not None:
            assert r["score"] == pytest.approx(plain(texts[r["doc_id"]])), texts[r["doc_id"]][:80]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot", 0.0, "a"), (2, "fine", 1.0, "b")], "doc_id bigint, text string, __toxicity double, score string")
    kept = toxicity.keep_civil(docs, toxicity.train(pa.array([], pa.large_string()), np.zeros(0, bool)))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "fine", 1.0, "b")]
