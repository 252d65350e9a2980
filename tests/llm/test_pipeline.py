import corpus_pipeline
from tests.llm.conftest import ODD, prose


def test_stages(spark, tables):
    rows = [(k, prose(["en", "fr", "de"][k % 3], 60, k) + (" you idiot scum" if k % 10 == 0 else ""), ["en", "fr", "de"][k % 3], f"s{k % 4}") for k in range(200)]
    rows += [(500 + k, rows[k + 1][1], "en", "s1") for k in range(8)] + [(900 + k, t, None, None) for k, t in enumerate(ODD)]
    labels = [(k, 1, int(k % 10 == 0), "x") for k in range(200)]
    at = tables(documents=rows, labels=labels)
    docs = spark.read.parquet(at + "/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = stage(spark, docs, at).cache()
        if name != "bpe":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in seen.items()}
    assert set(range(200)) <= ids["language"] and not ids["language"] & {900, 901, 902, 903}
    assert not ids["toxicity"] & set(range(0, 200, 10)) and {1, 2, 3} <= ids["toxicity"]
    assert not ids["near_duplicates"] & {500, 501, 502}
    assert seen["bpe"].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert seen["bpe"].count() == seen["mixing"].count()
    assert corpus_pipeline.run(spark, at).count() == seen["bpe"].count()


def test_empty(spark, tables):
    assert corpus_pipeline.run(spark, tables(documents=[], labels=[])).count() == 0


def test_near_duplicates_by_fingerprint(spark, tables):
    """Equal fingerprints join texts of different shingle sets; a near copy of either is in the group too."""
    tails = [" ".join(f"{x}{k}" for k in range(20)) for x in "ab"]
    first, second = ("one two three " * 50 + t for t in tails)
    rows = [(1, first, "en", "s0"), (2, second, "en", "s0"), (3, second + " end", "en", "s0"), (4, prose("en", 60, 1), "en", "s0")]
    at = tables(documents=rows, labels=[])
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(at + "/documents.parquet"), at)
    assert {r["doc_id"] for r in kept.collect()} == {1, 4}


def test_near_duplicates_find_components_twice(spark, tables, monkeypatch):
    """Links of both kinds are joined at once: components are found among the sets' first links and for the groups, no more."""
    from orelode.llm import neardup, simhash

    runs, found = [], neardup.connected_components
    for module in (corpus_pipeline, neardup, simhash):
        monkeypatch.setattr(module, "connected_components", lambda edges: runs.append(1) or found(edges))
    rows = [(k, prose("en", 60, k // 2) + (" end" if k % 2 else ""), "en", "s0") for k in range(10)]
    at = tables(documents=rows, labels=[])
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(at + "/documents.parquet"), at)
    assert {r["doc_id"] for r in kept.collect()} == {0, 2, 4, 6, 8} and len(runs) == 2
