import hashlib
import re
from collections import defaultdict

import pytest

from orelode.llm import exactdedup

from .conftest import ODD, odd_documents

HEAVY = [(50_000 + k, "the  same\ttext" if k % 2 else "the same text", "en", "hot") for k in range(700)]


def expected(rows):
    """Groups by dictionary; ids of kept rows, a null one greater than any other."""
    by = defaultdict(list)
    for r in rows:
        by[re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")].append(r[0])
    out = []
    for norm, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        left = 1  # one row of the least id stays
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("tracked", [8, 4096])
def test_groups_equal_a_dictionary(spark, tables, tracked, monkeypatch):
    monkeypatch.setattr(exactdedup.groups, "__defaults__", (tracked,))
    rows = [*odd_documents(), *HEAVY, *[(k, f"text {k // 3}", "en", "s") for k in range(900)]]
    got = exactdedup.op12_exactdedup(spark, tables(rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_frequent_digests_are_all_found(spark):
    rows = [(f"{k}".encode(),) for k in range(3000)] + [(b"a",)] * 900 + [(b"b",)] * 600
    found = {bytes(r[0]) for r in exactdedup.frequent_digests(spark.createDataFrame(rows, "digest binary").repartition(6), 64).collect()}
    assert {b"a", b"b"} <= found and len(found) <= 64


def test_keep_one_keeps_all_columns(spark, tables):
    rows = [*odd_documents(), *HEAVY]
    docs = spark.read.parquet(f"{tables(rows)}/documents.parquet").withColumnsRenamed({"u": "place", "fp": "first", "component": "digest", "lang": "kept"})
    kept = exactdedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows})
    assert {r["doc_id"] for r in kept.where("source = 'hot'").collect()} == {50_000}


def test_empty_table(spark, tables):
    assert exactdedup.op12_exactdedup(spark, tables([])).count() == 0


def test_plan_has_no_python_and_one_shuffle_by_digest(spark, tables):
    plan = exactdedup.op12_exactdedup(spark, tables([(k, t, None, None) for k, t in enumerate(ODD)]))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Python" not in physical and physical.count("hashpartitioning") == 1
