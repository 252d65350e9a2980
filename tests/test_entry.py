"""The driver contract, with and without the training-data part."""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
TINY = "/root/testdata/sf0.001"
QUICK = ["avg_rating_by_tag", "split_counts", "bag_subtract", "user_mean", "inverse_user_frequency", "freq_itemsets", "assoc_rules", "genre_cosine", "naive_fields", "predict_content", "error_histogram", "connected_components", "single_part_roundtrip", "top_items", "freq_itemsets_by_share", "csv_roundtrip"]


def _has(name: str) -> bool:
    """Whether a module can be found, without any of its parents."""
    try:
        return importlib.util.find_spec(name) is not None
    except ModuleNotFoundError:
        return False


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(1, 14) if _has("orelode.llm") else []:
        assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


LIBRARY_ONLY = "import __spark_entry__ as e; q = e.queries(); assert 'word_count' in q and 'pipeline' not in q and not [k for k in q if k[:2] == 'op']; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_training_data_part(tmp_path, pipeline):
    shutil.copytree(REPO / "orelode", tmp_path / "orelode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from orelode.llm import bpe\n")
    subprocess.run([sys.executable, "-c", LIBRARY_ONLY], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not _has("orelode.llm"), reason="needs the training-data part")
@pytest.mark.parametrize("package", ["zstandard", "regex", "xxhash", "tokenizers"])
def test_without_an_optional_package(package):
    code = f"import sys; sys.modules['{package}'] = None; import __spark_entry__ as e; assert 'word_count' in e.queries() and 'word_count' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def _rows(frame):
    clean = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in clean.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(TINY), reason="needs the benchmark tables")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    import duckdb

    from orelode.plans import catalog

    con = duckdb.connect()
    for path in Path(TINY).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    assert _rows(catalog.QUERIES[name](spark, TINY).toPandas()) == _rows(con.execute(catalog.ORACLES[name]).df())
