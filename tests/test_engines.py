"""A sample of named queries against their SQL equivalents, and the contract of the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from compare_engines import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ("a11_batch_rows", "b11_accept_view", "c43_summarise", "d7_repeated_openings", "e13_duplicate_ids", "f15_snapshot_diff",
          "g5_open_operations", "h8_box_stats", "i2_text_overlap", "j1_fonts")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, connection, name):
    status, count, _ = compare(spark, connection, SF, name, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert status == "ok" and count > 0


def test_entry_and_catalogue(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["doc_id", "error", "warn", "info", "status"] and frame.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_stream_replay_equals_batch(spark, rows):
    queries = entry_module.queries()
    batch, stream = queries["g1_history_fold"](spark, SF), queries["k2_history_fold_stream"](spark, SF)
    assert rows(batch.select(sorted(batch.columns))) == rows(stream.select(sorted(batch.columns)))


def test_catalogue_loads_without_the_training_data_part(tmp_path):
    """In a copy without the optional folders, the entry module lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "proofline", tmp_path / "proofline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(s) <= set(q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
