from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "model_key" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_the_flagship_ranks_without_a_shuffle_of_profiles(spark, sf):
    plan = entry.queries()["recommend_topk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" in plan


def test_scans_are_pruned(spark, sf):
    plan = entry.queries()["scan_pruned_keys"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint>" in plan


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """A copy without the part imports and has the other queries; a fault inside the part is not passed over."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("aspectra", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy
        if os.path.exists(f"{root}/{name}"):
            copy(f"{root}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') for k in q), 'pipeline' in q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    part = tmp_path / "aspectra" / "llm"
    if part.exists():
        (part / "common.py").rename(part / "hidden.py")
        assert run().returncode != 0
        shutil.rmtree(part)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    n, has_op, has_pipeline = run().stdout.split()
    assert int(n) > 100 and has_op == has_pipeline == "False"
