import os
import shutil
import subprocess
import sys
import zipfile

import duckdb
import pytest

import __spark_entry__ as entry
from orbitlake.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


LEFT_ALONE = """
import __spark_entry__ as entry
from orbitlake.plans import catalogue
assert entry.__file__.startswith({root!r}), entry.__file__
assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.SQL)
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_the_library_does_not_need_the_training_operators(tmp_path, pipeline_too):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("orbitlake/llm", "tests/llm"):
        shutil.rmtree(os.path.join(copy, folder), ignore_errors=True)
    if pipeline_too and os.path.exists(os.path.join(copy, "corpus_pipeline.py")):
        os.remove(os.path.join(copy, "corpus_pipeline.py"))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", LEFT_ALONE.format(root=copy)], cwd=copy, env=environment, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_modules_are_sent_to_the_workers(spark):
    with zipfile.ZipFile(entry._archive()) as z:
        assert "orbitlake/__init__.py" in z.namelist() and "orbitlake/operators/simulate.py" in z.namelist()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["settling", "regime_class", "mask_geometry", "tensor_layer_a", "cluster_coherence", "seed_mix", "entity_profiles", "autocorr_first_min"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    show = lambda df: sorted(tuple("" if v is None or v != v or str(v) == "<NA>" else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert show(got) == show(want)
