"""Every query of the library against its SQL on the smallest test tables."""

import importlib
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from defectlake.catalogue_of_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    cell = lambda v: None if pd.isna(v) else round(float(v), 8) if isinstance(v, float) else str(v)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_stands_without_the_optional_package(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("defectlake", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "defectlake").mkdir()
    for p in (ROOT / "defectlake").iterdir():
        if p.name != "llm":
            (tmp_path / "defectlake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    assert importlib.import_module("__spark_entry__").entry
