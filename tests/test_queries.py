"""Every registered query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from aeroweave.queries import QUERIES
from conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def as_rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(pdf.astype(object).where(pdf.notna(), None).astype(str).agg("|".join, axis=1).tolist())


#: The training-data queries have tests of their own.
OWN = sorted(QUERIES)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = sql.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("gone", [["aeroweave/llm"], ["aeroweave/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_imports_without_the_training_data_operators(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *(os.path.basename(g) for g in gone)))
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout
    assert ("op1_" in out) == ("aeroweave/llm" not in gone) and "'pipeline'" not in out and all(f"'{name}'" in out for name in OWN)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
