from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from storyframe.plans import queries as own

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    return None if value is None else round(float(value), 6) if isinstance(value, (int, float)) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(own.ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    df = own.QUERIES[name](spark, sf)
    result = duck.sql(own.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    found = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    places = [result.columns.index(c) for c in columns]
    expected = sorted((tuple(normal(r[p]) for p in places) for r in result.fetchall()), key=repr)
    assert found == expected


@pytest.mark.parametrize("name", [n for n in own.QUERIES if n not in own.ORACLES])
def test_query_runs(spark, sf, name):
    assert own.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, *a):
        if name.startswith('storyframe.llm') or name == 'corpus_pipeline':
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and not any(n.startswith('op1_') for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
