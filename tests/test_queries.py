"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from gridpulse.plans import catalog, oracle
from tools.compare import TABLES, TYPE_NAMES, comparable

QUERIES, SQL = catalog.registered(), oracle.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_only_fitted_results_lack_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(SQL) == {
        "risk_model", "risk_model_metrics", "risk_ablation", "risk_scores", "risk_point",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    relation = duck.sql(SQL[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {f.name: TYPE_NAMES[f.dataType.simpleString()] for f in df.schema.fields} == types
    got, want = comparable(df.toPandas()), comparable(relation.df())
    assert got.equals(want), (got.compare(want) if len(got) == len(want) else (got, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
    assert rows == sorted(rows, key=lambda r: (-r["total_activity"], r["grid_id"]))
