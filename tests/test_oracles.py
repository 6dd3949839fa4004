"""Every registered query against its DuckDB oracle on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from feedlens.sources.tables import TABLES
from tools.oracle_check import digest

QUERIES = E.queries()
ORACLES = E.oracle_sql()
# The queries of the llm subpackage that SQL cannot express have tests of their own beside it.
ROWS_ONLY = {q for q in set(QUERIES) - set(ORACLES) if not re.match(r"op\d+_|pipeline$", q)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    assert ROWS_ONLY == {"synth_reviews"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["company", "day", "reddit", "trustpilot", "youtube"]
    assert df.count() > 0
