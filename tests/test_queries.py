"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__
from lexloom.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(table):
    fix = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[[fix(v) for v in table.column(n).to_pylist()] for n in names])))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DATA).toArrow()) == plain(duck.sql(ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", ["lexical_topk", "lexical_topk_filtered", "union_passes_topk", "retrieval_by_language"])
def test_search_makes_no_pairs_of_all_tokens_and_texts(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]
