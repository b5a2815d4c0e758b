"""Every core query over the smallest tables, against its SQL twin where it has one."""

import math
import os

import duckdb
import pytest

from weftline.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v if v is None else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE:
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())


def test_every_fiftieth_document_searches(spark, duck):
    """With or without a source, so that searches grow with the data."""
    got = {r["query"] for r in QUERIES["bm25_search"](spark, DATA).select("query").distinct().collect()}
    ids = {r[0] for r in duck.sql("select doc_id from documents where doc_id % 50 = 0 and regexp_matches(text, '[A-Za-z_][A-Za-z_0-9]{2}')").fetchall()}
    assert got >= ids and all(q % 50 == 0 for q in got) and got


@pytest.mark.parametrize("name", ["discovery_search", "rrf_search", "pit_search", "bm25_search"])
def test_searches_move_no_pairs(name, spark):
    """Scores are made and used where a query's block is: after that nothing is joined, grouped or dealt out."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert len(plan) > 1 and not any(x in part for part in plan for x in ("Join", "Aggregate", "Window"))


def test_searches_of_odd_documents(spark, tmp_path):
    """Repeated, empty and null ids and texts, against the SQL."""
    con = duckdb.connect()
    con.sql("create table documents as select * from (values (50, 'abc def abc', 'a'), (50, 'abc xyz', 'a'), (51, 'abc', 'a'), (52, 'abc', null), (100, null, 'a'), (150, '', 'a'), (200, 'def Ünï abc', 'b'), (null, 'abc def', 'b'), (null, 'def', 'b'), (250, 'a b', 'b')) t(doc_id, text, source)")
    con.sql(f"copy (select doc_id::bigint as doc_id, text, source from documents) to '{tmp_path}/documents.parquet'")
    for name in ("discovery_search", "bm25_search", "rrf_search", "pit_search"):
        df = QUERIES[name](spark, str(tmp_path))
        got = sorted(repr([norm(v) for v in r]) for r in df.collect())
        assert got == sorted(repr([norm(v) for v in r]) for r in con.sql(f"select {', '.join(df.columns)} from ({ORACLE[name]})").fetchall()), name
