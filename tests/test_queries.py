from __future__ import annotations

import os

import oracle
import pytest

from factlake import code_queries, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.database()


ALL, SQL = queries.QUERIES | code_queries.QUERIES, queries.SQL | code_queries.SQL


def test_every_query_has_its_sql():
    assert set(ALL) == set(SQL) and len(ALL) == len(queries.QUERIES) + len(code_queries.QUERIES)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_matches_sql(spark, con, name):
    oracle.same(spark, con, ALL[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_last_segment_reads_whole_texts(spark, con):
    got = {r["page_id"]: r["segment"] for r in queries.QUERIES["last_segment"](spark, oracle.FOLDER).collect()}
    rows = con.execute("SELECT page_id, html FROM pages").fetchall()
    assert max(len(t) for _, t in rows) > 400 and got == {i: t.rsplit(".", 1)[-1] for i, t in rows}


def test_the_walk_goes_ten_calls_deep(spark):
    rows = [r["depth"] for r in queries.QUERIES["call_graph_bfs"](spark, oracle.FOLDER).collect()]
    assert 4 < max(rows) <= 10
