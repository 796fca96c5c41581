"""Every query with SQL gives the rows of its SQL; the others run."""

import os

import oracle
import pytest

from lexweave import registry


#: Queries over every hundredth question; the smallest tables have none.
QUESTIONS = ("run_", "bm25_", "hybrid_", "expand_", "parse_lines")
LARGER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf, name):
    if name.startswith(QUESTIONS):
        sf = LARGER
    con = oracle.connect(sf)
    assert oracle.compare(spark, con, name, registry.QUERIES[name], registry.SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, LARGER if name.startswith(QUESTIONS) else sf)
    rows = df.collect()
    assert rows and len(rows) == len(set(map(str, rows)))
    if {"qid", "rank0"} <= set(df.columns) and not name.startswith(("run_exp4g", "run_exp4d", "run_exp4a")):
        assert len({(r.qid, r.rank0) for r in rows}) == len(rows) and all(r.rank0 >= 0 for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["qid", "rank0", "chunk_id", "score"] and rows.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
