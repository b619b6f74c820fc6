"""Tables in which nothing is missing, and work that is done once however often it is read."""

import duckdb
import pytest

from lodestrata.plans import base, catalog

from comparison import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """The small tables with one product sold in one market every quarter: no series has a gap."""
    folder = tmp_path_factory.mktemp("dense")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE ('one' AS p_name) FROM '{SF}/part.parquet') TO '{folder}/part.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * REPLACE (0::INT AS c_nationkey) FROM '{SF}/customer.parquet') TO '{folder}/customer.parquet' (FORMAT parquet)")
    for t in ("nation", "orders", "lineitem"):
        c.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["gap_guardrail", "gap_stats", "gap_distribution", "gap_levels", "blank_patterns"])
def test_without_gaps(spark, dense, name):
    same(catalog.QUERIES[name](spark, dense), duck(dense), catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["ridge_forecast", "floor_unseen", "gap_levels", "sales_overview"])
def test_fact_is_joined_once(spark, monkeypatch, name):
    """However often a query reads the series, the fact's joins run once, and orders and lines are shuffled at every size."""
    made = []
    plain = base.long_table
    monkeypatch.setattr(base, "long_table", lambda *a: made.append(plain(*a)) or made[-1])
    out = catalog.QUERIES[name](spark, SF)
    assert "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1
    assert "SortMergeJoin" in made[0]._jdf.queryExecution().executedPlan().toString()
