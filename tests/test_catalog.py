"""Catalogue smoke at sf0.001: entry() runs, and a sample of queries
equals its DuckDB oracle (the full gate is tests/oracle_check.py)."""
import duckdb
import pytest

import __spark_entry__ as E
from tests.oracle_check import TABLES, rows
from tideline.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "target_30m" in df.columns


def test_every_query_has_oracle_or_is_model_or_stream():
    missing = set(catalog.QUERIES) - set(E.oracle_sql())
    assert set(catalog.QUERIES) <= set(E.queries())
    assert missing <= {"gbt_backtest", "gbt_latest", "contributions", "global_importance", "local_explanation", "whatif_scores"}


@pytest.mark.parametrize("name", ["unified_timeline_1h", "features", "alerts", "drift_status", "union_pump_streams",
                                  "parse_readings", "regression_metrics", "scenario_rewrite"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    s = E.queries()[name](spark, SF).toPandas()
    d = con.sql(E.oracle_sql()[name]).df()
    assert rows(s) == rows(d)
