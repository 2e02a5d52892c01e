import duckdb
import pytest

from tallyglass.plans import catalog

DIR = "/root/testdata/sf0.001"


#: Queries whose plans differ most; the others share theirs.
NAMES = [
    "rate_by_type", "fn_quantile_over_time", "lookback", "fold_missing_label", "match_absent_empty", "admission", "trace_summaries", "trace_tree", "trace_window", "trace_scoreboard",
    "histogram_quantiles", "time_bits", "query_range", "small_functions", "cache_keys", "budget", "tenant_status", "breaker",
]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert len(got) and key(got) == key(want)
