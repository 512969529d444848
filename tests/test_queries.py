"""Every registered query against its SQL twin, or at least run to the end."""

import pytest

from compare import connect, difference
from lapcast.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


HOT = [
    "w1_gap_of_long_series", "w2_flat_windows", "w4_past_future_static_windows", "w7_lag_pairs", "t1_autocorrelation",
    "m2_change_quantiles", "h2_early_stop", "o1_series_order", "f5_long_series", "j1_rows_with_counts", "j3_complement",
    "j4_dictionary_lookup", "x2_exact_split", "x1_entity_sample", "x3_stratified_entities", "f7_trimmed_outliers", "a6_size_ecdf",
]


@pytest.mark.parametrize("name", HOT)
def test_query_with_overfull_keys(spark, sf, con, tiny_limits, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name]) is None


def test_median_stop_with_overfull_epochs(spark, sf, con):
    spark.conf.set("lapcast.blockRows", "40")
    try:
        assert difference(QUERIES["h3_median_stop"](spark, sf), con, SQL["h3_median_stop"]) is None
    finally:
        spark.conf.unset("lapcast.blockRows")


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["horizon"] for r in sorted(rows, key=lambda r: r["horizon"])] == [1, 2, 3]
    assert set(entry.oracle_sql()) <= set(entry.queries())
