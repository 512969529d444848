"""Physical plans: one shuffle for shared keys, pruned scans, limits before the shuffle."""

from pyspark.sql import functions as F

from lapcast.catalog.registry import EVENTS, table
from lapcast.operators import filters as flt
from lapcast.operators import sampling as smp
from lapcast.operators import windows as win


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gap_filter_and_windows_share_one_shuffle(spark, sf):
    gapped = win.with_gap(table(spark, sf, "events"), EVENTS, min_rows=23)
    made = win.windows(gapped, EVENTS, ["value", "days_since_last"])
    text = plan(made)
    assert text.count("Exchange hashpartitioning") == 1
    assert "props" not in text and "event_type" not in text


def test_last_rows_are_limited_before_the_shuffle(spark, sf):
    text = plan(smp.last_n(table(spark, sf, "events"), EVENTS, 20))
    assert "WindowGroupLimit" in text.split("Exchange", 1)[1]


def test_hash_split_and_fraction_do_not_shuffle(spark, sf):
    events = table(spark, sf, "events")
    labelled = smp.split_entities(events, "user_id", {"train": 0.8, "test": 0.2})
    assert "Exchange" not in plan(labelled.where("split = 'train'"))
    assert "Exchange" not in plan(smp.sample_entities(events, "user_id", fraction=0.1))


def test_filters_reach_the_scan(spark, sf):
    rows = flt.with_rules(table(spark, sf, "events"), {"large": F.col("value") > 10}).select("event_id")
    text = plan(rows)
    assert "GreaterThan(value,10.0)" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_small_lookups_are_broadcast_and_large_ones_are_not(spark, sf):
    events = table(spark, sf, "events")
    assert "BroadcastHashJoin" in plan(flt.min_category_count(events, "event_type", 1))
    spark.conf.set("lapcast.broadcastRows", "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(flt.min_category_count(events, "event_type", 1))
    finally:
        spark.conf.unset("lapcast.broadcastRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
