"""Gaps, windows, serving windows, future rows, timelines, live windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapcast.catalog.registry import BY_TYPE, EVENTS, ITEMS, ORDERS, query, shown, table
from lapcast.operators import windows as win
from lapcast.operators.forecast import finish_quantiles, fit_empirical_quantiles, predict_empirical
from lapcast.operators.sampling import last_n
from lapcast.roles import Roles
from lapcast.session import fresh_path
from lapcast.streaming import live


def ids(array, field: str = "event_id"):
    """An array of row ids as text, so that whole windows are compared."""
    return F.array_join(F.transform(array, lambda r: r[field].cast("string")), ",")


def total(array):
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


@query(
    "w1_days_since_last",
    """SELECT l_orderkey, l_linenumber, coalesce(date_sub('day', lag(l_shipdate) OVER w, l_shipdate), 0) AS days_since_last
    FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber)""",
)
def days_since_last(spark, sf_dir):
    gapped = win.with_gap(table(spark, sf_dir, "lineitem"), ITEMS)
    return gapped.select("l_orderkey", "l_linenumber", "days_since_last")


@query(
    "w1_days_since_last_rounded_up",
    """SELECT event_id, CAST(coalesce(ceil(epoch_us(ts) / 86400000000.0 - epoch_us(lag(ts) OVER w) / 86400000000.0), 0) AS BIGINT) AS days_since_last
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def days_since_last_rounded_up(spark, sf_dir):
    return win.with_gap(table(spark, sf_dir, "events"), EVENTS, rounding="up").select("event_id", "days_since_last")


@query(
    "w1_gap_of_long_series",
    """SELECT event_id, gap FROM (SELECT event_id, coalesce(date_sub('day', lag(ts) OVER w, ts), 0) AS gap, count(*) OVER (PARTITION BY user_id, event_type) AS n
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE n >= 10""",
)
def gap_of_long_series(spark, sf_dir):
    return win.with_gap(table(spark, sf_dir, "events"), BY_TYPE, "gap", min_rows=10).select("event_id", "gap")


@query(
    "w2_flat_windows",
    """SELECT * FROM (SELECT user_id, event_type, ts AS origin_ts,
      string_agg(event_id, ',') OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS past_ids,
      count(*) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS size, lead(value) OVER w AS target
      FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE size = 10 AND target IS NOT NULL""",
)
def flat_windows(spark, sf_dir):
    made = win.flat_windows(table(spark, sf_dir, "events"), BY_TYPE, ["value", "event_id"], 10)
    return made.select("user_id", "event_type", "origin_ts", ids("past").alias("past_ids"), F.size("past").cast("long").alias("size"), "target")


@query(
    "w3_multi_horizon_windows",
    """SELECT user_id, origin_ts, past_ids, t1, t2, t3 FROM (SELECT user_id, ts AS origin_ts,
      string_agg(event_id, ',') OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS past_ids,
      count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS size,
      lead(value, 1) OVER w AS t1, lead(value, 2) OVER w AS t2, lead(value, 3) OVER w AS t3
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE size = 20 AND t3 IS NOT NULL""",
)
def multi_horizon_windows(spark, sf_dir):
    made = win.windows(table(spark, sf_dir, "events"), EVENTS, ["value", "event_id"], length=20, horizon=3)
    t = F.col("target")
    return made.select("user_id", "origin_ts", ids("past").alias("past_ids"), t[0].alias("t1"), t[1].alias("t2"), t[2].alias("t3"))


@query(
    "w4_past_future_static_windows",
    """SELECT l_partkey, l_returnflag, origin_ts, past_sum, past_lines, future_sum, static_line, target_sum FROM (
      SELECT l_partkey, l_returnflag, l_shipdate AS origin_ts,
        round(sum(l_extendedprice) OVER p, 2) + 0.0 AS past_sum, string_agg(l_linenumber, ',') OVER p AS past_lines, count(*) OVER p AS size,
        round(sum(l_quantity) OVER f, 2) + 0.0 AS future_sum, count(*) OVER f AS ahead,
        first_value(l_linenumber) OVER p AS static_line, round(sum(l_extendedprice) OVER f, 2) + 0.0 AS target_sum
      FROM lineitem
      WINDOW p AS (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    WHERE size = 5 AND ahead = 3""",
)
def past_future_static_windows(spark, sf_dir):
    made = win.windows(
        table(spark, sf_dir, "lineitem"), ITEMS, ["l_extendedprice", "l_linenumber"], ["l_quantity"], ["l_linenumber"],
        length=5, horizon=3,
    )
    return made.select(
        *ITEMS.keys, "origin_ts",
        shown(total(F.transform("past", lambda r: r["l_extendedprice"])), 2).alias("past_sum"),
        ids("past", "l_linenumber").alias("past_lines"),
        shown(total(F.transform("future", lambda r: r["l_quantity"])), 2).alias("future_sum"),
        F.col("static.l_linenumber").alias("static_line"),
        shown(total(F.col("target")), 2).alias("target_sum"),
    )


SERVING = """last20 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders),
kept AS (SELECT * FROM last20 WHERE back <= 20),
shape AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS origin_ts, arg_min(o_orderkey, back) AS newest,
  string_agg(o_orderkey, ',' ORDER BY back DESC) AS body FROM kept GROUP BY o_custkey)"""


@query(
    "w5_serving_windows",
    f"""WITH {SERVING} SELECT o_custkey, origin_ts, CAST(n AS INT) AS n_rows, repeat(newest || ',', CAST(20 - n AS INT)) || body AS past_ids FROM shape""",
)
def serving_windows(spark, sf_dir):
    made = win.latest_window(table(spark, sf_dir, "orders"), ORDERS, ["o_orderkey", "o_totalprice"], 20)
    return made.select("o_custkey", "origin_ts", "n_rows", ids("past", "o_orderkey").alias("past_ids"))


def _future_sql(clamp: bool) -> str:
    plus = "CAST(o_orderdate AS DATE) + to_months(h)" if clamp else "date_trunc('month', o_orderdate) + to_months(h) + to_days(CAST(day(o_orderdate) AS INT) - 1)"
    return f"""WITH last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back,
        DATE '1990-01-31' + CAST(o_custkey AS INT) AS birth FROM orders),
    ahead AS (SELECT o_custkey, h AS horizon, CAST({plus} AS DATE) AS future_date, birth, o_orderpriority FROM last, (VALUES (1), (2), (3)) AS v(h) WHERE back = 1)
    SELECT o_custkey, horizon, future_date, CAST(month(future_date) - 1 AS INT) AS month,
      CAST(greatest((year(future_date) - year(birth)) * 12 + month(future_date) - month(birth), 0) AS INT) AS age_months, o_orderpriority FROM ahead"""


def _future(spark, sf_dir, clamp: bool):
    newest = last_n(table(spark, sf_dir, "orders"), ORDERS, 1)
    born = newest.withColumn("birth", F.date_add(F.lit("1990-01-31").cast("date"), F.col("o_custkey").cast("int")))
    return win.future_rows(born, ORDERS, 3, ["o_orderpriority"], "birth", clamp)


@query("w6_future_rows", _future_sql(False))
def future_rows(spark, sf_dir):
    return _future(spark, sf_dir, False)


@query("w6_future_rows_clamped", _future_sql(True))
def future_rows_clamped(spark, sf_dir):
    return _future(spark, sf_dir, True)


@query(
    "w7_lag_pairs",
    """SELECT event_id, previous, current FROM (SELECT event_id, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous,
    value AS current FROM events) WHERE previous IS NOT NULL""",
)
def lag_pairs(spark, sf_dir):
    return win.lag_pairs(table(spark, sf_dir, "events"), BY_TYPE).select("event_id", "previous", "current")


LAGS = """lags AS (SELECT * FROM (SELECT event_id, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous,
    value AS current FROM events) WHERE previous IS NOT NULL)"""


@query(
    "w7_lag_limits",
    f"WITH {LAGS} SELECT count(*) AS pairs, least(min(previous), min(current)) AS low, greatest(max(previous), max(current)) AS high FROM lags",
)
def lag_limits(spark, sf_dir):
    return win.lag_limits(win.lag_pairs(table(spark, sf_dir, "events"), BY_TYPE))


@query(
    "w7_sampled_pairs",
    f"""WITH {LAGS} SELECT event_id, previous, current FROM lags
    ORDER BY ('0x' || substr(md5('42:' || event_id), 1, 8))::UBIGINT / 4294967296.0, event_id LIMIT 5000""",
)
def sampled_pairs(spark, sf_dir):
    return win.sample_pairs(win.lag_pairs(table(spark, sf_dir, "events"), BY_TYPE), BY_TYPE).select("event_id", "previous", "current")


CHANGES = """win AS (SELECT * FROM (SELECT user_id, ts AS origin_ts, event_id, value,
      count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS size,
      lead(value, 1) OVER w AS t1, lead(value, 2) OVER w AS t2, lead(value, 3) OVER w AS t3
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE size = 20 AND t3 IS NOT NULL),
steps AS (SELECT user_id, origin_ts, value AS last, 1 AS horizon, t1 AS y FROM win UNION ALL
  SELECT user_id, origin_ts, value, 2, t2 FROM win UNION ALL SELECT user_id, origin_ts, value, 3, t3 FROM win),
model AS (SELECT horizon, quantile_cont(y - last, 0.1) AS d10, quantile_cont(y - last, 0.5) AS d50, quantile_cont(y - last, 0.9) AS d90
  FROM steps GROUP BY horizon)"""


def empirical_model(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    made = win.windows(events, EVENTS, ["value"], length=20, horizon=3)
    return fit_empirical_quantiles(made, "value", at_most=events.count())


def next_bands(spark, sf_dir):
    """Forecasts from every user's newest window."""
    newest = win.latest_window(table(spark, sf_dir, "events"), EVENTS, ["value"], 20)
    return finish_quantiles(predict_empirical(newest, empirical_model(spark, sf_dir), "value", ["user_id"]))


@query(
    "w8_timeline",
    f"""WITH {CHANGES}, newest AS (SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1),
    ahead AS (SELECT user_id, horizon, least(value + d10, value + d50) AS q10, value + d50 AS q50, greatest(value + d90, value + d50) AS q90 FROM newest, model)
    SELECT user_id, 'actual' AS line, strftime(ts, '%Y-%m-%d') AS label, round(value, 6) + 0.0 AS y FROM events
    UNION ALL SELECT user_id, l, strftime(ts, '%Y-%m-%d'), round(value, 6) + 0.0 FROM newest, (VALUES ('q10'), ('q50'), ('q90')) AS v(l)
    UNION ALL SELECT user_id, 'q10', 'M+' || horizon, round(q10, 6) + 0.0 FROM ahead
    UNION ALL SELECT user_id, 'q50', 'M+' || horizon, round(q50, 6) + 0.0 FROM ahead
    UNION ALL SELECT user_id, 'q90', 'M+' || horizon, round(q90, 6) + 0.0 FROM ahead""",
)
def timeline(spark, sf_dir):
    made = win.timeline(table(spark, sf_dir, "events"), next_bands(spark, sf_dir), EVENTS)
    label = F.when(F.col("label").startswith("M+"), F.col("label")).otherwise(F.substring("label", 1, 10))
    return made.select("user_id", "line", label.alias("label"), shown("y").alias("y"))


@query(
    "w8_timeline_with_importance",
    """WITH back AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
    SELECT o_custkey, 'actual' AS line, strftime(o_orderdate, '%Y-%m-%d') AS label, round(o_totalprice, 3) + 0.0 AS y FROM orders
    UNION ALL SELECT o_custkey, l, strftime(o_orderdate, '%Y-%m-%d'), round(o_totalprice, 3) + 0.0 FROM back, (VALUES ('q10'), ('q50'), ('q90')) AS v(l) WHERE r = 1
    UNION ALL SELECT o_custkey, l, 'M+1', round(o_totalprice * f, 3) + 0.0 FROM back, (VALUES ('q10', 0.5), ('q50', 1.0), ('q90', 2.0)) AS v(l, f) WHERE r = 1
    UNION ALL SELECT o_custkey, 'importance', strftime(o_orderdate, '%Y-%m-%d'), round(100 * (21 - r) / 210.0, 3) + 0.0 FROM back WHERE r <= 20""",
)
def timeline_with_importance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    bands = last_n(orders, ORDERS, 1).select(
        "o_custkey", F.lit(1).alias("horizon"), (price * 0.5).alias("q10"), price.alias("q50"), (price * 2.0).alias("q90")
    )
    weights = spark.range(1, 21).select(F.col("id").cast("int").alias("position"), ((21 - F.col("id")) / 210).alias("share"))
    made = win.timeline(orders, bands, ORDERS, weights)
    label = F.when(F.col("label").startswith("M+"), F.col("label")).otherwise(F.substring("label", 1, 10))
    return made.select("o_custkey", "line", label.alias("label"), shown("y", 3).alias("y"))


def _live(spark, sf_dir):
    """The events table read as a stream of files."""
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")


def _drained(q):
    q.awaitTermination()


@query(
    "r1_live_windows",
    """WITH kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 20)
    SELECT user_id, max(ts) AS origin_ts, CAST(count(*) AS INT) AS n_rows, string_agg(event_id, ',' ORDER BY back DESC) AS past_ids FROM kept GROUP BY user_id""",
)
def live_windows(spark, sf_dir):
    out, checkpoint = fresh_path(spark, "live"), fresh_path(spark, "live-checkpoint")
    updates = live.stream_windows(_live(spark, sf_dir), EVENTS, ["value", "event_type"], 20)
    _drained(live.score_stream(updates, lambda batch: batch, out, checkpoint))
    final = live.latest_versions(live.read_stream_output(spark, out), EVENTS)
    return final.select("user_id", "origin_ts", "n_rows", ids("rows").alias("past_ids"))


@query(
    "r2_live_forecasts",
    f"""WITH {CHANGES}, newest AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT user_id, horizon, round(least(value + d10, value + d50), 6) + 0.0 AS q10, round(value + d50, 6) + 0.0 AS q50,
      round(greatest(value + d90, value + d50), 6) + 0.0 AS q90 FROM newest, model""",
)
def live_forecasts(spark, sf_dir):
    model = empirical_model(spark, sf_dir).persist()
    out, checkpoint = fresh_path(spark, "live"), fresh_path(spark, "live-checkpoint")

    def score(batch):
        ready = live.as_serving_window(batch, ["value"], 20)
        return finish_quantiles(predict_empirical(ready, model, "value", ["user_id", "version"]))

    updates = live.stream_windows(_live(spark, sf_dir), EVENTS, ["value"], 20)
    _drained(live.score_stream(updates, score, out, checkpoint))
    roles = Roles("user_id", ("user_id", "horizon"), "ts", ("event_id",), "value")
    final = live.latest_versions(live.read_stream_output(spark, out).drop("batch"), roles)
    return final.select("user_id", "horizon", *[shown(q).alias(q) for q in ("q10", "q50", "q90")])
