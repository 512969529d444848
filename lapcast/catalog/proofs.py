"""Exact fits with their proof, windows that end, committed snapshots."""

from __future__ import annotations

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapcast.catalog.forecasts import SPACE, feature_windows, trailing_spread
from lapcast.catalog.registry import EVENTS, query, shown, table, unit_sql
from lapcast.catalog.sequences import ids
from lapcast.operators import attribution as attr
from lapcast.operators import forecast as fc
from lapcast.operators import runs
from lapcast.operators import windows as win
from lapcast.operators.encode import fit_dictionary, fit_scaler, scale
from lapcast.operators.pinball import fit_exact
from lapcast.operators.sampling import split_entities
from lapcast.operators.tuning import search_together
from lapcast.session import fresh_path, written
from lapcast.sources import json_arrays, readers, snapshots
from lapcast.schema import IMPORTED_RACE
from lapcast.streaming import live, sessions

# ---- quantile regression at its true minimum ------------------------------------------------------


@query("m1_exact_fit")
def exact_fit(spark, sf_dir):
    """Loss, lower bound and gap of all nine fits on the whole feature set."""
    made, names, _ = feature_windows(spark, sf_dir)
    return fit_exact(made, names, tolerance=1e-5).certificate(spark)


def group_windows(spark, sf_dir):
    """Next three values by the kind of the last event, one 0/1 feature a kind."""
    events = table(spark, sf_dir, "events")
    kinds = [r["value"] for r in fit_dictionary(events, "event_type").orderBy("code").collect()]
    made = win.windows(events, EVENTS, ["event_type"], length=1, horizon=3)
    last = F.element_at("past", -1)["event_type"]
    x = F.array(*[(last == F.lit(k)).cast("double") for k in kinds])
    return written(made.select(last.alias("event_type"), x.alias("x"), "target"), "windows"), [f"kind.{k}" for k in kinds]


_BEST = " + ".join(f"CASE WHEN quantile = {q} THEN greatest({q} * (y - d{d}), ({q} - 1) * (y - d{d})) ELSE 0 END" for q, d in ((0.1, 10), (0.5, 50), (0.9, 90)))


@query(
    "m1_exact_group_fit",
    f"""WITH w AS (SELECT event_type, lead(value, 1) OVER s AS y1, lead(value, 2) OVER s AS y2, lead(value, 3) OVER s AS y3
      FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)),
    steps AS (SELECT event_type, h AS horizon, CASE h WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS y FROM w, (VALUES (1), (2), (3)) AS v(h) WHERE y3 IS NOT NULL),
    best AS (SELECT *, quantile_disc(y, 0.1) OVER g AS d10, quantile_disc(y, 0.5) OVER g AS d50, quantile_disc(y, 0.9) OVER g AS d90
      FROM steps WINDOW g AS (PARTITION BY event_type, horizon))
    SELECT CAST(horizon AS INT) AS horizon, quantile, count(*) AS rows, round(avg({_BEST}), 4) + 0.0 AS loss, TRUE AS proved
    FROM best, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS q(quantile) GROUP BY horizon, quantile""",
)
def exact_group_fit(spark, sf_dir):
    """With one feature a group the least loss is known: every group's own quantile. Spark fits, SQL takes quantiles."""
    made, names = group_windows(spark, sf_dir)
    found = fit_exact(made, names, tolerance=1e-7)
    proof = found.certificate(spark)
    within = F.col("gap") <= F.lit(1e-7 * found.model.spread)
    return proof.select("horizon", "quantile", "rows", shown("loss", 4).alias("loss"), within.alias("proved"))


# ---- all settings of a search in the same scans -----------------------------------------------------

LONGEST = 15


def search_windows(spark, sf_dir):
    """Windows of the longest length any setting uses; a shorter one takes their last rows."""
    events = split_entities(table(spark, sf_dir, "events"), "user_id", {"train": 0.8, "val": 0.2})
    state = fit_scaler(events.where("split = 'train'"), "value")
    rows = win.with_gap(scale(events, state, "value", "scaled"), EVENTS).withColumn("gap_log", F.log1p("days_since_last"))
    made = win.windows(rows, EVENTS, ["scaled", "gap_log"], target="scaled", length=LONGEST, carry=["split"])
    slim = fc.with_features(made, ["scaled", "gap_log"]).select("x", "target", (F.col("split") == "train").alias("train"))
    names = fc.feature_columns(["scaled", "gap_log"], [], [], LONGEST, 3)
    return written(slim, "search"), names, state.first()["std"]


def used_features(settings: dict) -> list[str]:
    kinds = ["scaled"] if settings["features"] == "value" else ["scaled", "gap_log"]
    return [f"past.{k}.{i}" for i in range(LONGEST - settings["length"] + 1, LONGEST + 1) for k in kinds]


def searched(spark, sf_dir, n: int = 30, rounds: int = 5, **more):
    made, names, unit = search_windows(spark, sf_dir)
    return search_together(made, names, runs.candidates(spark, SPACE, n), used_features, rounds, unit=unit, **more)


@query("h1_search")
def search(spark, sf_dir):
    """Thirty settings, seven scans: each setting with its rounds, whether it was stopped, and its scores."""
    return searched(spark, sf_dir).scores


# ---- windows that end -------------------------------------------------------------------------------

IDLE, DELAY, SLICES = 36 * 3600, 24 * 3600, 5

_DELIVERED = """d AS (SELECT *, CAST(floor(day(ts) / 8) AS INT) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS b, date_trunc('hour', ts) AS f FROM events),
k AS (SELECT unnest(range(0, 5)) AS b),
c AS (SELECT k.b, (SELECT date_trunc('milliseconds', max(ts)) FROM d WHERE d.b < k.b) AS clock FROM k),
u AS (SELECT user_id, d.b, max(ts) AS newest, min(f) FILTER (WHERE clock IS NULL OR f + INTERVAL 36 HOUR > clock) AS opened FROM d JOIN c ON c.b = d.b GROUP BY user_id, d.b),
s(user_id, b, newest, opened) AS (
  SELECT user_id, -1, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP) FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT s.user_id, s.b + 1,
    CASE WHEN s.newest IS NOT NULL AND (clock IS NULL OR date_trunc('milliseconds', s.newest) + INTERVAL 36 HOUR > clock) THEN greatest(s.newest, coalesce(u.newest, s.newest))
      WHEN u.opened IS NOT NULL THEN u.newest END,
    CASE WHEN s.newest IS NOT NULL AND (clock IS NULL OR date_trunc('milliseconds', s.newest) + INTERVAL 36 HOUR > clock) THEN s.opened ELSE u.opened END
  FROM s JOIN c ON c.b = s.b + 1 LEFT JOIN u ON u.user_id = s.user_id AND u.b = s.b + 1),
rows AS (SELECT d.user_id, d.ts, d.event_id, a.opened, coalesce(f <= clock - INTERVAL 24 HOUR, FALSE) AS late,
    (p.newest IS NULL OR date_trunc('milliseconds', p.newest) + INTERVAL 36 HOUR <= clock) AND coalesce(f + INTERVAL 36 HOUR <= clock, FALSE) AS stale
  FROM d JOIN c ON c.b = d.b JOIN s a ON a.user_id = d.user_id AND a.b = d.b JOIN s p ON p.user_id = d.user_id AND p.b = d.b - 1),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id, opened ORDER BY ts DESC, event_id DESC) AS back FROM rows WHERE NOT stale)"""


def _ending(spark, sf_dir):
    """All changes of the windows while the events arrive in five deliveries, some rows one delivery late.

    Every delivery is a run of its own from the same checkpoint, so the state also survives a restart.
    """
    events = table(spark, sf_dir, "events")
    delivered = F.floor(F.dayofmonth("ts") / 8).cast("int") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    source, out, checkpoint = (fresh_path(spark, n) for n in ("deliveries", "endings", "endings-checkpoint"))
    for number in range(SLICES):
        events.where(delivered == number).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        changes = sessions.stream_sessions(stream, EVENTS, ["value"], 20, idle=IDLE, delay=DELAY)
        with sessions.keyed_state(spark):
            live.score_stream(changes, lambda batch: batch, out, checkpoint).awaitTermination()
    return live.read_stream_output(spark, out)


@query(
    "r1_ending_windows",
    f"""WITH RECURSIVE {_DELIVERED}
    SELECT user_id, opened, CASE WHEN date_trunc('milliseconds', max(ts)) + INTERVAL 36 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) THEN 'expired' ELSE 'open' END AS state,
      max(ts) AS newest, CAST(least(count(*), 20) AS INT) AS n_rows, count(*) FILTER (WHERE late) AS late, 0 AS stale,
      string_agg(event_id, ',' ORDER BY back DESC) FILTER (WHERE back <= 20) AS past_ids FROM w GROUP BY user_id, opened
    UNION ALL SELECT user_id, NULL, 'stale', NULL, NULL, NULL, count(*), NULL FROM rows WHERE stale GROUP BY user_id""",
)
def ending_windows(spark, sf_dir):
    final = sessions.final_sessions(_ending(spark, sf_dir), EVENTS)
    moment = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return final.select("user_id", moment("opened"), "state", moment("newest"), "n_rows", "late", "stale", ids("rows").alias("past_ids"))


# ---- committed snapshots ----------------------------------------------------------------------------


@query(
    "s8_after_failed_writer",
    """SELECT 'items' AS "table", l_orderkey AS key, l_linenumber AS line, round(l_extendedprice, 2) + 0.0 AS price, 1 AS version FROM lineitem
    UNION ALL SELECT 'orders', o_orderkey, NULL, round(o_totalprice, 2) + 0.0, 1 FROM orders""",
)
def after_failed_writer(spark, sf_dir):
    """Two tables under one commit; a second writer finishes the first table and fails within the next. Readers see version 1 whole."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_extendedprice").alias("price"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(None).cast("int").alias("line"), F.col("o_totalprice").alias("price"))
    path = fresh_path(spark, "snapshot")
    snapshots.commit(spark, path, {"items": items, "orders": orders})
    price = F.when(F.pmod(F.xxhash64("key"), F.lit(50)) == 0, F.raise_error(F.lit("the writer dies here")).cast("double")).otherwise(F.col("price"))
    try:
        snapshots.commit(spark, path, {"items": items.withColumn("price", F.col("price") * 2), "orders": orders.withColumn("price", price)})
    except PySparkException as died:
        if "the writer dies here" not in str(died):
            raise
    version = snapshots.latest_version(spark, path)
    parts = [
        snapshots.read(spark, path, name, check=True).select(F.lit(name).alias("table"), "key", "line", shown("price", 2).alias("price"), F.lit(version).alias("version"))
        for name in ("items", "orders")
    ]
    return parts[0].unionByName(parts[1])


# ---- exported histories as files ----------------------------------------------------------------------

_HISTORY = T.StructType([T.StructField("nageur_id", T.LongType()), *IMPORTED_RACE.fields])


def exported_histories(spark, sf_dir) -> str:
    """A folder of JSON arrays, one a customer, as an export could leave them: some elements are no JSON, some arrays have no end.

    Every element is a line of its own, so no customer's elements are gathered.
    """
    race = F.struct(
        F.col("o_custkey").alias("nageur_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("nage"),
        (F.col("o_orderkey") % 3 * 50 + 50).alias("distance"), F.lit(50).alias("bassin"), F.round("o_totalprice", 2).alias("temps"),
    )
    element = F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit('{"nage": none of this, "temps": '), F.col("o_orderkey"), F.lit("}"))).otherwise(F.to_json(race))
    end = F.when(F.col("o_custkey") % 40 == 0, F.lit("")).otherwise(F.lit("]"))
    of_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    start = F.when(F.row_number().over(of_customer) == 1, F.lit("[")).otherwise(F.lit(""))
    more = F.lead(F.lit(True)).over(of_customer)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", start.alias("start"), more.alias("more"))
    path = fresh_path(spark, "histories")
    orders.select(F.concat("start", element, F.when(F.col("more"), F.lit(",")).otherwise(end)).alias("value")).write.text(path)
    return path


@query(
    "s3_history_files",
    """WITH p AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
                    DATE '1990-01-31' + CAST(c_custkey AS INT) AS birth FROM customer)
    SELECT o_custkey AS nageur_id, o_orderpriority AS perf_nage, p.sex AS nageur_sexe,
           CAST(o_orderkey % 3 * 50 + 50 AS INT) AS perf_distance, 50 AS perf_bassin,
           CAST(month(o_orderdate) - 1 AS INT) AS mois_saison,
           CAST(greatest((year(o_orderdate) - year(birth)) * 12 + month(o_orderdate) - month(birth), 0) AS INT) AS nageur_age_mois,
           round(o_totalprice, 2) + 0.0 AS perf_temps_sec, CAST(o_orderdate AS DATE) AS date
    FROM orders JOIN p ON o_custkey = c_custkey WHERE o_orderkey % 97 <> 0""",
)
def history_files(spark, sf_dir):
    """The histories of all customers, read from their files and joined with the profiles.

    The rows are stored once, and bad ones left out behind that: the join counts its keys first, which else would read all files
    twice, and a filter before would parse every element twice.
    """
    rows = json_arrays.read_histories(spark, exported_histories(spark, sf_dir), _HISTORY)
    races = written(rows.select(*_HISTORY.names, "_bad_row"), "races").where("_bad_row IS NULL").drop("_bad_row")
    profiles = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("nageur_id"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("nageur_sexe"),
        F.date_add(F.lit("1990-01-31").cast("date"), F.col("c_custkey").cast("int")).alias("nageur_date_naissance"),
    )
    return readers.import_history(races, profiles)


@query(
    "s3_broken_rows",
    """SELECT count(*) FILTER (WHERE o_orderkey % 97 <> 0) AS races, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS no_json,
      count(DISTINCT o_custkey) FILTER (WHERE o_custkey % 40 = 0) AS no_end FROM orders""",
)
def broken_rows(spark, sf_dir):
    """The same files as a stream: races, elements that are no JSON, arrays without an end."""
    source, out, checkpoint = exported_histories(spark, sf_dir), fresh_path(spark, "imported"), fresh_path(spark, "imported-checkpoint")
    rows = json_arrays.stream_histories(spark, source, _HISTORY)
    live.score_stream(rows, lambda batch: batch, out, checkpoint).awaitTermination()
    bad = F.col("_bad_row")
    return live.read_stream_output(spark, out).agg(
        F.count_if(bad.isNull()).alias("races"), F.count_if(bad.startswith("{")).alias("no_json"), F.count_if(bad == "array without an end").alias("no_end")
    )


# ---- attributions of a user's model -------------------------------------------------------------------

BACKGROUND = 16

_ATTRIBUTED = f"""win AS (SELECT * FROM (SELECT user_id, ts AS origin_ts, event_id, list(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS past, lead(value, 3) OVER w AS t3
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE len(past) = 20 AND t3 IS NOT NULL),
    base AS (SELECT past FROM win ORDER BY {unit_sql(42, "event_id")}, event_id LIMIT {BACKGROUND})"""


def user_windows(spark, sf_dir):
    """Windows with the id of their last event, and the background windows."""
    made = win.windows(table(spark, sf_dir, "events"), EVENTS, ["value"], length=20, horizon=3, carry=["event_id"])
    return made, attr.background(made, ["event_id"], BACKGROUND)


@query(
    "m6_user_model_attributions",
    f"""WITH {_ATTRIBUTED}, q(quantile) AS (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)),
    f AS (SELECT user_id, event_id, quantile, CASE quantile WHEN 0.1 THEN list_aggregate(past, 'quantile_cont', 0.1) WHEN 0.5 THEN list_aggregate(past, 'quantile_cont', 0.5)
      ELSE list_aggregate(past, 'quantile_cont', 0.9) END AS y FROM win, q),
    b AS (SELECT quantile, avg(CASE quantile WHEN 0.1 THEN list_aggregate(past, 'quantile_cont', 0.1) WHEN 0.5 THEN list_aggregate(past, 'quantile_cont', 0.5)
      ELSE list_aggregate(past, 'quantile_cont', 0.9) END) AS y FROM base, q GROUP BY quantile)
    SELECT user_id, event_id, quantile, 4 AS features, round(f.y - b.y, 8) + 0.0 AS change FROM f JOIN b USING (quantile)""",
)
def user_model_attributions(spark, sf_dir):
    """Every window's shares of four runs of past rows add up to its forecast's change from the background's mean forecast."""
    made, against = user_windows(spark, sf_dir)
    rows = attr.attributions(made, trailing_spread, attr.by_position(["value"], 20, 5), against, ["user_id", "event_id"], pairs=BACKGROUND // 2, horizons=[1])
    first = rows.groupBy("user_id", "event_id", "quantile")
    return first.agg(F.count(F.lit(1)).cast("int").alias("features"), shown(F.sum("share"), 8).alias("change"))


def fading_mean():
    """A small linear user model: a weighted mean that fades into the past, the same for all quantiles and horizons."""

    fading = fading_mean_of_arrays()

    def run(batch):
        return fading({"value": np.array([[r["value"] for r in rows] for rows in batch["past"]], dtype=float)}, batch)

    return run


def fading_mean_of_arrays():
    """The same model on arrays."""

    def run(past, _):
        weights = np.arange(1, past["value"].shape[1] + 1) / 210
        return np.repeat((past["value"] @ weights)[:, None], 9, axis=1)

    return run


fading_mean.arrays = fading_mean_of_arrays


@query(
    "m7_user_model_positions",
    f"""WITH {_ATTRIBUTED}, p AS (SELECT unnest(range(1, 21)) AS i), m AS (SELECT i, avg(past[i]) AS y FROM base, p GROUP BY i),
    a AS (SELECT i, avg(abs(i / 210.0 * (past[i] - m.y))) AS a FROM win, m GROUP BY i)
    SELECT CAST(i AS INT) AS position, round(a / (sum(a) OVER () + 1e-8), 6) + 0.0 AS share FROM a""",
)
def user_model_positions(spark, sf_dir):
    """Mean share of each of twenty past rows; for a linear model sampled shares equal the closed form."""
    made, against = user_windows(spark, sf_dir)
    rows = attr.attributions(made, fading_mean, attr.by_position(["value"], 20), against, ["event_id"], pairs=BACKGROUND // 2, horizons=[1], quantiles=[0.5])
    shares = attr.mean_shares(rows)
    return shares.select(F.col("feature").cast("int").alias("position"), shown("share").alias("share"))
