"""Forecasts, their evaluation, and experiments over many runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lapcast.catalog.registry import EVENTS, query, shown, table
from lapcast.catalog.sequences import CHANGES, empirical_model
from lapcast.catalog.statistics import BANDS
from lapcast.functions.columns import cyclic
from lapcast.operators import evaluate as ev
from lapcast.operators import forecast as fc
from lapcast.operators import runs
from lapcast.operators import windows as win
from lapcast.operators.encode import fit_scaler, scale
from lapcast.operators.profile import by_importance
from lapcast.operators.sampling import split_entities
from lapcast.plans.bands import band_report, empirical_bands
from lapcast.session import written

METRICS = [
    "mae", "rmse", "mape", "pinball_q10", "pinball_q50", "pinball_q90", "pinball", "coverage", "winkler", "penalised_score",
]
PINBALL = "greatest({q} * (y - {c}), ({q} - 1) * (y - {c}))"
PB10, PB50, PB90 = PINBALL.format(q=0.1, c="q10"), PINBALL.format(q=0.5, c="q50"), PINBALL.format(q=0.9, c="q90")
WINKLER = "q90 - q10 + 10 * (greatest(q10 - y, 0) + greatest(y - q90, 0))"
REPORT = f"""count(*) AS n, round(avg(abs(q50 - y)), 9) + 0.0 AS mae, round(sqrt(avg((q50 - y) * (q50 - y))), 9) + 0.0 AS rmse,
  round(avg(abs((y - q50) / nullif(y, 0))) * 100, 4) + 0.0 AS mape, count(*) FILTER (WHERE y = 0) AS mape_excluded,
  round(avg({PB10}), 9) + 0.0 AS pinball_q10, round(avg({PB50}), 9) + 0.0 AS pinball_q50, round(avg({PB90}), 9) + 0.0 AS pinball_q90,
  round((avg({PB10}) + avg({PB50}) + avg({PB90})) / 3, 9) + 0.0 AS pinball,
  round(avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0::DOUBLE ELSE 0 END) * 100, 9) + 0.0 AS coverage, round(avg({WINKLER}), 9) + 0.0 AS winkler,
  round(avg({WINKLER}) / 10 + 20 * abs(avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0::DOUBLE ELSE 0 END) - 0.8), 9) + 0.0 AS penalised_score"""


def _report(made, *by):
    return made.select(*by, "n", "mape_excluded", *[shown(c, 4 if c == "mape" else 9).alias(c) for c in METRICS])


def bands(spark, sf_dir):
    return empirical_bands(table(spark, sf_dir, "events"), EVENTS)


@query("m0_band_report", f"WITH {BANDS} SELECT horizon, {REPORT} FROM bands GROUP BY horizon")
def report_of_bands(spark, sf_dir):
    return _report(band_report(table(spark, sf_dir, "events"), EVENTS), "horizon")


@query(
    "m2_change_quantiles",
    f"WITH {CHANGES} SELECT horizon, round(d10, 6) + 0.0 AS d_q10, round(d50, 6) + 0.0 AS d_q50, round(d90, 6) + 0.0 AS d_q90 FROM model",
)
def change_quantiles(spark, sf_dir):
    return empirical_model(spark, sf_dir).select("horizon", *[shown(c).alias(c) for c in ("d_q10", "d_q50", "d_q90")])


@query(
    "m2_change_quantiles_by_user",
    f"""WITH {CHANGES} SELECT user_id, horizon, round(quantile_cont(y - last, 0.1), 6) + 0.0 AS d_q10,
    round(quantile_cont(y - last, 0.5), 6) + 0.0 AS d_q50, round(quantile_cont(y - last, 0.9), 6) + 0.0 AS d_q90 FROM steps GROUP BY user_id, horizon""",
)
def change_quantiles_by_user(spark, sf_dir):
    made = win.windows(table(spark, sf_dir, "events"), EVENTS, ["value"])
    model = fc.fit_empirical_quantiles(made, "value", ["user_id"])
    return model.select("user_id", "horizon", *[shown(c).alias(c) for c in ("d_q10", "d_q50", "d_q90")])


@query(
    "m3_scored_windows",
    f"""WITH {BANDS} SELECT user_id, origin_ts, horizon, y, round(q10, 6) + 0.0 AS q10, round(q50, 6) + 0.0 AS q50, round(q90, 6) + 0.0 AS q90 FROM bands""",
)
def scored_windows(spark, sf_dir):
    return bands(spark, sf_dir).select("user_id", "origin_ts", "horizon", "y", *[shown(q).alias(q) for q in fc.NAMES])


# ---- linear quantile regression on the whole feature set ----------------------------------------

PAST, AHEAD, STATIC = ["scaled", "gap_log"], ["month_sin", "month_cos"], ["parity"]


def feature_windows(spark, sf_dir, length: int = 10, horizon: int = 3):
    """Scaled past values and gaps, known season ahead, a static code; plus the scaler."""
    events = table(spark, sf_dir, "events")
    state = fit_scaler(events, "value").persist()
    rows = win.with_gap(scale(events, state, "value", "scaled"), EVENTS)
    k = F.get_json_object("props", "$.k").cast("int")
    sine, cosine = cyclic(k % 12)
    rows = rows.select(
        "user_id", "ts", "event_id", "scaled", F.log1p("days_since_last").alias("gap_log"),
        sine.alias("month_sin"), cosine.alias("month_cos"), (F.col("user_id") % 2).alias("parity"),
    )
    made = win.windows(rows, EVENTS, PAST, AHEAD, STATIC, target="scaled", length=length, horizon=horizon)
    names = fc.feature_columns(PAST, AHEAD, STATIC, length, horizon)
    slim = fc.with_features(made, PAST, AHEAD, STATIC).select("user_id", "origin_ts", "x", "target")
    return written(slim, "windows"), names, state


def fitted(spark, sf_dir, rounds: int = 5):
    made, names, state = feature_windows(spark, sf_dir)
    return made, fc.fit_quantile_forecaster(made, names, rounds=rounds), state


@query("m1_quantile_regression")
def quantile_regression(spark, sf_dir):
    model = fitted(spark, sf_dir)[1]
    made = fc.coefficients_table(model, spark)
    return made.select("horizon", "quantile", "feature", shown("coefficient").alias("coefficient"))


@query("m3_regression_report")
def regression_report(spark, sf_dir):
    made, model, state = fitted(spark, sf_dir)
    scored = fc.predict(made, model, ["user_id", "origin_ts"])
    return _report(ev.evaluate(fc.finish_quantiles(scored, state, "value"), ["horizon"]), "horizon")


def trailing_spread():
    """A small user model: the past rows' own quantiles for every horizon."""

    spread = spread_of_arrays()

    def run(batch):
        return spread({"value": np.stack([[r["value"] for r in rows] for rows in batch["past"]])}, batch)

    return run


def spread_of_arrays():
    """The same model on arrays."""
    return lambda past, _: np.repeat(np.quantile(past["value"], [0.1, 0.5, 0.9], axis=1).T[:, None, :], 3, axis=1)


trailing_spread.arrays = spread_of_arrays


@query(
    "m4_user_model",
    """WITH win AS (SELECT * FROM (SELECT user_id, ts AS origin_ts, list(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS past,
      lead(value, 1) OVER w AS t1, lead(value, 2) OVER w AS t2, lead(value, 3) OVER w AS t3
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE len(past) = 20 AND t3 IS NOT NULL)
    SELECT user_id, origin_ts, CAST(h AS INT) AS horizon, CASE h WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS y,
      round(list_aggregate(past, 'quantile_cont', 0.1), 6) + 0.0 AS q10, round(list_aggregate(past, 'quantile_cont', 0.5), 6) + 0.0 AS q50,
      round(list_aggregate(past, 'quantile_cont', 0.9), 6) + 0.0 AS q90 FROM win, (VALUES (1), (2), (3)) AS v(h)""",
)
def user_model(spark, sf_dir):
    made = win.windows(table(spark, sf_dir, "events"), EVENTS, ["value"], length=20, horizon=3)
    scored = fc.predict_with(made, trailing_spread, ["user_id", "origin_ts"], 3)
    return scored.select("user_id", "origin_ts", "horizon", "y", *[shown(q).alias(q) for q in fc.NAMES])


@query(
    "m5_finished_quantiles",
    """SELECT l_orderkey, l_linenumber, round(least(l_quantity, l_linenumber * 7) * s + m, 2) + 0.0 AS q10, round(l_linenumber * 7 * s + m, 2) + 0.0 AS q50,
      round(greatest(l_quantity - 10, l_linenumber * 7) * s + m, 2) + 0.0 AS q90
    FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)""",
)
def finished_quantiles(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    raw = items.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q10"), (F.col("l_linenumber") * 7.0).alias("q50"),
        (F.col("l_quantity") - 10).alias("q90"),
    )
    made = fc.finish_quantiles(raw, fit_scaler(items, "l_extendedprice"), "l_extendedprice", 2)
    return made.select("l_orderkey", "l_linenumber", *[(F.col(q) + F.lit(0.0)).alias(q) for q in fc.NAMES])


@query("m6_feature_importance")
def feature_importance(spark, sf_dir):
    model = fitted(spark, sf_dir)[1]
    made = fc.feature_importance(fc.coefficients_table(model, spark), {"month_sin": "season", "month_cos": "season"})
    return made.select("feature", shown("share").alias("share"))


@query("m6_permutation_importance")
def permutation_importance(spark, sf_dir):
    made, model, _ = fitted(spark, sf_dir)
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(model.features):
        groups.setdefault(name.split(".")[1], []).append(i)
    return fc.permutation_importance(made, model, groups, ["user_id", "origin_ts"])


@query("m7_position_importance")
def position_importance(spark, sf_dir):
    model = fitted(spark, sf_dir)[1]
    made = fc.position_importance(fc.coefficients_table(model, spark))
    return made.select("position", shown("share").alias("share"))


COEFFICIENTS = """coef AS (SELECT event_type, event_id % 10 + 1 AS position, avg(value) * CASE WHEN event_type < 'm' THEN -1 ELSE 1 END AS c, stddev_pop(value) AS s
  FROM events GROUP BY event_type, event_id % 10)"""


def event_coefficients(spark, sf_dir):
    """Effects per event type and position taken from the events, in the shape of a coefficient table."""
    name = F.concat(F.lit("past."), "event_type", F.lit("."), (F.col("event_id") % 10 + 1).cast("string"))
    sign = F.when(F.col("event_type") < "m", -1).otherwise(1)
    effects = table(spark, sf_dir, "events").groupBy("event_type", name.alias("feature"))
    return effects.agg((F.avg("value") * sign).alias("coefficient"), F.stddev_pop("value").alias("std"))


@query(
    "m6_importance_shares",
    f"""WITH {COEFFICIENTS}, f AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'browsing' ELSE event_type END AS feature, sum(abs(c) * s) AS e FROM coef GROUP BY 1)
    SELECT feature, round(e / (sum(e) OVER () + 1e-8), 9) + 0.0 AS share FROM f""",
)
def importance_shares(spark, sf_dir):
    made = fc.feature_importance(event_coefficients(spark, sf_dir), {"click": "browsing", "view": "browsing"})
    return made.select("feature", shown("share", 9).alias("share"))


@query(
    "m7_position_shares",
    f"""WITH {COEFFICIENTS}, f AS (SELECT position, sum(abs(c) * s) AS e FROM coef GROUP BY 1)
    SELECT CAST(position AS INT) AS position, round(e / (sum(e) OVER () + 1e-8), 9) + 0.0 AS share FROM f""",
)
def position_shares(spark, sf_dir):
    made = fc.position_importance(event_coefficients(spark, sf_dir))
    return made.select("position", shown("share", 9).alias("share"))


@query("o3_ranked_importance")
def ranked_importance(spark, sf_dir):
    model = fitted(spark, sf_dir)[1]
    return by_importance(fc.feature_importance(fc.coefficients_table(model, spark)))


@query(
    "o3_ranked_totals",
    """SELECT event_type AS feature, round(s / sum(s) OVER (), 9) + 0.0 AS share, row_number() OVER (ORDER BY s DESC, event_type) AS rank
    FROM (SELECT event_type, sum(value) AS s FROM events GROUP BY event_type)""",
)
def ranked_totals(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("s"))
    shares = sums.select(F.col("event_type").alias("feature"), (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("share"))
    return by_importance(shares).select("feature", shown("share", 9).alias("share"), "rank")


# ---- evaluation ---------------------------------------------------------------------------------


@query(
    "e1_pinball_by_user",
    f"""WITH {BANDS} SELECT user_id, horizon, round(avg({PB10}), 9) + 0.0 AS pinball_q10, round(avg({PB50}), 9) + 0.0 AS pinball_q50,
    round(avg({PB90}), 9) + 0.0 AS pinball_q90, round((avg({PB10}) + avg({PB50}) + avg({PB90})) / 3, 9) + 0.0 AS pinball FROM bands GROUP BY user_id, horizon""",
)
def pinball_by_user(spark, sf_dir):
    made = ev.pinball(bands(spark, sf_dir), ["user_id", "horizon"])
    return made.select("user_id", "horizon", *[shown(c, 9).alias(c) for c in ("pinball_q10", "pinball_q50", "pinball_q90", "pinball")])


@query("e2_e6_report_overall", f"WITH {BANDS} SELECT {REPORT} FROM bands")
def report_overall(spark, sf_dir):
    return _report(ev.evaluate(bands(spark, sf_dir)))


@query("e3_e6_report_by_user", f"WITH {BANDS} SELECT user_id, {REPORT} FROM bands GROUP BY user_id")
def report_by_user(spark, sf_dir):
    return _report(ev.evaluate(bands(spark, sf_dir), ["user_id"]), "user_id")


@query(
    "e4_e5_scores_by_version",
    f"""WITH {BANDS}, two AS (SELECT 'banded' AS version, y, q10, q50, q90 FROM bands UNION ALL
      SELECT 'narrow', y, q50 - (q50 - q10) / 2, q50, q50 + (q90 - q50) / 2 FROM bands)
    SELECT version, {REPORT} FROM two GROUP BY version""",
)
def scores_by_version(spark, sf_dir):
    wide = bands(spark, sf_dir).select(F.lit("banded").alias("version"), "y", *fc.NAMES)
    low, mid, high = F.col("q10"), F.col("q50"), F.col("q90")
    narrow = wide.select(F.lit("narrow").alias("version"), "y", (mid - (mid - low) / 2).alias("q10"), mid, (mid + (high - mid) / 2).alias("q90"))
    return _report(ev.evaluate(wide.unionByName(narrow), ["version"]), "version")


# ---- runs ---------------------------------------------------------------------------------------


def curves(spark, sf_dir):
    """Every user is a run, every event an epoch, losses come from the value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.row_number().over(order).alias("epoch"),
        (F.col("value") / 100).alias("train_loss"),
        (F.col("value") / 100 + 1 / F.row_number().over(order)).alias("val_loss"),
        (F.col("event_id") % 5 + 1).alias("rows"),
    )


CURVES = """curves AS (SELECT user_id AS run_id, CAST(row_number() OVER w AS INT) AS epoch, value / 100 AS train_loss,
  value / 100 + 1 / (row_number() OVER w)::DOUBLE AS val_loss, event_id % 5 + 1 AS rows
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

SPACE = {
    "ridge": ("log", 1e-4, 1e-1),
    "length": ("int", 5, 15, 5),
    "epsilon": ("uniform", 0.02, 0.2),
    "features": ("choice", ["value", "value+gap"]),
}


def search_outcome(spark, sf_dir, n: int = 3, rounds: int = 3):
    events = split_entities(table(spark, sf_dir, "events"), "user_id", {"train": 0.8, "val": 0.2})
    state = fit_scaler(events.where("split = 'train'"), "value").persist()
    rows = win.with_gap(scale(events, state, "value", "scaled"), EVENTS).withColumn("gap_log", F.log1p("days_since_last"))
    rows = written(rows.select("user_id", "ts", "event_id", "scaled", "gap_log", "split"), "search")

    def run(settings):
        past = ["scaled"] if settings["features"] == "value" else ["scaled", "gap_log"]
        made = win.windows(rows, EVENTS, past, target="scaled", length=settings["length"], carry=["split"])
        made = written(fc.with_features(made, past).select("user_id", "origin_ts", "split", "x", "target"), "trial")
        names = fc.feature_columns(past, [], [], settings["length"], 3)
        model = fc.fit_quantile_forecaster(
            made.where("split = 'train'"), names, ridge=settings["ridge"], epsilon=settings["epsilon"], rounds=rounds
        )
        scored = fc.predict(made.where("split = 'val'"), model, ["user_id"])
        return fc.finish_quantiles(scored, state, "value")

    return runs.search(runs.candidates(spark, SPACE, n), run, "penalised_score")


def _early_sql(patience: int, delta: float) -> str:
    return f"""WITH RECURSIVE {CURVES}, walk AS (
      SELECT run_id, epoch, val_loss AS best, 0 AS counter, epoch AS best_epoch, 1 AS saves FROM curves WHERE epoch = 1
      UNION ALL SELECT c.run_id, c.epoch, least(w.best, c.val_loss),
        CASE WHEN c.val_loss < w.best THEN 0 WHEN c.val_loss > w.best + {delta} THEN w.counter + 1 ELSE w.counter END,
        CASE WHEN c.val_loss < w.best THEN c.epoch ELSE w.best_epoch END, w.saves + CASE WHEN c.val_loss < w.best THEN 1 ELSE 0 END
      FROM walk w JOIN curves c ON c.run_id = w.run_id AND c.epoch = w.epoch + 1 WHERE w.counter < {patience})
    SELECT run_id, max(epoch) AS last_epoch, max(CASE WHEN counter >= {patience} THEN 1 ELSE 0 END) AS stopped,
      round(min(best), 9) + 0.0 AS best_loss, max(best_epoch) AS best_epoch, CAST(max(saves) AS BIGINT) AS saves FROM walk GROUP BY run_id"""


@query("h2_early_stop", _early_sql(7, 1e-4))
def early_stop(spark, sf_dir):
    made = runs.early_stop(curves(spark, sf_dir), 7, 1e-4)
    return made.select("run_id", "last_epoch", "stopped", shown("best_loss", 9).alias("best_loss"), "best_epoch", "saves")


@query(
    "h3_median_stop",
    f"""WITH {CURVES}, own AS (SELECT run_id, epoch, val_loss, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch) AS best,
      dense_rank() OVER (ORDER BY run_id) - 1 AS nth FROM curves),
    med AS (SELECT o.run_id, o.epoch, count(*) AS m, quantile_cont(e.val_loss, 0.5) AS median FROM own o JOIN own e ON e.epoch = o.epoch AND e.nth < o.nth
      WHERE o.nth >= 5 AND o.epoch > 3 GROUP BY o.run_id, o.epoch)
    SELECT run_id, epoch, round(best, 9) + 0.0 AS best_so_far, coalesce(m, 0) AS earlier_runs, coalesce(best > median, FALSE) AS stop
    FROM own LEFT JOIN med USING (run_id, epoch)""",
)
def median_stop(spark, sf_dir):
    made = runs.median_stop(curves(spark, sf_dir), 5, 3)
    return made.select("run_id", "epoch", shown("best_so_far", 9).alias("best_so_far"), "earlier_runs", "stop")


@query(
    "h4_loss_curves",
    f"""WITH {CURVES} SELECT run_id, epoch, round(sum(train_loss * rows) / sum(rows), 9) + 0.0 AS train_loss, round(sum(val_loss * rows) / sum(rows), 9) + 0.0 AS val_loss
    FROM (SELECT run_id, CAST((epoch + 9) // 10 AS INT) AS epoch, train_loss, val_loss, rows FROM curves) GROUP BY run_id, epoch""",
)
def loss_curves(spark, sf_dir):
    batches = curves(spark, sf_dir).withColumn("epoch", F.ceil(F.col("epoch") / 10).cast("int"))
    made = runs.loss_curves(batches)
    return made.select("run_id", "epoch", shown("train_loss", 9).alias("train_loss"), shown("val_loss", 9).alias("val_loss"))


@query("h4_best_run", f"WITH {CURVES} SELECT run_id, epoch, round(val_loss, 9) + 0.0 AS val_loss FROM curves ORDER BY val_loss, run_id, epoch LIMIT 1")
def best_run(spark, sf_dir):
    return runs.best_run(curves(spark, sf_dir)).select("run_id", "epoch", shown("val_loss", 9).alias("val_loss"))
