"""Exact fits, searches in shared scans, windows that end, committed snapshots, gamma tails."""

import datetime as dt
import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapcast.catalog import forecasts as cat
from lapcast.catalog import proofs
from lapcast.catalog.registry import EVENTS
from lapcast.operators import dependence as dep
from lapcast.operators import forecast as fc
from lapcast.operators import pinball, runs
from lapcast.operators.tuning import search_together
from lapcast.sources import snapshots, writers
from lapcast.streaming import live, sessions

# ---- exact pinball fits -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def windows(spark, sf):
    return cat.feature_windows(spark, sf)


@pytest.fixture(scope="module")
def exact(windows):
    made, names, _ = windows
    return pinball.fit_exact(made, names, tolerance=1e-6)


def loss_of(y, line, q):
    e = y - line
    return np.maximum(q * e, (q - 1) * e).mean()


def test_gap_is_proved_and_sql_finds_the_same_loss(windows, exact):
    """The loss is recomputed in SQL from the raw coefficients alone."""
    made, names, _ = windows
    con = duckdb.connect()
    frame = made.select("x", "target").toPandas()
    con.register("w", pd.DataFrame({"x": [list(map(float, v)) for v in frame["x"]], "y": [list(map(float, v)) for v in frame["target"]]}))
    raw = exact.model.raw_coefficients()
    rows = [(i + 1, q, [float(c) for c in raw[i, j]]) for i in range(3) for j, q in enumerate(exact.model.quantiles)]
    con.register("c", pd.DataFrame(rows, columns=["horizon", "q", "c"]))
    found = con.execute(
        """SELECT horizon, q, avg(greatest(q * e, (q - 1) * e)) FROM (
             SELECT horizon, q, y[horizon] - (c[1] + list_dot_product(CAST(c[2:] AS DOUBLE[]), CAST(x AS DOUBLE[]))) AS e FROM w, c) GROUP BY horizon, q"""
    ).fetchall()
    assert len(found) == 9
    for horizon, q, loss in found:
        j = exact.model.quantiles.index(q)
        assert loss == pytest.approx(exact.loss[horizon - 1, j], rel=1e-10)
    assert (exact.gap <= 1e-6 * exact.model.spread).all() and (exact.gap > -1e-9).all()


def test_exact_fit_is_no_worse_than_the_smoothed_one(windows, exact):
    made, names, _ = windows
    smooth = fc.fit_quantile_forecaster(made, names, ridge=0.0, rounds=10, epsilon=0.02)
    frame = made.select("x", "target").toPandas()
    x, y = np.stack(frame["x"]), np.stack(frame["target"])
    raw = smooth.raw_coefficients()
    for i, j in itertools.product(range(3), range(3)):
        assert exact.loss[i, j] <= loss_of(y[:, i], raw[i, j, 0] + x @ raw[i, j, 1:], smooth.quantiles[j]) + 1e-9


@pytest.mark.parametrize("kind", ["plain", "ties", "heavy"])
def test_exact_fit_equals_the_best_line_through_two_points(spark, kind):
    """The minimum is reached by a line through two points, so trying all pairs finds it."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 9, 60).astype(float) if kind == "ties" else rng.normal(size=60)
    y = 2 * x + (rng.standard_cauchy(60) if kind == "heavy" else rng.exponential(1, 60))
    y = np.round(y) if kind == "ties" else y
    df = spark.createDataFrame([([float(a)], [float(b)]) for a, b in zip(x, y)], "x array<double>, target array<double>").repartition(3)
    fit = pinball.fit_exact(df, ["x"], [0.1, 0.5, 0.8], tolerance=1e-8)
    for j, q in enumerate([0.1, 0.5, 0.8]):
        pairs = ((a, b) for a, b in itertools.combinations(range(60), 2) if x[a] != x[b])
        lines = (((y[b] - y[a]) / (x[b] - x[a]), a) for a, b in pairs)
        best = min(loss_of(y, y[a] + s * (x - x[a]), q) for s, a in lines)
        assert fit.loss[0, j] == pytest.approx(best, abs=1e-6 * y.std())
        assert fit.bound[0, j] <= best + 1e-9


def test_exact_fit_of_features_that_say_nothing_new(spark):
    """A constant and a repeated feature: the loss is still the least one."""
    rng = np.random.default_rng(2)
    a, y = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([([float(v), 1.0, float(2 * v)], [float(t)]) for v, t in zip(a, y)], "x array<double>, target array<double>")
    one = spark.createDataFrame([([float(v)], [float(t)]) for v, t in zip(a, y)], "x array<double>, target array<double>")
    many, few = pinball.fit_exact(df, ["a", "b", "c"], [0.5]), pinball.fit_exact(one, ["a"], [0.5])
    assert many.loss[0, 0] == pytest.approx(few.loss[0, 0], abs=3e-6)
    assert many.gap[0, 0] <= 1e-6 * many.model.spread
    with pytest.raises(ValueError, match="no windows"):
        pinball.fit_exact(df.where("false"), ["a", "b", "c"])
    with pytest.raises(ValueError, match="3 features"):
        pinball.fit_exact(df, ["a"])


# ---- searching in shared scans ------------------------------------------------------------------


def test_candidates_together_equal_single_fits_and_stop_as_told(spark, sf):
    made, names, unit = proofs.search_windows(spark, sf)
    trials = runs.candidates(spark, proofs.SPACE, 30).persist()
    together = search_together(made, names, trials, proofs.used_features, 3, unit=unit)
    assert together.scans == 5
    curves = {(r["trial"], r["epoch"]): r for r in together.curves.collect()}
    scores = {r["trial"]: r for r in together.scores.collect()}
    assert len(scores) == 30
    for trial in (0, 7, 21):
        alone = search_together(made, names, trials.where(F.col("trial") == trial), proofs.used_features, 3, unit=unit)
        for r in alone.curves.collect():
            if (trial, r["epoch"]) in curves:
                assert curves[trial, r["epoch"]]["pinball"] == pytest.approx(r["pinball"], rel=1e-12)
                assert curves[trial, r["epoch"]]["penalised_score"] == pytest.approx(r["penalised_score"], rel=1e-12)
    # Whoever was stopped was worse than the median of the earlier trials that got as far, and nobody else.
    for trial, r in scores.items():
        for epoch in range(2, r["epochs"] + 1):
            best = min(curves[trial, e]["pinball"] for e in range(1, epoch + 1))
            earlier = [curves[t, epoch]["pinball"] for t in range(trial) if (t, epoch) in curves]
            worse = trial >= 5 and bool(earlier) and best > np.median(earlier)
            assert worse == (r["stopped"] and epoch == r["epochs"]) or epoch == 3
    told = runs.median_stop(together.curves, 5, 1, "trial", "pinball").where("stop AND epoch < 3").collect()
    assert {(r["trial"], r["epoch"]) for r in told} == {(t, r["epochs"]) for t, r in scores.items() if r["stopped"]}
    left = [r for r in scores.values() if not r["stopped"]]
    assert together.best["trial"] == min(left, key=lambda r: (r["penalised_score"], r["trial"]))["trial"]


def test_one_round_of_the_search_equals_the_forecaster(spark, sf):
    made, names, _ = proofs.search_windows(spark, sf)
    trials = spark.createDataFrame([(0, 1e-3, 0.05)], "trial int, ridge double, epsilon double")
    found = search_together(made, names, trials, lambda s: names, 4).candidates[0]
    train = made.where("train").select("x", "target")
    n, mean, std, centre, spread = fc._moments(train, len(names), 3)
    model = fc.QuantileModel(names, [0.1, 0.5, 0.9], 3, mean, std, centre, spread, np.zeros((3, 3, len(names) + 1)), np.zeros((3, 3)))
    penalty = 1e-3 * n * np.eye(len(names) + 1)
    penalty[0, 0] = 1e-9 * n
    for _ in range(4):
        g = fc._gram(train, model, 0.05)
        for i, j in np.ndindex(3, 3):
            size = g[i, j, 0, 0] / n
            model.coef[i, j] = np.linalg.solve(g[i, j, :, :-1] / size + penalty, g[i, j, :, -1] / size)
    assert found.coef == pytest.approx(model.coef, rel=1e-8, abs=1e-10)


# ---- windows that end -----------------------------------------------------------------------------


def deliver(spark, tmp_path, batches, **times):
    """One run a delivery from one checkpoint; all changes."""
    schema = "user_id long, ts timestamp_ntz, event_id long, value double, _4 string"
    for rows in batches:
        data = [(u, dt.datetime(2024, 3, 1) + dt.timedelta(hours=h), e, float(e), None) for u, h, e in rows]
        spark.createDataFrame(data, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with sessions.keyed_state(spark):
            made = sessions.stream_sessions(stream, EVENTS, ["value", "_4"], 3, **times)
            live.score_stream(made, lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return sessions.final_sessions(live.read_stream_output(spark, str(tmp_path / "out")), EVENTS).collect()


def test_idle_series_leave_and_late_is_not_stale(spark, tmp_path):
    batches = [
        [(1, 0, 1), (1, 1, 2), (2, 0, 3), (None, 2, 4)] + [(3, h / 10, 100 + h) for h in range(30)],
        [(1, 30, 5), (3, 31, 6)],  # the clock was 2.9 h; nothing is late
        [(1, 3, 7), (2, 4, 8), (2, 31, 9), (3, 31, 6)],  # clock 31 h: late for 1, which is live; stale for 2, which left
        [(2, 5, 10)],
    ]
    found = deliver(spark, tmp_path, batches, idle=10 * 3600, delay=5 * 3600, reach=1000 * 3600)
    windows = {(r["user_id"], r["opened"].hour + 24 * (r["opened"].day - 1)): r for r in found if r["state"] != "stale"}
    ids = {k: [x["event_id"] for x in r["rows"]] for k, r in windows.items()}
    assert windows[1, 0]["state"] == "open" and ids[1, 0] == [2, 7, 5] and windows[1, 0]["late"] == 1
    assert windows[2, 0]["state"] == "expired" and ids[2, 0] == [3]
    assert windows[2, 31]["state"] == "open" and ids[2, 31] == [10, 9] and windows[2, 31]["late"] == 1
    assert windows[None, 2]["state"] == "expired" and ids[None, 2] == [4]
    assert windows[3, 0]["state"] == "open" and ids[3, 0] == [128, 129, 6] and windows[3, 0]["late"] == 0
    assert set(windows) == {(1, 0), (2, 0), (2, 31), (None, 2), (3, 0)}
    stale = {r["user_id"]: r["stale"] for r in found if r["state"] == "stale"}
    assert stale == {2: 1}


def test_rows_without_a_key_stay_apart_from_other_series(spark, tmp_path):
    """All series meet in one task; the key is null in some rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [(u, h, 10 * h + (u or 0)) for h in range(4) for u in (1, None, 2, 3)]
        found = deliver(spark, tmp_path, [rows[:10], rows[10:]], idle=10 * 3600, delay=5 * 3600, reach=1000 * 3600)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = {r["user_id"]: [x["event_id"] for x in r["rows"]] for r in found}
    assert ids == {u: [10 * h + (u or 0) for h in (1, 2, 3)] for u in (1, None, 2, 3)} and len(found) == 4


class _Counted:
    """A state handle that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *a: self.calls.append(name) or getattr(self, f"_{name}")(*a)

    def _get(self):
        return self.value

    def _update(self, value):
        self.value = value

    def _clear(self):
        self.value = None

    def _registerTimer(self, at):
        self.timers.add(at)

    def _deleteTimer(self, at):
        self.timers.remove(at)


def test_a_series_costs_a_micro_batch_few_state_calls():
    names = ["u", "ts", "id", "_clock", "_us", "_floor", "_n", "_full"]
    fields = [T.StructField("ts", T.LongType()), T.StructField("id", T.LongType())]
    processor, handle, second = sessions._Sessions(names, ["u"], ["ts", "id"], fields, 3, 100, 50, 1000), _Counted(), 1_000_000
    processor.init(handle)

    class At:
        def __init__(self, clock):
            self.getCurrentWatermarkInMs = lambda: clock * 1000 - 1_000_000

    rows = lambda *ids: iter([(1, i, i, None, i * second, i * second, 1, True) for i in ids])
    out = [*processor.handleInputRows((1,), rows(2000, 2001), At(0))]
    assert handle.calls == ["get", "update", "registerTimer"] and [r["state"] for r in out] == ["open"]
    handle.calls.clear()
    out = [*processor.handleInputRows((1,), rows(2003, 2002, 2002), At(2001))]
    assert handle.calls == ["get", "update", "deleteTimer", "registerTimer"] and handle.timers == {2003_000 + 100_000 - 1_000_000}
    assert [x["id"] for x in out[0]["rows"]] == [2001, 2002, 2003]
    handle.calls.clear()
    out = [*processor.handleInputRows((1,), rows(1950), At(2003))]  # late, and older than the window
    assert handle.calls == ["get", "update"] and out[0]["late"] == 1 and [x["id"] for x in out[0]["rows"]] == [2001, 2002, 2003]
    handle.calls.clear()
    out = [*processor.handleInputRows((1,), rows(2150, 1999), At(2110))]  # the window ends, one row opens the next, one is stale
    assert handle.calls == ["get", "clear", "update", "deleteTimer", "registerTimer"] and handle.timers == {2150_000 + 100_000 - 1_000_000}
    assert [(r["state"], r["stale"], [x["id"] for x in r["rows"]]) for r in out] == [("expired", 0, [2001, 2002, 2003]), ("stale", 1, []), ("open", 0, [2150])]
    handle.calls.clear()
    out = [*processor.handleExpiredTimer((1,), At(2250), None)]
    assert handle.calls == ["get", "clear"] and out[0]["state"] == "expired" and handle.value is None


def test_reach_must_exceed_the_other_times(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS user_id", "timestamp AS ts", "value AS event_id", "1.0D AS value")
    with pytest.raises(ValueError, match="reach"):
        sessions.stream_sessions(stream, EVENTS, ["value"], idle=10, delay=5, reach=10)


def test_combining_in_map_tasks_keeps_newest_rows_and_counts_the_rest():
    run = sessions._combined(["u"], ["ts", "id"], 2, flush=5)
    rows = pd.DataFrame({"u": [1] * 12 + [2], "ts": [*range(12), 3], "id": range(13), "_us": [*range(12), 3], "_floor": [t // 4 * 4 for t in range(12)] + [0], "_n": 1, "_full": True})
    for size in (3, 13):
        out = pd.concat(list(run(rows.iloc[i : i + size] for i in range(0, 13, size))), ignore_index=True)
        assert out["_n"].sum() == 13
        kept = sorted(out.loc[out["_full"] & (out["u"] == 1), "id"])
        assert kept[-2:] == [10, 11]
        assert out.groupby(["u", "_floor"])["_n"].sum().to_dict() == {(1, 0): 4, (1, 4): 4, (1, 8): 4, (2, 0): 1}


# ---- committed snapshots ----------------------------------------------------------------------------


def test_versions_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots.latest_version(spark, path) == 0
    with pytest.raises(ValueError, match="no committed table"):
        snapshots.read(spark, path, "a")
    assert snapshots.commit(spark, path, {"a": spark.range(10), "empty": spark.range(0)}) == 1
    dying = spark.range(100).select(F.when(F.col("id") == 57, F.raise_error(F.lit("x")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        snapshots.commit(spark, path, {"a": spark.range(99), "b": dying})
    assert snapshots.latest_version(spark, path) == 1
    assert snapshots.commit(spark, path, {"a": spark.range(7)}) == 2
    assert snapshots.read(spark, path, "a", check=True).count() == 7
    assert snapshots.read(spark, path, "a", version=1, check=True).count() == 10
    assert snapshots.read(spark, path, "empty", version=1, check=True).count() == 0
    told = {(r["version"], r["table"]): r["rows"] for r in snapshots.versions(spark, path).collect()}
    assert told == {(1, "a"): 10, (1, "empty"): 0, (2, "a"): 7}


def test_readers_ignore_files_no_manifest_names(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.commit(spark, path, {"a": spark.range(4)})
    folder = snapshots.manifests(spark, path).where("file IS NOT NULL").first()["file"].rsplit("/", 1)[0]
    spark.range(100).write.mode("append").parquet(folder)
    assert snapshots.read(spark, path, "a", check=True).count() == 4


def test_write_once_doesnt_take_a_dead_writers_folder(spark, tmp_path):
    path = str(tmp_path / "once")
    spark.range(3).write.parquet(f"{path}/data/dead/table")
    assert writers.written_once(spark.range(5), path).count() == 5
    assert writers.written_once(spark.range(9), path).count() == 5


# ---- gamma tails ------------------------------------------------------------------------------------


@pytest.mark.parametrize("freedom", [1, 2, 5, 10, 20, 101, 1000])
def test_chi_square_tail(spark, freedom):
    at = [1e-9, 0.01, 0.5, 1.0, freedom / 2, float(freedom), freedom + 2.0, freedom + 5 * math.sqrt(2 * freedom), freedom + 60.0]
    rows = spark.createDataFrame([(q,) for q in at], "q double").select("q", dep.chi_square_tail(F.col("q"), freedom).alias("p")).collect()

    def want(q):
        x, a = q / 2, freedom / 2
        if freedom % 2 == 0:
            return sum(math.exp(-x + j * math.log(x) - math.lgamma(j + 1)) for j in range(freedom // 2))
        return math.erfc(math.sqrt(x)) + sum(math.exp(-x + (j - 0.5) * math.log(x) - math.lgamma(j + 0.5)) for j in range(1, int(a + 0.5)))

    for r in rows:
        assert r["p"] == pytest.approx(want(r["q"]), rel=1e-9, abs=1e-14)


def test_tails_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (-1.0,)], "q double").select(dep.chi_square_tail(F.col("q"), 5).alias("p")).collect()
    assert [r["p"] for r in rows] == [None, None, 1.0, 1.0]
