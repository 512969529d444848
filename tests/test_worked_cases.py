"""Small cases worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapcast.functions import columns as C
from lapcast.operators import dependence as dep
from lapcast.operators import encode as enc
from lapcast.operators import evaluate as ev
from lapcast.operators import forecast as fc
from lapcast.operators import profile as prof
from lapcast.operators import runs
from lapcast.operators import windows as win
from lapcast.roles import Roles

R = Roles(entity="s", series=("s",), ts="t", tie=("i",), value="x")


def series(spark, values, name="a"):
    start = dt.datetime(2024, 1, 1)
    rows = [(name, start + dt.timedelta(days=i), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, t timestamp_ntz, i int, x double")


def near(x, digits=6):
    return pytest.approx(x, abs=10**-digits)


def test_evaluation(spark):
    rows = [(60.0, 59.0, 60.5, 61.0), (62.0, 63.0, 62.5, 64.0), (70.0, 65.0, 66.0, 69.0), (55.0, 50.0, 49.0, 54.0)]
    done = fc.finish_quantiles(spark.createDataFrame(rows, "y double, q10 double, q50 double, q90 double"))
    assert [(r["q10"], r["q90"]) for r in done.orderBy("q50").collect()] == [(49, 54), (59, 61), (62.5, 64), (65, 69)]
    m = ev.evaluate(done).first()
    assert m["mae"] == near(2.75)
    assert m["rmse"] == near(3.6228441865)
    assert m["mape"] == near(4.5657903924)
    assert (m["pinball_q10"], m["pinball_q50"], m["pinball_q90"]) == (near(0.4125), near(1.375), near(0.525))
    assert m["coverage"] == 25
    assert m["winkler"] == near(9.375)
    assert m["penalised_score"] == near(11.9375)
    assert ev.pinball(done).first()["pinball"] == near((0.4125 + 1.375 + 0.525) / 3)


def test_mape_leaves_out_zero(spark):
    m = ev.evaluate(spark.createDataFrame([(0.0, 1.0, 1.0, 1.0), (2.0, 1.0, 1.0, 1.0)], "y double, q10 double, q50 double, q90 double")).first()
    assert (m["mape"], m["mape_excluded"]) == (50.0, 1)


@pytest.mark.parametrize("limit", [None, "4"])
def test_dependence(spark, limit):
    if limit:
        spark.conf.set("lapcast.blockRows", limit)
    try:
        products = dep.lag_products(series(spark, [1, 3, 2, 5, 4, 6, 5, 8, 7, 9]), R)
        r = {x["lag"]: x["acf"] for x in dep.acf(products, R).collect()}
        assert [r[k] for k in range(5)] == [1, near(0.45), near(0.5), near(-0.033333, 5), near(0.066667, 5)]
        assert len(r) == 5
        p = {x["lag"]: x["pacf"] for x in dep.pacf(products, R).collect()}
        assert [p[k] for k in range(5)] == [1, near(0.5), near(0.5), near(-0.806878), near(0.545599)]
        lb = dep.ljung_box(products, R).first()
        assert (lb["q"], lb["p"]) == (near(8.4846031746), near(0.1314733581))
    finally:
        spark.conf.unset("lapcast.blockRows")


def test_chi_square_tail(spark):
    assert spark.range(1).select(dep.chi_square_tail(F.lit(11.0705), 5).alias("p")).first()["p"] == near(0.05, 4)


def test_constant_series_is_tested_but_has_no_correlation(spark):
    products = dep.lag_products(series(spark, [3.0] * 12), R)
    assert {x["acf"] for x in dep.acf(products, R).collect()} == {None}
    assert {x["pacf"] for x in dep.pacf(products, R).collect()} == {None}
    tests = dep.ljung_box(products, R)
    assert tests.first()["p"] is None
    share = dep.significant_share(tests).first()
    assert (share["tested"], share["significant"]) == (1, 0)


@pytest.mark.parametrize("clock, seconds", [(1.0523, 65.23), (0.2815, 28.15), (16.30, 990.0)])
def test_clock(spark, clock, seconds):
    assert spark.range(1).select(C.clock_to_seconds(F.lit(clock)).alias("s")).first()["s"] == pytest.approx(seconds, abs=2e-4)


@pytest.mark.parametrize("at, months", [("2005-02-01", 1), ("2004-12-31", 0), ("2020-01-01", 180)])
def test_age(spark, at, months):
    age = C.age_months(F.lit("2005-01-31").cast("date"), F.lit(at).cast("date"))
    assert spark.range(1).select(age.alias("m")).first()["m"] == months


def test_gap_counts_whole_elapsed_days(spark):
    times = [dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 3, 1)]
    df = spark.createDataFrame([("a", t, i, 0.0) for i, t in enumerate(times)], "s string, t timestamp_ntz, i int, x double")
    assert [r["days_since_last"] for r in win.with_gap(df, R).orderBy("i").collect()] == [0, 0, 1]
    assert [r["days_since_last"] for r in win.with_gap(df, R, rounding="up").orderBy("i").collect()] == [0, 1, 1]


def test_future_dates(spark):
    last = spark.createDataFrame([("a", dt.date(2024, 1, 31), dt.date(2005, 3, 1))], "s string, t date, birth date")
    over = win.future_rows(last, R, 3, birth="birth").orderBy("horizon").collect()
    assert [str(r["future_date"]) for r in over] == ["2024-03-02", "2024-03-31", "2024-05-01"]
    assert [(r["month"], r["age_months"]) for r in over] == [(2, 228), (2, 228), (4, 230)]
    cut = win.future_rows(last, R, 3, clamp=True).orderBy("horizon").collect()
    assert [str(r["future_date"]) for r in cut] == ["2024-02-29", "2024-03-31", "2024-04-30"]


@pytest.mark.parametrize(
    "given, pad, want",
    [("abc", "last", "ccabc"), ("abc", "first", "aaabc"), ("abcdef", "last", "bcdef"), ("", "last", "")],
)
def test_padding(spark, given, pad, want):
    rows = spark.createDataFrame([(list(given),)], "a array<string>")
    assert "".join(rows.select(win.padded(F.col("a"), 5, pad).alias("p")).first()["p"]) == want


@pytest.mark.parametrize("n, length, horizon, count", [(22, 20, 3, 0), (23, 20, 3, 1), (30, 20, 3, 8), (10, 10, 1, 0), (11, 10, 1, 1)])
def test_window_counts(spark, n, length, horizon, count):
    made = win.windows(series(spark, range(n)), R, ["x"], length=length, horizon=horizon)
    assert made.count() == count


def test_window_contents(spark):
    df = series(spark, range(8)).withColumn("k", F.col("i") * 10)
    first = win.windows(df, R, ["x"], ["k"], ["i"], length=3, horizon=2).orderBy("origin_ts").first()
    assert [r["x"] for r in first["past"]] == [0, 1, 2]
    assert [r["k"] for r in first["future"]] == [30, 40]
    assert first["static"]["i"] == 0
    assert first["target"] == [3.0, 4.0]


def test_bins(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 4, 5, 9, 10, 1000)], "n int")
    edges = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 1001]
    counted = prof.binned_counts(sizes, "n", edges, [str(e) for e in edges[:-1]], open_end=True).orderBy("bin")
    assert [r["count"] for r in counted.collect()] == [1, 2, 2, 1, 0, 0, 0, 0, 0, 1]
    short = [0, 10, 20, 50, 100, 200, 500, 1000]
    dropped = prof.binned_counts(sizes, "n", short, [str(e) for e in short[:-1]]).orderBy("bin")
    assert [r["count"] for r in dropped.collect()] == [5, 1, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("limit", [None, "3"])
def test_early_stop(spark, limit):
    losses = [1.0, 0.8, 0.8004, 0.81, 0.79, 0.80, 0.7904, 0.795, 0.90, 0.1]
    df = spark.createDataFrame([(1, e + 1, v) for e, v in enumerate(losses)], "run_id int, epoch int, val_loss double")
    if limit:
        spark.conf.set("lapcast.blockRows", limit)
    try:
        trace = runs.early_stop_trace(df, 3, 0.0005).orderBy("epoch").collect()
        assert [r["epoch"] for r in trace if r["save"] and r["ran"]] == [1, 2, 5]
        assert [r["counter"] for r in trace][:9] == [0, 0, 0, 1, 0, 1, 1, 2, 3]
        done = runs.early_stop(df, 3, 0.0005).first()
        assert (done["last_epoch"], done["stopped"], done["best_loss"], done["best_epoch"], done["saves"]) == (9, 1, 0.79, 5, 3)
    finally:
        spark.conf.unset("lapcast.blockRows")


def test_dictionaries_and_scaler(spark):
    df = spark.createDataFrame(
        [("Dos", 1500, 1.0), ("Brasse", 50, 2.0), ("Nage Libre", 100, 3.0), ("4 Nages", 50, 4.0), ("Papillon", 50, None)],
        "stroke string, distance int, v double",
    )
    joint = enc.fit_dictionaries(df, ["stroke", "distance"])
    codes = {(r["column"], r["value"]): r["code"] for r in joint.collect()}
    assert [codes["stroke", s] for s in ("4 Nages", "Brasse", "Dos", "Nage Libre", "Papillon")] == [0, 1, 2, 3, 4]
    assert [codes["distance", s] for s in ("50", "100", "1500")] == [0, 1, 2]
    state = enc.fit_scaler(df, "v").first()
    assert (state["mean"], state["std"]) == (2.5, near(1.1180339887))


def test_unseen_values(spark):
    known = enc.fit_dictionary(spark.createDataFrame([("a",), ("b",)], "c string"), "c")
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    assert {r["k"] for r in enc.encode(df, "c", known, "k", "null").collect()} == {0, None}
    assert {r["k"] for r in enc.encode(df, "c", known, "k", "other").collect()} == {0, 2}
    with pytest.raises(Exception, match="unseen value in c: z"):
        enc.encode(df, "c", known, "k").collect()


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r["v"] for r in enc.scale(df, enc.fit_scaler(df, "v"), "v").collect()} == {0.0}


def test_ecdf_and_histogram(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (4.0,)], "n double")
    assert [(r["n"], r["share"]) for r in prof.ecdf(df, "n").orderBy("n").collect()] == [(1, 0.5), (2, 0.75), (4, 1.0)]
    assert [r["height"] for r in prof.histogram(df, "n", 3).orderBy("bin").collect()] == [2, 1, 1]
    assert sum(r["height"] for r in prof.histogram(df, "n", 3, density=True).collect()) == near(1.0)


def test_median_stop_shuffles_its_blocks_once(spark):
    """Without an over-full epoch both directions of counting work on one layout."""
    rows = [(r, e, float((r * 37 + e * 11) % 23)) for r in range(12) for e in range(1, 7)]
    told = runs.median_stop(spark.createDataFrame(rows, "run_id long, epoch int, val_loss double"), 5, 3)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2
    losses = {(r, e): v for r, e, v in rows}
    for t in told.collect():
        r, e = t["run_id"], t["epoch"]
        earlier = sorted(losses[i, e] for i in range(r)) if r >= 5 and e > 3 else []
        best, n = min(losses[r, k] for k in range(1, e + 1)), len(earlier)
        median = (earlier[(n - 1) // 2] + earlier[n // 2]) / 2 if n else 0
        assert (t["best_so_far"], t["earlier_runs"], t["stop"]) == (best, n, bool(n) and best > median)


def test_median_stop_ties_go_on(spark):
    rows = [(r, 4, float(r)) for r in range(5)] + [(5, 4, 2.0), (6, 4, 2.5)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, val_loss double")
    verdict = {r["run_id"]: r["stop"] for r in runs.median_stop(df, 5, 3).collect()}
    assert verdict == {0: False, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_gaps_do_not_depend_on_the_session_zone(spark):
    times = [dt.datetime(2024, 3, 9, 2, 30), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 11, 2, 29)]
    df = spark.createDataFrame([("a", t, i, 0.0) for i, t in enumerate(times)], "s string, t timestamp_ntz, i int, x double")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r["days_since_last"] for r in win.with_gap(df, R).orderBy("i").collect()] == [0, 1, 0]
        assert [r["days_since_last"] for r in win.with_gap(df, R, rounding="up").orderBy("i").collect()] == [0, 1, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
