"""Properties that hold whatever the data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapcast.catalog import forecasts as cat
from lapcast.catalog.registry import EVENTS, table
from lapcast.functions.quantiles import exact_quantiles
from lapcast.operators import dependence as dep
from lapcast.operators import evaluate as ev
from lapcast.operators import forecast as fc
from lapcast.operators import profile as prof
from lapcast.operators import runs
from lapcast.operators import sampling as smp
from lapcast.plans.ordered import ranked


@pytest.fixture(scope="module")
def fitted(spark, sf):
    return cat.fitted(spark, sf, rounds=6)


def samples():
    rng = random.Random(5)
    yield "uniform", [rng.random() for _ in range(700)]
    yield "copies", [1.5] * 400 + [2.0] * 3 + [rng.gauss(0, 1) for _ in range(50)]
    yield "constant", [7.0] * 100
    yield "wide", [10.0 ** rng.uniform(-200, 200) * rng.choice([-1, 1]) for _ in range(300)]
    yield "two", [3.0] * 50 + [4.0] * 51
    yield "nan", [float("nan")] * 20 + [float(i) for i in range(60)]


@pytest.mark.parametrize("name, values", list(samples()))
def test_bracket_search_equals_sorting(spark, tiny_limits, name, values):
    probs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.77, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(None if i % 2 else "g", v) for i, v in enumerate(values)], "g string, v double").repartition(3)
    got = {r["g"]: r["v"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for key, part in ((None, values[1::2]), ("g", values[0::2])):
        kept = sorted(v for v in part if not math.isnan(v))
        want = np.quantile(kept, probs)
        assert got[key] == pytest.approx(list(want), rel=1e-9, abs=1e-12)
    whole = exact_quantiles(df, [], ["v"], probs).first()["v"]
    assert whole == pytest.approx(list(np.quantile([v for v in values if not math.isnan(v)], probs)), rel=1e-9, abs=1e-12)


def test_overfull_groups_take_two_scans_and_a_wrong_bracket_is_noticed(spark, tiny_limits, monkeypatch):
    import lapcast.functions.quantiles as quant

    rng = random.Random(8)
    values = [rng.gauss(0, 1) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    probs = [0.01, 0.333, 0.5, 0.999]
    tables, searched = [], []
    write, search = quant.written, quant._bracket_search
    monkeypatch.setattr(quant, "written", lambda d, name="table": tables.append(name) or write(d, name))
    monkeypatch.setattr(quant, "_bracket_search", lambda *a: searched.append(1) or search(*a))
    want = list(np.quantile(values, probs))
    assert exact_quantiles(df, [], "v", probs).first()["v"] == pytest.approx(want, rel=1e-12)
    # The values are written once and read twice: for the sketch and for the counts.
    assert tables == ["values", "brackets", "counted", "solved"] and not searched
    monkeypatch.setattr(quant.F, "percentile_approx", lambda v, p, a: F.transform(p, lambda x: x * 0.0 + 9.0))
    assert exact_quantiles(df, [], "v", probs).first()["v"] == pytest.approx(want, rel=1e-12)
    assert searched


def test_rank_is_dense_and_ordered(spark, tiny_limits):
    df = spark.range(500).select((F.col("id") % 3 == 0).alias("k"), F.hash("id").alias("o"), "id")
    rows = ranked(df, ["k"], ["o", "id"], "r").collect()
    for key in (True, False):
        part = sorted((r["o"], r["id"], r["r"]) for r in rows if r["k"] is key)
        assert [p[2] for p in part] == list(range(1, len(part) + 1))


def test_splits_are_disjoint_complete_and_repeatable(spark, sf):
    events = table(spark, sf, "events")
    for exact in (False, True):
        ratios = {"train": 0.8, "val": 0.1, "test": 0.1}
        labelled = smp.split_entities(events, "user_id", ratios, exact=exact)
        assert labelled.count() == events.count()
        assert labelled.select("user_id", "split").distinct().count() == events.select("user_id").distinct().count()
        again = smp.split_entities(events.repartition(7), "user_id", ratios, exact=exact)
        assert labelled.select("event_id", "split").exceptAll(again.select("event_id", "split")).isEmpty()


def test_stratified_sample_keeps_proportions_or_falls_back(spark, sf):
    events = table(spark, sf, "events").withColumn("third", F.col("event_id") % 3)
    roles = cat.EVENTS
    chosen = smp.stratified_entities(events, roles, "third", fraction=0.5, at_least=1)
    assert chosen.count() == int(0.5 * events.select("user_id").distinct().count())
    unique = smp.stratified_entities(events, roles, "event_id", fraction=0.5, at_least=1)
    assert unique.count() == chosen.count()


def test_acf_is_bounded(spark, sf):
    made = dep.acf(dep.lag_products(table(spark, sf, "events"), EVENTS), EVENTS)
    assert made.where("abs(acf) > 1 + 1e-9 OR (lag = 0 AND abs(acf - 1) > 1e-12)").isEmpty()


def test_training_coverage_is_exact_and_beats_the_constant(spark, fitted):
    made, model, _ = fitted
    n = made.count()
    scored = fc.predict(made, model, ["user_id", "origin_ts"])
    for q, level in zip(fc.NAMES, model.quantiles):
        for r in scored.groupBy("horizon").agg(F.avg((F.col("y") <= F.col(q)).cast("double")).alias("c")).collect():
            assert abs(r["c"] - level) <= 2 / n + 1e-9
    plain = exact_quantiles(scored, ["horizon"], "y", model.quantiles).select(
        "horizon", *[F.col("y")[i].alias(f"c{i}") for i in range(3)]
    )
    both = scored.join(plain, "horizon")
    for i, (q, level) in enumerate(zip(fc.NAMES, model.quantiles)):
        own, constant = both.agg(F.avg(ev.pinball_of(F.col("y"), F.col(q), level)), F.avg(ev.pinball_of(F.col("y"), F.col(f"c{i}"), level))).first()
        assert own <= constant + 1e-9


def test_quantiles_do_not_cross_after_finishing(spark, fitted):
    made, model, state = fitted
    done = fc.finish_quantiles(fc.predict(made, model, ["user_id"]), state, "value")
    assert done.where("q10 > q50 OR q50 > q90").isEmpty()


def test_regression_agrees_with_spark_ml_on_one_round(spark, fitted):
    """The first round from zero coefficients is plain weighted least squares."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    made, model, _ = fitted
    p, h = len(model.features), model.horizon
    start = fc.QuantileModel(model.features, [0.5], h, model.mean, model.std, model.centre, model.spread, np.zeros((h, 1, p + 1)), np.zeros((h, 1)))
    g = fc._gram(made, start, 0.05)[0, 0]
    ours = np.linalg.solve(g[:, : p + 1] + 1e-9 * np.eye(p + 1), g[:, p + 1])
    y = (F.col("target")[0] - model.centre) / model.spread
    scaled = F.array(*[(F.col("x")[k] - float(model.mean[k])) / float(model.std[k]) for k in range(p)])
    rows = made.select(y.alias("label"), array_to_vector(scaled).alias("features")).withColumn("w", 0.5 / F.greatest(F.abs("label"), F.lit(0.05)))
    theirs = LinearRegression(solver="normal", weightCol="w").fit(rows)
    assert ours[0] == pytest.approx(theirs.intercept, abs=1e-3)
    assert ours[1:] == pytest.approx(theirs.coefficients.toArray(), abs=2e-2)


def test_importances_sum_to_one(spark, fitted):
    _, model, _ = fitted
    coefficients = fc.coefficients_table(model, spark)
    shares = fc.feature_importance(coefficients, {"month_sin": "season", "month_cos": "season"})
    assert {r["feature"] for r in shares.collect()} == {"scaled", "gap_log", "season", "parity"}
    positions = fc.position_importance(coefficients)
    assert sorted(r["position"] for r in positions.collect()) == list(range(1, 11))
    if not model.constant.all():
        for t in (shares, positions):
            assert t.agg(F.sum("share")).first()[0] == pytest.approx(1.0, abs=1e-6)
    order = [r["share"] for r in prof.by_importance(shares).orderBy("rank").collect()]
    assert order == sorted(order, reverse=True)


def test_permutation_matters_only_for_used_features(spark, fitted):
    made, model, _ = fitted
    groups = {"all": list(range(len(model.features))), "none": []}
    got = {r["feature"]: r["increase"] for r in fc.permutation_importance(made, model, groups, ["user_id", "origin_ts"]).collect()}
    assert got["none"] == pytest.approx(0.0, abs=1e-12)
    assert got["all"] > 0 or model.constant.all()


def test_search_keeps_the_best(spark, sf):
    scores, best = cat.search_outcome(spark, sf, n=2, rounds=2)
    rows = scores.collect()
    assert len(rows) == 2
    assert min(rows, key=lambda r: r["penalised_score"])["trial"] == best["trial"]


def test_candidates_stay_in_their_space(spark):
    drawn = runs.candidates(spark, {"a": ("log", 1e-4, 1e-1), "b": ("int", 64, 512, 32), "c": ("choice", ["x", "y"]), "d": ("uniform", 0.2, 0.6)}, 200).collect()
    assert all(1e-4 <= r["a"] <= 1e-1 and 64 <= r["b"] <= 512 and r["b"] % 32 == 0 and 0.2 <= r["d"] <= 0.6 for r in drawn)
    assert {r["c"] for r in drawn} == {"x", "y"} and {r["b"] for r in drawn} >= {64, 512}


@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_density_equals_the_plain_sum_of_kernels(spark, sf, spread):
    """Also far tails, where most cells are empty, and points outside the values."""
    values = np.array([r["value"] for r in table(spark, sf, "events").select("value").collect()])
    values = np.concatenate([values, values.mean() + spread * np.array([-9.0, 3.0, 27.0])])
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "value double")
    low, high = float(values.min()) - 5, float(values.max()) + 5
    got = {r["point"]: r["density"] for r in prof.kde(df, "value", 50, (low, high)).collect()}
    h = values.std(ddof=1) * len(values) ** -0.2
    for i in range(50):
        at = low + i * (high - low) / 49
        want = np.exp(-0.5 * ((at - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert got[i] == pytest.approx(want, abs=2 * prof.KERNEL_ERROR / h)


def test_moments_survive_a_large_offset(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e9, 1.0, (400, 2))
    df = spark.createDataFrame([(list(map(float, r)), [float(r[0])]) for r in x], "x array<double>, target array<double>").repartition(5)
    n, mean, std, centre, spread = fc._moments(df, 2, 1)
    assert n == 400
    assert mean == pytest.approx(x.mean(axis=0), rel=1e-12)
    assert std == pytest.approx(x.std(axis=0), rel=1e-4)
    assert spread == pytest.approx(x[:, 0].std(), rel=1e-4)
