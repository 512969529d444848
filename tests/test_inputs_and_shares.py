"""Files of JSON arrays, attributions, bottom-k samples, long lags."""

import io
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapcast.catalog import proofs
from lapcast.catalog.registry import table
from lapcast.operators import attribution as attr
from lapcast.operators import dependence as dep
from lapcast.operators import sampling as smp
from lapcast.roles import Roles
from lapcast.sources import json_arrays as ja

objects = st.dictionaries(st.text(max_size=4), st.recursive(st.none() | st.integers() | st.text(max_size=6), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=6), max_size=3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(objects, max_size=4), max_size=4), st.integers(1, 9), st.booleans())
def test_whole_arrays_come_back_whatever_the_chunks(arrays, chunk, ascii_only):
    text = "\n".join(json.dumps(a, ensure_ascii=ascii_only) for a in arrays)
    before, ja.CHUNK = ja.CHUNK, chunk
    try:
        found = list(ja.elements(io.StringIO(text)))
    finally:
        ja.CHUNK = before
    assert [json.loads(e) for e, bad in found] == [o for a in arrays for o in a]
    assert all(bad is None for _, bad in found)


@pytest.mark.parametrize("chunk", [2, 1 << 20])
@pytest.mark.parametrize("text, good, bad", [
    ('[{"a":1}, {"a": oops, "b":[1,2]}, {"a":3}]', 2, ['{"a": oops, "b":[1,2]}']), ('[{"a":1}\n[{"a":2}]', 2, ["array without an end"]),
    ('[{"a":1},{"b":', 1, ['{"b":', "array without an end"]), ('[1,"x",null,{"a":"],["}]', 1, ["1", '"x"', "null"]), ("", 0, []), ("[]", 0, []),
    ('{"a":1}', 1, []), ("[" + "[" * 5000, 0, None), ("[,,{}]", 1, []),
])
def test_broken_elements_are_told_and_the_rest_is_read(monkeypatch, chunk, text, good, bad):
    monkeypatch.setattr(ja, "CHUNK", chunk)
    found = list(ja.elements(io.StringIO(text)))
    assert sum(e is not None for e, _ in found) == good
    assert bad is None or [b for _, b in found if b is not None] == bad


def test_histories_by_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    race = {"date": "2018-02-15", "nage": "Dos", "distance": 100, "bassin": 50, "temps": 59.8}
    (tmp_path / "in" / "a.json").write_text(json.dumps([race, {**race, "distance": "far"}, race]))
    (tmp_path / "in" / "b.json").write_text("[" + json.dumps(race) + ", nothing]")
    (tmp_path / "in" / "_SUCCESS").write_text("x")
    path = str(tmp_path / "in")
    rows = sorted((r["file"][-6:], r["place"], r["distance"], r["_bad_row"] is not None) for r in ja.read_histories(spark, path).collect())
    assert rows == [("a.json", 0, 100, False), ("a.json", 1, None, True), ("a.json", 2, 100, False), ("b.json", 0, 100, False), ("b.json", 1, None, True)]

    def drain():
        query = ja.stream_histories(spark, path).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert drain() == 5
    (tmp_path / "in" / "c.json").write_text(json.dumps([race] * 4))
    assert drain() == 9
    assert ja.read_histories(spark, str(tmp_path / "none")).count() == 0


def models():
    """Factories as values: workers can't import this module."""

    def linear():
        def run(batch):
            past = np.array([[[r["v"], r["w"]] for r in rows] for rows in batch["past"]], dtype=float)
            y = past[:, :, 0] @ [1.0, 2.0, 3.0] - past[:, :, 1] @ [0.5, 0.0, 4.0]
            return np.repeat(y[:, None], 9, axis=1) * np.arange(1, 10)

        return run

    def product():
        def run(batch):
            past = np.array([[r["v"] for r in rows] for rows in batch["past"]], dtype=float)
            return np.repeat(past.prod(axis=1)[:, None], 9, axis=1)

        return run

    return linear, product


linear, product = models()


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [(float(v), float(w)) for v, w in rng.normal(2, 1, (3, 2))]) for i in range(30)]
    return spark.createDataFrame(rows, "id long, past array<struct<v:double,w:double>>").repartition(3)


def past_of(df):
    return {r["id"]: np.array([[x["v"], x["w"]] for x in r["past"]]) for r in df.collect()}


def test_shares_of_a_linear_model_are_its_closed_form(small):
    against = attr.background(small, ["id"], 4)
    own, mean = past_of(small), np.mean(list(past_of(against).values()), axis=0)
    rows = attr.attributions(small, linear, attr.by_column(["v", "w"], 3), against, ["id"], pairs=2, rows=7).collect()
    assert len(rows) == 30 * 9 * 2
    for r in rows:
        gap = own[r["id"]] - mean
        want = {"v": gap[:, 0] @ [1, 2, 3], "w": -gap[:, 1] @ [0.5, 0, 4]}[r["feature"]]
        place = (r["horizon"] - 1) * 3 + [0.1, 0.5, 0.9].index(r["quantile"]) + 1
        assert r["share"] == pytest.approx(want * place, rel=1e-9, abs=1e-9)


def test_shares_of_a_product_are_near_the_exact_ones_within_their_error(small):
    """Against one background window all six orders of three positions can be tried."""
    from itertools import permutations

    against = attr.background(small, ["id"], 1)
    own, other = past_of(small), next(iter(past_of(against).values()))[:, 0]
    rows = attr.attributions(small, product, attr.by_position(["v"], 3), against, ["id"], pairs=40).where("horizon = 1 AND quantile = 0.5").collect()
    for r in rows:
        x, k = own[r["id"]][:, 0], int(r["feature"]) - 1
        exact = 0.0
        for order in permutations(range(3)):
            mixed = other.copy()
            for g in order:
                before, mixed[g] = mixed.prod(), x[g]
                exact += (mixed.prod() - before) / 6 if g == k else 0
        assert abs(r["share"] - exact) <= 5 * r["error"] + 1e-9
    sums = {}
    for r in rows:
        sums[r["id"]] = sums.get(r["id"], 0) + r["share"]
    assert all(s == pytest.approx(own[i][:, 0].prod() - other.prod(), abs=1e-9) for i, s in sums.items())


def test_a_model_of_arrays_gives_the_shares_of_its_rows_without_python_rows(small):
    def plain():
        def run(batch):
            past = np.array([[(r["v"], r["w"]) for r in rows] for rows in batch["past"]])
            return np.repeat(past.prod(axis=(1, 2))[:, None], 9, axis=1) * np.arange(1, 10)

        return run

    def never():
        raise AssertionError("rows are not asked for")

    never.arrays = lambda: lambda past, batch: np.repeat((past["v"] * past["w"]).prod(axis=1)[:, None], 9, axis=1) * np.arange(1, 10)
    against, groups = attr.background(small, ["id"], 3), attr.by_position(["v"], 3)
    place = lambda r: (r["id"], r["horizon"], r["quantile"], r["feature"])
    want = {place(r): r for r in attr.attributions(small, plain, groups, against, ["id"], pairs=3).collect()}
    got = attr.attributions(small, never, groups, against, ["id"], pairs=3, rows=7, horizons=[3, 1], quantiles=[0.9]).collect()
    assert sorted(map(place, got)) == sorted(k for k in want if k[1] != 2 and k[2] == 0.9)
    for r in got:
        assert (r["share"], r["error"]) == pytest.approx((want[place(r)]["share"], want[place(r)]["error"]), rel=1e-9, abs=1e-9)


def test_windows_with_missing_values_go_to_the_model_of_rows(small):
    def plain():
        return lambda batch: np.array([[sum(r["v"] or 0.0 for r in rows)] * 9 for rows in batch["past"]])

    both = lambda: plain()
    both.arrays = lambda: lambda past, batch: np.repeat(past["v"].sum(axis=1)[:, None], 9, axis=1)
    holed = small.selectExpr("id", "transform(past, (x, i) -> named_struct('v', if(id = 7 and i = 1, null, x.v), 'w', x.w)) AS past")
    against, groups = attr.background(small.where("id <> 7"), ["id"], 2), attr.by_position(["v"], 3)
    rows = lambda f: {(r["id"], r["feature"], r["horizon"], r["quantile"]): r["share"] for r in attr.attributions(holed, f, groups, against, ["id"], pairs=1).collect()}
    assert rows(both) == pytest.approx(rows(plain), rel=1e-9, abs=1e-9)


def test_shares_without_a_number_are_null(small):
    holed = small.selectExpr("id", "transform(past, (x, i) -> named_struct('v', if(id = 7 and i = 1, null, if(id = 8, double('NaN'), x.v)))) AS past")

    def total():
        return lambda batch: np.array([[sum(np.nan if r["v"] is None else r["v"] for r in rows)] * 9 for rows in batch["past"]])

    total.arrays = lambda: lambda past, batch: np.repeat(past["v"].sum(axis=1)[:, None], 9, axis=1)
    against = attr.background(small.where("id not in (7, 8)").select("id", F.expr("transform(past, x -> named_struct('v', x.v))").alias("past")), ["id"], 2)
    got = attr.attributions(holed, total, attr.by_position(["v"], 3), against, ["id"], pairs=1).collect()
    assert len(got) == 30 * 9 * 3 and all(r["share"] is None for r in got if r["id"] == 8)
    assert all((r["share"] is None) == (r["id"] in (7, 8)) or r["id"] == 7 for r in got)
    assert any(r["share"] is None for r in got if r["id"] == 7)


def test_mean_shares_add_up_to_one(small):
    rows = attr.attributions(small, linear, attr.by_position(["v", "w"], 3, 2), attr.background(small, ["id"], 2), ["id"], pairs=1)
    shares = {r["feature"]: r["share"] for r in attr.mean_shares(rows).collect()}
    assert set(shares) == {"1-2", "3-3"} and sum(shares.values()) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError, match="background"):
        attr.attributions(small, linear, attr.by_column(["v"], 3), small.where("false"), ["id"])


def test_bottom_k_is_the_head_of_the_sorted_keys(spark):
    rows = [(s, u, k) for s in ("a", None, "b") for k in range(200) for u in [(k * 7919) % 50 / 50]] * 3 + [("a", 0.0, None)]
    df = spark.createDataFrame(rows, "s string, _u double, k long").repartition(7)
    got = sorted((str(r["s"]), r["_u"], r["k"]) for r in smp.bottom_k(df, ["s"], "k", 11).collect())
    want = sorted(x for s in ("a", "None", "b") for x in sorted({(s, u, k) for t, u, k in rows if str(t) == s and k is not None}, key=lambda r: r[1:])[:11])
    assert got == want
    assert smp.bottom_k(df.where("false"), [], "k", 3).count() == 0


@pytest.mark.parametrize("block", [7, 16, 4096])
def test_long_lags_equal_plain_sums(spark, block):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(5, 2, 100), "b": rng.normal(size=9), None: np.ones(30), "c": rng.normal(size=1)}
    rows = [(k, i, float(v)) for k, values in data.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, t long, v double").repartition(4)
    found = dep.long_lag_products(df, Roles("s", ("s",), "t", (), "v"), 7, block).collect()
    assert len(found) == 4
    for r in found:
        d = data[r["s"]] - data[r["s"]].mean()
        want = [float(d[: len(d) - k] @ d[k:]) if k < len(d) else 0.0 for k in range(8)]
        assert r["n"] == len(d) and r["products"] == pytest.approx(want, abs=1e-9)


def test_long_lags_with_overfull_series(spark, sf, tiny_limits):
    roles = Roles("event_type", ("event_type",), "ts", ("event_id",), "value")
    events = table(spark, sf, "events")
    plain = {r["event_type"]: r["products"] for r in dep.lag_products(events, roles, 10).collect()}
    for r in dep.long_lag_products(events, roles, 10, 64).collect():
        assert r["products"] == pytest.approx(plain[r["event_type"]], rel=1e-9)


def test_exported_histories_are_read_whole(spark, sf):
    rows = ja.read_histories(spark, proofs.exported_histories(spark, sf), proofs._HISTORY)
    told = rows.agg(F.count_if(F.col("_bad_row").isNull()).alias("good"), F.count_if(F.col("_bad_row").startswith("{")).alias("bad")).first()
    assert told["good"] + told["bad"] == table(spark, sf, "orders").count()
