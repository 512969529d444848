"""Quantile forecasts: empirical changes, linear quantile regression, user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapcast.functions.quantiles import exact_quantiles
from lapcast.operators.encode import unscale
from lapcast.plans.ordered import blocks
from lapcast.plans.skew import hot_keys, lookup_join
from lapcast.schema import QUANTILES
from lapcast.session import written

NAMES = ["q10", "q50", "q90"]
_FIT_TASKS = 8192


def by_horizon(windows: DataFrame, keep: Sequence[str], anchor: Column, horizon: int | None = None) -> DataFrame:
    """One row per (window, horizon) with the last known value ``last`` and, where known, the true ``y``."""
    if "target" in windows.columns:
        steps = windows.select(*keep, anchor.cast("double").alias("last"), F.posexplode("target").alias("_h", "y"))
        return steps.select(*keep, "last", (F.col("_h") + 1).alias("horizon"), "y")
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")
    return windows.select(*keep, anchor.cast("double").alias("last"), ahead)


def change_quantiles(
    steps: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = tuple(QUANTILES), at_most: int | None = None
) -> DataFrame:
    """(by, horizon, change quantiles) of the rows of :func:`by_horizon`."""
    changes = steps.select(*by, "horizon", (F.col("y") - F.col("last")).alias("change"))
    return exact_quantiles(changes, [*by, "horizon"], "change", quantiles, at_most).select(
        *by, "horizon", *[F.col("change")[i].alias(f"d_{n}") for i, n in enumerate(NAMES[: len(quantiles)])]
    )


def add_changes(steps: DataFrame, model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Last value plus the change quantiles of the row's group."""
    scored = lookup_join(steps, model, [*by, "horizon"])
    names = [n for n in NAMES if f"d_{n}" in model.columns]
    return scored.select(*[c for c in steps.columns if c != "last"], *[(F.col("last") + F.col(f"d_{n}")).alias(n) for n in names])


def fit_empirical_quantiles(
    windows: DataFrame,
    value: str,
    by: Sequence[str] = (),
    quantiles: Sequence[float] = tuple(QUANTILES),
    at_most: int | None = None,
) -> DataFrame:
    """(by, horizon, change quantiles): how much the value moves h steps ahead.

    ``at_most`` is a proven bound on the number of windows, if one is known.
    """
    steps = by_horizon(windows, list(by), F.element_at("past", -1)[value])
    return change_quantiles(steps, by, quantiles, at_most)


def predict_empirical(
    windows: DataFrame, model: DataFrame, value: str, keep: Sequence[str], by: Sequence[str] = (), horizon: int = 3
) -> DataFrame:
    """Last value plus the change quantiles of the window's group, one row per horizon.

    ``horizon`` matters only for windows without a target.
    """
    kept = list(dict.fromkeys([*keep, *by]))
    steps = by_horizon(windows, kept, F.element_at("past", -1)[value], horizon)
    return add_changes(steps, model, by).drop(*[c for c in by if c not in keep])


def finish_quantiles(df: DataFrame, state: DataFrame | None = None, column: str | None = None, digits: int | None = None) -> DataFrame:
    """Undo scaling, put the outer quantiles on their side of the median, optionally round."""
    if state is not None:
        df = unscale(df, state, column, *NAMES, *(["y"] if "y" in df.columns else []))
    df = df.withColumns({"q10": F.least("q10", "q50"), "q90": F.greatest("q90", "q50")})
    return df.withColumns({n: F.round(n, digits) for n in NAMES}) if digits is not None else df


# ---- linear quantile regression ------------------------------------------------------------


@dataclass
class QuantileModel:
    """Coefficients per (horizon, quantile) on standardised features, intercept first."""

    features: list[str]
    quantiles: list[float]
    horizon: int
    mean: np.ndarray
    std: np.ndarray
    centre: float
    spread: float
    coef: np.ndarray  # (horizon, quantile, 1 + features)
    constant: np.ndarray  # (horizon, quantile): 1 where the plain quantile was kept

    def raw_coefficients(self) -> np.ndarray:
        """The same model on unscaled features and target."""
        slope = self.coef[:, :, 1:] / self.std
        intercept = self.coef[:, :, 0] - slope @ self.mean
        return np.concatenate([(intercept * self.spread + self.centre)[..., None], slope * self.spread], axis=2)


def feature_columns(past: Sequence[str], future: Sequence[str], static: Sequence[str], length: int, horizon: int) -> list[str]:
    """Names of the flattened window: past by position, then future, then static."""
    return (
        [f"past.{c}.{i + 1}" for i in range(length) for c in past]
        + [f"future.{c}.{i + 1}" for i in range(horizon) for c in future]
        + [f"static.{c}" for c in static]
    )


def with_features(windows: DataFrame, past: Sequence[str], future: Sequence[str] = (), static: Sequence[str] = ()) -> DataFrame:
    """Add ``x``: the window as one array in the order of :func:`feature_columns`."""
    parts = [F.flatten(F.transform("past", lambda r: F.array(*[r[c].cast("double") for c in past])))]
    if future:
        parts.append(F.flatten(F.transform("future", lambda r: F.array(*[r[c].cast("double") for c in future]))))
    if static:
        parts.append(F.array(*[F.col("static")[c].cast("double") for c in static]))
    return windows.withColumn("x", F.concat(*parts))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, width)


def _few_tasks(table: DataFrame) -> DataFrame:
    """Every task sends one set of sums, so their number is bounded for very large tables."""
    slim = table.select("x", "target")
    return slim.coalesce(_FIT_TASKS)


def _moments(table: DataFrame, p: int, horizon: int) -> tuple[int, np.ndarray, np.ndarray, float, float]:
    """Count, feature mean and std, target centre and spread.

    A task keeps means and squared deviations per batch; Spark brings them to the common mean,
    which stays accurate where plain sums of squares would cancel.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, dev = np.zeros(p + 1), np.zeros(p + 1), np.zeros(p + 1)
        for b in batches:
            x, y = _matrix(b.column(0), p), _matrix(b.column(1), horizon)
            if not len(x):
                continue
            more = np.append(np.full(p, float(len(x))), float(y.size))
            centre = np.append(x.mean(axis=0), y.mean())
            around = np.append(((x - centre[:p]) ** 2).sum(axis=0), ((y - centre[p]) ** 2).sum())
            gap, both = centre - mean, n + more
            dev += around + gap**2 * n * more / both
            mean += gap * more / both
            n = both
        if n[0]:
            names = ["i", "n", "mean", "dev"]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p + 1, dtype=np.int32)), pa.array(n), pa.array(mean), pa.array(dev)], names=names)

    every = Window.partitionBy("i")
    rows = (
        _few_tasks(table)
        .mapInArrow(partial, "i int, n double, mean double, dev double")
        .withColumn("centre", F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every))
        .groupBy("i")
        .agg(
            F.sum("n").alias("n"),
            F.first("centre").alias("mean"),
            F.sum(F.col("dev") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2))).alias("dev"),
        )
        .orderBy("i")
        .collect()
    )
    if not rows:
        raise ValueError("no windows to fit: are the series long enough for length + horizon?")
    n, mean, dev = (np.array([r[c] for r in rows]) for c in ("n", "mean", "dev"))
    std = np.sqrt(dev / n)
    std[std < 1e-12] = 1.0
    return int(n[0]), mean[:p], std[:p], float(mean[p]), float(std[p])


def _gram(table: DataFrame, model: QuantileModel, epsilon: float) -> np.ndarray:
    """Weighted normal equations of all (horizon, quantile) fits in one pass.

    Each task adds up its rows; the sums travel as one row per (fit, matrix row) and are
    added by Spark, so the driver receives fits * features rows whatever the data size.
    """
    p, h, q = len(model.features), model.horizon, len(model.quantiles)
    coef, mean, std = model.coef, model.mean, model.std
    centre, spread, levels = model.centre, model.spread, np.array(model.quantiles)
    width = p + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((h, q, p + 1, width))
        for b in batches:
            x = (_matrix(b.column(0), p) - mean) / std
            y = (_matrix(b.column(1), h) - centre) / spread
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for i in range(h):
                for j in range(q):
                    e = y[:, i] - x @ coef[i, j]
                    w = np.where(e >= 0, levels[j], 1 - levels[j]) / np.maximum(np.abs(e), epsilon)
                    xw = x * w[:, None]
                    total[i, j, :, : p + 1] += xw.T @ x
                    total[i, j, :, p + 1] += xw.T @ y[:, i]
        flat = total.reshape(h * q * (p + 1), width)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), lists], names=["i", "g"])

    summed = (
        _few_tasks(table)
        .mapInArrow(partial, "i int, g array<double>")
        .groupBy("i")
        .agg(F.array(*[F.sum(F.get("g", F.lit(c))) for c in range(width)]).alias("g"))
    )
    out = np.zeros((h * q * (p + 1), width))
    for row in summed.toLocalIterator():
        out[row["i"]] = row["g"]
    return out.reshape(h, q, p + 1, width)


def fit_quantile_forecaster(
    table: DataFrame,
    features: Sequence[str],
    quantiles: Sequence[float] = tuple(QUANTILES),
    ridge: float = 1e-3,
    rounds: int = 10,
    epsilon: float = 0.05,
) -> QuantileModel:
    """Minimise mean pinball loss for every horizon and quantile over all rows of ``table`` (x, target).

    Iteratively reweighted least squares on the standardised problem, one pass per round
    for all fits; then each intercept moves by the exact residual quantile so that training
    coverage is right, and a fit that does not beat the plain quantile is replaced by it.
    Persist or write ``table`` first: it is read ``rounds`` + 3 times.
    """
    features = list(features)
    p = len(features)
    first = table.select(F.size("target").alias("h"), F.size("x").alias("p")).first()
    if first is None:
        raise ValueError("no windows to fit: are the series long enough for length + horizon?")
    if first["p"] != p:
        raise ValueError(f"windows have {first['p']} features, {p} names given")
    h = first["h"]
    n, mean, std, centre, spread = _moments(table, p, h)
    shape = (h, len(quantiles))
    model = QuantileModel(features, list(quantiles), h, mean, std, centre, spread, np.zeros((*shape, p + 1)), np.zeros(shape))
    penalty = ridge * n * np.eye(p + 1)
    penalty[0, 0] = 1e-9 * n
    for _ in range(rounds):
        g = _gram(table, model, epsilon)
        for i in range(h):
            for j in range(len(quantiles)):
                # Bring the weights to mean 1 so that the ridge means the same in every round.
                size = g[i, j, 0, 0] / n
                model.coef[i, j] = np.linalg.solve(g[i, j, :, : p + 1] / size + penalty, g[i, j, :, p + 1] / size)
    return _calibrate(table, model)


def _calibrate(table: DataFrame, model: QuantileModel) -> QuantileModel:
    """Shift intercepts to exact training coverage and fall back to plain quantiles where better."""
    h, q = model.horizon, len(model.quantiles)
    n = table.count()
    lines = written(_with_lines(table, model, ["target"]), "lines")
    truth = F.get("target", F.floor(F.col("_f") / q).cast("int"))
    rows = lines.select(F.posexplode("_lines").alias("_f", "_v"), "target").select("_f", "_v", truth.alias("y"))
    plain = _by_fit(exact_quantiles(rows.select("_f", "y"), ["_f"], "y", model.quantiles, n), "y", q)
    errors = rows.select("_f", (F.col("y") - F.col("_v")).alias("e"))
    shift = _by_fit(exact_quantiles(errors, ["_f"], "e", model.quantiles, n), "e", q)
    level = F.get(F.lit(model.quantiles), F.col("_f") % q)
    moved, constant = F.col("_v") + F.get(F.lit(shift), F.col("_f")), F.get(F.lit(plain), F.col("_f"))
    losses = rows.groupBy("_f").agg(
        F.avg(_pinball(F.col("y"), moved, level)).alias("moved"), F.avg(_pinball(F.col("y"), constant, level)).alias("constant")
    )
    for r in losses.collect():
        i, j = divmod(r["_f"], q)
        if r["moved"] <= r["constant"]:
            model.coef[i, j, 0] += shift[r["_f"]] / model.spread
        else:
            model.coef[i, j] = 0.0
            model.coef[i, j, 0] = (plain[r["_f"]] - model.centre) / model.spread
            model.constant[i, j] = 1.0
    return model


def _pinball(y: Column, forecast: Column, level: Column) -> Column:
    e = y - forecast
    return F.greatest(level * e, (level - 1) * e)


def _by_fit(found: DataFrame, column: str, q: int) -> list[float]:
    """The quantile each (horizon, quantile) fit is about, in fit order (horizon * quantiles rows)."""
    return [float(r[column][r["_f"] % q]) for r in sorted(found.collect(), key=lambda r: r["_f"])]


def _with_lines(table: DataFrame, model: QuantileModel, keep: Sequence[str]) -> DataFrame:
    """``keep`` plus ``_lines``: all (horizon, quantile) forecasts of a row, one matrix product per Arrow batch."""
    p, raw = len(model.features), model.raw_coefficients().reshape(-1, len(model.features) + 1)
    schema = T.StructType([*[table.schema[c] for c in keep], T.StructField("_lines", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _matrix(b.column(0), p) @ raw[:, 1:].T + raw[:, 0]
            lines = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(raw)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lines], names=[*keep, "_lines"])

    return table.select("x", *keep).mapInArrow(score, schema)


def predict(table: DataFrame, model: QuantileModel, keep: Sequence[str]) -> DataFrame:
    """q10/q50/q90 per (window, horizon); ``y`` too where the windows have a target."""
    known = ["target"] if "target" in table.columns else []
    q = len(model.quantiles)
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("horizon"),
                *[F.get("target", F.lit(i)).alias("y") for _ in known],
                *[F.get("_lines", F.lit(i * q + j)).alias(n) for j, n in enumerate(NAMES[:q])],
            )
            for i in range(model.horizon)
        ]
    )
    return _with_lines(table, model, list(dict.fromkeys([*keep, *known]))).select(*keep, F.inline(rows))


def predict_with(windows: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], np.ndarray]], keep: Sequence[str], horizon: int = 3) -> DataFrame:
    """Score with the user's model: ``factory`` runs once per task and returns a function from
    a batch of windows to an array (rows, horizon, 3)."""
    kept = [windows.schema[c] for c in keep]
    known = [T.StructField("y", T.DoubleType())] if "target" in windows.columns else []
    schema = T.StructType(
        [*kept, T.StructField("horizon", T.IntegerType()), *known, *[T.StructField(n, T.DoubleType()) for n in NAMES]]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            if batch.empty:
                continue
            out = np.asarray(model(batch), dtype=float).reshape(len(batch), horizon, len(NAMES))
            rows = batch.loc[batch.index.repeat(horizon), list(keep)].reset_index(drop=True)
            rows["horizon"] = np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(batch))
            if known:
                rows["y"] = np.concatenate([np.asarray(t, dtype=float) for t in batch["target"]])
            for j, name in enumerate(NAMES):
                rows[name] = out[:, :, j].ravel()
            yield rows

    return windows.mapInPandas(score, schema)


# ---- importances ------------------------------------------------------------------------------


def coefficients_table(model: QuantileModel, spark) -> DataFrame:
    """(horizon, quantile, feature, coefficient, std); the effect of a feature is |coefficient| * std."""
    raw = model.raw_coefficients()
    rows = [
        (i + 1, float(level), name, float(raw[i, j, k + 1]), float(model.std[k]))
        for i in range(model.horizon)
        for j, level in enumerate(model.quantiles)
        for k, name in enumerate(model.features)
    ]
    return spark.createDataFrame(rows, "horizon int, quantile double, feature string, coefficient double, std double")


def _shares(effects: DataFrame, label: str) -> DataFrame:
    total = effects.agg(F.coalesce(F.sum("effect"), F.lit(0.0))).first()[0] + 1e-8
    return effects.select(label, (F.col("effect") / F.lit(total)).alias("share"))


def feature_importance(coefficients: DataFrame, folds: dict[str, str] | None = None) -> DataFrame:
    """(feature, share): share of each input column in the forecast; ``folds`` merges columns for display."""
    column = F.split("feature", r"\.")[1]
    for name, into in (folds or {}).items():
        column = F.when(column == name, F.lit(into)).otherwise(column)
    effects = coefficients.groupBy(column.alias("feature")).agg(F.sum(F.abs("coefficient") * F.col("std")).alias("effect"))
    return _shares(effects, "feature")


def position_importance(coefficients: DataFrame) -> DataFrame:
    """(position, share): share of each past row, 1 = oldest of the window."""
    past = coefficients.where(F.col("feature").startswith("past."))
    effects = past.groupBy(F.split("feature", r"\.")[2].cast("int").alias("position")).agg(
        F.sum(F.abs("coefficient") * F.col("std")).alias("effect")
    )
    return _shares(effects, "position")


def permutation_importance(
    table: DataFrame, model: QuantileModel, groups: dict[str, list[int]], key: Sequence[str], seed: int = 42
) -> DataFrame:
    """(feature, increase): growth of mean pinball loss when a group's columns come from another window.

    The other window is the neighbour in the hash order of ``key``, within one of many hash buckets.
    """
    buckets = 16 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    mixed = table.select("x", "target", place.alias("_u")).withColumn("_b", F.pmod("_u", F.lit(buckets)))
    laid = blocks(mixed, ["_b"], ["_u"], 1, 0, hot_keys(mixed, ["_b"]))
    mixed = laid.home(laid.df.withColumn("_other", F.lag("x").over(laid.window())))
    # The first window of a bucket keeps its own values.
    mixed = mixed.withColumn("_other", F.coalesce("_other", "x"))
    p, h, names = len(model.features), model.horizon, list(groups)
    raw, levels = model.raw_coefficients(), np.array(model.quantiles)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names) + 1, 2))
        for b in batches:
            x, other, y = _matrix(b.column(0), p), _matrix(b.column(1), p), _matrix(b.column(2), h)

            def add(i: int, features: np.ndarray) -> None:
                e = y[:, :, None] - (features @ raw[:, :, 1:].reshape(-1, p).T).reshape(len(y), h, -1) - raw[:, :, 0]
                total[i] += [np.maximum(levels * e, (levels - 1) * e).sum(), e.size]

            add(0, x)
            for i, name in enumerate(names):
                swapped = x.copy()
                swapped[:, groups[name]] = other[:, groups[name]]
                add(i + 1, swapped)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *names]), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["feature", "s", "n"]
        )

    sums = mixed.select("x", "_other", "target").mapInArrow(partial, "feature string, s double, n double")
    losses = sums.groupBy("feature").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("loss"))
    base = F.broadcast(losses.where("feature = ''").select(F.lit(1).alias("_one"), F.col("loss").alias("_base")))
    changed = losses.where("feature <> ''").withColumn("_one", F.lit(1))
    return changed.join(base, "_one").select("feature", (F.col("loss") - F.col("_base")).alias("increase"))
