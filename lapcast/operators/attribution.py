"""How much each input moves a forecast of any model: attributions row by row, averaged where wanted."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapcast.functions.columns import unit_hash
from lapcast.schema import QUANTILES

Groups = dict[str, list[tuple[str, int]]]
Factory = Callable[[], Callable[[pd.DataFrame], np.ndarray]]


def by_column(columns: Sequence[str], length: int) -> Groups:
    """One group for each past column."""
    return {c: [(c, i) for i in range(length)] for c in columns}


def by_position(columns: Sequence[str], length: int, width: int = 1) -> Groups:
    """One group for each run of ``width`` past rows, named by its first and last position, 1 = oldest."""
    name = lambda i: str(i + 1) if width == 1 else f"{i + 1}-{min(i + width, length)}"
    return {name(i): [(c, k) for c in columns for k in range(i, min(i + width, length))] for i in range(0, length, width)}


def background(windows: DataFrame, key: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """The ``size`` windows with the smallest hash of their key (its columns as text, joined by colons)."""
    place = unit_hash(seed, F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    return windows.withColumn("_u", place).orderBy("_u", *key).limit(size).drop("_u")


def _orders(groups: int, pairs: int, seed: int) -> list[np.ndarray]:
    """Random orders of the groups, each followed by its reverse, which evens out what an early place is worth."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(pairs):
        order = rng.permutation(groups)
        out += [order, order[::-1]]
    return out


def attributions(
    windows: DataFrame, factory: Factory, groups: Groups, against: DataFrame, keep: Sequence[str], horizon: int = 3, pairs: int = 8,
    seed: int = 42, rows: int = 500, horizons: Sequence[int] | None = None, quantiles: Sequence[float] | None = None,
) -> DataFrame:
    """(keep, horizon, quantile, feature, share, error) of every window: how far each group of inputs moves the forecast from that
    of a background window to its own.

    Along a random order of the groups the background's values are replaced by the window's, group by group; a group's share is the
    change it brings, averaged over 2 * ``pairs`` orders. All windows use the same orders and background windows (order i meets
    background window i modulo their number), so every model call is one batch. The shares of a window always add up to its
    forecast less the mean forecast of the background windows met; for a model that is a sum over groups each share is exact,
    otherwise ``error`` is its standard error over the orders. Inputs outside all groups keep the window's values. ``against`` is small:
    it is collected, see :func:`background`. ``rows`` bounds a model call. ``horizons`` and ``quantiles`` name the forecasts wanted
    (None: all).

    A factory with an attribute ``arrays`` also gives models of arrays: ``factory.arrays()`` takes the past as one (rows, length) array
    of doubles for each column and the batch without it. Such a model is used where all past columns are doubles without nulls and
    all windows equally long, so no Python object stands for a past row.
    """
    base = [[row.asDict() for row in r["past"]] for r in against.select("past").collect()]
    if not base:
        raise ValueError("no background windows")
    orders, names = _orders(len(groups), pairs, seed), list(groups)
    fields = windows.schema["past"].dataType.elementType.fields
    columns = {f.name for f in fields}
    # Which columns a group sets at each position.
    cells: dict[str, dict[int, set[str]]] = {}
    for name, places in groups.items():
        for c, k in places:
            cells.setdefault(name, {}).setdefault(k, set()).add(c)
    steps = [h - 1 for h in horizons] if horizons is not None else list(range(horizon))
    levels = [QUANTILES.index(q) for q in quantiles] if quantiles is not None else list(range(len(QUANTILES)))
    kept = [windows.schema[c] for c in keep]
    schema = T.StructType([
        *kept, T.StructField("horizon", T.IntegerType()), T.StructField("quantile", T.DoubleType()), T.StructField("feature", T.StringType()),
        T.StructField("share", T.DoubleType()), T.StructField("error", T.DoubleType()),
    ])

    def shares(n: int, forecast: Callable, own, mixed: Callable, put: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard error over the orders, (group, row, horizon, quantile). Every order ends at the own forecast."""
        wanted = lambda past: np.asarray(forecast(past), dtype=float).reshape(n, horizon, len(QUANTILES))[:, steps][:, :, levels]
        changes, whole = np.zeros((len(orders), len(names), n, len(steps), len(levels))), wanted(own)
        for o, order in enumerate(orders):
            past = mixed(base[o % len(base)])
            last = wanted(past)
            for nth, g in enumerate(order):
                put(past, names[g])
                now = whole if nth == len(order) - 1 else wanted(past)
                changes[o, g], last = now - last, now
        return changes.mean(axis=0), changes.std(axis=0, ddof=1) / np.sqrt(len(orders))

    def of_rows(model: Callable[[pd.DataFrame], np.ndarray], batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        own = [list(past) for past in batch["past"]]

        def take(past: list[list[dict]], source: Callable[[int], list[dict]], name: str) -> None:
            """Take a group's cells from other rows; whole rows are only referred to."""
            for k, some in cells[name].items():
                for i, rows_of in enumerate(past):
                    given = source(i)[k]
                    rows_of[k] = given if some == columns else {**rows_of[k], **{c: given[c] for c in some}}

        def mixed(other: list[dict]) -> list[list[dict]]:
            past = [list(p) for p in own]
            for name in names:
                take(past, lambda i: other, name)
            return past

        return shares(len(batch), lambda past: model(batch.assign(past=past)), own, mixed, lambda past, name: take(past, lambda i: own[i], name))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.iloc[at : at + rows].reset_index(drop=True)
                share, error = of_rows(model, batch)
                each, shape = len(names) * len(steps) * len(levels), (len(batch), len(steps), len(levels), len(names))
                out = batch.loc[batch.index.repeat(each), list(keep)].reset_index(drop=True)
                spread = lambda values, axis: np.broadcast_to(np.asarray(values).reshape([-1 if a == axis else 1 for a in range(4)]), shape).ravel()  # noqa: E731, B023
                out["horizon"] = spread(np.array(steps, dtype=np.int32) + np.int32(1), 1)
                out["quantile"] = spread([QUANTILES[q] for q in levels], 2)
                out["feature"] = spread(np.array(names, dtype=object), 3)
                out["share"] = share.transpose(1, 2, 3, 0).ravel()
                out["error"] = error.transpose(1, 2, 3, 0).ravel()
                yield out

    def matrices(past: pa.Array, length: int) -> dict[str, np.ndarray] | None:
        """The past as one array a column; None where a value is missing or a window has another length."""
        values = past.flatten()
        if past.null_count or values.null_count or len(values) != len(past) * length or (np.diff(past.offsets.to_numpy()) != length).any():
            return None
        parts = dict(zip(names_of, values.flatten(), strict=True))
        if any(v.null_count for v in parts.values()):
            return None
        return {c: v.to_numpy().reshape(-1, length) for c, v in parts.items()}

    def explain_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, plain = factory.arrays(), None
        length = len(base[0])
        grounds = {id(b): {c: np.array([np.nan if r[c] is None else r[c] for r in b], dtype=float) for c in columns} for b in base}
        even = all(len(b) == length and all(r[c] is not None for r in b for c in columns) for b in base)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                own = matrices(batch.column("past"), length) if even else None
                if own is None:
                    plain = plain or factory()
                    rest = batch.drop_columns("past").to_pandas()
                    share, error = of_rows(plain, rest.assign(past=pd.Series(batch.column("past").to_pylist(), dtype=object)))
                else:
                    rest = batch.drop_columns("past").to_pandas()

                    def mixed(other: list[dict], own=own) -> dict[str, np.ndarray]:
                        past = {c: v.copy() for c, v in own.items()}
                        for places in cells.values():
                            for k, some in places.items():
                                for c in some:
                                    past[c][:, k] = grounds[id(other)][c][k]
                        return past

                    def put(past: dict[str, np.ndarray], name: str, own=own) -> None:
                        for k, some in cells[name].items():
                            for c in some:
                                past[c][:, k] = own[c][:, k]

                    share, error = shares(batch.num_rows, lambda past, rest=rest: model(past, rest), own, mixed, put)
                n, each = batch.num_rows, len(names) * len(steps) * len(levels)
                again = pa.array(np.repeat(np.arange(n), each))
                horizon_of = np.tile(np.repeat(np.array(steps, dtype=np.int32) + np.int32(1), len(levels) * len(names)), n)
                quantile_of = np.tile(np.repeat([QUANTILES[q] for q in levels], len(names)), n * len(steps))
                feature = pa.DictionaryArray.from_arrays(np.tile(np.arange(len(names), dtype=np.int32), n * len(steps) * len(levels)), pa.array(names, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(again) for c in keep], pa.array(horizon_of), pa.array(quantile_of), feature.cast(pa.string()),
                     *[pa.array(x.transpose(1, 2, 3, 0).ravel(), from_pandas=True) for x in (share, error)]],
                    schema.names,
                )

    names_of = [f.name for f in fields]
    if hasattr(factory, "arrays") and all(f.dataType == T.DoubleType() for f in fields):
        return windows.mapInArrow(explain_arrays, schema)
    return windows.mapInPandas(explain, schema)


def mean_shares(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, share): mean absolute attribution over all rows, normalised to add up to 1 in each group."""
    each = rows.groupBy(*by, "feature").agg(F.avg(F.abs("share")).alias("_a"))
    # One row a feature and group: small.
    return each.select(*by, "feature", (F.col("_a") / (F.sum("_a").over(Window.partitionBy(*by)) + 1e-8)).alias("share"))
