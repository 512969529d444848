"""Keeping every series' latest window up to date while results arrive in any order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lapcast.operators.windows import padded
from lapcast.roles import Roles


def _newest(rows: pd.DataFrame, keys: list[str], order: list[str], length: int) -> pd.DataFrame:
    ordered = rows.drop_duplicates([*keys, *order]).sort_values(order, kind="stable")
    return ordered.groupby(keys, sort=False, dropna=False).tail(length)


def _pretrim(roles: Roles, length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task keep only rows that can still be among a series' newest, so that a hot series
    sends at most ``length`` rows per task and flush into the shuffle."""
    keys, order, flush = roles.keys, roles.order, 200_000

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(_newest(batch, keys, order, length))
            size += len(held[-1])
            if size > flush:
                kept = _newest(pd.concat(held), keys, order, length)
                if len(kept) > flush // 2:
                    yield kept
                    held, size = [], 0
                else:
                    held, size = [kept], len(kept)
        if held:
            yield _newest(pd.concat(held), keys, order, length)

    return trim


def stream_windows(stream: DataFrame, roles: Roles, columns: Sequence[str], length: int = 20) -> DataFrame:
    """The updated window of each series touched by a micro-batch.

    Columns: series keys, ``version`` (updates so far), ``origin_ts``, ``n_rows``, ``rows`` (oldest
    first, at most ``length``). State per series is these rows only. Insertion is by (time, tie),
    so late rows go to their place and rows older than the kept ones change nothing. A row that
    arrives twice counts once.
    """
    columns = list(dict.fromkeys([*roles.order, *columns]))
    keys, order = roles.keys, roles.order
    slim = stream.select(*dict.fromkeys([*keys, *columns]))
    held = T.StructType([f for f in slim.schema.fields if f.name in columns])
    state_type = T.StructType([T.StructField("version", T.LongType()), T.StructField("rows", T.ArrayType(held))])
    out_type = T.StructType(
        [f for f in slim.schema.fields if f.name in keys]
        + [
            T.StructField("version", T.LongType()),
            T.StructField("origin_ts", slim.schema[roles.ts].dataType),
            T.StructField("n_rows", T.IntegerType()),
            T.StructField("rows", T.ArrayType(held)),
        ]
    )
    out_keys = [f.name for f in slim.schema.fields if f.name in keys]
    at = [columns.index(c) for c in order]
    stored = [f.name for f in held.fields]
    at = [stored.index(c) for c in order]

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, rows = state.get if state.exists else (0, [])
        best = {tuple(r[i] for i in at): tuple(r) for r in rows}
        for chunk in chunks:
            # Chunks are bounded Arrow batches; only ``length`` rows survive each.
            chunk = chunk.sort_values(order, kind="stable").tail(length)
            for r in zip(*[_plain(chunk[c]) for c in stored]):
                best[tuple(r[i] for i in at)] = r
            best = {k: best[k] for k in sorted(best)[-length:]}
        rows = [best[k] for k in sorted(best)]
        state.update((version + 1, rows))
        named = dict(zip(keys, key))
        yield pd.DataFrame(
            {
                **{k: [named[k]] for k in out_keys},
                "version": [version + 1],
                "origin_ts": [rows[-1][at[0]]],
                "n_rows": pd.Series([len(rows)], dtype="int32"),
                "rows": [[dict(zip(stored, r)) for r in rows]],
            }
        )

    return (
        slim.mapInPandas(_pretrim(roles, length), slim.schema)
        .groupBy(*keys)
        .applyInPandasWithState(update, out_type, state_type, "append", GroupStateTimeout.NoTimeout)
    )


def _plain(column: pd.Series) -> list:
    """Python values, times as datetime so that state and chunk rows compare alike."""
    if pd.api.types.is_datetime64_any_dtype(column):
        return [v.to_pydatetime() for v in column]
    return column.tolist()


def latest_versions(updates: DataFrame, roles: Roles) -> DataFrame:
    """The newest update of every series."""
    others = [c for c in updates.columns if c not in roles.keys]
    newest = F.max_by(F.struct(*others), "version")
    return updates.groupBy(*roles.keys).agg(newest.alias("_u")).select(*roles.keys, "_u.*")


def as_serving_window(updates: DataFrame, columns: Sequence[str], length: int = 20) -> DataFrame:
    """Updates in the shape the forecasters take: ``past`` padded to ``length`` rows."""
    past = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return updates.withColumn("past", padded(past, length)).drop("rows")


def score_stream(
    windows: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True
):
    """Score every emitted window and keep the forecasts, one folder per micro-batch.

    Writing a batch again after a failure replaces its folder, so results count once.
    """

    def save(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = windows.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_stream_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output)
