"""Live windows whose state ends: a series that has been idle long enough leaves the state, and old rows are told apart."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapcast.roles import Roles
from lapcast.streaming.live import _newest

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Helper columns: microseconds, the same floored to the grain, how many rows stand for it, whether the row itself is there.
_TIME, _FLOOR, _COUNT, _FULL = "_us", "_floor", "_n", "_full"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that timers and lists need; the session's own is set again afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _combined(keys: list[str], order: list[str], length: int, flush: int = 200_000):
    """Per task: the newest ``length`` rows of each series as they are, of all others one row for each floored time with their
    number, so that a hot series sends few rows. Every arrival is counted, also repeated ones."""
    by = [*keys, _FLOOR, _FULL]

    def squeeze(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        full = rows[rows[_FULL]]
        kept = _newest(full, keys, order, length)
        rest = pd.concat([rows[~rows[_FULL]], full.drop(kept.index).assign(**{_FULL: False})])
        if rest.empty:
            return kept
        counts = rest.groupby(by, dropna=False, as_index=False).agg(**{_COUNT: (_COUNT, "sum"), "_at": (_TIME, "idxmin")})
        # Payload of a counted row is never read; it is carried to keep the columns' types.
        some = rest.loc[~rest.index.duplicated()].loc[counts["_at"]].assign(**{_COUNT: counts[_COUNT].to_numpy()})
        return pd.concat([kept, some], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, least = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            # Rows kept are squeezed again only with as many new ones, so a row is sorted a bounded number of times.
            if size > max(2 * least, flush // 4):
                held = [squeeze(pd.concat(held, ignore_index=True))]
                size = least = len(held[0])
                if size > flush:
                    yield held[0]
                    held, size, least = [], 0, 0
        if size:
            yield squeeze(pd.concat(held, ignore_index=True))

    return run


class _Sessions(StatefulProcessor):
    """Opens, updates and ends the window of one series.

    A series has one state value and one timer, which its newest time tells, so a micro-batch costs it one read and one write.
    The window's rows are stored as one pickled list, as converting every value of every row is most of a read or write otherwise.
    """

    def __init__(self, names, keys, order, state_fields, length, idle, delay, reach):
        self.length = length
        self.stored = stored = [f.name for f in state_fields]
        self.idle, self.delay, self.reach = idle * 1000, delay * 1000, reach * 1000
        self.at = [stored.index(c) for c in order]
        # Names that are no Python names may arrive changed, so values are taken by place.
        self.places = [names.index(c) for c in stored]
        self.time, self.floor, self.count, self.full = (names.index(c) for c in (_TIME, _FLOOR, _COUNT, _FULL))
        self.out = Row(*keys, "opened", "version", "state", "newest", "n_rows", "late", "stale", "rows")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "opened long, newest long, version long, late long, rows binary")

    def _clock(self, timers) -> int | None:
        """The newest event time of earlier micro-batches, in ms."""
        mark = timers.getCurrentWatermarkInMs()
        return mark + self.reach if mark > 0 else None

    def _timer(self, newest: int) -> int:
        return newest // 1000 + self.idle - self.reach

    def _known(self) -> tuple | None:
        about = self.about.get()
        return None if about is None else (*about[:4], pickle.loads(bytes(about[4])))

    def _row(self, key, about, state, stale=0) -> Row:
        opened, newest, version, late, rows = about
        return self.out(*key, opened, version, state, newest, len(rows), late, stale, [dict(zip(self.stored, r)) for r in rows])

    def _end(self, key, about) -> Row:
        opened, newest, version, late, rows = about
        self.about.clear()
        return self._row(key, (opened, newest, version + 1, late, rows), "expired")

    def _last(self, held: dict) -> dict:
        """The newest ``length`` rows, oldest first; nulls are last."""
        places = sorted(held, key=lambda k: [(v is None, v) for v in k])[-self.length :]
        return {k: held[k] for k in places}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = self._clock(timerValues)
        about = self._known()
        before = None if about is None else about[1]
        if about is not None and clock is not None and before // 1000 + self.idle <= clock:
            yield self._end(key, about)
            about = None
        opened, newest, version, late, kept = about or (None, None, 0, 0, [])
        held = {tuple(r[i] for i in self.at): r for r in kept}
        stale = 0
        for row in rows:
            floor = row[self.floor]
            if clock is not None and floor is not None:
                if about is None and floor // 1000 + self.idle <= clock:
                    stale += row[self.count]
                    continue
                if floor // 1000 <= clock - self.delay:
                    late += row[self.count]
            if about is None and floor is not None:
                opened = floor if opened is None else min(opened, floor)
            if not row[self.full]:
                continue
            if row[self.time] is not None:
                newest = row[self.time] if newest is None else max(newest, row[self.time])
            r = tuple(row[i] for i in self.places)
            held[tuple(r[i] for i in self.at)] = r
            if len(held) >= 2 * self.length + 100:
                held = self._last(held)
        if stale:
            yield self._row(key, (None, None, 0, 0, []), "stale", stale)
        if newest is not None:
            about = (opened, newest, version + 1, late, [*self._last(held).values()])
            self.about.update((*about[:4], pickle.dumps(about[4])))
        if before != newest:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            if newest is not None:
                self.handle.registerTimer(self._timer(newest))
        if newest is not None:
            yield self._row(key, about, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        about = self._known()
        if about is not None:
            yield self._end(key, about)

    def close(self) -> None:
        pass


def stream_sessions(
    stream: DataFrame, roles: Roles, columns: Sequence[str], length: int = 20, idle: int = 30 * 86_400, delay: int = 86_400,
    reach: int = 3650 * 86_400, grain: int = 3_600,
) -> DataFrame:
    """Windows of the last ``length`` rows of each series, kept while the series is live; all times in seconds.

    The clock of a micro-batch is the newest event time of all earlier ones, in whole milliseconds. A series whose newest row is
    ``idle`` or more behind the clock leaves the state: timers end it, and nothing of it stays. One row of output per change:

    ``state`` ``open``: the updated window, its rows oldest first, ``late`` rows so far that were ``delay`` or more behind the clock
    and were put in their place. ``expired``: the window as it ended. ``stale``: rows of a series without state that were themselves
    ``idle`` behind the clock and were dropped, counted in ``stale``. Lateness is judged by the row's time floored to ``grain``, so that
    map tasks may count rows beyond a series' newest instead of sending them. ``opened`` is the floored time of the first accepted
    row of the micro-batch that opened the window, ``version`` numbers a window's changes. Rows more than ``reach`` behind the clock are
    dropped by the engine itself; ``reach`` must exceed ``idle`` and ``delay``, and times lie after 1970 + ``reach``. Repeated rows
    count as arrivals and stand once in the window. Start the query within :func:`keyed_state`.
    """
    if reach <= max(idle, delay):
        raise ValueError("reach must exceed idle and delay")
    keys, order = roles.keys, roles.order
    columns = list(dict.fromkeys([*order, *columns]))
    moment = F.col(roles.ts).cast("timestamp")
    micros = F.unix_micros(moment)
    slim = stream.select(*dict.fromkeys([*keys, *columns]), moment.alias("_clock"))
    marked = slim.withColumns({_TIME: micros, _FLOOR: F.floor(micros / (grain * 1_000_000)) * (grain * 1_000_000), _COUNT: F.lit(1).cast("long"), _FULL: F.lit(True)})
    dealt = marked.mapInPandas(_combined(keys, order, length), marked.schema)
    held = [f for f in marked.schema.fields if f.name in columns]
    out = T.StructType([
        *[marked.schema[k] for k in keys], T.StructField("opened", T.LongType()), T.StructField("version", T.LongType()),
        T.StructField("state", T.StringType()), T.StructField("newest", T.LongType()), T.StructField("n_rows", T.IntegerType()),
        T.StructField("late", T.LongType()), T.StructField("stale", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType(held))),
    ])
    processor = _Sessions(marked.columns, keys, order, held, length, idle, delay, reach)
    made = dealt.withWatermark("_clock", f"{reach} seconds").groupBy(*keys).transformWithState(processor, outputStructType=out, outputMode="append", timeMode="EventTime")
    return made.withColumns({"opened": F.timestamp_micros("opened"), "newest": F.timestamp_micros("newest")})


def final_sessions(changes: DataFrame, roles: Roles) -> DataFrame:
    """The last change of every window, and one row a series with the number of its stale rows."""
    keys = roles.keys
    rest = [c for c in changes.columns if c not in [*keys, "opened"]]
    windows = changes.where("state <> 'stale'").groupBy(*keys, "opened").agg(F.max_by(F.struct(*rest), "version").alias("u")).select(*keys, "opened", "u.*")
    stale = changes.where("state = 'stale'").groupBy(*keys).agg(F.sum("stale").alias("stale"))
    nothing = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in rest if c not in ("state", "stale")]
    return windows.unionByName(stale.select(*keys, F.lit(None).cast("timestamp").alias("opened"), F.lit("stale").alias("state"), *nothing, "stale"))
