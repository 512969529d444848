"""Gaps, training windows, serving windows, future rows and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapcast.functions.columns import age_months, elapsed_days, month_index, months_later, unit_hash
from lapcast.operators.filters import min_group_size
from lapcast.operators.sampling import last_n
from lapcast.plans.ordered import blocks
from lapcast.plans.skew import hot_keys, lookup_join
from lapcast.roles import Roles


def with_gap(df: DataFrame, roles: Roles, into: str = "days_since_last", rounding: str = "down", min_rows: int = 0) -> DataFrame:
    """Days since the previous row of the series; 0 on its first row.

    ``min_rows`` also drops shorter series, on the same shuffle where the series fit one task.
    """
    hot = hot_keys(df, roles.keys)
    laid = blocks(df, roles.keys, roles.order, 1, 0, hot)
    gap = elapsed_days(F.lag(roles.ts).over(laid.window()), roles.ts, rounding)
    columns = {into: F.coalesce(gap, F.lit(0))}
    if min_rows and hot is None:
        columns["_rows"] = F.count(F.lit(1)).over(Window.partitionBy(*roles.keys))
    out = laid.home(laid.df.withColumns(columns))
    if not min_rows:
        return out
    if hot is None:
        return out.where(F.col("_rows") >= min_rows).drop("_rows")
    return min_group_size(out, roles.keys, min_rows)


def _pack(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def windows(
    df: DataFrame,
    roles: Roles,
    past: Sequence[str],
    future: Sequence[str] = (),
    static: Sequence[str] = (),
    target: str | None = None,
    length: int = 20,
    horizon: int = 3,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every full (past, future, static, target) window of every series.

    ``past`` covers ``length`` rows, ``future`` and ``target`` the next ``horizon`` rows,
    ``static`` is taken from the first past row. A series of n rows gives
    max(0, n - length - horizon + 1) windows. ``carry`` keeps columns of the last past row.
    """
    target = target or roles.value
    needed = list(dict.fromkeys([*roles.keys, *roles.order, *past, *future, *static, target, *carry]))
    slim = df.select(*needed)
    laid = blocks(slim, roles.keys, roles.order, length - 1, horizon, hot_keys(slim, roles.keys))
    behind = laid.window().rowsBetween(-(length - 1), 0)
    in_front = laid.window().rowsBetween(1, horizon)
    columns = {
        "_past": F.collect_list(_pack(past)).over(behind),
        "_next": F.collect_list(_pack([*future, target] if target not in future else future)).over(in_front),
    }
    if static:
        columns["_static"] = F.first(_pack(static)).over(behind)
    full = laid.home(laid.df.withColumns(columns)).where((F.size("_past") == length) & (F.size("_next") == horizon))
    out = [*roles.keys, F.col(roles.ts).alias("origin_ts"), *[c for c in carry if c not in roles.keys], F.col("_past").alias("past")]
    if future:
        out.append(F.transform("_next", lambda r: F.struct(*[r[c].alias(c) for c in future])).alias("future"))
    if static:
        out.append(F.col("_static").alias("static"))
    out.append(F.transform("_next", lambda r: r[target].cast("double")).alias("target"))
    return full.select(*out)


def flat_windows(df: DataFrame, roles: Roles, features: Sequence[str], length: int = 10) -> DataFrame:
    """Single-step windows: ``length`` rows, then the next value of the first feature."""
    made = windows(df, roles, features, target=features[0], length=length, horizon=1)
    return made.withColumn("target", F.col("target")[0])


def latest_window(df: DataFrame, roles: Roles, columns: Sequence[str], length: int = 20, pad: str = "last") -> DataFrame:
    """Per series its last ``length`` rows as one array, padded in front when shorter.

    Padding repeats the newest row (``pad="first"``: the oldest one).
    """
    kept = last_n(df.select(*dict.fromkeys([*roles.keys, *roles.order, *columns])), roles, length)
    row = F.struct(_pack(roles.order).alias("k"), _pack(columns).alias("v"))
    rows = kept.groupBy(*roles.keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max(roles.ts).alias("origin_ts"))
    return rows.withColumn("past", padded(F.transform("_rows", lambda r: r["v"]), length, pad)).select(
        *roles.keys, "origin_ts", F.size("_rows").alias("n_rows"), "past"
    )


def padded(rows: Column, length: int, pad: str = "last") -> Column:
    """The last ``length`` elements; a shorter array is filled up in front; an empty one stays empty."""
    filler = F.element_at(rows, F.lit(-1 if pad == "last" else 1))
    short = F.concat(F.array_repeat(filler, F.lit(length) - F.size(rows)), rows)
    return F.when(F.size(rows) >= length, F.slice(rows, -length, length)).when(F.size(rows) > 0, short).otherwise(rows)


def future_rows(
    last: DataFrame,
    roles: Roles,
    horizon: int = 3,
    carry: Sequence[str] = (),
    birth: str | None = None,
    clamp: bool = False,
) -> DataFrame:
    """The next ``horizon`` monthly rows after each series' last row."""
    when = months_later(roles.ts, F.col("horizon"), clamp)
    out = last.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("future_date", when)
    columns = [*roles.keys, "horizon", "future_date", month_index("future_date").alias("month")]
    if birth is not None:
        columns.append(age_months(birth, "future_date").alias("age_months"))
    return out.select(*columns, *[c for c in carry if c not in roles.keys])


def lag_pairs(df: DataFrame, roles: Roles) -> DataFrame:
    """(previous value, value) for consecutive rows of each series."""
    slim = df.select(*dict.fromkeys([*roles.keys, *roles.order, roles.value]))
    laid = blocks(slim, roles.keys, roles.order, 1, 0, hot_keys(slim, roles.keys))
    w = laid.window()
    out = laid.home(
        laid.df.withColumns({"previous": F.lag(roles.value).over(w), "_nth": F.lag(F.lit(1)).over(w)})
    ).where("_nth IS NOT NULL")
    return out.select(*roles.keys, *roles.order, "previous", F.col(roles.value).alias("current"))


def lag_limits(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.least(F.min("previous"), F.min("current")).alias("low"),
        F.greatest(F.max("previous"), F.max("current")).alias("high"),
    )


def sample_pairs(pairs: DataFrame, roles: Roles, n: int = 5000, seed: int = 42) -> DataFrame:
    """``n`` pairs in hash order of their row id."""
    place = unit_hash(seed, F.concat_ws(":", *[F.col(c).cast("string") for c in roles.tie]))
    return pairs.withColumn("_u", place).orderBy("_u", *roles.tie).limit(n).drop("_u")


def timeline(actuals: DataFrame, forecasts: DataFrame, roles: Roles, importance: DataFrame | None = None) -> DataFrame:
    """Long chart rows: each actual, the forecast lines, and their anchor at the last actual.

    ``forecasts`` holds series, horizon, q10, q50, q90; ``importance`` optionally series,
    ``position`` counted back from the newest row (1 = newest) and ``share``.
    """
    keys = roles.keys
    step = F.col(roles.ts).cast("string")
    real = actuals.select(*keys, F.lit("actual").alias("line"), step.alias("label"), F.col(roles.value).cast("double").alias("y"))
    names = ["q10", "q50", "q90"]
    newest = last_n(actuals.select(*dict.fromkeys([*keys, *roles.order, roles.value])), roles, 1)
    anchor = newest.select(
        *keys, F.explode(F.array(*[F.lit(q) for q in names])).alias("line"), step.alias("label"),
        F.col(roles.value).cast("double").alias("y"),
    )
    lines = F.array(*[F.struct(F.lit(q).alias("line"), F.col(q).cast("double").alias("y")) for q in names])
    ahead = forecasts.select(*keys, F.concat(F.lit("M+"), "horizon").alias("label"), F.inline(lines)).select(
        *keys, "line", "label", "y"
    )
    out = real.unionByName(anchor).unionByName(ahead)
    if importance is None:
        return out
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in roles.order])
    reach = importance.agg(F.max("position")).first()[0] or 0
    recent = last_n(actuals, roles, reach).withColumn("position", F.row_number().over(newest_first))
    bars = lookup_join(recent, importance, [*[k for k in keys if k in importance.columns], "position"]).select(
        *keys, F.lit("importance").alias("line"), step.alias("label"), (F.col("share") * 100).alias("y")
    )
    return out.unionByName(bars)
