"""Column profiles, frequencies and distribution summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.functions.columns import missing_if_nan
from lapcast.functions.quantiles import exact_quantiles
from lapcast.plans.ordered import arrange, ranked


def _stacked(wide: DataFrame, columns: Sequence[str], fields: Sequence[str], label: str) -> DataFrame:
    rows = F.array(
        *[F.struct(F.lit(c).alias(label), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns]
    )
    return wide.select(F.inline(rows))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: type, non-null count, mean, sample std, min, quartiles, max."""
    types = dict(df.dtypes)
    aggs = []
    for c in columns:
        x = missing_if_nan(c)
        aggs += [
            F.lit(types[c]).alias(f"{c}__type"),
            F.count(x).alias(f"{c}__count"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
        ]
    moments = _stacked(df.agg(*aggs), columns, ["type", "count", "mean", "std", "min", "max"], "column")
    quartiles = exact_quantiles(df, [], columns, [0.25, 0.5, 0.75])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in columns])
    return moments.join(F.broadcast(quartiles.select(F.inline(rows))), "column").select(
        "column", "type", "count", "mean", "std", "min",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def binned_counts(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str], open_end: bool = False) -> DataFrame:
    """Rows per left-closed bin, in bin order with empty bins kept.

    ``open_end`` replaces the last edge by everything above the one before.
    """
    x = F.col(column)
    bin_of = F.lit(None).cast("int")
    for i in reversed(range(len(labels))):
        below = F.lit(True) if open_end and i == len(labels) - 1 else x < edges[i + 1]
        bin_of = F.when((x >= edges[i]) & below, F.lit(i)).otherwise(bin_of)
    counted = df.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    names = F.array(*[F.lit(s) for s in labels])
    every = df.sparkSession.range(len(labels)).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin", names[F.col("bin")].alias("label"), F.coalesce("_c", F.lit(0)).alias("count")
    )


def histogram(df: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width histogram between min and max; the last bin includes its right edge."""
    x = missing_if_nan(column)
    low, high, total = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not total:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, height double")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.where(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    height = F.coalesce("_c", F.lit(0)).cast("double") / (F.lit(total * width) if density else F.lit(1.0))
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("left"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("right"),
        height.alias("height"),
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Share of rows with a value at most each distinct value."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    total = F.lit(sizes.agg(F.sum("_c")).first()[0])
    summed = arrange(sizes, [], [column]).running("_upto", "sum", F.col("_c")).finish()
    return summed.select(column, (F.col("_upto") / total).alias("share"))


def series_summary(lengths: dict[str, DataFrame], column: str = "n") -> DataFrame:
    """Number, mean and median length of the series of each named table of lengths."""
    parts = []
    for name, table in lengths.items():
        totals = table.agg(F.count(column).alias("series"), F.avg(column).alias("mean_length")).withColumn("kind", F.lit(name))
        median = exact_quantiles(table, [], column, [0.5]).select(F.lit(name).alias("kind"), F.col(column)[0].alias("median_length"))
        parts.append(totals.join(F.broadcast(median), "kind"))
    return reduce(DataFrame.unionByName, parts)


def compare_distributions(df: DataFrame, columns: dict[str, str], digits: int = 4) -> DataFrame:
    """One row per named column: mean, median, population std, min, max, P10, P90."""
    aggs = []
    for label, c in columns.items():
        aggs += [
            F.avg(c).alias(f"{label}__mean"),
            F.stddev_pop(c).alias(f"{label}__std"),
            F.min(c).alias(f"{label}__min"),
            F.max(c).alias(f"{label}__max"),
        ]
    moments = _stacked(df.agg(*aggs), list(columns), ["mean", "std", "min", "max"], "series")
    named = df.select(*[F.col(c).alias(label) for label, c in columns.items()])
    q = exact_quantiles(named, [], list(columns), [0.5, 0.1, 0.9])
    rows = F.array(*[F.struct(F.lit(label).alias("series"), F.col(label).alias("q")) for label in columns])
    joined = moments.join(F.broadcast(q.select(F.inline(rows))), "series")
    shown = {
        "mean": F.col("mean"), "median": F.col("q")[0], "std": F.col("std"), "min": F.col("min"),
        "max": F.col("max"), "p10": F.col("q")[1], "p90": F.col("q")[2],
    }
    return joined.select("series", *[F.round(e, digits).alias(k) for k, e in shown.items()])


#: Terms of the expansion of the kernel about a cell's middle, width of a cell and reach of the kernel in bandwidths.
_TERMS, _CELL, _REACH = 18, 1.0, 8.5
#: Most that a value's kernel is off by: 1.09 times the sum of 0.5^k / sqrt(k!) from the first term left out, and what lies beyond the reach.
KERNEL_ERROR = 1e-13


def kde(df: DataFrame, column: str, points: int = 400, between: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian kernel density at equally spaced points, Scott bandwidth; the same sums whatever the number of values.

    Values are counted into cells one bandwidth wide by their powers about the cell's middle, from which Hermite functions give
    the kernel sums at any point (a fast Gauss transform). A value's kernel is off by at most :data:`KERNEL_ERROR` of its peak. One
    row of sums leaves a task for each cell it saw; a cell meets only the points within its kernel's reach.
    """
    x = missing_if_nan(column)
    n, std, low, high = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    if n < 2 or not std:
        raise ValueError(f"{column} needs at least two different values")
    start, stop = between or (low, high)
    bandwidth = std * n ** (-1 / 5)
    step = (stop - start) / (points - 1)
    width, unit = _CELL * bandwidth, bandwidth * 2**0.5
    middle = lambda c: F.lit(low) + (c + 0.5) * F.lit(width)
    places = df.where(x.isNotNull()).select(x.alias("_x"), F.floor((x - F.lit(low)) / F.lit(width)).alias("_cell"))
    places = places.select("_cell", ((F.col("_x") - middle(F.col("_cell"))) / F.lit(unit)).alias("_s"))
    powers = [F.sum(F.pow("_s", F.lit(float(k)))) / F.lit(float(math.factorial(k))) for k in range(_TERMS)]
    cells = places.groupBy("_cell").agg(F.array(*powers).alias("_m")).withColumn("_c", middle(F.col("_cell")))
    reach = (_REACH + _CELL / 2) * bandwidth
    first = F.greatest(F.ceil((F.col("_c") - F.lit(reach + start)) / F.lit(step)), F.lit(0))
    last = F.least(F.floor((F.col("_c") + F.lit(reach - start)) / F.lit(step)), F.lit(points - 1))
    met = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.lit(start) + F.col("point") * F.lit(step)
    met = met.select("point", "_m", ((at - F.col("_c")) / F.lit(unit)).alias("_u"))
    # Hermite functions by their recurrence: the sum so far, the function of this order and the one before.
    zero, begin = F.lit(0.0), F.exp(-F.col("_u") * F.col("_u"))
    state = lambda total, now, before, k: F.struct(total.alias("t"), now.alias("h"), before.alias("b"), k.alias("k"))
    sums = F.aggregate(
        "_m", state(zero, begin, zero, zero),
        lambda s, m: state(s["t"] + m * s["h"], 2 * F.col("_u") * s["h"] - 2 * s["k"] * s["b"], s["h"], s["k"] + 1),
        lambda s: s["t"],
    )
    every = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"), zero.alias("_k"))
    scale_by = F.lit(n * bandwidth * (2 * math.pi) ** 0.5)
    return (
        met.select("point", sums.alias("_k")).unionByName(every).groupBy("point")
        .agg((F.sum("_k") / scale_by).alias("density"))
        .select("point", at.alias("x"), "density")
    )


def box_stats(df: DataFrame, columns: dict[str, str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the furthest value within ``reach`` IQR of the box, outlier count."""
    named = df.select(*[F.col(c).alias(label) for label, c in columns.items()])
    quartiles = exact_quantiles(named, [], list(columns), [0.25, 0.5, 0.75]).first()
    aggs = []
    for label in columns:
        q1, q2, q3 = quartiles[label]
        x = F.col(label)
        inlier = x.between(q1 - reach * (q3 - q1), q3 + reach * (q3 - q1))
        aggs += [
            F.lit(q1).alias(f"{label}__q1"),
            F.lit(q2).alias(f"{label}__median"),
            F.lit(q3).alias(f"{label}__q3"),
            # A whisker never ends inside the box.
            F.least(F.min(F.when(inlier, x)), F.lit(q1)).alias(f"{label}__low"),
            F.greatest(F.max(F.when(inlier, x)), F.lit(q3)).alias(f"{label}__high"),
            F.count_if(~inlier).alias(f"{label}__outliers"),
        ]
    return _stacked(named.agg(*aggs), list(columns), ["q1", "median", "q3", "low", "high", "outliers"], "series")


def latest(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The ``n`` last rows in the given order, latest first."""
    return df.orderBy(*[F.col(c).desc() if isinstance(c, str) else c.desc() for c in order]).limit(n)


def earliest(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def by_importance(df: DataFrame, share: str = "share", label: str = "feature") -> DataFrame:
    """Rank of each feature, most important first."""
    return ranked(df.withColumn("_neg", -F.col(share)), [], ["_neg", label], "rank").drop("_neg").orderBy("rank")


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """How many different values each column has (one small aggregate per column)."""
    parts = [
        df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("distinct")).select(F.lit(c).alias("column"), "distinct")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def append(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
