"""Serial dependence of all series at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapcast.operators.profile import histogram
from lapcast.plans.ordered import arrange, blocks
from lapcast.plans.skew import hot_keys, null_safe_join
from lapcast.roles import Roles
from lapcast.session import broadcast_rows


def lag_products(df: DataFrame, roles: Roles, max_lag: int = 10) -> DataFrame:
    """Per series its length ``n`` and ``products``: sums of x_t * x_(t+k), k = 0..max_lag, about the mean.

    One shuffle for ordinary series; the shared input of all statistics below.
    """
    keys = roles.keys
    slim = df.select(*dict.fromkeys([*keys, *roles.order]), F.col(roles.value).cast("double").alias("_x"))
    hot = hot_keys(slim, keys, F.avg("_x").alias("_mean"))
    laid = blocks(slim, keys, roles.order, 0, max_lag, hot)
    mean = F.avg("_x").over(Window.partitionBy(*laid.part))
    rows = laid.df
    if hot is not None:
        rows = null_safe_join(rows, F.broadcast(hot.select(*keys, "_mean")), keys, "left")
        mean = F.coalesce(F.col("_mean"), mean)
    rows = rows.withColumn("_d", F.col("_x") - mean)
    w = laid.window()
    rows = laid.home(rows.withColumns({f"_p{k}": F.col("_d") * F.lead("_d", k).over(w) for k in range(1, max_lag + 1)}))
    sums = [F.sum(F.col("_d") * F.col("_d"))] + [F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) for k in range(1, max_lag + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("products"))


def long_lag_products(df: DataFrame, roles: Roles, max_lag: int, block: int = 4096) -> DataFrame:
    """The table of :func:`lag_products` for hundreds or thousands of lags.

    Every series is numbered and cut into blocks of ``block`` rows (at least ``max_lag``) that borrow the next ``max_lag`` rows; a block's
    sums for all lags are one correlation by Fourier transform, so the cost per row grows with the logarithm of the block and
    not with the number of lags. Blocks are added up per series and lag. A task holds one block at a time, whatever the series' length.
    """
    keys, size = roles.keys, max(block, max_lag)
    slim = df.select(*keys, *[c for c in roles.order if c not in keys], F.col(roles.value).cast("double").alias("_x"))
    about = slim.groupBy(*keys).agg(F.avg("_x").alias("_mean"), F.count(F.lit(1)).alias("n")).persist()
    small = about.limit(broadcast_rows(df.sparkSession) + 1).count() <= broadcast_rows(df.sparkSession)
    centred = null_safe_join(slim, F.broadcast(about) if small else about, keys).withColumn("_d", F.coalesce(F.col("_x") - F.col("_mean"), F.lit(0.0)))
    placed = arrange(centred, keys, roles.order).running("_p", "sum", F.lit(1).cast("long")).finish().withColumn("_p", F.col("_p") - 1)
    number, inside = F.floor(F.col("_p") / size), F.col("_p") % size
    homes = F.array(number, F.when((inside < max_lag) & (number > 0), number - 1))
    dealt = placed.select(*keys, F.explode(F.array_compact(homes)).alias("_b"), "_p", "_d")
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def correlate(table: pa.Table) -> pa.Table:
        place, values = table.column("_p").to_numpy(), table.column("_d").to_numpy()
        values = values[np.argsort(place)]
        head = min(size, len(values)) if place.min() % size == 0 else 0
        length = 1 << int(np.ceil(np.log2(len(values) + max_lag + 1)))
        first = np.fft.rfft(values[:head], length)
        sums = np.fft.irfft(np.conj(first) * np.fft.rfft(values, length), length)[: max_lag + 1]
        named = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table({**named, "_s": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    sums = dealt.groupBy(*keys, "_b").applyInArrow(correlate, schema)
    lags = sums.select(*keys, F.posexplode("_s").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    each = lags.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_s"))
    joined = null_safe_join(each, about.select(*keys, "n"), keys)
    return joined.select(*keys, "n", F.col("_s._v").alias("products"))


def _allowed(max_lag: int) -> Column:
    return F.least(F.lit(max_lag), F.floor(F.col("n") / 2) - 1).cast("int")


def _long_enough(products: DataFrame, max_lag: int) -> DataFrame:
    return products.where((F.col("n") >= 5) & (_allowed(max_lag) >= 1))


def _ratio(k: Column) -> Column:
    variation = F.col("products")[0]
    return F.when(variation > 0, F.get("products", k) / variation)


def acf(products: DataFrame, roles: Roles, max_lag: int = 10) -> DataFrame:
    """(series, lag, acf) for lags 0..min(max_lag, n // 2 - 1), series of at least 5 rows.

    A constant series has no autocorrelation: its values are null.
    """
    lags = F.explode(F.sequence(F.lit(0), _allowed(max_lag)))
    return (
        _long_enough(products, max_lag)
        .select(*roles.keys, "products", lags.alias("lag"))
        .select(*roles.keys, "lag", _ratio(F.col("lag")).alias("acf"))
    )


def pacf(products: DataFrame, roles: Roles, max_lag: int = 10) -> DataFrame:
    """(series, lag, pacf) by the Levinson-Durbin recursion on autocovariances divided by n - k."""
    used = F.slice("products", F.lit(1), _allowed(max_lag) + 1)
    covariance = F.transform(used, lambda s, k: s / (F.col("n") - k))

    def step(state: Column, k: Column) -> Column:
        phi, sigma = state["phi"], state["sigma"]
        explained = F.aggregate(
            F.zip_with(phi, F.sequence(F.lit(1), F.size(phi)), lambda f, j: f * F.get("_g", k - j)),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        # A perfectly predictable series leaves no variance to explain: null from there on.
        last = F.try_divide(F.get("_g", k) - F.when(F.size(phi) > 0, explained).otherwise(F.lit(0.0)), sigma)
        updated = F.concat(F.zip_with(phi, F.reverse(phi), lambda f, r: f - last * r), F.array(last))
        return F.struct(
            updated.alias("phi"),
            (sigma * (1 - last * last)).alias("sigma"),
            F.concat(state["out"], F.array(last)).alias("out"),
        )

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.get("_g", F.lit(0)).alias("sigma"), F.array(F.lit(1.0)).alias("out"))
    solved = F.when(
        F.get("_g", F.lit(0)) > 0,
        F.aggregate(F.sequence(F.lit(1), F.col("_m")), start, step, lambda s: s["out"]),
    ).otherwise(F.array_repeat(F.lit(None).cast("double"), F.col("_m") + 1))
    return (
        _long_enough(products, max_lag)
        .select(*roles.keys, covariance.alias("_g"), _allowed(max_lag).alias("_m"))
        .select(*roles.keys, F.posexplode(solved).alias("lag", "pacf"))
    )


def across_series(table: DataFrame, value: str) -> DataFrame:
    """Mean and population std over series at each lag, missing values left out."""
    return table.groupBy("lag").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("series")
    )


def upper_gamma(a: float, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) of a column, ``a`` fixed: a series of the lower one below ``a + 1``,
    Lentz's continued fraction above. Null and NaN give null, x <= 0 gives 1. Relative error below 1e-12 for ``a`` up to 1,000."""
    terms = F.sequence(F.lit(1), F.lit(80 + int(12 * math.sqrt(a))))
    scale = F.exp(a * F.log(x) - x - F.lit(math.lgamma(a)))
    pair = lambda term, total: F.struct(term.alias("term"), total.alias("total"))
    first = F.lit(1.0 / a)

    def more(s: Column, k: Column) -> Column:
        term = s["term"] * x / (k + F.lit(float(a)))
        return pair(term, s["total"] + term)

    lower = scale * F.aggregate(terms, pair(first, first), more, lambda s: s["total"])
    state = lambda b, c, d, h: F.struct(b.alias("b"), c.alias("c"), d.alias("d"), h.alias("h"))

    def further(s: Column, k: Column) -> Column:
        an, b = k * (F.lit(float(a)) - k), s["b"] + 2.0
        d, c = F.try_divide(F.lit(1.0), an * s["d"] + b), b + F.try_divide(an, s["c"])
        return state(b, c, d, s["h"] * d * c)

    # Spark may evaluate a branch it doesn't take, so nothing in it may fail.
    begin = x + F.lit(1.0 - a)
    inverse = F.try_divide(F.lit(1.0), begin)
    upper = scale * F.aggregate(terms, state(begin, F.lit(1e300), inverse, inverse), further, lambda s: s["h"])
    return F.when(F.isnan(x) | x.isNull(), None).when(x <= 0, 1.0).when(x < a + 1, 1.0 - lower).otherwise(upper)


def chi_square_tail(q: Column, freedom: int) -> Column:
    """P(X > q) for a chi-square variable."""
    return upper_gamma(freedom / 2, q / 2)


def ljung_box(products: DataFrame, roles: Roles, lags: int = 5) -> DataFrame:
    """(series, n, q, p) of the test over ``lags`` lags, series of at least 2 * ``lags`` rows; null for constant series.

    ``products`` must hold at least as many lags.
    """
    n = F.col("n").cast("double")
    squares = [F.try_divide(_ratio(F.lit(k)) * _ratio(F.lit(k)), n - k) for k in range(1, lags + 1)]
    total = sum(squares[1:], squares[0])
    tested = products.where(F.col("n") >= 2 * lags).select(*roles.keys, "n", (n * (n + 2) * total).alias("q"))
    return tested.withColumn("p", chi_square_tail(F.col("q"), lags))


def significant_share(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    significant = F.count_if(F.col("p") < alpha)
    return tests.agg(
        F.count(F.lit(1)).alias("tested"),
        significant.alias("significant"),
        (significant / F.count(F.lit(1))).alias("share"),
    )


def p_value_histogram(tests: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(tests, "p", bins)
