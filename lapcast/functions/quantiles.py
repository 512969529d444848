"""Exact, linearly interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapcast.functions.columns import missing_if_nan
from lapcast.plans.ordered import arrange
from lapcast.plans.skew import hot_keys, null_safe_join, split_hot
from lapcast.session import block_rows, materialise, written

_BINS = 1024
#: A sketched order statistic is off by at most 1 / accuracy of the group's rows; brackets reach twice as far.
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, by: Sequence[str], columns: Sequence[str] | str, probs: Sequence[float], at_most: int | None = None
) -> DataFrame:
    """One row per group; for each column an array of its quantiles. Nulls and NaN are ignored.

    ``at_most`` is a proven bound on the rows of any group; if it is small the groups are not counted.

    An ordinary group uses the built-in ``percentile``. That aggregate gathers all distinct
    values of a group in one buffer, so over-full groups take two scans instead: rank sketches
    that bracket each order statistic, then exact counts below and within the brackets.
    """
    by = list(by)
    columns = [columns] if isinstance(columns, str) else list(columns)
    clean = df.select(*by, *[missing_if_nan(c).alias(c) for c in columns])
    asked = F.array(*[F.lit(float(p)) for p in probs])
    proven = at_most is not None and at_most <= block_rows(df.sparkSession)
    hot = None if proven else hot_keys(clean, by)
    light, heavy = (clean, None) if hot is None else split_hot(clean, hot, by)
    out = light.groupBy(*by).agg(*[F.percentile(c, asked).alias(c) for c in columns])
    if heavy is None:
        return out
    found = None
    for c in columns:
        one = _two_scans(heavy.select(*by, F.col(c).alias("_v")).where("_v IS NOT NULL"), by, probs, c)
        if found is None:
            found = one
        else:
            found = null_safe_join(found.withColumn("_one", F.lit(1)), one.withColumn("_one", F.lit(1)), [*by, "_one"]).drop("_one")
    return out.unionByName(found) if by else found


def _two_scans(values: DataFrame, by: list[str], probs: Sequence[float], name: str) -> DataFrame:
    """Exact order statistics of over-full groups from two scans of their values.

    The first merges a rank sketch of every task (``percentile_approx``, whose rank error is proven) and asks it two error
    bounds below and above each wanted rank. The second counts, map-side combined, the values below each bracket and every
    different value within, about 4 / accuracy of the rows; only those are sorted. A bracket that misses its rank, which the
    bound excludes, is noticed by its counts and searched for by narrowing.
    """
    # A struct key also matches groups whose key is null.
    values = written(values.select(F.struct(*by, F.lit(0).alias("_all")).alias("_g"), "_v"), "values")
    reach = 2 / ACCURACY
    low = F.array(*[F.lit(max(float(p) - reach, 0.0)) for p in probs])
    high = F.array(*[F.lit(min(float(p) + reach, 1.0)) for p in probs])
    sketch = values.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", low, ACCURACY).alias("_low"), F.percentile_approx("_v", high, ACCURACY).alias("_high"),
    )
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_rank"),
            (F.col("_min") if p <= reach else F.get("_low", F.lit(i))).alias("_lo"),
            (F.col("_max") if p >= 1 - reach else F.get("_high", F.lit(i))).alias("_hi"),
        )
        for i, p in enumerate(probs)
    ])
    brackets = written(sketch.select("_g", F.inline(wanted)), "brackets")
    # Hot groups times probabilities: bounded by the hot-key bound.
    met = values.join(F.broadcast(brackets), "_g").where("_v <= _hi")
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counted = written(met.groupBy("_g", "_i", "_rank", inside.alias("_in")).agg(F.count(F.lit(1)).alias("_c")), "counted")
    placed = arrange(counted, ["_g", "_i"], ["_in"]).running("_upto", "sum", F.col("_c")).finish()
    at = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_in")))
    found = placed.groupBy("_g", "_i", "_rank").agg(at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b"))
    share = F.col("_rank") - F.floor("_rank")
    solved = found.select("_g", "_i", F.when(share == 0, F.col("_a")).otherwise(F.col("_a") + share * (F.col("_b") - F.col("_a"))).alias("_q"))
    solved = written(solved, "solved")
    gathered = solved.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_s"), F.count_if(F.col("_q").isNull()).alias("_missed"))
    out = gathered.where("_missed = 0").select(*[F.col("_g")[k].alias(k) for k in by], F.col("_s._q").alias(name))
    missed = gathered.where("_missed > 0").select("_g")
    if missed.isEmpty():
        return out
    rest = values.join(F.broadcast(missed), "_g", "left_semi").select(*[F.col("_g")[k].alias(k) for k in by], "_v")
    return out.unionByName(_bracket_search(rest, by, probs, name))


def _bracket_search(values: DataFrame, by: list[str], probs: Sequence[float], name: str) -> DataFrame:
    """Narrow each wanted order statistic's value range by counting, until it holds one value.

    Every pass is one map-side combined histogram of at most 1024 bins per open bracket, so no
    pass moves the values themselves. Bin edges follow the smallest and largest value seen in
    the chosen bin; those two always fall in different bins, so a bracket strictly shrinks.
    """
    # A struct key also matches groups whose key is null.
    values = written(values.select(F.struct(*by, F.lit(0).alias("_all")).alias("_g"), "_v"), "values")
    keys = ["_g"]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    todo = (
        values.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_w", F.explode(wanted))
        .select(
            *keys,
            F.col("_w.i").alias("_i"),
            (F.col("_w.p") * (F.col("_n") - 1)).alias("_rank"),
            F.lit(0).cast("long").alias("_below"),
            "_lo",
            "_hi",
        )
    )
    todo = materialise(todo)
    solved = None
    while True:
        done = todo.where("_lo = _hi").select(*keys, "_i", F.col("_lo").alias("_q"))
        solved = done if solved is None else solved.unionByName(done)
        todo = todo.where("_lo < _hi")
        if todo.isEmpty():
            break
        # Hot groups times probabilities: bounded by the hot-key bound.
        bracket = F.broadcast(todo)
        position = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        bins = (
            values.join(bracket, keys)
            .where("_v BETWEEN _lo AND _hi")
            .withColumn("_bin", F.least(F.floor(position * _BINS), F.lit(_BINS - 1)))
            .groupBy(*keys, "_i", "_rank", "_below", "_bin")
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        )
        order = Window.partitionBy(*keys, "_i").orderBy("_bin")
        seen = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
        lower = F.floor("_rank")
        hit = (
            bins.withColumn("_upto", F.col("_below") + seen)
            .withColumn("_next", F.lead("_lo").over(order))
            .where((lower >= F.col("_upto") - F.col("_c")) & (lower < F.col("_upto")))
        )
        hit = materialise(hit)
        # The two neighbours of a fractional rank lie in different bins: both are known now.
        straddles = (F.ceil("_rank") >= F.col("_upto")) & F.col("_next").isNotNull()
        share = F.col("_rank") - lower
        crossed = hit.where(straddles).select(
            *keys, "_i", (F.col("_hi") + share * (F.col("_next") - F.col("_hi"))).alias("_q")
        )
        solved = solved.unionByName(crossed)
        todo = hit.where(~straddles).select(
            *keys, "_i", "_rank", (F.col("_upto") - F.col("_c")).alias("_below"), "_lo", "_hi"
        )
    gathered = solved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_s"))
    return gathered.select(*[F.col("_g")[k].alias(k) for k in by], F.col("_s._q").alias(name))
