"""Order-dependent work on keys of any size.

An ordinary key is one window partition. A key that holds more rows than one task
should is range-partitioned on (key, order) instead; running values are then a local
window plus what earlier parts carry over, and fixed-width frames are computed in
blocks that borrow a few rows from their neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lapcast.plans.skew import hot_keys, null_safe_join, split_hot
from lapcast.session import block_rows, written

_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _range_parts(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Globally sorted parts; ``_part`` grows with (keys, order), ``_row`` within a part."""
    sorted_parts = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # Range bounds are sampled anew on every evaluation, so the numbering is stored, not recomputed.
    return written(
        sorted_parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()),
        "parts",
    )


@dataclass
class Arranged:
    """A table whose running values may be taken in ``order`` within ``keys``."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    parted: bool

    def running(self, name: str, how: str, value: Column, before: bool = False) -> Arranged:
        """Add the sum/min/max of ``value`` up to each row (up to the row before, if ``before``)."""
        fold = _FOLDS[how]
        end = -1 if before else Window.currentRow
        by = [*self.keys, "_part"] if self.parted else self.keys
        local = Window.partitionBy(*by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, end)
        if not self.parted:
            return Arranged(self.df.withColumn(name, fold(value).over(local)), self.keys, self.order, False)
        earlier = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            self.df.groupBy(*by)
            .agg(fold(value).alias("_total"))
            .withColumn("_carry", fold("_total").over(earlier))
            .drop("_total")
        )
        held = null_safe_join(self.df.withColumn("_local", fold(value).over(local)), carried, by)
        if how == "sum":
            either = F.coalesce(F.col("_carry") + F.col("_local"), F.col("_carry"), F.col("_local"))
        else:
            either = (F.least if how == "min" else F.greatest)("_carry", "_local")
        return Arranged(held.withColumn(name, either).drop("_carry", "_local"), self.keys, self.order, True)

    def finish(self) -> DataFrame:
        return self.df.drop("_part", "_row") if self.parted else self.df


def arrange(df: DataFrame, keys: list[str], order: list[str], counted: bool = False, hot: DataFrame | None = None) -> Arranged:
    """Lay a table out for running values; ``counted`` says that ``hot`` is the result of :func:`hot_keys`."""
    hot = hot if counted else hot_keys(df, keys)
    if hot is None:
        return Arranged(df, keys, order, False)
    light, heavy = split_hot(df, hot, keys)
    light = light.withColumn("_part", F.lit(-1)).withColumn("_row", F.lit(-1).cast("long"))
    return Arranged(light.unionByName(_range_parts(heavy, keys, order)), keys, order, True)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1-based row number within ``keys``."""
    return arrange(df, keys, order).running(name, "sum", F.lit(1).cast("long")).finish()


@dataclass
class Blocks:
    """A table on which frames of ``back`` rows behind and ``ahead`` rows in front are exact."""

    df: DataFrame
    part: list[str]
    order: list[str]
    split: bool

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def home(self, df: DataFrame) -> DataFrame:
        """Drop the borrowed rows once all frames are computed."""
        return df.where("_home").drop("_home", "_block", "_place") if self.split else df


def blocks(df: DataFrame, keys: list[str], order: list[str], back: int, ahead: int, hot: DataFrame | None) -> Blocks:
    """Lay ``df`` out for fixed-width frames; ``hot`` is the result of :func:`hot_keys`.

    A hot key is cut into runs of equal length by its exact row positions; the last
    ``back`` rows of a run are copied to the next one, the first ``ahead`` to the one before.
    """
    if hot is None:
        return Blocks(df, keys, order, False)
    size = max(block_rows(df.sparkSession), back + ahead + 1)
    light, heavy = split_hot(df, hot, keys)
    light = light.select(
        "*", F.lit(0).cast("long").alias("_place"), F.lit(0).cast("long").alias("_block"), F.lit(True).alias("_home")
    )
    parts = _range_parts(heavy, keys, order)
    # One row per part plus one per hot key: bounded, so it is broadcast.
    counts = parts.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    placed = null_safe_join(parts, F.broadcast(starts), [*keys, "_part"]).withColumn(
        "_place", F.col("_start") + F.col("_row") - F.col("_first")
    )
    number = F.floor(F.col("_place") / size)
    inside = F.col("_place") % size
    copies = F.array(
        F.struct(number.alias("b"), F.lit(True).alias("home")),
        F.when(inside >= size - back, F.struct((number + 1).alias("b"), F.lit(False).alias("home"))),
        F.when((inside < ahead) & (number > 0), F.struct((number - 1).alias("b"), F.lit(False).alias("home"))),
    )
    heavy = (
        placed.withColumn("_copy", F.explode(F.array_compact(copies)))
        .withColumn("_block", F.col("_copy.b"))
        .withColumn("_home", F.col("_copy.home"))
        .drop("_copy", "_part", "_row", "_first", "_start")
    )
    return Blocks(light.unionByName(heavy), [*keys, "_block"], [*order, "_place"], True)
