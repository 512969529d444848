"""Keeping one over-full key from becoming one over-full task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.session import block_rows, broadcast_rows, held


def hot_keys(df: DataFrame, keys: list[str], *extra: Column, limit: int | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows and their count ``_n``; ``None`` when there are none.

    The count combines on the map side, so the hot key itself is never gathered.
    At most (rows / limit) keys can qualify, which bounds what callers broadcast.
    """
    return hot_of(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *extra), limit)


def hot_of(counts: DataFrame, limit: int | None = None) -> DataFrame | None:
    """The hot keys of a table that already holds one count ``_n`` per key."""
    hot = held(counts.where(F.col("_n") > (limit or block_rows(counts.sparkSession))))
    if hot.count() == 0:
        hot.unpersist()
        return None
    return hot


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the left side's keys are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def split_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the ordinary keys and rows of the hot ones."""
    if not keys:
        return df.where(F.lit(False)), df
    listed = F.broadcast(hot.select(*keys))
    return null_safe_join(df, listed, keys, "left_anti"), null_safe_join(df, listed, keys, "left_semi")


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None
) -> DataFrame:
    """Equi-join whose big side may have hot keys; ``sizes`` are its counts ``_n`` per key, if at hand.

    A hot key's rows are spread over ceil(n / limit) salts by the map task they come
    from (stable when a task is run again) and the small side is repeated per salt.
    """
    limit = block_rows(big.sparkSession)
    hot = hot_keys(big, keys) if sizes is None else hot_of(sizes)
    if hot is None:
        return big.join(small, keys, how)
    salts = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")))
    width = F.coalesce(F.col("_salts"), F.lit(1))
    spread = (
        null_safe_join(big, salts, keys, "left")
        .withColumn("_salt", F.pmod(F.spark_partition_id(), width))
        .drop("_salts")
    )
    copied = (
        null_safe_join(small, salts, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), width - 1)))
        .drop("_salts")
    )
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", at_most: int | None = None
) -> DataFrame:
    """Join a table that is usually tiny: broadcast after counting it, salted shuffle otherwise.

    ``at_most`` is a proven bound on the small table's rows; within the limit it saves the count.
    """
    limit = broadcast_rows(big.sparkSession)
    if at_most is not None and at_most <= limit:
        return big.join(F.broadcast(small), keys, how)
    small = held(small)
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    small.unpersist()
    return salted_join(big, small, keys, how)
