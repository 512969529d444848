"""Filters on rows, group sizes, categories and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.functions.quantiles import exact_quantiles
from lapcast.plans.skew import lookup_join, salted_join


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def with_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that pass every rule."""
    for rule in rules.values():
        df = df.where(rule)
    return df


def rule_drops(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows each rule removes when the rules are applied in order; one scan."""
    passed = F.lit(True)
    counts = []
    for name, rule in rules.items():
        holds = F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(passed & ~holds).alias(name))
        passed = passed & holds
    return df.agg(F.count(F.lit(1)).alias("rows_in"), *counts, F.count_if(passed).alias("rows_out"))


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Each row with its group's row count."""
    sizes = group_sizes(df, keys, "_n").persist()
    return salted_join(df, sizes.withColumnRenamed("_n", name), list(keys), sizes=sizes)


def min_group_size(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with at least ``n`` rows; the groups are counted once."""
    sizes = group_sizes(df, keys, "_n").persist()
    kept = sizes.where(F.col("_n") >= n).select(*keys)
    return salted_join(df, kept, list(keys), "left_semi", sizes)


def min_category_count(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose category occurs at least ``n`` times."""
    kept = group_sizes(df, [column]).where(F.col("n") >= n).select(column)
    return lookup_join(df, kept, [column], "left_semi")


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return salted_join(df, members.select(*keys).distinct(), list(keys), "left_semi")


def drop_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return salted_join(df, members.select(*keys).distinct(), list(keys), "left_anti")


def trim_quantiles(df: DataFrame, column: str, low: float = 0.001, high: float = 0.999, approximate: bool = False) -> DataFrame:
    """Rows strictly between two quantiles of the whole column."""
    if approximate:
        bounds = df.agg(F.percentile_approx(column, F.array(F.lit(low), F.lit(high)), 100_000).alias(column))
    else:
        bounds = exact_quantiles(df, [], column, [low, high])
    least, most = bounds.first()[column]
    return df.where((F.col(column) > least) & (F.col(column) < most))


def discipline(df: DataFrame, chosen: dict[str, object], ts: str, *tie: str) -> DataFrame:
    """One discipline's history in date order."""
    for column, value in chosen.items():
        df = df.where(F.col(column).cast("string") == str(value))
    return df.orderBy(ts, *tie)

