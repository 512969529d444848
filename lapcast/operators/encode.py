"""Dictionaries and scalers, kept as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapcast.plans.ordered import ranked
from lapcast.plans.skew import lookup_join
from lapcast.schema import MONTH_NAMES


def fit_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct values numbered from 0, in the column's own order."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return ranked(values, [], ["value"], "_r").select("value", (F.col("_r") - 1).cast("int").alias("code"))


def fit_dictionaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code) for several columns in one pass; values as text, codes in each column's own order."""
    items = []
    for c in columns:
        kind = df.schema[c].dataType
        whole = F.col(c).cast("decimal(38,0)") if isinstance(kind, T.IntegralType) else F.lit(None).cast("decimal(38,0)")
        real = F.col(c).cast("double") if isinstance(kind, T.FractionalType) else F.lit(None).cast("double")
        items.append(F.struct(F.lit(c).alias("column"), whole.alias("_whole"), real.alias("_real"), F.col(c).cast("string").alias("value")))
    values = df.select(F.inline(F.array(*items))).where("value IS NOT NULL").distinct().persist()
    coded = ranked(values, ["column"], ["_whole", "_real", "value"], "_r")
    return coded.select("column", "value", (F.col("_r") - 1).cast("int").alias("code"))


def dictionary_of(dictionaries: DataFrame, column: str, kind: str = "string") -> DataFrame:
    """One column's dictionary out of a joint table."""
    return dictionaries.where(F.col("column") == column).select(F.col("value").cast(kind).alias("value"), "code")


def encode(
    df: DataFrame, column: str, dictionary: DataFrame, into: str, unseen: str = "error", at_most: int | None = None
) -> DataFrame:
    """Add the code of each value; ``unseen`` values raise, stay null, or share the next free code.

    ``at_most`` is a proven bound on the dictionary's length, if one is known.
    """
    named = dictionary.select(F.col("value").alias(column), F.col("code").alias(into))
    out = lookup_join(df, named, [column], "left", at_most)
    if unseen == "error":
        failed = F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.col(column).cast("string"))).cast("int")
        return out.withColumn(into, F.when(F.col(into).isNull(), failed).otherwise(F.col(into)))
    if unseen == "other":
        spare = dictionary.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
        return out.withColumn(into, F.coalesce(into, F.lit(spare)))
    if unseen != "null":
        raise ValueError(f"unknown policy {unseen!r}")
    return out


def fit_scaler(df: DataFrame, *columns: str) -> DataFrame:
    """(column, mean, std) with population standard deviation, all columns in one pass."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in columns])
    return stats.select(F.inline(rows))


def _constants(state: DataFrame, column: str) -> tuple[float, float]:
    row = state.where(F.col("column") == column).first()
    if row is None:
        raise ValueError(f"no scaler for {column}")
    return row["mean"], row["std"] or 1.0


def scale(df: DataFrame, state: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Standardise with a stored scaler; a constant column is only centred."""
    mean, std = _constants(state, column)
    return df.withColumn(into or column, (F.col(column) - F.lit(mean)) / F.lit(std))


def unscale(df: DataFrame, state: DataFrame, column: str, *targets: str) -> DataFrame:
    """Undo ``scale`` on ``column`` itself or on ``targets`` measured in its unit."""
    mean, std = _constants(state, column)
    return df.withColumns({t: F.col(t) * F.lit(std) + F.lit(mean) for t in (targets or (column,))})


def choices(dictionaries: DataFrame, month_column: str | None = None) -> DataFrame:
    """(column, choices): the valid values of each encoded column in code order."""
    per_column = dictionaries.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("code", "value"))), lambda s: s["value"]).alias("choices")
    )
    if month_column is None:
        return per_column
    months = per_column.sparkSession.range(1).select(
        F.lit(month_column).alias("column"), F.array(*[F.lit(m) for m in MONTH_NAMES]).alias("choices")
    )
    return per_column.unionByName(months)
