"""Writing tables and feature state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapcast.sources import snapshots


def write_cleaned(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; partition only by low-cardinality columns, never by series."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_splits(labelled: DataFrame, path: str) -> None:
    """One table with a folder per split, values unscaled, so that any split is read alone."""
    labelled.write.mode("overwrite").partitionBy("split").parquet(path)


def save_feature_state(dictionaries: DataFrame, scalers: DataFrame, path: str) -> int:
    """Both tables under one commit; the version they got."""
    return snapshots.commit(dictionaries.sparkSession, path, {"dictionaries": dictionaries, "scalers": scalers})


def load_feature_state(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Dictionaries and scalers of the same commit, the newest unless a version is given."""
    version = version or snapshots.latest_version(spark, path)
    return snapshots.read(spark, path, "dictionaries", version), snapshots.read(spark, path, "scalers", version)


def written_once(df: DataFrame, path: str) -> DataFrame:
    """The table committed at ``path``, written from ``df`` only if none is; what a failed writer left doesn't count."""
    return snapshots.once(df, path)


def bad_row_count(df: DataFrame, column: str = "_bad_row") -> DataFrame:
    return df.agg(F.count(column).alias("bad_rows"), F.count(F.lit(1)).alias("rows"))
