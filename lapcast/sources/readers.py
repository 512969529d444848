"""Reading histories and scoring requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapcast.functions.columns import age_months, month_index
from lapcast.plans.skew import salted_join
from lapcast.schema import IMPORTED_RACE, RAW_PERFORMANCES, REQUEST_BODY

BAD_ROW = "_bad_row"


def read_performances(spark: SparkSession, path: str, schema: T.StructType = RAW_PERFORMANCES) -> DataFrame:
    """Typed CSV scan by header name; unparsable rows stay, with their text in ``_bad_row``."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in schema.fields}
    ordered = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    return (
        spark.read.schema(ordered.add(BAD_ROW, T.StringType()))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_ROW)
        .csv(path)
        .select(*[f.name for f in schema.fields], BAD_ROW)
    )


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """Exported histories: each file is one JSON array of races."""
    return spark.read.schema(IMPORTED_RACE).option("multiLine", True).json(path)


def import_history(races: DataFrame, profiles: DataFrame, key: str = "nageur_id") -> DataFrame:
    """Add sex, age in months and month index to imported races of the profiled athletes."""
    joined = salted_join(races, profiles.select(key, "nageur_sexe", "nageur_date_naissance"), [key])
    return joined.select(
        key,
        F.col("nage").alias("perf_nage"),
        "nageur_sexe",
        F.col("distance").cast("int").alias("perf_distance"),
        F.col("bassin").cast("int").alias("perf_bassin"),
        month_index("date").alias("mois_saison"),
        age_months("nageur_date_naissance", "date").alias("nageur_age_mois"),
        F.col("temps").cast("double").alias("perf_temps_sec"),
        "date",
    )


def read_requests(df: DataFrame, horizon: int = 3, body: str | None = None) -> DataFrame:
    """Scoring requests with a ``reason`` that is null for valid ones.

    ``body`` names a JSON text column; without it the two array columns must exist already.
    """
    if body is not None:
        df = df.withColumn("_b", F.from_json(body, REQUEST_BODY)).select(
            *[c for c in df.columns if c != body], "_b.past_sequence", "_b.future_sequence"
        )
    future, past = F.col("future_sequence"), F.col("past_sequence")
    reason = (
        F.when(past.isNull() | future.isNull(), F.lit("unreadable"))
        .when(F.size(future) != horizon, F.lit(f"future must have {horizon} rows"))
        .when(F.size(past) < 1, F.lit("past is empty"))
    )
    return df.withColumn("reason", reason)
