"""Named queries on the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapcast.roles import Roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(c: Column | str, digits: int = 6) -> Column:
    """A rounded double without negative zero, as the SQL twins show it."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x.cast("double"), digits) + F.lit(0.0)


EVENTS = Roles(entity="user_id", series=("user_id",), ts="ts", tie=("event_id",), value="value")
BY_TYPE = Roles(entity="user_id", series=("user_id", "event_type"), ts="ts", tie=("event_id",), value="value")
ORDERS = Roles(entity="o_custkey", series=("o_custkey",), ts="o_orderdate", tie=("o_orderkey",), value="o_totalprice")
ITEMS = Roles(
    entity="l_partkey",
    series=("l_partkey", "l_returnflag"),
    ts="l_shipdate",
    tie=("l_orderkey", "l_linenumber"),
    value="l_extendedprice",
)


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a raw performance row; some clock values are missing."""
    k = F.substring_index(F.substring_index("props", ": ", -1), "}", 1).cast("int")
    v, u = F.col("value"), F.col("user_id")
    minutes = F.floor(v / 60)
    clock = (minutes + (v - minutes * 60) / 100).cast("float")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("int").alias("perf_id"),
        F.when(k != 13, clock).alias("perf_temps"),
        F.get(F.array(F.lit(50), F.lit(100), F.lit(200), F.lit(1500)), k % 4).cast("short").alias("perf_distance"),
        F.when(F.floor(k / 4) % 2 == 0, F.lit(25)).otherwise(F.lit(50)).cast("byte").alias("perf_bassin"),
        F.concat(F.lit("V"), (k % 7).cast("string")).alias("competition_ville"),
        F.lit("FR").alias("competition_pays"),
        u.cast("int").alias("nageur_id"),
        F.when(u % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("nageur_sexe"),
        F.lit("FR").alias("nageur_pays"),
        (u * 7 % 200 - 5 + k % 60).cast("short").alias("nageur_age_mois"),
        (k % 12).cast("byte").alias("mois_saison"),
        F.col("event_type").alias("perf_nage"),
        F.to_date("ts").alias("perf_date"),
        F.date_sub(F.to_date("ts"), (u * 7 % 200 + k % 60).cast("int") * 30).alias("nageur_date_naissance"),
    )


PERFORMANCES = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
perf AS (
  SELECT CAST(event_id AS INT) AS perf_id,
         CASE WHEN k <> 13 THEN CAST(floor(value / 60) + (value - floor(value / 60) * 60) / 100 AS FLOAT) END AS perf_temps,
         CAST(CASE k % 4 WHEN 0 THEN 50 WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE 1500 END AS SMALLINT) AS perf_distance,
         CAST(CASE WHEN (k // 4) % 2 = 0 THEN 25 ELSE 50 END AS TINYINT) AS perf_bassin,
         'V' || (k % 7) AS competition_ville,
         CAST(user_id AS INT) AS nageur_id,
         CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS nageur_sexe,
         CAST(user_id * 7 % 200 - 5 + k % 60 AS SMALLINT) AS nageur_age_mois,
         CAST(k % 12 AS TINYINT) AS mois_saison,
         event_type AS perf_nage,
         CAST(ts AS DATE) AS perf_date,
         CAST(ts AS DATE) - CAST((user_id * 7 % 200 + k % 60) * 30 AS INT) AS nageur_date_naissance
  FROM k)
"""


def unit_sql(seed: int, key: str) -> str:
    """The SQL form of the entity hash."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::UBIGINT / 4294967296.0)"
