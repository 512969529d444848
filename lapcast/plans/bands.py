"""Whole forecasting pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapcast.functions.columns import cyclic
from lapcast.operators.encode import encode, scale
from lapcast.operators.evaluate import evaluate
from lapcast.operators.forecast import add_changes, by_horizon, change_quantiles, finish_quantiles
from lapcast.operators.windows import padded, windows
from lapcast.roles import Roles
from lapcast.session import written


def empirical_bands(df: DataFrame, roles: Roles, length: int = 20, horizon: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Windows, change quantiles fitted on all of them, forecasts without crossing.

    Fitting and scoring both need only each window's last value and targets. That narrow table
    is written once, so the series are shuffled and framed a single time.
    """
    made = windows(df, roles, [roles.value], length=length, horizon=horizon, carry=list(by))
    keep = list(dict.fromkeys([*roles.keys, "origin_ts", *by]))
    steps = written(by_horizon(made, keep, F.element_at("past", -1)[roles.value]), "steps")
    # A row of the written table is one (window, horizon): its count bounds every group.
    model = change_quantiles(steps, by, at_most=steps.count())
    return finish_quantiles(add_changes(steps, model, by))


def band_report(df: DataFrame, roles: Roles, length: int = 20, horizon: int = 3) -> DataFrame:
    """Metrics of the empirical bands per horizon."""
    return evaluate(empirical_bands(df, roles, length, horizon), ["horizon"])


def request_windows(
    requests: DataFrame,
    dictionaries: dict[str, DataFrame],
    scalers: DataFrame,
    key: str = "request_id",
    length: int = 20,
    unseen: str = "error",
) -> DataFrame:
    """Valid scoring requests as model windows: padded past, encoded and scaled past, future and static.

    Rows are exploded, encoded by the shared dictionaries and put back per request (at most
    ``length`` + horizon rows each).
    """
    valid = requests.where("reason IS NULL").withColumn("past_sequence", padded(F.col("past_sequence"), length))
    past = valid.select(key, F.posexplode("past_sequence").alias("i", "r")).select(key, "i", "r.*")
    past = scale(past, scalers, "perf_temps_sec")
    past = encode(past, "perf_nage", dictionaries["perf_nage"], "perf_nage_encoded", unseen)
    past = encode(past, "nageur_sexe", dictionaries["nageur_sexe"], "nageur_sexe_encoded", unseen)
    past = past.withColumn("days_since_last_log", F.log1p("days_since_last"))
    future = valid.select(key, F.posexplode("future_sequence").alias("i", "r")).select(key, "i", "r.*")
    future = encode(future, "perf_distance", dictionaries["perf_distance"], "perf_distance_encoded", unseen)
    future = encode(future, "perf_bassin", dictionaries["perf_bassin"], "perf_bassin_encoded", unseen)
    future = scale(future, scalers, "nageur_age_mois", "nageur_age_mois_scaled")
    sine, cosine = cyclic("mois_saison")
    future = future.withColumns({"mois_saison_sin": sine, "mois_saison_cos": cosine})

    def regrouped(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        item = F.struct("i", F.struct(*columns).alias("v"))
        return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias(name))

    from lapcast.schema import FUTURE_COLUMNS, PAST_COLUMNS

    packed_past = regrouped(past, [*PAST_COLUMNS, "nageur_sexe_encoded"], "past")
    return (
        packed_past.join(regrouped(future, FUTURE_COLUMNS, "future"), key)
        .withColumn("static", F.struct(F.col("past")[0]["nageur_sexe_encoded"].alias("nageur_sexe_encoded")))
    )
