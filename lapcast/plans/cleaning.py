"""Raw performances to the cleaned, encoded, series-ordered table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapcast.functions.columns import clock_to_seconds, cyclic, series_key
from lapcast.operators.encode import dictionary_of, encode, fit_dictionaries, fit_scaler, scale
from lapcast.operators.filters import drop_incomplete, min_category_count, min_group_size, with_rules
from lapcast.operators.windows import with_gap
from lapcast.schema import SWIM_ROLES
from lapcast.session import written

# Encoded columns of the performance table and the names of their codes.
ENCODED = {
    "perf_nage": "perf_nage_encoded",
    "nageur_sexe": "nageur_sexe_encoded",
    "perf_distance": "perf_distance_encoded",
    "perf_bassin": "perf_bassin_encoded",
}
UNUSED = ["competition_ville", "competition_pays", "nageur_date_naissance", "nageur_pays"]


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the swimming data; parameters for everything else."""

    min_age_months: int = 48
    min_entity_rows: int = 10
    min_category_rows: int = 100_000
    min_series_rows: int = 10


@dataclass
class Cleaned:
    table: DataFrame
    dictionaries: dict[str, DataFrame]
    scaler: DataFrame


def filter_performances(raw: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Complete, plausible rows of frequent athletes and frequent strokes.

    The rows of frequent athletes are written once: counting strokes, fitting and encoding
    then scan only the columns they need.
    """
    rows = drop_incomplete(raw.drop("_bad_row"))
    rows = with_rules(rows, {"positive age": F.col("nageur_age_mois") > 0, "old enough": F.col("nageur_age_mois") > limits.min_age_months})
    frequent = min_group_size(rows.drop(*UNUSED), ["nageur_id"], limits.min_entity_rows)
    return min_category_count(written(frequent, "frequent"), "perf_nage", limits.min_category_rows)


def clean_performances(raw: DataFrame, limits: Thresholds = Thresholds(), fit_on: DataFrame | None = None) -> Cleaned:
    """The whole preparation. Dictionaries and the age scaler are fitted on ``fit_on`` (default: all kept rows)."""
    rows = filter_performances(raw, limits)
    basis = rows if fit_on is None else fit_on
    joint = fit_dictionaries(basis, list(ENCODED)).persist()
    entries = joint.count()
    dictionaries = {c: dictionary_of(joint, c, basis.schema[c].dataType.simpleString()) for c in ENCODED}
    scaler = fit_scaler(basis, "nageur_age_mois").persist()
    for column, code in ENCODED.items():
        rows = encode(rows, column, dictionaries[column], code, at_most=entries)
    rows = scale(rows, scaler, "nageur_age_mois", "nageur_age_mois_scaled")
    sine, cosine = cyclic("mois_saison")
    rows = rows.select(
        "perf_id", "perf_date", "nageur_id", *ENCODED.values(), "nageur_age_mois_scaled",
        sine.alias("mois_saison_sin"), cosine.alias("mois_saison_cos"),
        clock_to_seconds("perf_temps").alias("perf_temps_sec"),
    )
    gapped = with_gap(rows, SWIM_ROLES, min_rows=limits.min_series_rows)
    table = gapped.select(
        *[c for c in rows.columns],
        series_key(*SWIM_ROLES.keys).alias("series_id"),
        F.log1p("days_since_last").alias("days_since_last_log"),
    )
    return Cleaned(table, dictionaries, scaler)
