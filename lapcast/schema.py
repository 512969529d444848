"""Declared schemas and the fixed values of the swimming preset."""

from __future__ import annotations

from pyspark.sql import types as T

from lapcast.roles import Roles

# The raw performance file's header, in file order.
RAW_PERFORMANCES = T.StructType(
    [
        T.StructField("perf_id", T.IntegerType()),
        T.StructField("perf_temps", T.FloatType()),
        T.StructField("perf_distance", T.ShortType()),
        T.StructField("perf_bassin", T.ByteType()),
        T.StructField("competition_ville", T.StringType()),
        T.StructField("competition_pays", T.StringType()),
        T.StructField("nageur_id", T.IntegerType()),
        T.StructField("nageur_sexe", T.StringType()),
        T.StructField("nageur_pays", T.StringType()),
        T.StructField("nageur_age_mois", T.ShortType()),
        T.StructField("mois_saison", T.ByteType()),
        T.StructField("perf_nage", T.StringType()),
        T.StructField("perf_date", T.DateType()),
        T.StructField("nageur_date_naissance", T.DateType()),
    ]
)

# One imported race as users export it.
IMPORTED_RACE = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("nage", T.StringType()),
        T.StructField("distance", T.IntegerType()),
        T.StructField("bassin", T.IntegerType()),
        T.StructField("temps", T.DoubleType()),
    ]
)

# Field names of a scoring request.
PAST_ROW = T.StructType(
    [
        T.StructField("perf_nage", T.StringType()),
        T.StructField("nageur_sexe", T.StringType()),
        T.StructField("nageur_age_mois", T.DoubleType()),
        T.StructField("perf_distance", T.IntegerType()),
        T.StructField("perf_bassin", T.IntegerType()),
        T.StructField("mois_saison", T.IntegerType()),
        T.StructField("perf_temps_sec", T.DoubleType()),
        T.StructField("days_since_last", T.DoubleType()),
    ]
)
FUTURE_ROW = T.StructType(
    [
        T.StructField("nageur_age_mois", T.DoubleType()),
        T.StructField("perf_distance", T.IntegerType()),
        T.StructField("perf_bassin", T.IntegerType()),
        T.StructField("mois_saison", T.IntegerType()),
    ]
)
REQUEST_BODY = T.StructType(
    [
        T.StructField("past_sequence", T.ArrayType(PAST_ROW)),
        T.StructField("future_sequence", T.ArrayType(FUTURE_ROW)),
    ]
)

# Month names offered as choices, January first.
MONTH_NAMES = [
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
]

# Column roles of the cleaned performance table.
PAST_COLUMNS = ["perf_temps_sec", "days_since_last_log", "perf_nage_encoded"]
FUTURE_COLUMNS = [
    "mois_saison_sin",
    "mois_saison_cos",
    "perf_distance_encoded",
    "perf_bassin_encoded",
    "nageur_age_mois_scaled",
]
STATIC_COLUMNS = ["nageur_sexe_encoded"]
QUANTILES = [0.1, 0.5, 0.9]

SWIM_ROLES = Roles(
    entity="nageur_id",
    series=("nageur_id", "perf_nage_encoded", "perf_distance_encoded", "perf_bassin_encoded"),
    ts="perf_date",
    tie=("perf_id",),
    value="perf_temps_sec",
)
