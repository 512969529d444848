"""Sources, projections, filters, joins, dictionaries, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapcast.catalog.registry import (
    BY_TYPE, EVENTS, ITEMS, ORDERS, PERFORMANCES, performances, query, shown, table, unit_sql,
)
from lapcast.functions import columns as C
from lapcast.operators import encode as enc
from lapcast.operators import filters as flt
from lapcast.operators import sampling as smp
from lapcast.operators.profile import append, distinct_counts, earliest, latest
from lapcast.operators.windows import latest_window
from lapcast.plans.cleaning import Thresholds, clean_performances
from lapcast.plans.skew import salted_join
from lapcast.session import fresh_path, written
from lapcast.sources import readers, writers

# ---- sources and sinks --------------------------------------------------------------------------


@query(
    "s1_typed_csv_scan",
    f"""WITH {PERFORMANCES}
    SELECT perf_id, round(CAST(perf_temps AS DOUBLE), 4) + 0.0 AS perf_temps, perf_distance, perf_bassin, nageur_id,
           nageur_sexe, nageur_age_mois, mois_saison, perf_nage, perf_date FROM perf""",
)
def typed_csv_scan(spark, sf_dir):
    path = fresh_path(spark, "csv")
    performances(spark, sf_dir).write.option("header", True).csv(path)
    return readers.read_performances(spark, path).select(
        "perf_id", shown("perf_temps", 4).alias("perf_temps"), "perf_distance", "perf_bassin", "nageur_id",
        "nageur_sexe", "nageur_age_mois", "mois_saison", "perf_nage", "perf_date",
    )


@query(
    "s2_cleaned_scan",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events WHERE value > 10 GROUP BY event_type",
)
def cleaned_scan(spark, sf_dir):
    rows = readers.read_cleaned(spark, f"{sf_dir}/events.parquet").where("value > 10")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), shown(F.sum("value"), 4).alias("total"))


@query(
    "s3_history_import",
    """WITH p AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
                    DATE '1990-01-31' + CAST(c_custkey AS INT) AS birth FROM customer)
    SELECT o_custkey AS nageur_id, o_orderpriority AS perf_nage, p.sex AS nageur_sexe,
           CAST(o_orderkey % 3 * 50 + 50 AS INT) AS perf_distance, 50 AS perf_bassin,
           CAST(month(o_orderdate) - 1 AS INT) AS mois_saison,
           CAST(greatest((year(o_orderdate) - year(birth)) * 12 + month(o_orderdate) - month(birth), 0) AS INT) AS nageur_age_mois,
           round(o_totalprice, 2) + 0.0 AS perf_temps_sec, CAST(o_orderdate AS DATE) AS date
    FROM orders JOIN p ON o_custkey = c_custkey""",
)
def history_import(spark, sf_dir):
    races = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("nageur_id"), F.col("o_orderpriority").alias("nage"),
        (F.col("o_orderkey") % 3 * 50 + 50).alias("distance"), F.lit(50).alias("bassin"),
        shown("o_totalprice", 2).alias("temps"), F.to_date("o_orderdate").alias("date"),
    )
    profiles = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("nageur_id"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("nageur_sexe"),
        F.date_add(F.lit("1990-01-31").cast("date"), F.col("c_custkey").cast("int")).alias("nageur_date_naissance"),
    )
    return readers.import_history(races, profiles)


@query(
    "s4_scoring_requests",
    """WITH last20 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT user_id AS request_id,
           CASE WHEN user_id % 11 = 0 THEN 'unreadable' WHEN user_id % 5 <> 3 THEN 'future must have 3 rows'
                WHEN user_id % 7 = 0 THEN 'past is empty' END AS reason,
           CAST(CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 0 ELSE count(*) END AS INT) AS n_past,
           round(CASE WHEN user_id % 11 = 0 OR user_id % 7 = 0 THEN 0 ELSE sum(value) END, 4) + 0.0 AS total
    FROM last20 WHERE r <= 20 GROUP BY user_id""",
)
def scoring_requests(spark, sf_dir):
    history = latest_window(table(spark, sf_dir, "events"), EVENTS, ["event_type", "value"], 20)
    u = F.col("user_id")
    past = F.transform(
        F.slice("past", 21 - F.col("n_rows"), 20),
        lambda r: F.struct(r["event_type"].alias("perf_nage"), r["value"].alias("perf_temps_sec")),
    )
    ahead = F.transform(F.sequence(F.lit(1), (u % 5).cast("int")), lambda i: F.struct(i.alias("mois_saison")))
    body = F.to_json(
        F.struct(
            F.when(u % 7 == 0, F.array().cast("array<struct<perf_nage:string,perf_temps_sec:double>>")).otherwise(past).alias("past_sequence"),
            F.when(u % 5 > 0, ahead).otherwise(F.array().cast("array<struct<mois_saison:int>>")).alias("future_sequence"),
        )
    )
    bodies = history.select(u.alias("request_id"), F.when(u % 11 == 0, F.lit("{")).otherwise(body).alias("body"))
    checked = readers.read_requests(bodies, 3, "body")
    values = F.coalesce(F.transform("past_sequence", lambda r: r["perf_temps_sec"]), F.array().cast("array<double>"))
    return checked.select(
        "request_id", "reason",
        F.when(F.col("past_sequence").isNotNull(), F.size("past_sequence")).alias("n_past"),
        shown(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 4).alias("total"),
    )


_LIMITS = Thresholds(min_age_months=48, min_entity_rows=10, min_category_rows=100, min_series_rows=5)

CLEANED = f"""{PERFORMANCES},
f1 AS (SELECT * FROM perf WHERE perf_temps IS NOT NULL AND nageur_age_mois > 48),
f3 AS (SELECT * FROM f1 WHERE nageur_id IN (SELECT nageur_id FROM f1 GROUP BY 1 HAVING count(*) >= 10)),
f4 AS (SELECT * FROM f3 WHERE perf_nage IN (SELECT perf_nage FROM f3 GROUP BY 1 HAVING count(*) >= 100)),
enc AS (
  SELECT *,
         CAST(dense_rank() OVER (ORDER BY perf_nage) - 1 AS INT) AS perf_nage_encoded,
         CAST(dense_rank() OVER (ORDER BY nageur_sexe) - 1 AS INT) AS nageur_sexe_encoded,
         CAST(dense_rank() OVER (ORDER BY perf_distance) - 1 AS INT) AS perf_distance_encoded,
         CAST(dense_rank() OVER (ORDER BY perf_bassin) - 1 AS INT) AS perf_bassin_encoded,
         (nageur_age_mois - avg(nageur_age_mois) OVER ()) / stddev_pop(nageur_age_mois) OVER () AS age_scaled,
         CAST(trunc(CAST(perf_temps AS DOUBLE)) AS INT) AS minutes
  FROM f4),
ser AS (
  SELECT *, concat_ws('_', nageur_id, perf_nage_encoded, perf_distance_encoded, perf_bassin_encoded) AS series_id FROM enc),
gap AS (
  SELECT *, count(*) OVER (PARTITION BY series_id) AS n,
         coalesce(perf_date - lag(perf_date) OVER (PARTITION BY series_id ORDER BY perf_date, perf_id), 0) AS days
  FROM ser),
cleaned AS (
  SELECT perf_id, perf_date, nageur_id, perf_nage_encoded, nageur_sexe_encoded, perf_distance_encoded, perf_bassin_encoded,
         round(age_scaled, 6) + 0.0 AS nageur_age_mois_scaled,
         round(sin(2 * pi() * mois_saison / 12), 6) + 0.0 AS mois_saison_sin,
         round(cos(2 * pi() * mois_saison / 12), 6) + 0.0 AS mois_saison_cos,
         round(minutes * 60 + (CAST(perf_temps AS DOUBLE) - minutes) * 100, 4) + 0.0 AS perf_temps_sec,
         series_id, round(ln(1 + days), 6) + 0.0 AS days_since_last_log
  FROM gap WHERE n >= 5)
"""


def cleaned(spark, sf_dir):
    # The raw table is a stored file in practice; here it is derived from the events first.
    made = clean_performances(written(performances(spark, sf_dir), "raw"), _LIMITS)
    return made, made.table.select(
        *[c for c in made.table.columns if dict(made.table.dtypes)[c] != "double"],
        *[shown(c, 4 if c == "perf_temps_sec" else 6).alias(c) for c, t in made.table.dtypes if t == "double"],
    )


@query("s5_cleaning_pipeline_written", f"WITH {CLEANED} SELECT * FROM cleaned")
def cleaning_pipeline_written(spark, sf_dir):
    path = fresh_path(spark, "cleaned")
    writers.write_cleaned(cleaned(spark, sf_dir)[1], path)
    return readers.read_cleaned(spark, path)


@query(
    "s6_split_tables",
    f"""SELECT event_id, user_id, value,
        CASE WHEN {unit_sql(42, 'user_id')} < 0.8 THEN 'train' WHEN {unit_sql(42, 'user_id')} < 0.9 THEN 'val' ELSE 'test' END AS split
        FROM events""",
)
def split_tables(spark, sf_dir):
    path = fresh_path(spark, "splits")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    writers.write_splits(smp.split_entities(rows, "user_id", {"train": 0.8, "val": 0.1, "test": 0.1}), path)
    return spark.read.parquet(path).select("event_id", "user_id", "value", F.col("split").cast("string").alias("split"))


@query(
    "s7_feature_state",
    """WITH v AS (
      SELECT DISTINCT 'event_type' AS col, event_type AS value, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events
      UNION ALL SELECT DISTINCT 'user_id', CAST(user_id AS VARCHAR), dense_rank() OVER (ORDER BY user_id) - 1 FROM events)
    SELECT col AS "column", value, CAST(code AS INT) AS code, NULL::DOUBLE AS mean, NULL::DOUBLE AS std FROM v
    UNION ALL SELECT 'value', NULL, NULL, round(avg(value), 6) + 0.0, round(stddev_pop(value), 6) + 0.0 FROM events""",
)
def feature_state(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), fresh_path(spark, "state")
    writers.save_feature_state(enc.fit_dictionaries(events, ["event_type", "user_id"]), enc.fit_scaler(events, "value"), path)
    dictionaries, scalers = writers.load_feature_state(spark, path)
    none = F.lit(None)
    return dictionaries.select("column", "value", "code", none.cast("double").alias("mean"), none.cast("double").alias("std")).unionByName(
        scalers.select("column", none.cast("string").alias("value"), none.cast("int").alias("code"), shown("mean").alias("mean"), shown("std").alias("std"))
    )


@query(
    "s8_written_once",
    f"SELECT event_id, user_id, value FROM events WHERE {unit_sql(7, 'user_id')} < 0.2",
)
def written_once(spark, sf_dir):
    path = fresh_path(spark, "sample")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    writers.written_once(smp.sample_entities(rows, "user_id", seed=7, fraction=0.2), path)
    # A later run with another seed reads the sample that is there.
    return writers.written_once(smp.sample_entities(rows, "user_id", seed=8, fraction=0.2), path)


# ---- projections --------------------------------------------------------------------------------


@query("p1_drop_columns", "SELECT event_id, user_id, value FROM events")
def drop_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").drop("ts", "event_type", "props")


@query(
    "p2_race_clock",
    f"""WITH {PERFORMANCES}
    SELECT perf_id, round(trunc(CAST(perf_temps AS DOUBLE)) * 60 + (CAST(perf_temps AS DOUBLE) - trunc(CAST(perf_temps AS DOUBLE))) * 100, 4) + 0.0 AS seconds
    FROM perf""",
)
def race_clock(spark, sf_dir):
    return performances(spark, sf_dir).select("perf_id", shown(C.clock_to_seconds("perf_temps"), 4).alias("seconds"))


@query(
    "p3_cyclic_month",
    """SELECT o_orderkey, round(sin(2 * pi() * (month(o_orderdate) - 1) / 12), 6) + 0.0 AS month_sin,
        round(cos(2 * pi() * (month(o_orderdate) - 1) / 12), 6) + 0.0 AS month_cos FROM orders""",
)
def cyclic_month(spark, sf_dir):
    sine, cosine = C.cyclic(C.month_index("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown(sine).alias("month_sin"), shown(cosine).alias("month_cos"))


@query(
    "p4_series_key",
    "SELECT concat_ws('_', l_partkey, l_returnflag) AS series, count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag",
)
def series_key(spark, sf_dir):
    sizes = flt.group_sizes(table(spark, sf_dir, "lineitem"), ITEMS.keys)
    return sizes.select(C.series_key(*ITEMS.keys).alias("series"), "n")


@query(
    "p5_age_months",
    """SELECT o_orderkey, CAST(greatest((year(o_orderdate) - year(b)) * 12 + month(o_orderdate) - month(b), 0) AS INT) AS age
    FROM (SELECT *, DATE '1990-01-31' + CAST(o_custkey AS INT) * 3 AS b FROM orders)""",
)
def age_months(spark, sf_dir):
    birth = F.date_add(F.lit("1990-01-31").cast("date"), F.col("o_custkey").cast("int") * 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.age_months(birth, F.col("o_orderdate")).alias("age"))


@query(
    "p6_log_gap",
    """SELECT o_orderkey, round(ln(1 + coalesce(date_sub('day', lag(o_orderdate) OVER w, o_orderdate), 0)), 6) + 0.0 AS log_gap
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def log_gap(spark, sf_dir):
    from lapcast.operators.windows import with_gap

    gapped = with_gap(table(spark, sf_dir, "orders"), ORDERS)
    return gapped.select("o_orderkey", shown(F.log1p("days_since_last")).alias("log_gap"))


@query("p7_month_index", "SELECT o_orderkey, CAST(month(o_orderdate) - 1 AS INT) AS month_index FROM orders")
def month_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.month_index("o_orderdate").alias("month_index"))


@query("p8_integer_codes", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS quantity FROM lineitem")
def integer_codes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))


@query(
    "p9_scale_and_back",
    """SELECT event_id, round((value - m) / s, 6) + 0.0 AS scaled, round(value, 6) + 0.0 AS back
    FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""",
)
def scale_and_back(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = enc.fit_scaler(events, "value")
    scaled = enc.scale(events, state, "value", "scaled").withColumn("back", F.col("scaled"))
    return enc.unscale(scaled, state, "value", "back").select("event_id", shown("scaled").alias("scaled"), shown("back").alias("back"))


# ---- filters ------------------------------------------------------------------------------------


@query("f1_complete_rows", f"WITH {PERFORMANCES} SELECT perf_id, nageur_id FROM perf WHERE perf_temps IS NOT NULL")
def complete_rows(spark, sf_dir):
    return flt.drop_incomplete(performances(spark, sf_dir)).select("perf_id", "nageur_id")


def _age_rules():
    return {"positive_age": F.col("nageur_age_mois") > 0, "over_four_years": F.col("nageur_age_mois") > 48}


@query("f2_plausible_ages", f"WITH {PERFORMANCES} SELECT perf_id, nageur_age_mois FROM perf WHERE nageur_age_mois > 48")
def plausible_ages(spark, sf_dir):
    return flt.with_rules(performances(spark, sf_dir), _age_rules()).select("perf_id", "nageur_age_mois")


@query(
    "f2_rule_drops",
    f"""WITH {PERFORMANCES} SELECT count(*) AS rows_in, count(*) FILTER (WHERE nageur_age_mois <= 0) AS positive_age,
        count(*) FILTER (WHERE nageur_age_mois BETWEEN 1 AND 48) AS over_four_years,
        count(*) FILTER (WHERE nageur_age_mois > 48) AS rows_out FROM perf""",
)
def rule_drops(spark, sf_dir):
    return flt.rule_drops(performances(spark, sf_dir), _age_rules())


@query(
    "f3_frequent_entities",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 10)",
)
def frequent_entities(spark, sf_dir):
    return flt.min_group_size(table(spark, sf_dir, "orders"), ["o_custkey"], 10).select("o_orderkey", "o_custkey")


@query(
    "f4_frequent_categories",
    """SELECT event_id, event_type FROM events
    WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM events) / 5)""",
)
def frequent_categories(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    least = -(-events.count() // 5)
    return flt.min_category_count(events, "event_type", least).select("event_id", "event_type")


@query(
    "f5_long_series",
    """SELECT event_id FROM events WHERE (user_id, event_type) IN
    (SELECT (user_id, event_type) FROM events GROUP BY user_id, event_type HAVING count(*) >= 10)""",
)
def long_series(spark, sf_dir):
    return flt.min_group_size(table(spark, sf_dir, "events"), BY_TYPE.keys, 10).select("event_id")


@query(
    "f6_trainable_series",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_returnflag) IN
    (SELECT (l_partkey, l_returnflag) FROM lineitem GROUP BY l_partkey, l_returnflag HAVING count(*) >= 10 + 3)""",
)
def trainable_series(spark, sf_dir):
    return flt.min_group_size(table(spark, sf_dir, "lineitem"), ITEMS.keys, 10 + 3).select("l_orderkey", "l_linenumber")


@query(
    "f7_trimmed_outliers",
    """SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM events)
    WHERE value > lo AND value < hi""",
)
def trimmed_outliers(spark, sf_dir):
    return flt.trim_quantiles(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query("f8_one_discipline", "SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'")
def one_discipline(spark, sf_dir):
    rows = flt.discipline(table(spark, sf_dir, "events"), {"event_type": "purchase"}, "ts", "event_id")
    return rows.select("event_id", "user_id", "ts", "value")


# ---- joins --------------------------------------------------------------------------------------


@query("j1_rows_with_counts", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def rows_with_counts(spark, sf_dir):
    return flt.with_group_size(table(spark, sf_dir, "orders"), ["o_custkey"]).select("o_orderkey", "n")


@query(
    "j2_members",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def members(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return flt.keep_members(table(spark, sf_dir, "orders"), chosen, ["o_custkey"]).select("o_orderkey")


@query(
    "j3_complement",
    "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def complement(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return flt.drop_members(table(spark, sf_dir, "orders"), chosen, ["o_custkey"]).select("o_orderkey")


@query(
    "j4_dictionary_lookup",
    """WITH d AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'))
    SELECT o_orderkey, CAST(coalesce(code, 4) AS INT) AS code FROM orders LEFT JOIN d USING (o_orderpriority)""",
)
def dictionary_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    known = enc.fit_dictionary(orders.where("o_orderpriority <> '5-LOW'"), "o_orderpriority")
    return enc.encode(orders, "o_orderpriority", known, "code", unseen="other").select("o_orderkey", "code")


# ---- dictionaries and scalers -------------------------------------------------------------------


@query(
    "a8_dictionaries",
    """SELECT 'perf_distance' AS "column", CAST(v AS VARCHAR) AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code
    FROM (SELECT DISTINCT CAST(l_quantity AS INT) AS v FROM lineitem)
    UNION ALL SELECT 'flag', v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)""",
)
def dictionaries(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("perf_distance"), F.col("l_returnflag").alias("flag"))
    return enc.fit_dictionaries(items, ["perf_distance", "flag"])


@query(
    "a9_scaler_on_train",
    f"""SELECT 'value' AS "column", round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std
    FROM events WHERE {unit_sql(42, 'user_id')} < 0.8""",
)
def scaler_on_train(spark, sf_dir):
    labelled = smp.split_entities(table(spark, sf_dir, "events"), "user_id", {"train": 0.8, "val": 0.1, "test": 0.1})
    state = enc.fit_scaler(labelled.where("split = 'train'"), "value")
    return state.select("column", shown("mean").alias("mean"), shown("std").alias("std"))


@query(
    "a10_choices",
    """SELECT 'event_type' AS "column", string_agg(v, '|' ORDER BY v) AS choices FROM (SELECT DISTINCT event_type AS v FROM events)
    UNION ALL SELECT 'month', 'Janvier|Février|Mars|Avril|Mai|Juin|Juillet|Août|Septembre|Octobre|Novembre|Décembre'""",
)
def choices(spark, sf_dir):
    made = enc.choices(enc.fit_dictionaries(table(spark, sf_dir, "events"), ["event_type"]), "month")
    return made.select("column", F.array_join("choices", "|").alias("choices"))


# ---- sampling -----------------------------------------------------------------------------------


@query(
    "x1_entity_sample",
    f"""SELECT event_id, user_id FROM events WHERE user_id IN
    (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY {unit_sql(42, 'user_id')}, user_id LIMIT 40)""",
)
def entity_sample(spark, sf_dir):
    return smp.sample_entities(table(spark, sf_dir, "events"), "user_id", n=40).select("event_id", "user_id")


@query("x1_entity_fraction", f"SELECT event_id, user_id FROM events WHERE {unit_sql(42, 'user_id')} < 0.2")
def entity_fraction(spark, sf_dir):
    return smp.sample_entities(table(spark, sf_dir, "events"), "user_id", fraction=0.2).select("event_id", "user_id")


@query(
    "x2_exact_split",
    f"""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY {unit_sql(42, 'user_id')}, user_id) - 1 AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT user_id FROM events))
    SELECT event_id, CASE WHEN r < floor(0.8 * n) THEN 'train' WHEN r < floor(0.9 * n) THEN 'val' ELSE 'test' END AS split
    FROM events JOIN u USING (user_id)""",
)
def exact_split(spark, sf_dir):
    ratios = {"train": 0.8, "val": 0.1, "test": 0.1}
    return smp.split_entities(table(spark, sf_dir, "events"), "user_id", ratios, exact=True).select("event_id", "split")


@query(
    "x2_two_step_split",
    f"""SELECT user_id, CASE WHEN {unit_sql(1, 'user_id')} >= 0.8 THEN 'test' WHEN {unit_sql(2, 'user_id')} < 0.9 THEN 'train' ELSE 'val' END AS split,
        count(*) AS n FROM events GROUP BY ALL""",
)
def two_step_split(spark, sf_dir):
    outer = smp.split_entities(table(spark, sf_dir, "events"), "user_id", {"train": 0.8, "test": 0.2}, seed=1)
    outer = outer.withColumnRenamed("split", "outer")
    inner = smp.split_entities(outer, "user_id", {"train": 0.9, "val": 0.1}, seed=2)
    split = F.when(F.col("outer") == "test", "test").otherwise(F.col("split"))
    return inner.groupBy("user_id", split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x3_stratified_entities",
    f"""WITH firsts AS (SELECT user_id, event_id % 3 AS stratum FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY user_id || '_' || event_type, ts, event_id) AS r FROM events) WHERE r = 1),
    strata AS (SELECT stratum, count(*) AS size FROM firsts GROUP BY stratum),
    target AS (SELECT greatest(floor(0.3 * sum(size)), least(10, sum(size))) AS n, sum(size) AS total FROM strata),
    shares AS (SELECT stratum, size * n / total AS exact, floor(size * n / total) AS low, n FROM strata, target),
    quotas AS (SELECT stratum, low + CASE WHEN row_number() OVER (ORDER BY round(low - exact, 9), stratum) <= n - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
    placed AS (SELECT user_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {unit_sql(42, 'user_id')}, user_id) AS r FROM firsts)
    SELECT user_id, stratum FROM placed JOIN quotas USING (stratum) WHERE r <= quota""",
)
def stratified_entities(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("third", F.col("event_id") % 3)
    return smp.stratified_entities(events, BY_TYPE, "third", fraction=0.3, at_least=10)


@query(
    "a11_first_category",
    """SELECT user_id, event_id % 3 AS stratum FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY user_id || '_' || event_type, ts, event_id) AS r FROM events) WHERE r = 1""",
)
def first_category(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("third", F.col("event_id") % 3)
    return smp.first_category(events, BY_TYPE, "third")


@query(
    "x4_row_sample",
    f"SELECT event_id FROM events WHERE {unit_sql(42, 'event_id')} < 0.1",
)
def row_sample(spark, sf_dir):
    return smp.sample_rows(table(spark, sf_dir, "events"), 0.1, key=["event_id"]).select("event_id")


@query("x4_row_sample_native")
def row_sample_native(spark, sf_dir):
    return smp.sample_rows(table(spark, sf_dir, "events"), 0.1).select("event_id")


@query(
    "x5_last_rows",
    """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r <= 5""",
)
def last_rows(spark, sf_dir):
    return smp.last_n(table(spark, sf_dir, "lineitem"), ITEMS, 5).select("l_orderkey", "l_linenumber")


# ---- order, distinct, append --------------------------------------------------------------------


@query(
    "o1_series_order",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders""",
)
def series_order(spark, sf_dir):
    from lapcast.plans.ordered import ranked

    return ranked(table(spark, sf_dir, "orders"), ORDERS.keys, ORDERS.order, "place").select("o_orderkey", "place")


@query(
    "o2_head_and_tail",
    """(SELECT 'first' AS side, event_id, ts FROM events ORDER BY ts, event_id LIMIT 5) UNION ALL
    (SELECT 'last', event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)""",
)
def head_and_tail(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    head = earliest(events, 5, "ts", "event_id").select(F.lit("first").alias("side"), "event_id", "ts")
    tail = latest(events, 5, "ts", "event_id").select(F.lit("last").alias("side"), "event_id", "ts")
    return append(head, tail)


@query(
    "o4_distinct_pairs",
    """SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events""",
)
def distinct_pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    coded = enc.encode(events, "event_type", enc.fit_dictionary(events, "event_type"), "code")
    return coded.select("event_type", F.col("code").cast("long").alias("code")).distinct()


@query(
    "o4_distinct_counts",
    """SELECT 'user_id' AS "column", count(DISTINCT user_id) AS "distinct" FROM events
    UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events UNION ALL SELECT 'value', count(DISTINCT value) FROM events""",
)
def distinct_value_counts(spark, sf_dir):
    return distinct_counts(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query(
    "o5_appended_history",
    """SELECT user_id, ts, value FROM events UNION ALL
    SELECT user_id, max(ts) + INTERVAL 1 DAY, arg_max(value, (ts, event_id)) FROM events GROUP BY user_id""",
)
def appended_history(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    entry = smp.last_n(events, EVENTS, 1).select("user_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), "value")
    return append(events.select("user_id", "ts", "value"), entry)
