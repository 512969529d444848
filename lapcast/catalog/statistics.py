"""Profiles, distributions and serial dependence."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lapcast.catalog.registry import BY_TYPE, EVENTS, ITEMS, ORDERS, query, shown, table
from lapcast.catalog.sequences import CHANGES
from lapcast.operators import dependence as dep
from lapcast.operators import filters as flt
from lapcast.operators import profile as prof
from lapcast.plans.bands import empirical_bands
from lapcast.roles import Roles
from lapcast.session import written

# Bins of rows per entity and of series lengths.
ENTITY_EDGES = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 1001]
ENTITY_LABELS = ["1", "2-4", "5-9", "10-19", "20-49", "50-99", "100-199", "200-499", "500-999", "1000+"]
LENGTH_EDGES = [0, 10, 20, 50, 100, 200, 500, 1000]
LENGTH_LABELS = ["<10", "10-20", "20-50", "50-100", "100-200", "200-500", "500+"]


def _profile_sql(relation: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count({c}) AS count, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS std,
        CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS q50,
        round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {relation}"""
        for c, t in columns.items()
    )


@query("a1_column_profile", _profile_sql("lineitem", {"l_quantity": "double", "l_discount": "double", "l_linenumber": "int"}))
def column_profile(spark, sf_dir):
    made = prof.profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])
    return made.select("column", "type", "count", *[shown(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("a2_value_counts", 'SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1')
def value_counts(spark, sf_dir):
    return prof.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("a3_group_sizes", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def group_sizes(spark, sf_dir):
    return flt.group_sizes(table(spark, sf_dir, "orders"), ["o_custkey"])


def _bins_sql(relation: str, edges: list, labels: list, open_end: bool) -> str:
    rows = ", ".join(
        f"({i}, '{s}', {edges[i]}, {10**18 if open_end and i == len(labels) - 1 else edges[i + 1]})" for i, s in enumerate(labels)
    )
    return f"""SELECT CAST(b AS INT) AS bin, label, count(n) AS "count" FROM (VALUES {rows}) AS v(b, label, lo, hi)
    LEFT JOIN ({relation}) ON n >= lo AND n < hi GROUP BY b, label"""


@query("a4_entity_size_bins", _bins_sql("SELECT count(*) AS n FROM orders GROUP BY o_custkey", ENTITY_EDGES, ENTITY_LABELS, True))
def entity_size_bins(spark, sf_dir):
    sizes = flt.group_sizes(table(spark, sf_dir, "orders"), ["o_custkey"])
    return prof.binned_counts(sizes, "n", ENTITY_EDGES, ENTITY_LABELS, open_end=True)


@query(
    "a4_series_length_bins",
    _bins_sql("SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag", LENGTH_EDGES, LENGTH_LABELS, False),
)
def series_length_bins(spark, sf_dir):
    sizes = flt.group_sizes(table(spark, sf_dir, "lineitem"), ITEMS.keys)
    return prof.binned_counts(sizes, "n", LENGTH_EDGES, LENGTH_LABELS)


def _hist_sql(relation: str, column: str, bins: int, density: bool) -> str:
    height = f"count(x) / (t * w)" if density else "CAST(count(x) AS DOUBLE)"
    return f"""WITH x AS ({relation}), s AS (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS w, count({column}) AS t FROM x),
    n AS (SELECT least(CAST(floor(({column} - lo) / w) AS INT), {bins - 1}) AS b, {column} AS x FROM x, s)
    SELECT CAST(i AS INT) AS bin, round(any_value(lo + i * w), 6) + 0.0 AS "left", round(any_value(lo + (i + 1) * w), 6) + 0.0 AS "right",
      round({height}, 8) + 0.0 AS height FROM range({bins}) AS r(i) CROSS JOIN s LEFT JOIN n ON b = i GROUP BY i, t, w"""


def _hist(made):
    return made.select("bin", shown("left").alias("left"), shown("right").alias("right"), shown("height", 8).alias("height"))


@query("a5_histogram_counts", _hist_sql("SELECT CAST(n AS DOUBLE) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)", "n", 50, False))
def histogram_counts(spark, sf_dir):
    return _hist(prof.histogram(flt.group_sizes(table(spark, sf_dir, "orders"), ["o_custkey"]), "n", 50))


@query("a5_histogram_density", _hist_sql("SELECT value FROM events", "value", 70, True))
def histogram_density(spark, sf_dir):
    return _hist(prof.histogram(table(spark, sf_dir, "events"), "value", 70, density=True))


@query(
    "a6_size_ecdf",
    """SELECT n, round(sum(c) OVER (ORDER BY n) / sum(c) OVER (), 9) + 0.0 AS share
    FROM (SELECT n, count(*) AS c FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n)""",
)
def size_ecdf(spark, sf_dir):
    made = prof.ecdf(flt.group_sizes(table(spark, sf_dir, "orders"), ["o_custkey"]), "n")
    return made.select("n", shown("share", 9).alias("share"))


@query(
    "a7_series_summary",
    """SELECT 'entity' AS kind, count(*) AS series, round(avg(n), 6) + 0.0 AS mean_length, round(quantile_cont(n, 0.5), 6) + 0.0 AS median_length
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)
    UNION ALL SELECT 'series', count(*), round(avg(n), 6) + 0.0, round(quantile_cont(n, 0.5), 6) + 0.0
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag)""",
)
def series_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    made = prof.series_summary({"entity": flt.group_sizes(items, ["l_partkey"]), "series": flt.group_sizes(items, ITEMS.keys)})
    return made.select("kind", "series", shown("mean_length").alias("mean_length"), shown("median_length").alias("median_length"))


BANDS = f"""{CHANGES}, bands AS (SELECT user_id, origin_ts, horizon, y, least(last + d10, last + d50) AS q10, last + d50 AS q50,
  greatest(last + d90, last + d50) AS q90 FROM steps JOIN model USING (horizon))"""


def first_step(spark, sf_dir):
    return empirical_bands(table(spark, sf_dir, "events"), EVENTS).where("horizon = 1")


def _moments(c: str, label: str) -> str:
    return f"""SELECT '{label}' AS series, round(avg({c}), 4) + 0.0 AS mean, round(quantile_cont({c}, 0.5), 4) + 0.0 AS median,
    round(stddev_pop({c}), 4) + 0.0 AS std, round(min({c}), 4) + 0.0 AS min, round(max({c}), 4) + 0.0 AS max,
    round(quantile_cont({c}, 0.1), 4) + 0.0 AS p10, round(quantile_cont({c}, 0.9), 4) + 0.0 AS p90 FROM bands WHERE horizon = 1"""


@query("a12_true_and_predicted", f"WITH {BANDS} {_moments('y', 'true')} UNION ALL {_moments('q50', 'predicted')}")
def true_and_predicted(spark, sf_dir):
    made = prof.compare_distributions(first_step(spark, sf_dir), {"true": "y", "predicted": "q50"})
    return made.select("series", *[(F.col(c) + F.lit(0.0)).alias(c) for c in made.columns[1:]])


@query(
    "a13_density_curves",
    f"""WITH {BANDS}, v AS (SELECT 'true' AS series, y FROM bands WHERE horizon = 1 UNION ALL SELECT 'predicted', q50 FROM bands WHERE horizon = 1),
    e AS (SELECT min(y) AS lo, max(y) AS hi FROM v),
    s AS (SELECT series, count(*) AS n, stddev_samp(y) * pow(count(*), -0.2) AS h FROM v GROUP BY series),
    m AS (SELECT series, y, count(*) AS c FROM v GROUP BY series, y)
    SELECT series, CAST(i AS INT) AS point, round(lo + i * ((hi - lo) / 399), 6) + 0.0 AS x,
      round(sum(c * exp(-0.5 * pow((lo + i * ((hi - lo) / 399) - y) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 9) + 0.0 AS density
    FROM range(400) AS r(i), e, s JOIN m USING (series) GROUP BY series, i, lo, hi""",
)
def density_curves(spark, sf_dir):
    rows = written(first_step(spark, sf_dir).select("y", "q50"), "density")
    low, high = rows.agg(F.least(F.min("y"), F.min("q50")), F.greatest(F.max("y"), F.max("q50"))).first()
    curves = [prof.kde(rows, c, 400, (low, high)).withColumn("series", F.lit(s)) for s, c in (("true", "y"), ("predicted", "q50"))]
    return prof.append(*curves).select("series", "point", shown("x").alias("x"), shown("density", 9).alias("density"))


@query(
    "a13_density_of_prices",
    """WITH s AS (SELECT count(*) AS n, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    m AS (SELECT l_extendedprice AS y, count(*) AS c FROM lineitem GROUP BY y)
    SELECT CAST(i AS INT) AS point, round(lo + i * ((hi - lo) / 99), 6) + 0.0 AS x,
      round(1e5 * sum(c * exp(-0.5 * pow((lo + i * ((hi - lo) / 99) - y) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 9) + 0.0 AS density
    FROM range(100) AS r(i), s, m GROUP BY i, lo, hi""",
)
def density_of_prices(spark, sf_dir):
    """Far more distinct values than points; density per 100,000 units of price."""
    made = prof.kde(table(spark, sf_dir, "lineitem"), "l_extendedprice", 100)
    return made.select("point", shown("x").alias("x"), shown(F.col("density") * 1e5, 9).alias("density"))


def _box(c: str, label: str) -> str:
    return f"""SELECT '{label}' AS series, round(q1, 6) + 0.0 AS q1, round(q2, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
    round(least(min({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), q1), 6) + 0.0 AS low,
    round(greatest(max({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), q3), 6) + 0.0 AS high,
    count(*) FILTER (WHERE NOT ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
    FROM (SELECT y, q50 FROM bands WHERE horizon = 1), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM bands WHERE horizon = 1)
    GROUP BY q1, q2, q3"""


@query("a14_box_summary", f"WITH {BANDS} {_box('y', 'true')} UNION ALL {_box('q50', 'predicted')}")
def box_summary(spark, sf_dir):
    made = prof.box_stats(first_step(spark, sf_dir), {"true": "y", "predicted": "q50"})
    return made.select("series", *[shown(c).alias(c) for c in ("q1", "median", "q3", "low", "high")], "outliers")


# ---- serial dependence --------------------------------------------------------------------------


def _acf_cte(max_lag: int = 10) -> str:
    leads = ", ".join(f"lead(d, {k}) OVER w AS d{k}" for k in range(1, max_lag + 1))
    sums = ", ".join(f"coalesce(sum(d * d{k}), 0) AS p{k}" for k in range(1, max_lag + 1))
    long = " UNION ALL ".join(
        f"SELECT user_id, event_type, n, {k} AS lag, CASE WHEN p0 > 0 THEN p{k} / p0 END AS r, p{k} AS p FROM prod" for k in range(max_lag + 1)
    )
    return f"""dev AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id, event_type) AS d FROM events),
    led AS (SELECT *, {leads} FROM dev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    prod AS (SELECT user_id, event_type, count(*) AS n, sum(d * d) AS p0, {sums} FROM led GROUP BY user_id, event_type),
    long AS ({long}),
    acf AS (SELECT user_id, event_type, CAST(lag AS INT) AS lag, r FROM long WHERE n >= 5 AND n // 2 - 1 >= 1 AND lag <= least({max_lag}, n // 2 - 1)),
    lb AS (SELECT user_id, event_type, n, n * (n + 2) * sum(r * r / (n - lag)) AS q FROM long WHERE n >= 10 AND lag BETWEEN 1 AND 5 GROUP BY user_id, event_type, n)"""


ACF = _acf_cte()

# erf(z) = 2 / sqrt(pi) * exp(-z^2) * sum of 2^k z^(2k+1) / (2k+1)!!; the tail then has a closed form.
P_VALUES = """tails AS (SELECT *, CASE WHEN q > 0 THEN 1 - 2 / sqrt(pi()) * exp(-q / 2) * list_sum(list_transform(range(200),
      lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(sqrt(q / 2)) - lgamma(2 * k + 2) + lgamma(k + 1)))) WHEN q = 0 THEN 1 END AS erfc FROM lb),
    ps AS (SELECT *, erfc + sqrt(2 * q / pi()) * exp(-q / 2) * (1 + q / 3) AS p FROM tails)"""


def _products(spark, sf_dir):
    return dep.lag_products(table(spark, sf_dir, "events"), BY_TYPE)


@query("t1_autocorrelation", f"WITH {ACF} SELECT user_id, event_type, lag, round(r, 6) + 0.0 AS acf FROM acf")
def autocorrelation(spark, sf_dir):
    made = dep.acf(_products(spark, sf_dir), BY_TYPE)
    return made.select("user_id", "event_type", "lag", shown("acf").alias("acf"))


_KIND = Roles("event_type", ("event_type",), "ts", ("event_id",), "value")


@query(
    "t1_long_autocorrelation",
    """WITH d AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, count(*) OVER (PARTITION BY event_type) AS n,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
    v AS (SELECT event_type, sum(d * d) AS v FROM d GROUP BY event_type),
    k AS (SELECT unnest(range(0, 501)) AS k)
    SELECT a.event_type, CAST(k AS INT) AS lag, round(sum(a.d * b.d) / any_value(v), 8) + 0.0 AS acf
    FROM d a JOIN k ON k <= n // 2 - 1 JOIN d b ON b.event_type = a.event_type AND b.p = a.p + k JOIN v ON v.event_type = a.event_type GROUP BY a.event_type, k""",
)
def long_autocorrelation(spark, sf_dir):
    """500 lags of few, long series."""
    products = dep.long_lag_products(table(spark, sf_dir, "events"), _KIND, 500)
    return dep.acf(products, _KIND, 500).select("event_type", "lag", shown("acf", 8).alias("acf"))


def _pacf_sql(max_lag: int = 10) -> str:
    """Levinson-Durbin unrolled: phi_k_j for every order k."""
    g = ", ".join(f"p{k} / (n - {k}) AS g{k}" for k in range(max_lag + 1))
    steps = [f"base AS (SELECT user_id, event_type, n, {g} FROM prod WHERE n >= 5 AND n // 2 - 1 >= 1 AND p0 > 0), s0 AS (SELECT *, g0 AS v0 FROM base)"]
    for k in range(1, max_lag + 1):
        known = "".join(f" - f{k - 1}_{j} * g{k - j}" for j in range(1, k))
        rest = "".join(f", f{k - 1}_{j} - a{k} * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k))
        steps.append(
            f"a{k} AS (SELECT *, (g{k}{known}) / v{k - 1} AS a{k} FROM s{k - 1}), "
            f"s{k} AS (SELECT *, a{k} AS f{k}_{k}{rest}, v{k - 1} * (1 - a{k} * a{k}) AS v{k} FROM a{k})"
        )
    out = " UNION ALL ".join(
        f"SELECT user_id, event_type, {k} AS lag, {'1.0' if k == 0 else f'a{k}'} AS x FROM s{max_lag} WHERE {k} <= least({max_lag}, n // 2 - 1)"
        for k in range(max_lag + 1)
    )
    return f"{', '.join(steps)}, pacf AS ({out})"


@query(
    "t2_partial_autocorrelation",
    f"WITH {ACF}, {_pacf_sql()} SELECT user_id, event_type, CAST(lag AS INT) AS lag, round(x, 5) + 0.0 AS pacf FROM pacf",
)
def partial_autocorrelation(spark, sf_dir):
    made = dep.pacf(_products(spark, sf_dir), BY_TYPE)
    return made.select("user_id", "event_type", "lag", shown("pacf", 5).alias("pacf"))


@query(
    "t3_mean_autocorrelation",
    f"WITH {ACF} SELECT lag, round(avg(r), 6) + 0.0 AS mean, round(stddev_pop(r), 6) + 0.0 AS std, count(r) AS series FROM acf GROUP BY lag",
)
def mean_autocorrelation(spark, sf_dir):
    made = dep.across_series(dep.acf(_products(spark, sf_dir), BY_TYPE), "acf")
    return made.select("lag", shown("mean").alias("mean"), shown("std").alias("std"), "series")


@query(
    "t4_ljung_box",
    f"""WITH {ACF}, {P_VALUES} SELECT user_id, event_type, n, round(q, 5) + 0.0 AS q, round(p, 8) + 0.0 AS p,
    q > 11.070497693516351 AS significant FROM ps""",
)
def ljung_box(spark, sf_dir):
    made = dep.ljung_box(_products(spark, sf_dir), BY_TYPE)
    return made.select("user_id", "event_type", "n", shown("q", 5).alias("q"), shown("p", 8).alias("p"), (F.col("p") < 0.05).alias("significant"))


def _even_tail(freedom: int) -> str:
    """The chi-square tail of an even number of degrees of freedom is a finite sum."""
    return "exp(-q / 2) * (" + " + ".join(f"pow(q / 2, {j}) / {math.factorial(j)}.0" for j in range(freedom // 2)) + ")"


_LONG_Q = {k: " + ".join(f"r{j} * r{j} / (n - {j})" for j in range(1, k + 1)) for k in (10, 20)}


@query(
    "t4_ljung_box_long",
    f"""WITH dev AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events),
    led AS (SELECT user_id, d, {", ".join(f"lead(d, {k}) OVER w AS d{k}" for k in range(1, 21))} FROM dev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT user_id, count(*) AS n, {", ".join(f"sum(d * d{k}) / sum(d * d) AS r{k}" for k in range(1, 21))} FROM led GROUP BY user_id),
    q AS ({" UNION ALL ".join(f"SELECT user_id, {k} AS lags, n, n * (n + 2) * ({_LONG_Q[k]}) AS q FROM r WHERE n >= {2 * k}" for k in (10, 20))})
    SELECT user_id, CAST(lags AS INT) AS lags, n, round(q, 5) + 0.0 AS q, round(CASE lags WHEN 10 THEN {_even_tail(10)} ELSE {_even_tail(20)} END, 8) + 0.0 AS p FROM q""",
)
def ljung_box_long(spark, sf_dir):
    products = dep.lag_products(table(spark, sf_dir, "events"), EVENTS, 20)
    made = [dep.ljung_box(products, EVENTS, k).withColumn("lags", F.lit(k)) for k in (10, 20)]
    return prof.append(*made).select("user_id", "lags", "n", shown("q", 5).alias("q"), shown("p", 8).alias("p"))


@query(
    "t5_significant_share",
    f"""WITH {ACF} SELECT count(*) AS tested, count(*) FILTER (WHERE q > 11.070497693516351) AS significant,
    round(count(*) FILTER (WHERE q > 11.070497693516351) / count(*), 6) + 0.0 AS share FROM lb""",
)
def significant_share(spark, sf_dir):
    made = dep.significant_share(dep.ljung_box(_products(spark, sf_dir), BY_TYPE))
    return made.select("tested", "significant", shown("share").alias("share"))


@query(
    "t5_p_value_histogram",
    _hist_sql(f"WITH {ACF}, {P_VALUES} SELECT p FROM ps", "p", 20, False),
)
def p_value_histogram(spark, sf_dir):
    return _hist(dep.p_value_histogram(dep.ljung_box(_products(spark, sf_dir), BY_TYPE)))


@query(
    "x5_t1_recent_autocorrelation",
    """WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) WHERE back <= 12),
    dev AS (SELECT *, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS d FROM recent),
    led AS (SELECT *, lead(d) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d1 FROM dev)
    SELECT o_custkey, round(sum(d * d1) / sum(d * d), 6) + 0.0 AS acf FROM led GROUP BY o_custkey HAVING count(*) >= 5""",
)
def recent_autocorrelation(spark, sf_dir):
    from lapcast.operators.sampling import last_n

    recent = last_n(table(spark, sf_dir, "orders"), ORDERS, 12)
    made = dep.acf(dep.lag_products(recent, ORDERS, 1), ORDERS, 1)
    return made.where("lag = 1").select("o_custkey", shown("acf").alias("acf"))
