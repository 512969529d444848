"""One thin query per operator: its whole table in, the agreed digest columns out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapcast.llm import audit, clusters, katz, leaks, lines, mixing, near, packing, private, rules, secrets, urls, wrapper
from lapcast.llm.common import table
from lapcast.llm.registry import query
from lapcast.llm.spans import joined


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many of them go, and which (numbers from 0); every line with a word is compared."""
    docs = table(spark, sf_dir, "documents")
    late = lines.later_lines(docs).withColumnsRenamed({"id": "_id", "row": "_key"})
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lines.NO_ID)).alias("_id"),
        lines.row_key(F.col("doc_id"), F.col("text")).alias("_key"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
    )
    joined = named.join(late, ["_id", "_key"], "left")
    nos = F.coalesce("nos", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(nos).cast("long").alias("n_later"), F.array_join(nos, ",").alias("later_lines"))


@query("op3_katz_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_private_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), *[_count("base", k.name) for k in private.BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


_PARTS = r"""
SELECT page_id, url, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS place FROM pages"""
_FITS = "(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"


def _url_sql() -> str:
    by_length = sorted(urls.RULES, key=lambda r: -len(r.rule))
    fit = lambda r: _FITS.format(h=r.host, p=r.path)
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r.rule}'" for r in by_length) + " END"
    said = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r.verdict}'" for r in by_length) + " END"
    term = lambda words: f"regexp_matches(lower(u), '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])')"
    soft = " + ".join(f"CAST({term([w])} AS INT)" for w in urls.SOFT)
    method = f"CASE WHEN {term(urls.STRICT)} OR {soft} >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END"
    return f"""
WITH a AS ({_PARTS}),
r AS (SELECT page_id, u, CASE WHEN place > 0 THEN substr(u, place + 3) ELSE '' END AS rest FROM a),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, {method}) AS verdict FROM b"""


@query("op5_url_filter", _url_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judged_urls(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op6_main_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.main_texts(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op7_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.linked(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _rules_sql() -> str:
    bounds = []
    for r in rules.RULES:
        value = f"CAST({r.numerator} AS DOUBLE) / greatest({r.denominator}, 1)"
        bounds += [f"{value} >= {r.least}"] if r.least is not None else []
        bounds += [f"{value} <= {r.most}"] if r.most is not None else []
    stops = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
t AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
c AS (SELECT row, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
m AS (SELECT w.row, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words
      FROM w LEFT JOIN c ON c.row = w.row),
b AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(bounds)} AS kept
FROM b"""


@query("op8_quality_rules", _rules_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = leaks.hit_words(F.col("spans"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    told = lambda v: F.size(F.filter(F.coalesce("verdicts", F.array()), lambda x: x["verdict"] == v)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[_count("base", k.name) for k in secrets.BASE],
        secrets.digest(F.col("base")).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        told("live").alias("n_live"), told("example").alias("n_example"),
    )


def _clusters_sql(count: int = 16, rounds: int = 3) -> str:
    """Every round is one step: squared distances over zipped lists, then floored means by component."""
    near = """a{r} AS (SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
  SELECT row, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{r}) GROUP BY row)"""
    mean = """m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS c FROM (
  SELECT cluster, i, sum(v) AS s, count(*) AS n FROM (
    SELECT cluster, unnest(range(1, 65)) AS i, unnest(x) AS v FROM a{r} JOIN x USING (row)) GROUP BY cluster, i) GROUP BY cluster),
c{n} AS (SELECT o.cluster, CAST(coalesce(m.c, o.c) AS BIGINT[]) AS c FROM c{r} o LEFT JOIN m{r} m ON m.cluster = o.cluster)"""
    steps = [step.format(r=r, n=r + 1) for r in range(rounds) for step in (near, mean)] + [near.format(r=rounds)]
    return f"""
WITH k AS (SELECT row_number() OVER () AS row, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
x AS (SELECT row, vec_id, list_transform(e, lambda v: CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT)) AS x FROM k),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c FROM (
  SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM x ORDER BY h, x LIMIT {count})),
{", ".join(steps)}
SELECT x.vec_id, CAST(a.cluster AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN x USING (row) JOIN c{rounds} c ON c.cluster = a.cluster"""


@query("op11_centroid_clusters", _clusters_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))[0].withColumnRenamed("id", "vec_id")


_AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, FALSE)] AS f FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, i AS step, o[i] AS own, o[1:i - 1] AS before FROM o, i),
m AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(before, lambda x: f[x])) = 0 AS alive,
    len(list_filter(f, lambda x: x)) AS failed FROM c, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN alive AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN alive AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND NOT alive THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN alive AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN alive AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""


@query("op12_filter_audit", _AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_source_mix")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(mixing.mixed_sources(table(spark, sf_dir, "documents")))
    return taken.withColumnRenamed("id", "doc_id")
