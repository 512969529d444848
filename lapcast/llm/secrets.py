"""Secret scan: pattern candidates, then corpus-wide ownership frequency tells copied examples from live-looking keys.

Column expressions only; no Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.spans import SPAN, Kind, joined, matches, unmarked
from lapcast.plans.skew import salted_join
from lapcast.session import written

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Runs shorter than the least length hold no match, so the length stands in the pattern.
BASE = (
    Kind("assign", _ASSIGN, lambda v: F.char_length(F.regexp_extract(v, _ASSIGN, 1)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of tokens beyond the base kinds.
ADDED = (
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Kind("bearer", r"(?i:bearer)\x20[A-Za-z0-9._~+/-]{20,}"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,20000}+-----END"),
    Kind("login", r"://[A-Za-z0-9._-]{1,60}:[^\s/@:]{6,60}@"),
)
#: A value that so many owners or repositories hold is a copied example; so is one that spells out that it is a placeholder.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 3
_PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|x{6,}|\*{4,}|(.)\1{7,}|0123456|abcdef0?123"


def secret_part(kind: Column, value: Column) -> Column:
    """The credential itself: an assignment's right side, else the whole match."""
    return F.when(kind == "assign", F.regexp_extract(value, _ASSIGN, 1)).otherwise(value)


def looks_live(secret: Column) -> Column:
    """Long enough, mixed enough and no placeholder."""
    kinds = [secret.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")]
    distinct = F.size(F.array_distinct(F.split(secret, "")))
    return (F.char_length(secret) >= 8) & (reduce(lambda a, b: a + b, kinds) >= 2) & (distinct >= 6) & ~secret.rlike(_PLACEHOLDER)


def scanned(df: DataFrame, text: str = "text", base: tuple[Kind, ...] = BASE, added: tuple[Kind, ...] = ADDED) -> DataFrame:
    """The rows with ``base`` and ``added`` span arrays; a null text is empty. Both names replace columns called so."""
    held = df.withColumn("_scan", unmarked(F.coalesce(df[text].cast("string"), F.lit(""))))
    arrays = {f"_k_{k.name}": matches(F.col("_scan"), k) for k in (*base, *added)}
    parts = lambda kinds: F.concat(F.array().cast(SPAN), *[F.col(f"_k_{k.name}") for k in kinds])
    return held.withColumns(arrays).withColumns({"base": parts(base), "added": parts(added)}).drop("_scan", *arrays)


def by_place(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind in the order given."""
    order = F.array(*[F.lit(k) for k in kinds])
    at = lambda s: F.array_position(order, s["kind"]).alias("at")
    fields = lambda s, names: [s[n].alias(n) for n in names]
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), at(s), *fields(s, ("end", "kind", "value"))))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(*fields(s, ("kind", "start", "end", "value"))))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per hash: ``_n`` rows, distinct ``repos`` and ``owners``; counts combine before every shuffle."""
    per_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("_n"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("hash").agg(
        F.sum("_n").alias("_n"), F.sum("repos").alias("repos"), F.count("owner").alias("owners")
    )


def secret_scan(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang") -> DataFrame:
    """One row per input row: ``id``, ``base`` and ``spans`` (ordered span arrays) and ``verdicts``.

    ``verdicts`` holds one struct per span: kind, start, end, owners, repos and verdict, which is ``example``
    (held by ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOS`` repositories or more, or a placeholder), ``live`` (held by fewer and live-looking) or
    ``weak``. Null and empty texts have no spans; null owners count as no owner; a repository is a pair of owner
    and ``repo``. Repeated rows keep one result each. Only the four named columns are read, so others may have any name.
    """
    plain = df.select(
        df[key].cast("long").alias("id"), df[text].cast("string").alias("text"),
        df[owner].cast("string").alias("owner"), df[repo].cast("string").alias("repo"),
    )
    order = [k.name for k in (*BASE, *ADDED)]
    rows = scanned(plain).select(
        F.monotonically_increasing_id().alias("row"), "id", "owner", "repo",
        by_place(F.col("base"), order).alias("base"), by_place(F.concat("base", "added"), order).alias("spans"),
    )
    rows = written(rows, "secret-spans")
    spans = rows.where(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("s"))
    secret = secret_part(F.col("s.kind"), F.col("s.value"))
    spans = spans.select("row", "owner", "repo", "s", secret.alias("secret"), F.sha2(secret, 256).alias("hash"))
    held = written(ownership(spans), "secret-owners")
    placed = salted_join(spans, held.drop("_n"), ["hash"], sizes=held.select("hash", "_n"))
    verdict = (
        F.when((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS) | F.col("secret").rlike(_PLACEHOLDER), "example")
        .when(looks_live(F.col("secret")), "live")
        .otherwise("weak")
    )
    told = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), "owners", "repos", verdict.alias("verdict"))
    verdicts = placed.groupBy("row").agg(F.sort_array(F.collect_list(told)).alias("verdicts"))
    return rows.join(verdicts, "row", "left").select("id", "base", "spans", "verdicts")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans), 256)
