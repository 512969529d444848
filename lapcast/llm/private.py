"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Column expressions only; no Python runs on executors. What reaches the driver are the vote patterns, at most
3 ** (number of labelers), whatever the corpus holds.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.spans import Kind, digits, luhn, matches, starting, unmarked
from lapcast.session import written


def _between(value: Column, least: int, most: int) -> Column:
    return F.char_length(digits(value)).between(least, most)


def _small_parts(value: Column) -> Column:
    """Every part of a dotted number is at most 255; parts of three digits compare as text."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.char_length(bare) < 3) | ((F.char_length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


_LOCAL = "A-Za-z0-9._%+-"
BASE = (
    Kind("email", starting(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", starting("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", lambda v: _between(v, 13, 19) & luhn(v)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: _between(v, 9, 15)),
)

# Given names, titles, mail domains and telling words that the gazetteer and context labelers know.
GIVEN_NAMES = (
    "Alice Andreas Anna Antonio Carlos Carmen Claire David Elena Emma Hans Heike James Jean John Jose Juan "
    "Julia Karl Laura Linda Lucas Luis Maria Marie Mary Michael Michel Miguel Patricia Paul Peter Pierre "
    "Robert Sarah Sophie Stefan Susan Thomas William"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Sr Sra".split()
DOMAIN_ENDS = "com org net edu gov info io de fr es uk eu".split()
TELLING = (
    "address call card cell contact credit email fax iban ip mail mobile name owner phone reach signed social ssn tel "
    "telephone visa correo adresse telefon kontakt tarjeta carte"
).split()
MISLEADING = "article chapter edition isbn issue item model order page part release section serial sku version".split()

_NAME = r"[A-Z][a-zà-öø-ÿ]{1,30}"
#: Wide candidates beyond the base kinds; most are noise until the labelers agree.
WIDE = (
    Kind("words_email", rf"[A-Za-z0-9._%+-]{{1,64}}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}"),
    Kind("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Kind("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    Kind("local_phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    Kind("name", rf"(?<![A-Za-z])(?:(?:{'|'.join(TITLES)})\.?|{'|'.join(GIVEN_NAMES)})\x20{_NAME}(?:\x20{_NAME})?"),
)
CONTEXT = 40
LABELERS = ("shape", "gazetteer", "context", "filler")
ROUNDS = 30
#: Words beside a span are hashed to so many values, which bounds the classifier's table.
BUCKETS = 4096


def candidates(text: Column, base: tuple[Kind, ...], wide: tuple[Kind, ...]) -> tuple[Column, Column]:
    """Base spans by kind, then start; and wide ones that touch no base span, with the words around them."""
    own = F.concat(*[matches(text, k) for k in base])
    return own, F.concat(*[matches(text, k) for k in wide])


def _around(spans: Column, text: Column) -> Column:
    def seen(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, first + 1, s["start"] - first)
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
        fields = [s[n].alias(n) for n in ("kind", "start", "end", "value")]
        return F.struct(*fields, before.alias("before"), after.alias("after"))

    return F.transform(spans, seen)


def _clear_of(wide: Column, base: Column) -> Column:
    overlaps = lambda w: F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    return F.filter(wide, lambda w: ~overlaps(w))


def votes() -> dict[str, Column]:
    """One column for each labeler over a span ``s``: 1 for personal, -1 against, 0 abstains."""
    kind, value, before = F.col("s.kind"), F.col("s.value"), F.lower(F.col("s.before"))
    bare = digits(value)
    base = kind.isin([k.name for k in BASE])
    shape = (
        F.when(base, 1)
        .when(kind == "social", F.when(bare.rlike("^(000|666|9)|^...00|0000$"), -1).otherwise(1))
        .when(kind == "local_phone", F.when(bare.rlike("^[01]|^...[01]"), -1).otherwise(1))
        .when(kind == "account", F.when(_between(value, 10, 32), 1).otherwise(-1))
        .otherwise(0)
    )
    words = F.split(value, r"[^\p{L}]+")
    known = F.arrays_overlap(words, F.array(*[F.lit(x) for x in GIVEN_NAMES + DOMAIN_ENDS]))
    titled = F.arrays_overlap(words, F.array(*[F.lit(x) for x in TITLES]))
    gazetteer = F.when(known | titled, 1).when(kind.isin("name", "words_email"), -1).otherwise(0)
    said = F.split(before, r"[^\p{L}]+")
    context = (
        F.when(F.arrays_overlap(said, F.array(*[F.lit(x) for x in MISLEADING])), -1)
        .when(F.arrays_overlap(said, F.array(*[F.lit(x) for x in TELLING])), 1)
        .otherwise(0)
    )
    filler = F.when(bare.rlike(r"([0-9])\1{5,}") | bare.contains("123456789"), -1).otherwise(0)
    return {"shape": shape, "gazetteer": gazetteer, "context": context, "filler": filler}


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict]]:
    """Expectation-maximisation over counted vote patterns: prior, and for each labeler P(vote | class) of both classes.

    Starts from the sign of the votes' sum; counts are smoothed by one, so a labeler that never speaks stays neutral.
    """
    posterior = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p, _ in patterns}
    prior, tables = 0.5, []
    for _ in range(rounds):
        good = sum(n * posterior[p] for p, n in patterns)
        total = sum(n for _, n in patterns)
        prior = (good + 1) / (total + 2)
        tables = []
        for j in range(len(LABELERS)):
            table = {}
            for v in (-1, 0, 1):
                yes = sum(n * posterior[p] for p, n in patterns if p[j] == v)
                no = sum(n * (1 - posterior[p]) for p, n in patterns if p[j] == v)
                # A vote for may never count against: that keeps the two classes from changing places.
                table[v] = ((yes + 1) / (good + 3), (no + 1) / (total - good + 3))
            tables.append(table)
        posterior = {p: believed(p, prior, tables) for p, _ in patterns}
    return prior, tables


def believed(pattern: tuple[int, ...], prior: float, tables: list[dict]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, table in zip(pattern, tables, strict=True):
        ratio = math.log(table[v][0] / table[v][1])
        odds += max(ratio, 0.0) if v > 0 else min(ratio, 0.0) if v < 0 else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features() -> Column:
    """What the classifier sees of a span: kind, hashed neighbours, and the form of the value."""
    last = F.regexp_extract(F.lower("s.before"), r"(\p{L}+)[^\p{L}]*$", 1)
    first = F.regexp_extract(F.lower("s.after"), r"^[^\p{L}]*(\p{L}+)", 1)
    hashed = lambda name, w: F.concat(F.lit(name), F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("string"))
    form = F.concat(F.lit("digits"), F.least(F.char_length(digits(F.col("s.value"))), F.lit(20)).cast("string"))
    voted = [F.concat(F.lit(f"{n}:"), F.col(n).cast("string")) for n in LABELERS]
    return F.array(F.concat(F.lit("kind:"), F.col("s.kind")), hashed("before:", last), hashed("after:", first), form, *voted)


def find_private(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``base`` (span array by kind as listed, then start) and ``spans`` (base, then added ones).

    Base spans always stay. A wide span is added when the classifier gives it odds above one; wide spans that touch
    base spans are left out, so no place is told twice by them. Null and empty texts have no spans, a table without
    spans trains nothing and adds nothing, and repeated rows keep one result each. Only the two named columns are read.
    """
    plain = df.select(df[key].cast("long").alias("id"), unmarked(F.coalesce(df[text].cast("string"), F.lit(""))).alias("text"))
    own, wide = candidates(F.col("text"), BASE, WIDE)
    found = plain.select("id", "text", own.alias("base"), wide.alias("wide"))
    rows = found.select(
        F.monotonically_increasing_id().alias("row"), "id",
        _around(F.col("base"), F.col("text")).alias("base"),
        _around(_clear_of(F.col("wide"), F.col("base")), F.col("text")).alias("wide"),
    )
    rows = written(rows, "private-spans")
    spans = rows.select("row", F.explode(F.concat("base", "wide")).alias("s"))
    voted = written(spans.select("row", "s", *[c.cast("int").alias(n) for n, c in votes().items()]), "private-votes")

    patterns = [(tuple(r[n] for n in LABELERS), r["n"]) for r in voted.groupBy(*LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()]
    prior, tables = reliabilities(patterns) if patterns else (0.5, [])
    known = df.sparkSession.createDataFrame(
        [(*p, believed(p, prior, tables)) for p, _ in patterns], ", ".join(f"{n} int" for n in LABELERS) + ", p double"
    )
    soft = voted.join(F.broadcast(known), list(LABELERS)).select("row", "s", "p", _features().alias("features"))

    # Naive Bayes on the soft labels; its table has at most the bounded number of feature values.
    counted = soft.select("p", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")
    )
    total = soft.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("y"), F.coalesce(F.sum(1 - F.col("p")), F.lit(0.0)).alias("n")).first()
    weight = F.log((F.col("yes") + 0.5) / (total["y"] + 1)) - F.log((F.col("no") + 0.5) / (total["n"] + 1))
    weights = counted.select("feature", weight.alias("weight"))
    start = math.log((total["y"] + 1) / (total["n"] + 1))
    scored = (
        soft.where(F.col("s.kind").isin([k.name for k in WIDE]))
        .select("row", "s", "p", F.explode("features").alias("feature"))
        .join(F.broadcast(weights), "feature")
        .groupBy("row", "s.kind", "s.start", "s.end").agg(F.sum("weight").alias("weight"), F.max("p").alias("p"))
        .where((F.col("weight") + start > 0) & (F.col("p") > 0.5))
    )
    order = F.array(*[F.lit(k.name) for k in WIDE])
    added = scored.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.array_position(order, F.col("kind")).alias("at"), "start", "end", "kind"))).alias("added")
    )
    plain_spans = lambda c: F.transform(c, lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "start", "end")]))
    out = rows.join(added, "row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.select("id", plain_spans("base").alias("base"), F.concat(plain_spans("base"), F.coalesce(plain_spans("added"), none)).alias("spans"))
