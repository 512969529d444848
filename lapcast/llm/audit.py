"""What each of several text filters removes, in every order they could be applied in.

Filters: A few words, B few distinct words, C many capitals, D a mark character, E the text of a smaller id. E is found by a left
semi join on the text's hash, the text itself and a smaller id; its ids are united with those that fail A to D, and counts are taken
of combinations of failures, from which every order follows by arithmetic.

A null text is empty, a null part is the empty part. Empty texts fail A, and E where a smaller id has an empty text. A null id is
neither smaller nor larger than another, so it never fails E. Rows that repeat id and text don't fail E by each other. Label
rows of an id count once: one that says 1 decides. An empty table gives no row. Columns other than the named ones are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.common import words_of
from lapcast.plans.skew import lookup_join
from lapcast.session import written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
#: Hashes that several ids share are sent to every task while there are no more of them than this (16 bytes each).
SHARED = 2**20
#: A text with more copies than this is compared in several tasks.
COPIES = 20_000

_COPY = 1 << FILTERS.index("E")


def _plain(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``id, part, text, hash`` of every row."""
    held = docs.select(
        docs[key].cast("long").alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )
    return held.withColumn("hash", F.xxhash64("text"))


def _failed(plain: DataFrame) -> DataFrame:
    """``id, part, hash`` and the bits of A to D that the text fails."""
    counted = plain.select(
        "id", "part", "hash", words_of(F.col("text")).alias("w"), F.char_length("text").cast("long").alias("chars"),
        F.char_length(F.regexp_replace("text", "[^A-Z]++", "")).cast("long").alias("capitals"), F.col("text").rlike(MARKS).alias("marked"),
    )
    n, distinct = F.size("w").cast("long"), F.size(F.array_distinct("w")).cast("long")
    tests = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * F.col("capitals") > MOST_CAPITALS * F.col("chars"), F.col("marked")]
    bits = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    return counted.select("id", "part", "hash", bits.alias("bits"))


def copies(plain: DataFrame, hashes: DataFrame) -> DataFrame:
    """``id, part, hash`` of the rows whose text stands under a smaller id; ``hashes`` has ``id, hash`` of every row.

    Texts travel only where several ids share the hash (where such hashes are too many to be sent to every task, all texts do).
    Of the smaller ids only the smallest of each text is joined, as it exists exactly if any does. A text with very many copies
    is repeated for several tasks and its rows are dealt over them.
    """
    shared = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = written(shared.where("low < high").select("hash", "low", F.ceil(F.col("n") / COPIES).cast("int").alias("tasks")), "shared")
    few = shared.limit(SHARED + 1).count() <= SHARED
    # Otherwise only the texts with very many copies are listed: at most one for each COPIES rows.
    sent = F.broadcast(shared if few else shared.where("tasks > 1"))
    met = plain.join(sent, "hash", "inner" if few else "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
    first = met.where("id IS NOT NULL").groupBy("hash", "text").agg(F.min("id").alias("first"), F.max("tasks").alias("tasks"))
    first = first.select("hash", "text", "first", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    later = met.where(F.col("id") > F.coalesce("low", F.lit(-(2**63)))).withColumn("task", F.pmod(F.xxhash64("id"), "tasks").cast("int"))
    same = (later["hash"] == first["hash"]) & (later["task"] == first["task"]) & (later["text"] == first["text"])
    return later.join(first, same & (first["first"] < later["id"]), "left_semi").select("id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, bits, n, good, toxic``: rows of each part that fail exactly the filters in ``bits``."""
    plain = _plain(docs, key, text, part)
    failed = written(_failed(plain), "failed")
    again = copies(plain, failed.select("id", "hash"))
    united = failed.withColumn("n", F.lit(1).cast("long")).unionByName(again.withColumns({"bits": F.lit(_COPY), "n": F.lit(0).cast("long")}))
    # Rows that agree in id, hash and part fail alike.
    each = united.groupBy("id", "hash", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    told = labels.select(labels["doc_id"].cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL")
    told = told.where("quality = 1 OR toxic = 1").groupBy("id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    known = lookup_join(each, told, ["id"], "left")
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return known.groupBy("part", "bits").agg(F.sum("n").alias("n"), weighed("good"), weighed("toxic"))


def _bit(letter: Column) -> Column:
    return F.get(F.lit([1 << i for i in range(len(FILTERS))]), F.ascii(letter) - ord("A"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    counts = combinations(docs, labels, key, text, part)
    # At most one entry for each combination of failures.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("counts"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = parts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = lambda k: F.substring("filter_order", k, 1)
    before = sum((F.when(F.col("step") > k, _bit(at(k))).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    steps = steps.withColumns({"own": _bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))), "before": before})
    own, earlier = F.col("own"), F.col("before")

    def total(of: str, test) -> Column:
        return F.aggregate(F.filter("counts", test), F.lit(0).cast("long"), lambda s, c: s + c[of])

    fails = lambda c: c["bits"].bitwiseAND(own) != 0
    alive = lambda c: c["bits"].bitwiseAND(earlier) == 0
    # Of all orders, the share in which a filter comes first among k failed ones is 1 / k.
    orders_each = lambda c: F.floor(F.lit(factorial(len(FILTERS))) / F.bit_count(c["bits"])).cast("long")
    shapley = F.aggregate(F.filter("counts", fails), F.lit(0).cast("long"), lambda s, c: s + c["n"] * orders_each(c))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda c: alive(c) & ~fails(c)).alias("kept"), total("n", lambda c: alive(c) & fails(c)).alias("removed"),
        total("n", lambda c: ~alive(c) & fails(c)).alias("redundant"), total("n", lambda c: c["bits"] == own).alias("unique_fails"),
        total("good", lambda c: alive(c) & fails(c)).alias("good_lost"), total("toxic", lambda c: alive(c) & fails(c)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
