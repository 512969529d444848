"""Mixing sources to target weights: blocks of words, multinomial draws per output shard, permuted block numbers.

Every source's documents, in order of id and size, are one run of words that is cut into blocks; the last may be short. The mix is a
row of slots. Each slot draws a source in proportion to the blocks that source is to give, so a shard's counts are multinomial;
what the draws of all shards together give a source too often passes to those drawn too seldom, so every source gives exactly its
number. The k-th slot of a source takes block ``permutation(k mod blocks)`` of round ``k div blocks``, so no block is taken more
often than any other by more than one, and the last slot is cut to the word.

A null text has no words; such documents are in no block. Null sources are one source, the last. Rows that repeat an id are rows of
their own, equal ones are interchangeable; null ids come first. An empty table gives no row. Other columns are not read. All draws are
hashes of slot numbers: the same table gives the same mix, whatever its partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lapcast.llm.common import words_of
from lapcast.llm.hashing import mixed
from lapcast.plans.ordered import arrange, ranked
from lapcast.plans.skew import lookup_join
from lapcast.session import written

# Fixed values of the task: weights by the source's place, and how often a word may be taken.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Words in a block, slots in an output shard.
BLOCK, SHARD = 2048, 1024
#: A line of numbers is cut into at least so many cells to find the range a number lies in.
CELLS = 4096

_TURNS = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OFFSETS = np.arange(_TURNS, dtype=np.uint64) * _STEP


def _turn(value: np.ndarray, half: np.ndarray, key: np.ndarray, inverse: bool) -> np.ndarray:
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = value >> half, value & mask
    for t in range(_TURNS):
        k = key + _OFFSETS[_TURNS - 1 - t if inverse else t]
        if inverse:
            left, right = right ^ (mixed(left ^ k) & mask), left
        else:
            left, right = right, left ^ (mixed(right ^ k) & mask)
    return (left << half) | right


def permuted(value: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed bijection of 0 .. size-1: a Feistel network over the next power of four, walked until it is back in range."""
    value, size, key = (np.asarray(x).astype(np.uint64) for x in (value, size, key))
    half = np.ones(len(size), dtype=np.uint64)
    while (small := (np.uint64(1) << (half * np.uint64(2))) < size).any():
        half[small] += np.uint64(1)
    out, todo = value.copy(), np.arange(len(value))
    while len(todo):
        out[todo] = _turn(out[todo], half[todo], key[todo], inverse)
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def key_of(seed: int, sid: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The permutation key of a source's round."""
    return mixed(mixed(np.uint64(seed) + np.asarray(sid).astype(np.uint64) * _STEP) + np.asarray(turn).astype(np.uint64))


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id, source, size`` of every row; the size is its number of words."""
    words = F.size(words_of(F.coalesce(docs[text].cast("string"), F.lit("")))).cast("long")
    return docs.select(docs[key].cast("long").alias("id"), docs[source].cast("string").alias("source"), words.alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sid, source, weight, source_size, target`` of every source, numbered by code point, null last.

    Targets share all sizes by weight, but none is above ``most`` times its source's size; what is cut off is shared again by
    weight. One pass over the table of sources for each time that more of them reach their bound.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_none", F.col("source").isNull())
    numbered = ranked(per, [], ["_none", "source"], "sid").withColumn("sid", F.col("sid") - 1)
    weight = F.get(F.lit(list(weights)), (F.col("sid") % len(weights)).cast("int"))
    table = written(numbered.select("sid", "source", weight.alias("weight"), "source_size"), "sources")
    bound = most * F.col("source_size")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, seen = 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) > bound
        r = table.agg(F.sum(F.when(full, bound)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (r["held"] or 0, r["open"] or 0)
        if now == seen or not now[1]:
            break
        level, seen = (total - now[0]) / now[1], now
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), bound.cast("double")))


def _budgets(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds ``blocks, tail, draws, cut``: blocks and words of the last one, slots to fill, words of the last slot (0: all).

    Whole rounds take every block; in the last round the short block stands at a place that the permutation's inverse tells.
    """
    names = ["sid", "blocks", "tail", "draws", "cut"]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, size, target = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            want = np.minimum(np.floor(target + 0.5).astype(np.int64), MOST * size)
            blocks = -(-size // block)
            tail = size - (blocks - 1) * block
            turns, rest = np.divmod(want, np.maximum(size, 1))
            some = size > 0
            place = np.zeros(len(sid), dtype=np.int64)
            place[some] = permuted(blocks[some] - 1, blocks[some], key_of(seed, sid[some], turns[some]), inverse=True)
            ahead = place * block
            beyond = rest - ahead - tail
            slots = np.where(rest <= ahead, -(-rest // block), np.where(beyond <= 0, place + 1, place + 1 - (-beyond // block)))
            last = np.where(rest <= ahead, rest - (slots - 1) * block, np.where(beyond <= 0, rest - ahead, beyond - (slots - place - 2) * block))
            slots, last = np.where(rest > 0, slots, 0), np.where(rest > 0, last, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sid, blocks, tail, turns * blocks + slots, last)], names=names)

    planned = targets.select("sid", "source_size", "target").mapInArrow(plan, "sid long, blocks long, tail long, draws long, cut long")
    return targets.join(planned, "sid")


def _starts(table: DataFrame, **counts: Column) -> DataFrame:
    """Adds for each name the sum of its count over earlier sources."""
    for name, count in counts.items():
        table = arrange(table, [], ["sid"]).running(name, "sum", count, before=True).finish()
        table = table.withColumn(name, F.coalesce(name, F.lit(0)))
    return table


def _within(points: DataFrame, at: str, ranges: DataFrame, first: str, count: str, end: int, cells: int) -> DataFrame:
    """Each point with the columns of the range ``[first, first + count)`` that holds its number ``at``.

    Ranges are listed under every cell they touch, at most one more row a cell, so this is an equality join on cells.
    """
    width = max(1, -(-end // max(cells, CELLS)))
    cell = lambda c: F.floor(c / F.lit(width))
    touched = F.sequence(cell(F.col(first)), cell(F.col(first) + F.col(count) - 1))
    listed = ranges.where(F.col(count) > 0).withColumn("_cell", F.explode(touched))
    joined = lookup_join(points.withColumn("_cell", cell(F.col(at))), listed, ["_cell"])
    return joined.where((F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + F.col(count))).drop("_cell")


def _slots(sources: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """``shard, slot, sid, block, words``: what every slot of the mix takes."""
    spark = sources.sparkSession
    plan = written(_starts(sources, first=F.col("draws")), "plan")
    number, total = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("draws"), F.lit(0))).first()
    schema = "shard long, slot long, sid long, block long, words long"
    if not total:
        return spark.createDataFrame([], schema)
    cells = 4 * number
    points = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(seed).cast("long"), "id"), F.lit(total)).alias("_at"))
    shard_of = F.floor(F.col("slot") / F.lit(shard)).alias("shard")
    drawn = _within(points, "_at", plan.select("sid", "first", "draws"), "first", "draws", total, cells).select(shard_of, "slot", "sid")
    # The multinomial counts of each shard, and how often earlier shards drew the source.
    counts = written(drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")), "draws")
    earlier = arrange(counts, ["sid"], ["shard"]).running("_earlier", "sum", F.col("n"), before=True).finish().drop("n")
    place = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot"))
    numbered = drawn.withColumn("_place", place).join(earlier, ["sid", "shard"])
    numbered = numbered.select("shard", "slot", "sid", (F.coalesce("_earlier", F.lit(0)) + F.col("_place") - 1).alias("k"))
    got = plan.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    zero = F.lit(0).cast("long")
    got = got.withColumns({"over": F.greatest(F.col("got") - F.col("draws"), zero), "under": F.greatest(F.col("draws") - F.col("got"), zero)})
    plan = written(_starts(got, over_first=F.col("over"), under_first=F.col("under")), "plan")
    spare = plan.agg(F.sum("under")).first()[0]
    known = lookup_join(numbered, plan.select("sid", "draws", "over_first"), ["sid"])
    kept = known.where("k < draws").select("shard", "slot", "sid", "k")
    if spare:
        passed = known.where("k >= draws").select("shard", "slot", (F.col("over_first") + F.col("k") - F.col("draws")).alias("_at"))
        taker = plan.select("sid", "got", "under", "under_first")
        given = _within(passed, "_at", taker, "under_first", "under", spare, cells)
        kept = kept.unionByName(given.select("shard", "slot", "sid", (F.col("got") + F.col("_at") - F.col("under_first")).alias("k")))
    ready = lookup_join(kept, plan.select("sid", "blocks", "tail", "draws", "cut"), ["sid"])
    return _permuted_slots(ready, schema, block, seed)


def _permuted_slots(ready: DataFrame, schema: str, block: int, seed: int) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, slot, sid, k, blocks, tail, draws, cut = (b.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            turn, at = np.divmod(k, blocks)
            index = permuted(at, blocks, key_of(seed, sid, turn))
            words = np.where(index == blocks - 1, tail, block)
            words = np.where((k == draws - 1) & (cut > 0), cut, words)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, slot, sid, index, words)], names=["shard", "slot", "sid", "block", "words"])

    return ready.select("shard", "slot", "sid", "k", "blocks", "tail", "draws", "cut").mapInArrow(place, schema)


@dataclass
class Mix:
    """``sources``: one row a source. ``documents``: id, sid, size, start of every document in its source (null without words).
    ``slots``: shard, slot, sid, block, words. ``pieces``: shard, slot, place in the slot, and id, sid, start of the document, first
    word and number of words taken from it."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mixed_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    block: int = BLOCK, shard: int = SHARD, seed: int = 1,
) -> Mix:
    """The whole mix; as many words as the table has, unless rounding to words changes a source by one."""
    sizes = written(document_sizes(docs, key, text, source), "sizes")
    sources = written(_budgets(source_targets(sizes, weights), block, seed), "sources")
    named = sources.select("sid", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"))
    keyed = sizes.select("id", "size", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"))
    keyed = lookup_join(keyed, named, ["_s", "_none"]).select("id", "sid", "size")
    laid = arrange(keyed.where("size > 0"), ["sid"], ["id", "size"]).running("start", "sum", F.col("size"), before=True).finish()
    laid = laid.select("id", "sid", "size", F.coalesce("start", F.lit(0)).cast("long").alias("start"))
    none = keyed.where("size = 0").withColumn("start", F.lit(None).cast("long"))
    documents = written(laid.unionByName(none), "laid")
    slots = written(_slots(sources, block, shard, seed), "slots")
    begin, end = F.col("start"), F.col("start") + F.col("size")
    number = lambda c: F.floor(c / F.lit(block))
    parts = documents.where("size > 0").withColumn("block", F.explode(F.sequence(number(begin), number(end - 1))))
    low = F.greatest(begin, F.col("block") * block)
    high = F.least(end, F.col("block") * block + F.col("words"))
    pieces = slots.join(parts, ["sid", "block"]).where(high > low).select(
        "shard", "slot", (low - F.col("block") * block).alias("place"), "id", "sid", "start", "size",
        (low - begin).alias("first_word"), (high - low).alias("words"),
    )
    return Mix(sources, documents, slots, pieces)


def taken_words(mix: Mix) -> DataFrame:
    """``id, size, source_size, target, taken`` of every document row: how many of its words the mix takes, repeats counted."""
    none = mix.documents.where("size > 0").select("sid", "start", "id", "size", F.lit(0).cast("long").alias("taken"))
    some = mix.pieces.select("sid", "start", "id", "size", F.col("words").alias("taken"))
    counted = none.unionByName(some).groupBy("sid", "start", "id", "size").agg(F.sum("taken").alias("taken")).drop("start")
    empty = mix.documents.where("size = 0").select("sid", "id", "size", F.lit(0).cast("long").alias("taken"))
    rows = lookup_join(counted.unionByName(empty), mix.sources.select("sid", "source_size", "target"), ["sid"])
    return rows.select("id", "size", "source_size", "target", "taken")
