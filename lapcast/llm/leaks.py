"""Benchmark decontamination: training tokens stream through a generalised suffix automaton of the test items."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapcast.llm.common import SLICE_BYTES, id_and_text, mapped
from lapcast.llm.hashing import Words, hashed
from lapcast.plans.skew import lookup_join
from lapcast.session import small_batches, written

WINDOW = 10
#: Item words in one automaton; more items are matched block by block.
BLOCK_WORDS = 100_000
#: A text of which matched spans cover more than this share is dropped whole.
COVERAGE = 0.5


@dataclass
class Automaton:
    """All runs of words of all items. State 0 is the empty run; ``longest[s]`` is the longest run of state s.

    ``gate[s]`` is the state of the last ``window`` words once that many match, ``items[g]`` the items they occur in, and
    ``short[s]`` lists (length, item) of the whole items shorter than a window that end wherever s ends.
    """

    window: int
    longest: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    gate: list[int] = field(default_factory=list)
    items: dict[int, tuple] = field(default_factory=dict)
    short: dict[int, tuple] = field(default_factory=dict)
    least: int = 0

    def _state(self, longest: int, link: int, step: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.step.append(step)
        return len(self.longest) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that ``word`` leads to from p, cut down to the runs that extend p's."""
        q = self.step[p][word]
        if self.longest[q] == self.longest[p] + 1:
            return q
        twin = self._state(self.longest[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def _extended(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.longest[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    @classmethod
    def of(cls, items: list[tuple[object, list[int]]], window: int) -> Automaton:
        made = cls(window)
        for _, words in items:
            state = 0
            for w in words:
                state = made._extended(state, w)
        order = sorted(range(len(made.longest)), key=made.longest.__getitem__)
        made.gate = [-1] * len(order)
        for s in order[1:]:
            above = made.link[s]
            made.gate[s] = made.gate[above] if made.longest[above] >= window else s if made.longest[s] >= window else -1
        gates: dict[int, set] = {}
        short: dict[int, set] = {}
        for name, words in items:
            state = 0
            for w in words:
                state = made.step[state][w]
                # The whole prefix is a run of this state, so a gate here means that a window of the item ends here.
                if made.gate[state] >= 0:
                    gates.setdefault(made.gate[state], set()).add(name)
            if 0 < len(words) < window:
                short.setdefault(state, set()).add((len(words), name))
        made.items = {s: tuple(x) for s, x in gates.items()}
        for s in order[1:]:
            own = short.get(s, set()) | set(made.short.get(made.link[s], ()))
            if own:
                made.short[s] = tuple(own)
        made.least = min((min(len(w), window) for _, w in items if w), default=sys.maxsize)
        return made

    def matches(self, words: list[int], first: int, found: list[tuple[int, int]], named: set) -> None:
        """Streams a run of words whose first has the given place; adds hit intervals and items found."""
        step, link, longest, gate, short, window = self.step, self.link, self.longest, self.gate, self.short, self.window
        state = length = 0
        for i, w in enumerate(words, first):
            while state and w not in step[state]:
                state = link[state]
                length = longest[state]
            state = step[state].get(w, 0)
            length = length + 1 if state else 0
            if length >= window:
                _grow(found, i + 1 - length, i + 1)
                named.update(self.items[gate[state]])
            if state in short:
                for size, item in short[state]:
                    if size <= length:
                        _grow(found, i + 1 - size, i + 1)
                        named.add(item)


def _grow(found: list[tuple[int, int]], start: int, end: int) -> None:
    """Adds an interval whose end is not before the others' ends, joining what it touches."""
    while found and found[-1][1] >= start:
        start = min(start, found.pop()[0])
    found.append((start, end))


def blocks(items: DataFrame, key: str, text: str, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata over the items' word hashes, each of at most ``block_words`` words (or one item), one at a time."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = hashed(batch.column("text"), alphanumeric=True)
            lists = [w.hashes[lo:hi].view(np.int64) for lo, hi in zip(*w.of_rows(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, pa.list_(pa.int64()))], ["id", "words"])

    rows = mapped(id_and_text(items, key, text), numbered, "id long, words array<long>", size=SLICE_BYTES)
    held, size = [], 0
    for row in rows.where(F.size("words") > 0).toLocalIterator():
        if held and size + len(row["words"]) > block_words:
            yield Automaton.of(held, window)
            held, size = [], 0
        held.append((row["id"], row["words"]))
        size += len(row["words"])
    if held:
        yield Automaton.of(held, window)


def _runs(w: Words, known: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of words that occur in items, within one text and of at least ``least`` words: row, start, end."""
    none = np.array([], dtype=np.int64)
    if not len(known):
        return none, none, none
    at = np.searchsorted(known, w.hashes)
    at[at == len(known)] = 0
    inside = known[at] == w.hashes
    if not inside.any():
        return none, none, none
    fresh = np.concatenate(([True], w.text[1:] != w.text[:-1]))
    begins = inside & (fresh | np.concatenate(([True], ~inside[:-1])))
    ends = inside & np.concatenate((fresh[1:] | ~inside[1:], [True]))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= least
    return w.text[start[long]], start[long], end[long]


def _matched(spark: SparkSession, texts: DataFrame, machine: Automaton) -> tuple[DataFrame, Broadcast]:
    known = np.unique(np.array(list(machine.step[0]), dtype=np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((machine, known))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = shared.value
        for batch in batches:
            w = hashed(batch.column("text"), alphanumeric=True)
            lo, hi = w.of_rows()
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            named: list[set] = [set() for _ in range(batch.num_rows)]
            signed = w.hashes.view(np.int64)
            for row, start, end in zip(*_runs(w, known, machine.least), strict=True):
                machine.matches(signed[start:end].tolist(), int(start - lo[row]), spans[row], named[row])
            cut = [[(s, e, int(w.start[lo[i] + s] - w.bounds[i]), int(w.end[lo[i] + e - 1] - w.bounds[i])) for s, e in x] for i, x in enumerate(spans)]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
            names = ("first", "last", "start", "end")
            cut = [[dict(zip(names, s, strict=True)) for s in x] for x in cut]
            ids = [sorted(x, key=lambda v: (v is not None, v)) for x in named]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(hi - lo, pa.int64()), pa.array(cut, kind), pa.array(ids, pa.list_(pa.int64()))],
                ["row", "id", "n_words", "spans", "items"],
            )

    schema = "row long, id long, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<long>"
    return mapped(texts, stream, schema, size=SLICE_BYTES), shared


def matched(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per input row: ``row, id, n_words, spans, items``.

    ``spans`` are the maximal runs of words that lie in occurrences of item windows, as places of words (first, one past
    last) and of bytes of the UTF-8 text (start, end); ``items`` are the item ids with a window in the text. An item
    shorter than ``window`` words is one window; null and empty texts and items have no words and match nothing. Without
    items nothing matches. Repeated rows keep one result each and items that repeat an id count once. Items are read in
    blocks of ``block_words``, so what is broadcast has a fixed size; the blocks' spans are united row by row.
    """
    spark = df.sparkSession
    texts = id_and_text(df, key, text).withColumn("row", F.monotonically_increasing_id())
    parts = []
    for machine in blocks(items, item_key, item_text, window, block_words):
        found, shared = _matched(spark, texts, machine)
        parts.append(found if not parts else written(found.where(F.size("spans") > 0), "leaks-block"))
    if not parts:
        return _matched(spark, texts, Automaton.of([], window))[0]
    if len(parts) == 1:
        return parts[0]
    parts[0] = written(parts[0], "leaks-block")
    more = parts[1]
    for part in parts[2:]:
        more = more.unionByName(part)
    every = parts[0].unionByName(more)
    return every.groupBy("row", "id", "n_words").agg(
        _united(F.sort_array(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def _united(spans):
    """Sorted spans with those that touch or overlap joined."""

    def step(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
        )
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"])
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.array_append(done, s))

    none = F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>")
    return F.aggregate(spans, none, step)


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])


def cleaned(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars",
    coverage: float = COVERAGE, window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows without matched spans: what lies between the spans stays as it is, joined by one blank.

    A row of which spans cover more than ``coverage`` of the words goes as a whole. ``length``, if it is a column, is set
    to the new text's code points. Rows without a match stay untouched, null texts included. Spans and rows meet by a
    64-bit hash of id and text, so repeated rows are treated alike.
    """
    fields = df.columns
    known = F.xxhash64(df[key].cast("long"), df[text].cast("string"))
    marked = df.select(F.struct(*[df[c] for c in fields]).alias("_row"), known.alias("_k"), df[text].cast("string").alias("_text"))
    with small_batches(df.sparkSession):
        found = matched(marked.select("_k", "_text"), items, "_k", "_text", window=window, block_words=block_words)
        hits = found.where(F.size("spans") > 0).select(F.col("id").alias("_k"), "spans", "n_words")
        hits = written(hits, "leaks-hits").dropDuplicates(["_k"])
    joined = lookup_join(marked, hits, ["_k"], "left").where(
        F.col("spans").isNull() | (hit_words(F.col("spans")) <= coverage * F.col("n_words"))
    )
    data = F.col("_text").cast("binary")
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(
            s["end"].alias("at"),
            F.array_append(a["parts"], F.trim(F.substring(data, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")).cast("string"))).alias("parts"),
        ),
        lambda a: F.concat_ws(" ", F.filter(F.array_append(a["parts"], F.trim(F.substring(data, (a["at"] + 1).cast("int"), F.octet_length("_text")).cast("string"))), lambda x: x != "")),
    )
    new = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(kept)
    out = joined.withColumn("_new", new)
    shown = [
        F.col("_new").alias(c) if c == text
        else F.when(F.col("spans").isNull(), F.col("_row")[c]).otherwise(F.char_length("_new").cast(df.schema[c].dataType)).alias(c) if c == length
        else F.col("_row")[c].alias(c)
        for c in fields
    ]
    return out.select(*shown)
