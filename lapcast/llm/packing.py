"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapcast.llm.common import id_and_text, mapped, utf8_column
from lapcast.session import written

LIMIT = 2048
#: Entries of a worker's table of known words; it is emptied when it is full.
KNOWN_WORDS = 1_000_000
#: Pieces of one length are numbered in shards of about so many.
SHARD_ROWS = 20_000
_PIECE = "id long, piece int, start long, length long, ids_crc32 long"


class _Known(dict):
    """Little-endian ids of blank-separated words, each encoded once.

    The tokenizer never joins characters across blanks, and never a letter a-z with a following stop or comma.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def encoded(self, text: str) -> bytes:
        # The same ids as ``encode``, without the places in the text.
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1:] in (b".", b",") and 97 <= word[-2] <= 122:
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self.encoded(word.decode())
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _Known:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return _Known(Tokenizer.from_file(path))


def token_ids(text: bytes, path: str) -> bytes:
    """The text's ids as unsigned 32-bit little-endian numbers, without special tokens but those the text spells out."""
    known = _tokenizer(path)
    if b"<|" in text:
        return known.encoded(text.decode())
    return b"".join(map(known.__getitem__, text.lower().split()))


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut after every ``limit`` ids: ``id, piece, start, length, ids_crc32`` (and ``ids``)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column("id").to_pylist(), utf8_column(batch, "text"), strict=True):
                ids = token_ids(data, tokenizer) + end
                for n, at in enumerate(range(0, len(ids), 4 * limit)):
                    piece = ids[at : at + 4 * limit]
                    rows.append((doc, n, at // 4, len(piece) // 4, zlib.crc32(piece), piece))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            kept = range(6 if with_ids else 5)
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], types[i]) for i in kept], [names[i] for i in kept])

    return mapped(id_and_text(df, key, text), cut, _PIECE + (", ids binary" if with_ids else ""))


class CapacityTree:
    """A segment tree over remaining capacities 0..limit that finds the tightest open one in logarithmic time."""

    def __init__(self, limit: int) -> None:
        self.leaves = 1 << limit.bit_length()
        self.any = [False] * (2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = is_open
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        node = self.leaves + least
        if self.any[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(counts: dict[int, int], limit: int) -> np.ndarray:
    """Best-fit decreasing over counted lengths: rows of (length, first rank, pieces a bin, first bin, offset).

    Pieces of one length are alike, and bins with one remaining capacity are alike, so both are handled in runs:
    the pieces from ``first rank`` on fill bins from ``first bin`` on, ``pieces a bin`` in each, from ``offset`` on.
    Bin by bin this is what best-fit decreasing does piece by piece, and its size depends on ``limit`` alone.
    """
    tree, bins, rows = CapacityTree(limit), 0, []
    open_runs: dict[int, list[tuple[int, int]]] = {}

    def keep(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = limit
                each = capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = open_runs[capacity].pop()
                if not open_runs[capacity]:
                    tree.put(capacity, False)
                each = capacity // length
            placed = min(left, n * each)
            full, rest = divmod(placed, each)
            rows.append((length, rank, each, first, limit - capacity))
            keep(capacity - each * length, first, full)
            keep(capacity - rest * length, first + full, 1 if rest else 0)
            untouched = n - full - (1 if rest else 0)
            keep(capacity, first + n - untouched, untouched)
            rank, left = rank + placed, left - placed
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """Numbers the pieces of every length from 0 in ``rank``; a length with many pieces is numbered in shards."""
    shards = max(8, -(-total // SHARD_ROWS))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)))
    inside = Window.partitionBy("length", "shard").orderBy("id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    numbered = sharded.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(bases, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("base")).drop("shard", "base")


def packed(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``.

    Null and empty texts are the single ``end_id``. Repeated rows, and rows that share an id, are packed once each; a
    null id stays null. An empty table gives no rows. Only the two named columns are read. The driver sees the counts
    of at most ``limit`` lengths; all sequences are filled from all pieces together, not part by part.
    """
    cut = written(pieces(df, tokenizer, key, text, limit, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, limit)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    lengths, firsts, each, bins, offsets = (rows[order, i] for i in range(5))
    wide = np.int64(1 << 44)
    places = lengths * wide + firsts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(places, length * wide + rank, "right") - 1
            nth, inside = np.divmod(rank - firsts[run], each[run])
            out = [*batch.columns, pa.array(bins[run] + nth), pa.array(offsets[run] + inside * length)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "sequence_id", "offset"])

    numbered = ranked(cut, sum(counts.values()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long").drop("rank")
