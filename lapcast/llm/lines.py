"""Line dedup by an exact set-similarity join: rarest words first, prefix, position and length filters, then Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.common import SLICE_BYTES, id_and_text, mapped
from lapcast.llm.hashing import hashed, mixed
from lapcast.plans.skew import lookup_join, salted_join
from lapcast.session import block_rows, scratch, small_batches, written

#: Similarity in hundredths; lines of fewer distinct words are left alone, which with 1 are only those without any.
PERCENT, LEAST_WORDS = 80, 1
#: Words are counted in so many buckets, which bounds the table that every task gets. Words that share a bucket
#: share a rarity; the order stays the same total order everywhere, so this touches speed, never results.
BUCKET_BITS = 22
#: Tables of all buckets are added up in so many parts, so that the driver gets one row for each part, whatever the corpus.
PART_BITS = 6
#: Bits of the table that tells tasks which lines are to be compared word by word, as a power of two: it bounds what every
#: task gets; lines that share a bit with a wanted one travel in vain.
WANTED_BITS = 27
#: Words that stand in so many lines or more share a rarity.
MOST = np.uint64((1 << 24) - 1)
#: Lines that share a key are compared where the key's rows meet while they are at most so many; larger groups take joins
#: that can be split. A word expected in more lines is no key alone: it is joined with later words of the line's prefix
#: until the key is expected in no more, so the groups do not grow with the corpus.
RARE = 512
#: A key has at most so many words.
DEEPEST = 4
NO_ID = -(2**63)
_ROW = ["token", "line", "size", "pos", "small", "sketch"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]


def row_key(row_id: Column, text: Column) -> Column:
    """What tells rows apart that share an id, or have none: a hash of id and text. Equal rows have the same."""
    return F.xxhash64(F.coalesce(row_id.cast("long"), F.lit(NO_ID)), F.coalesce(text.cast("string"), F.lit("")))


def _line_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word of a batch its hash, the number of its line in the batch, and that line's number in its text."""
    w = hashed(column)
    breaks = np.flatnonzero(w.data[: w.bounds[-1]] == 10)
    before = np.searchsorted(breaks, w.start)
    number = before - np.searchsorted(breaks, w.bounds[:-1])[w.text]
    return w.hashes, before + w.text, number, w.text


def _count(hashes: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return rarity[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)


def _by_line(line: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by ``line`` (which ascends), ``rank`` and ``h``: one sort of line and highest bits of rank, unless these tie for two words."""
    bits = np.uint64(max(int(line[-1]).bit_length(), 1) if len(line) else 1)
    both = line.astype(np.uint64) << (np.uint64(64) - bits) | rank >> bits
    order = np.argsort(both)
    tied = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    return np.lexsort((h, rank, line)) if (h[order[tied]] != h[order[tied + 1]]).any() else order


def _line_sets(column: pa.Array, rarity: np.ndarray | None = None):
    """The distinct words of every line, line by line, rarest first if counts are given.

    Gives the sorted words, the first place of every line among them, the lines' sizes, rows and numbers.
    """
    h, line, number, row = _line_words(column)
    rank = h if rarity is None else np.minimum(_count(h, rarity), MOST) << np.uint64(40) | h & np.uint64((1 << 40) - 1)
    order = _by_line(line, rank, h)
    h, line, rank = h[order], line[order], rank[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    kept = np.flatnonzero(fresh)
    h, line, rank, order = h[kept], line[kept], rank[kept], order[kept]
    first = np.flatnonzero(np.diff(line, prepend=-1)) if len(h) else np.array([], dtype=np.int64)
    size = np.diff(np.append(first, len(h)))
    return h, rank, first, size, row[order[first]], number[order[first]]


def _added(parts: DataFrame, bits: int, kind: str) -> np.ndarray:
    """A table of ``2 ** bits`` numbers of the given kind, the sum of the rows' ``places`` and ``values`` in each ``part``."""
    length = 1 << bits - PART_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, values in zip(*(batch.column(c).to_pylist() for c in ("part", "places", "values")), strict=True):
                total = sums.setdefault(part, np.zeros(length, dtype=np.uint64))
                # A row's places differ.
                total[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(values, dtype=np.uint32)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.minimum(total, np.iinfo(kind).max).astype(kind).tobytes()], pa.binary())], ["part", "sums"]
            )

    table = np.zeros(1 << bits, dtype=kind)
    found = parts.repartition(1 << PART_BITS, "part").mapInArrow(add, "part int, sums binary").toArrow()
    for part, sums in zip(found["part"].to_pylist(), found["sums"].to_pylist(), strict=True):
        table[part * length : (part + 1) * length] = np.frombuffer(sums, dtype=kind)
    return table


def _rare_counts(texts: DataFrame, least: int) -> tuple[DataFrame, np.ndarray]:
    """A written table of all lines (``id, row, no, size, line``) and the words' counts by bucket."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
        names = ["id", "row", "no", "size", "line", "part", "places", "values"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            h, _, first, size, row, number = _line_sets(batch.column("text"))
            np.add.at(counts, (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
            if not len(first):
                continue
            # The set's name: a sum over its words, so their order does not matter.
            line = np.add.reduceat(mixed(h), first)
            long = size >= least
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            arrays = [pa.array(ids[row[long]]), pa.array(keys[row[long]]), pa.array(number[long], pa.int32()), pa.array(size[long], pa.int32()), pa.array(line[long].view(np.int64))]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(arrays[0]), t) for t in types[5:])], names)
        for part, own in enumerate(counts.reshape(1 << PART_BITS, -1)):
            used = np.flatnonzero(own)
            if len(used):
                arrays = [pa.nulls(1, t) for t in types[:5]]
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (used.astype(np.uint16), own[used])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part], pa.int32()), *packed], names)

    schema = "id long, row long, no int, size int, line long, part int, places binary, values binary"
    seen = written(mapped(texts, collect, schema, rows=500, size=SLICE_BYTES), "lines")
    counts = _added(seen.where("line IS NULL").select("part", "places", "values"), BUCKET_BITS, "uint32")
    return seen.where("line IS NOT NULL").select("id", "row", "no", "size", "line"), counts


def _prefixes(texts: DataFrame, rarity: np.ndarray, n_lines: int, percent: int, least: int) -> DataFrame:
    """``token, line, size, pos, small, sketch``: keys from the rarest words of every line, of which similar lines share one.

    A line looks for partners of at most its size by its first ``size - ceil(t * size) + 1`` words; partners that are as
    long or longer find it by fewer (``small``), as equal sizes need a larger overlap. Similar lines that must share k words
    have the first k shared ones within k - 1 more words, so a frequent word is joined with the next ones: the rule
    depends on the words' counts alone, hence both lines have the key. ``pos`` is the last word's place less the words
    before it in the key. Short lines that only equal sets can be similar to have no rows. ``line`` is the set's name; ``sketch``
    has a bit for each of 64 classes of words, set where the line has an odd number of them; the highest 24 bits of
    ``token`` are the count of its rarest word, which bounds the key's. A word counted once is no key: no other line has it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, rank, first, size, _, _ = _line_sets(batch.column("text"), rarity)
            if not len(first):
                continue
            probe = size - -(-percent * size // 100) + 1
            index = size - -(-2 * percent * size // (100 + percent)) + 1
            overlap = -(-percent * size // 100)
            place = np.arange(len(h)) - np.repeat(first, size)
            line = np.repeat(np.arange(len(first)), size)
            name = np.add.reduceat(mixed(h), first).view(np.int64)
            sketch = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), first).view(np.int64)
            alone = (percent * (size + 1) > 100 * size) & (percent * size > 100 * (size - 1)) & (percent * (size + 1) > 100 * (size - 1))
            count = _count(h, rarity).astype(np.float64)
            last = np.flatnonzero((place < probe[line]) & (size >= least)[line] & ~alone[line] & (count > 1))
            key, expected, top = rank[last], count[last], rank[last] >> np.uint64(40) << np.uint64(40)
            found = []
            for depth in range(1, DEEPEST + 1):
                own = line[last]
                # Lines that may have to share no more words than the key has keep it; they have the longer keys too.
                few = overlap[own] <= depth
                ends = few | (expected <= RARE) if depth < DEEPEST else np.ones(len(last), dtype=bool)
                pos = place[last] - (depth - 1)
                found.append((key[ends], own[ends], pos[ends]))
                more = (expected > RARE) & (depth < DEEPEST)
                last, key, expected, top, own = last[more], key[more], expected[more], top[more], own[more]
                left = np.minimum(probe[own] + depth, size[own]) - 1 - place[last]
                at = np.repeat(np.arange(len(last)), left)
                last = last[at] + np.arange(len(at)) - np.repeat(np.cumsum(left) - left, left) + 1
                top = top[at]
                key = top | mixed(key[at] ^ mixed(h[last])) >> np.uint64(24)
                expected = expected[at] * count[last] / max(n_lines, 1)
            key, own, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)), pa.array(name[own]), pa.array(size[own], pa.int32()),
                    pa.array(pos, pa.int32()), pa.array(pos < index[own], pa.bool_()), pa.array(sketch[own]),
                ],
                _ROW,
            )

    return mapped(texts, emit, "token long, line long, size int, pos int, small boolean, sketch long", rows=500, size=SLICE_BYTES)


def _may_match(x: str, y: str, percent: int) -> Column:
    """Length, position and prefix filters for two lines that share the word at ``pos`` of each; and one by their sketches.

    A word that only one line has turns one bit of a sketch, so similar lines differ in few bits; unlike ones in half.
    """
    f = lambda side, name: F.col(f"{side}.{name}")
    small = F.least(f(x, "size"), f(y, "size"))
    total = f(x, "size") + f(y, "size")
    bound = F.least(f(x, "size") - f(x, "pos"), f(y, "size") - f(y, "pos"))
    shorter = F.when(f(x, "size") < f(y, "size"), f(x, "small")).when(f(x, "size") > f(y, "size"), f(y, "small")).otherwise(f(x, "small") & f(y, "small"))
    turned = F.bit_count(f(x, "sketch").bitwiseXOR(f(y, "sketch")))
    alike = (100 + percent) * turned <= (100 - percent) * total
    return alike & (100 * small >= percent * (total - small)) & ((100 + percent) * bound >= percent * total) & shorter


def _rare_pairs(c: dict[str, np.ndarray], percent: int) -> list[np.ndarray]:
    """The names of the two lines, smaller ones first, of the pairs that share a key and pass the filters; equal keys lie together.

    A line is named by ``line``, or by ``id, no``.
    """
    names = [k for k in ("line", "id", "no") if k in c]
    found = [[] for _ in (*names, *names)]
    token, size, sketch = (c[k] for k in ("token", "size", "sketch"))
    reach = size - c["pos"]
    i, step = np.arange(len(token)), 0
    while len(i):
        step += 1
        i = i[i + step < len(token)]
        i = i[token[i] == token[i + step]]
        turned = np.bitwise_count((sketch[i] ^ sketch[i + step]).view(np.uint64)).astype(np.int64)
        x = i[(100 + percent) * turned <= (100 - percent) * (size[i] + size[i + step])]
        y = x + step
        total, small = size[x] + size[y], np.minimum(size[x], size[y])
        shorter = (c["small"][x] | (size[x] > size[y])) & (c["small"][y] | (size[y] > size[x]))
        kept = (100 * small >= percent * (total - small)) & ((100 + percent) * np.minimum(reach[x], reach[y]) >= percent * total) & shorter
        x, y = x[kept], y[kept]
        swap, apart = (np.zeros(len(x), dtype=bool) for _ in range(2))
        for k in reversed(names):
            swap = (c[k][x] > c[k][y]) | ((c[k][x] == c[k][y]) & swap)
            apart |= c[k][x] != c[k][y]
        for out, name, other in zip(found, names * 2, np.repeat((False, True), len(names)), strict=True):
            out.append(np.where(swap != other, c[name][y], c[name][x])[apart])
    return [np.concatenate(f) if f else np.array([], dtype=np.int64) for f in found]


def _met(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of lines that share a key of at most ``RARE`` lines (``line`` and ``other``, no ``token``), and the rows of other keys as they are.

    A key's rows meet in one task, which passes on those of a larger group as they come; rows of words that stand in more than
    ``lapcast.blockRows`` lines are dealt over all tasks and passed on.
    """
    limit = min(block_rows(prefixes.sparkSession), int(MOST) - 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: dict[str, np.ndarray], large: np.ndarray) -> Iterator[pa.RecordBatch]:
            if large.any():
                columns = [pa.array(c[k][large]).cast(t) for k, t in zip(_ROW, _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.int64())], [*_ROW, "other"])
            x, y = _rare_pairs({k: v[~large] for k, v in c.items()}, percent)
            pairs = np.unique(np.stack([x, y]), axis=1) if len(x) else np.zeros((2, 0), dtype=np.int64)
            blank = [pa.nulls(pairs.shape[1], t) for t in _TYPES[2:]]
            yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), *blank, pa.array(pairs[1])], [*_ROW, "other"])

        def groups(c: dict[str, np.ndarray], over: int | None) -> np.ndarray:
            first = np.flatnonzero(np.append(True, c["token"][1:] != c["token"][:-1]))
            count = np.diff(np.append(first, len(c["token"])))
            large = (count > RARE) | (c["token"][first].view(np.uint64) >> np.uint64(40) > limit)
            large[0] |= over is not None and c["token"][0] == over
            return np.repeat(large, count)

        parts, held, over = [], 0, None
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _ROW}
            parts.append(c | {k: c[k].astype(np.int64) for k in ("size", "pos")})
            held += batch.num_rows
            if held < 1 << 17:
                continue
            c = {k: np.concatenate([p[k] for p in parts]) for k in _ROW}
            large = groups(c, over)
            # The last key's rows may go on in the next batch; those of a group known as large go out at once.
            cut = len(large) if large[-1] else int(np.argmax(c["token"] == c["token"][-1]))
            over = int(c["token"][-1]) if large[-1] else None
            yield from out({k: v[:cut] for k, v in c.items()}, large[:cut])
            parts, held = [{k: v[cut:] for k, v in c.items()}], len(large) - cut
        if held:
            c = {k: np.concatenate([p[k] for p in parts]) for k in _ROW}
            yield from out(c, groups(c, over))

    often = F.shiftrightunsigned("token", 40) > limit
    placed = prefixes.repartition("token", F.when(often, F.col("line")).otherwise(0)).sortWithinPartitions("token")
    schema = "token long, line long, size int, pos int, small boolean, sketch long, other long"
    return mapped(placed.select(*_ROW), meet, schema, rows=20_000)


def _wanted(names: DataFrame) -> np.ndarray:
    """A table of ``2 ** WANTED_BITS`` bits, eight to a byte, with those set that the lines' names hash to."""
    length = 1 << WANTED_BITS - PART_BITS - 3

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _bit(batch.column("line").to_numpy())
            for part in np.unique(at >> (WANTED_BITS - PART_BITS)).tolist():
                own = at[at >> (WANTED_BITS - PART_BITS) == part] & ((1 << WANTED_BITS - PART_BITS) - 1)
                bits = marks.setdefault(part, np.zeros(length, dtype=np.uint8))
                np.bitwise_or.at(bits, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        for part, bits in marks.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    table = np.zeros(length << PART_BITS, dtype=np.uint8)
    parts = names.repartition(1 << PART_BITS, F.shiftrightunsigned("line", 64 - PART_BITS))
    found = parts.mapInArrow(mark, "part int, bits binary").toArrow()
    for part, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        table[part * length : (part + 1) * length] |= np.frombuffer(bits, dtype=np.uint8)
    return table


def _bit(line: np.ndarray) -> np.ndarray:
    return (line.view(np.uint64) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)


def _words_of(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``line, words``: the names and distinct words, as hashes, of the lines whose names have their bit in ``wanted``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _, first, size, _, _ = _line_sets(batch.column("text"))
            if not len(first):
                continue
            line = np.add.reduceat(mixed(h), first).view(np.int64)
            bit = _bit(line)
            once = np.zeros(len(line), dtype=bool)
            once[np.unique(line, return_index=True)[1]] = True
            kept = np.flatnonzero(once & (wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & np.uint8(1)).astype(bool))
            words = h[np.repeat(first[kept] - np.cumsum(size[kept]) + size[kept], size[kept]) + np.arange(size[kept].sum())]
            ends = pa.array(np.append(0, np.cumsum(size[kept])), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(line[kept]), pa.ListArray.from_arrays(ends, pa.array(words.view(np.int64)))], ["line", "words"])

    return mapped(texts, emit, "line long, words array<long>", rows=500, size=SLICE_BYTES)


def _similar(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (early, late) whose sets of words have the Jaccard similarity, compared on all words by their 64-bit hashes.

    Texts stay where they are: a task sends only the words of lines that may be in a pair, once for each name.
    """
    names = pairs.select(F.explode(F.array("early.line", "late.line")).alias("line"))
    sets = _words_of(texts, _wanted(names)).dropDuplicates(["line"])
    side = lambda name: sets.select(F.col("line").alias(f"{name}_line"), F.col("words").alias(f"{name}_words"))
    both = pairs
    for name in ("early", "late"):
        both = both.join(side(name), F.col(f"{name}.line") == F.col(f"{name}_line"))
    common = F.size(F.array_intersect("early_words", "late_words"))
    union = F.size("early_words") + F.size("late_words") - common
    return both.where(100 * common >= percent * union).select("early", "late")


def later_lines(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``id, row, nos``: per row, told by id and ``row_key``, the lines (numbers from 0, sorted) that an earlier line of the corpus is similar to.

    Lines are cut at line feeds and compared as sets of words, A-Z as a-z; lines of fewer than ``least`` distinct
    words never match. Earlier is by id, then by ``row_key`` where rows with different texts share an id, then by line number;
    null ids come first, under the id ``NO_ID``. Null and empty texts have no lines. Rows with equal id and text are no earlier
    than each other: all lose the same lines. A line is removed also when the earlier line itself goes.

    Equal sets are found first, by a grouping that combines before it shuffles, so only the first line of every set
    enters the join. Lines that share a key of at most ``RARE`` lines meet in one pass over the key's rows; of a more
    frequent key every line meets the key's earliest one. Each line is verified against its earliest candidate first,
    and only lines without that match against the others, so a bucket of variants of one line costs its length.
    """
    with scratch(), small_batches(df.sparkSession):
        return _later(df, key, text, percent, least)


def _later(df: DataFrame, key: str, text: str, percent: int, least: int) -> DataFrame:
    texts = id_and_text(df, key, text).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), row_key(F.col("id"), F.col("text")).alias("row"), "text")
    lines, rarity = _rare_counts(texts, least)
    at = F.struct("id", "row", "no")
    firsts = written(lines.groupBy("line", "size").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("_n")), "lines-firsts")
    repeated = firsts.where("_n > 1")
    again = salted_join(lines, repeated.drop("_n"), ["line", "size"], sizes=repeated.select("line", "size", "_n"))
    equal = written(again.where(at > F.col("first")).select("id", "row", "no").distinct(), "lines-equal")

    gone = equal.groupBy("id", "row").agg(F.collect_set("no").alias("gone"))
    held = lookup_join(texts, gone, ["id", "row"], "left")
    blank = lambda l, i: F.when(F.array_contains("gone", i), "").otherwise(l)
    rest = held.select("id", "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.split("text", "\n"), blank), "\n")).alias("text"))
    gathered = written(_met(_prefixes(rest, rarity, lines.count(), percent, least), percent), "lines-met")
    place = lambda name: firsts.select(F.col("line").alias(name), F.struct("first.id", "first.row", "first.no", "line").alias(f"at_{name}"))
    close = gathered.where("token IS NULL").select(F.col("line").alias("x"), F.col("other").alias("y")).distinct()
    close = close.join(place("x"), "x").join(place("y"), "y").where("at_x <> at_y")
    close = written(close.select(F.least("at_x", "at_y").alias("early"), F.greatest("at_x", "at_y").alias("late")), "lines-close")

    often = gathered.where("token IS NOT NULL").drop("other").join(place("line"), "line")
    often = often.select("token", F.struct("at_line.id", "at_line.row", "at_line.no", "size", "pos", "small", "sketch", "line").alias("l"))
    heads = written(often.groupBy("token").agg(F.min("l").alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "lines-heads")
    rows = salted_join(often, heads.drop("_n"), ["token"], sizes=heads.select("token", "_n")).select("token", "l", "head")
    rows = written(rows, "lines-prefixes")

    place = lambda side: F.struct(*[F.col(f"{side}.{k}").alias(k) for k in ("id", "row", "no", "line")])
    pair = lambda df, e, l: df.select(place(e).alias("early"), place(l).alias("late")).distinct()
    starred = rows.where((place("head") < place("l")) & _may_match("head", "l", percent))
    nearest = close.groupBy("late").agg(F.min("early").alias("early"))
    tried = written(pair(starred, "head", "l").unionByName(nearest).distinct(), "lines-pairs")
    found = written(_similar(texts, tried, percent).select("late").distinct(), "lines-similar")

    matched = found.select(F.col("late.id").alias("_i"), F.col("late.row").alias("_r"), F.col("late.no").alias("_n"))
    mine = (F.col("l.id") == F.col("_i")) & (F.col("l.row") == F.col("_r")) & (F.col("l.no") == F.col("_n"))
    open_rows = rows.where(place("head") < place("l")).join(matched, mine, "left_anti").select("token", "l", "head")
    others = rows.select("token", F.col("l").alias("e"))
    met = open_rows.join(others, "token").where((place("head") < place("e")) & (place("e") < place("l")) & _may_match("e", "l", percent))
    unmatched = close.join(found, "late", "left_anti")
    fresh = written(pair(met, "e", "l").unionByName(unmatched).distinct().join(tried, ["early", "late"], "left_anti"), "lines-pairs")
    late = found.unionByName(_similar(texts, fresh, percent).select("late"))
    every = equal.unionByName(late.select("late.id", "late.row", "late.no")).distinct()
    return written(every.groupBy("id", "row").agg(F.sort_array(F.collect_list("no")).alias("nos")), "lines-late", keep=True)


def without_later_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", percent: int = PERCENT, least: int = LEAST_WORDS
) -> DataFrame:
    """The rows without the lines that ``later_lines`` tells; the input's columns.

    ``length``, if it is a column, is set to the new text's code points. A row that loses lines and keeps no word goes;
    rows that lose none stay untouched, also null and empty ones.
    """
    fields = df.columns
    marked = df.select(
        F.struct(*[df[c] for c in fields]).alias("_row"), F.coalesce(df[key].cast("long"), F.lit(NO_ID)).alias("_id"), df[text].cast("string").alias("_text"),
        row_key(df[key], df[text]).alias("_key"),
    )
    late = later_lines(df, key, text, percent, least).withColumnsRenamed({"id": "_id", "row": "_key"})
    joined = lookup_join(marked, late, ["_id", "_key"], "left")
    kept = F.filter(F.split("_text", "\n"), lambda line, i: ~F.array_contains("nos", i))
    new = F.when(F.col("nos").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("_new", new).where(F.col("nos").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    shown = [
        F.col("_new").alias(c) if c == text
        else F.when(F.col("nos").isNull(), F.col("_row")[c]).otherwise(F.char_length("_new").cast(df.schema[c].dataType)).alias(c) if c == length
        else F.col("_row")[c].alias(c)
        for c in fields
    ]
    return out.select(*shown)
