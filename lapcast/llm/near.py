"""Near-duplicate documents by HyperMinHash: compressed registers are banded, compared with collisions taken off, and verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.common import SLICE_BYTES, id_and_text, mapped
from lapcast.llm.graph import components
from lapcast.llm.hashing import hashed, mixed, shingles
from lapcast.plans.skew import lookup_join, salted_join
from lapcast.session import small_batches, written

WIDTH = 5
#: A register is 16 bits: the number of leading zeros plus one, and the next ten bits; 0 is an empty bucket.
REGISTERS, MANTISSA = 256, 10
#: 42 bands of 6 registers miss a pair of similarity 0.85 with a chance of (1 - 0.85 ** 6) ** 42 < 3e-9.
BANDS, ROWS = 42, 6
#: Two unlike registers agree by chance this often.
CHANCE = 2.0**-MANTISSA / 3
#: Pairs whose estimate is this far below the threshold are not verified: over six standard errors of 256 registers.
MARGIN = 0.15
#: Fewer filled registers than this say too little for an estimate; the bound on unlike registers still holds.
TOLD = 128
#: The lowest bits of a register that travel with a row while pairs are looked for.
CODE_BITS = 4
#: Where each register looks for a value when it is empty itself: an order of all registers of its own.
PROBES = np.argsort(mixed(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=0)
CODES = [f"code{i}" for i in range(CODE_BITS * REGISTERS // 64)]
PERCENT = 85


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set of sorted distinct 64-bit hashes."""
    out = np.zeros(REGISTERS, dtype="<u2")
    bucket = (sorted_hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = sorted_hashes[first] << np.uint64(8) | np.uint64(255)
    bits = np.frexp((low >> np.uint64(11)).astype(np.float64))[1].astype(np.int64) + 11
    zeros = np.minimum(64 - bits, 62)
    tail = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = ((zeros + 1) << MANTISSA | tail.astype(np.int64)).astype("<u2")
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Estimated Jaccard similarity of two register sets, chance agreements taken off; and the filled registers."""
    filled = int(np.count_nonzero((a > 0) | (b > 0)))
    if not filled:
        return 0.0, 0
    share = int(np.count_nonzero((a == b) & (a > 0))) / filled
    return max(0.0, (share - CHANCE) / (1 - CHANCE)), filled


def codes(register_rows: np.ndarray) -> list[np.ndarray]:
    """The lowest bits of every register of each row as 64-bit numbers, those of one bit of all registers together."""
    bits = [np.packbits((register_rows >> k & 1).astype(bool), axis=1).view(np.int64) for k in range(CODE_BITS)]
    return [half[:, i] for half in bits for i in range(REGISTERS // 64)]


def band_keys(register_rows: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of each row.

    An empty register first takes the value of the first filled one in its own order of registers, so bands of short
    documents too consist of ``ROWS`` values; two rows agree in such a register as often as in others, by their similarity.
    """
    full = register_rows.copy()
    row, at = np.nonzero((register_rows == 0) & (register_rows > 0).any(axis=1)[:, None])
    for probe in PROBES:
        if not len(row):
            break
        value = register_rows[row, probe[at]]
        full[row, at] = value
        row, at = row[value == 0], at[value == 0]
    keys = np.empty((len(full), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        h = np.full(len(full), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            h = mixed(h << np.uint64(16) ^ h >> np.uint64(48) ^ full[:, i].astype(np.uint64))
        keys[:, band] = h
    return keys.view(np.int64)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two rows with ``n`` and ``CODES`` may be a link, told by the registers whose codes differ.

    Every register that differs takes an element of its own that only one set has, and links have few of those: for
    small sets this bound is exact and sharp. Beside it stands the number that codes of a link exceed by chance only,
    five standard errors above what is expected when one in sixteen unlike registers has a like code.
    """
    lanes = REGISTERS // 64
    changed = lambda i: F.col(f"{a}.{CODES[i]}").bitwiseXOR(F.col(f"{b}.{CODES[i]}"))
    turned = lambda i: reduce(lambda x, y: x.bitwiseOR(y), [changed(i + k * lanes) for k in range(CODE_BITS)])
    unlike = reduce(lambda x, y: x + y, [F.bit_count(turned(i)) for i in range(lanes)])
    q = (1 - 2.0**-CODE_BITS) * (1 - percent / 100)
    chance = REGISTERS * q + 5 * (REGISTERS * q * (1 - q)) ** 0.5
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & ((100 + percent) * unlike <= (100 - percent) * (n_a + n_b)) & (unlike <= chance)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For every text of a batch its sorted distinct shingle hashes."""
    w = hashed(column)
    for lo, hi in zip(*w.of_rows(), strict=True):
        yield np.unique(shingles(w.hashes[lo:hi], WIDTH))


def sketches(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n, d1, d2, registers, bands`` and ``CODES``: size of the shingle set, 128 bits that name the set, its registers and band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, regs = [], [], [], []
            if not batch.num_rows:
                continue
            for s in _sets(batch.column("text")):
                n.append(len(s))
                d1.append(np.add.reduce(mixed(s)) if len(s) else np.uint64(0))
                d2.append(np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0))
                regs.append(registers(s).tobytes() if len(s) else bytes(2 * REGISTERS))
            longs = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            found = np.frombuffer(b"".join(regs), dtype="<u2").reshape(-1, REGISTERS)
            bits, keys = codes(found), band_keys(found)
            keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), longs(d1), longs(d2), pa.array(regs, pa.binary()), keys, *map(pa.array, bits)],
                ["id", "n", "d1", "d2", "registers", "bands", *CODES],
            )

    schema = "id long, n long, d1 long, d2 long, registers binary, bands array<long>, " + ", ".join(f"{c} long" for c in CODES)
    return mapped(id_and_text(df, key, text), sketch, schema, rows=500, size=SLICE_BYTES)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that really are links, confirmed on full shingle sets.

    A pair is first estimated from the registers. Then each ``b`` travels with its text to its ``a``; an ``a`` with
    many partners is dealt over salts, and a task holds one set of an ``a`` at a time.
    """
    regs = nodes.select("node", "n", "registers")
    side = lambda c: regs.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    )

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, total in zip(*(batch.column(c).to_pylist() for c in ("r_a", "r_b", "total")), strict=True):
                x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                j, filled = similarity(x, y)
                possible = (100 + percent) * np.count_nonzero(x != y) <= (100 - percent) * total
                keep.append(bool(possible and (filled < TOLD or j >= percent / 100 - MARGIN)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    told = sized.select("a", "b", "r_a", "r_b", (F.col("n_a") + F.col("n_b")).alias("total"))
    close = written(told.mapInArrow(estimate, "a long, b long"), "near-close")
    salts = close.groupBy("a").agg(F.count(F.lit(1)).alias("k")).select("a", F.ceil(F.col("k") / 256).cast("int").alias("salts"))
    dealt = close.join(salts, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("salts")))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    known = texts.select(F.col("id").alias("t"), "text")
    members = dealt.join(known, dealt["b"] == known["t"]).select("a", "salt", "b", "text")
    centres = heads.join(known, heads["a"] == known["t"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, np.array([], dtype=np.uint64)
        for batch in batches:
            found = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _sets(batch.column("text")), strict=True):
                if b is None:
                    head, held = a, s
                elif a == head and len(s):
                    common = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * common >= percent * (len(held) + len(s) - common):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    placed = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return mapped(placed, confirm, "a long, b long", rows=500, size=SLICE_BYTES)


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id, n, component`` (smallest id reachable over links, its own without any).

    Texts with equal shingle sets are one class, and classes are linked when ``100 * common >= percent * union`` on full sets.
    Null and empty texts have ``n`` 0 and no links; a text of fewer than five words has one shingle. Ids are taken to
    name documents: rows that repeat an id share one component. Rows with a null id join the class of their text under
    its smallest id, and have a null component if none is there. Only the two named columns are read.

    In every bucket each class is compared with the bucket's smallest one, then with three others, among them the one that shares most buckets with others, and only pairs
    that are still in different components after that are compared one by one, once for all their buckets and by the codes
    of their registers first; so a bucket of copies costs its length.
    """
    with small_batches(df.sparkSession):
        return _linked(df, key, text, percent)


def _linked(df: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    rows = written(sketches(df, key, text), "near-sketch")
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("_n"))
    classes = written(classes, "near-classes")
    heads = classes.select(F.col("node").alias("id"), "d1", "d2")
    heads = rows.join(heads, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"])
    nodes = written(heads.select(F.col("id").alias("node"), "n", "registers", "bands", *CODES), "near-nodes")

    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    hubs = [F.min("node").alias("h0")]
    hubs += [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("x"), "node"))["node"].alias(f"h{k}") for k in (1, 2)]
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *hubs).where("size > 1")
    shared = written(keyed.join(crowds, "key"), "near-buckets")
    # The text that others were made from shares more buckets with them than they do with each other.
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))

    pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct()
    first = pair(shared, "h0", "node")
    texts = id_and_text(df, key, text)

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        mine = lookup_join(texts, wanted, ["id"]).groupBy("id").agg(F.min("text").alias("text"))
        return written(verified(pairs, nodes, mine, percent), "near-links")

    links = confirmed(written(first, "near-pairs"))
    groups = components(links, "a", "b")
    tried = first
    for others in (["h1", "h2", "h3"], None):
        placed = _grouped(shared, groups)
        mixed_keys = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
        left = placed.join(mixed_keys, "key")
        if others:
            popular = left.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("h3"))
            left = left.join(popular, "key")
            found = left.select("node", "group", F.explode(F.array(*others)).alias("hub"))
            named = groups.select(F.col("node").alias("hub"), F.col("component").alias("hub_group"))
            found = found.distinct().join(named, "hub", "left").where("group <> coalesce(hub_group, hub)")
            fresh = pair(found, "hub", "node")
        else:
            fresh = _bucket_pairs(left, nodes, percent).distinct()
        fresh = written(fresh.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        links = links.unionByName(confirmed(fresh))
        groups = components(links, "a", "b")
        tried = tried.unionByName(fresh)

    members = classes.join(groups, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    worded = rows.where("n > 0").select("id", "n", "d1", "d2")
    found = salted_join(worded, members, ["d1", "d2"], sizes=classes.select("d1", "d2", "_n"))
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return found.select("id", "n", "component").unionByName(alone)


def _grouped(shared: DataFrame, groups: DataFrame) -> DataFrame:
    return shared.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")


def _bucket_pairs(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of different groups that share a bucket and may be links, each once; ``placed`` has ``key, node, group``.

    Rows know all their buckets, so a pair is made in its first common one only, not in each of up to ``BANDS``.
    Nothing inside a bucket's largest group needs comparing, only the others with all.
    """
    counted = placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("k"))
    major = counted.groupBy("key").agg(F.max(F.struct("k", "group"))["group"].alias("major"))
    keys = placed.groupBy("node").agg(F.collect_set("key").alias("keys"))
    code = nodes.join(keys, "node").select("node", F.struct("node", "n", "keys", *CODES).alias("code"))
    coded = placed.select("key", "node", "group").join(code, "node").join(major, "key")
    x = coded.select("key", F.col("code").alias("x"), F.col("group").alias("gx"), "major")
    y = coded.where("group <> major").select("key", F.col("code").alias("y"), F.col("group").alias("gy"))
    apart = (F.col("gx") != F.col("gy")) & ((F.col("gx") == F.col("major")) | (F.col("gx") < F.col("gy")))
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("key")
    met = x.join(y, "key").where(apart & may_link("x", "y", percent) & first)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows without those whose component has a smaller id; rows with a null id stay."""
    dropped = linked(df, key, text, percent).where("id <> component").select(F.col("id").alias("_dropped")).distinct()
    fields = df.columns
    marked = df.select(F.struct(*[df[c] for c in fields]).alias("_row"), df[key].cast("long").alias("_dropped"))
    return lookup_join(marked, dropped, ["_dropped"], "left_anti").select("_row.*")
