"""A Katz backoff model of word pairs: Good-Turing discounts, exactly normalised backoff weights, scores for every text.

A pair that training holds has its discounted share of its context; any other token backs off to the word model, which
discounts in the same way and backs off once more, to a uniform share of what words never seen are left with. All counts
are exact and of all training texts, and every word has its own, however seldom it is. Words, pairs and contexts are
written tables, keyed by a 64-bit hash. Occurrences are shuffled once, as packed runs dealt by context: a task counts the
pairs of its contexts and scores their occurrences from the same run. What it cannot know, probabilities of seldom words
and backoff weights of their contexts, is joined from the tables. Only frequent words are held by tasks and driver: those
with a share of at least 1 / ``FREQUENT``, of which there cannot be more than ``FREQUENT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.common import id_and_text, mapped
from lapcast.llm.hashing import hashed, mixed
from lapcast.session import written

#: Pairs seen at most so often are discounted.
TOP = 5
#: Words with this share of all tokens, or more, are known to every task.
FREQUENT = 1 << 20
#: Tokens that one task counts at a time.
PART_TOKENS = 3_000_000
#: A pair this frequent, and with at least this share of all pairs, is counted and scored where it is read.
HOT_PAIR, HOT_SHARE = 200_000, 1 << 14
#: Texts in one run, and rows in one batch of results.
ROWS, OUT = 1500, 50_000

_COUNTS = [f"m{r}" for r in range(1, TOP + 2)]

_END, _START = np.uint64(0xE2D), np.uint64(0x57A27)
_BITS = np.uint64(32)
#: Set in the key of every word, so that keys and the small numbers of frequent words differ.
_WORD = np.uint64(1 << 63)


@dataclass
class Lexicon:
    """The frequent words' keys in order and the training counts of all classes: these words, then the end.

    ``d`` and ``whole`` give the word model: a word seen c times has ``d[c] c / whole``, and ``left`` is what the words
    never seen share.
    """

    keys: np.ndarray
    counts: np.ndarray
    spread: np.ndarray
    tokens: int
    distinct: int
    d: np.ndarray
    whole: float
    left: float

    @property
    def end(self) -> int:
        return len(self.keys)

    @property
    def start(self) -> int:
        return len(self.keys) + 1

    @property
    def unseen(self) -> float:
        """The probability of a word never seen: of V + 1 such words each has the same."""
        return self.left / (max(self.distinct, 1) + 1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """The add-one model's log10 probability of words with the given counts."""
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        """The word model's probability of words with the given counts."""
        cut = np.append(np.append(1.0, self.d), 1.0)[np.minimum(counts, TOP + 1)]
        return np.where(counts > 0, cut * counts / self.whole, self.unseen)

    def p_column(self, n: Column) -> Column:
        """``p`` as a column expression; a null count is 0."""
        value = F.when(F.coalesce(n, F.lit(0)) == 0, self.unseen)
        for r, x in enumerate(self.d, 1):
            value = value.when(n == r, float(x) * r / self.whole)
        return value.otherwise(n / self.whole)


@dataclass
class Tokens:
    """The tokens of a batch: class or key of every token and of the one before, its text, and a 64-bit name of every text."""

    before: np.ndarray
    token: np.ndarray
    text: np.ndarray
    names: np.ndarray
    lengths: np.ndarray


def _with_ends(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, end, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text's values followed by ``end``; the value before each (``start`` at first); and the text of each."""
    rows = np.arange(len(lo))
    is_end = np.zeros(len(values) + len(lo), dtype=bool)
    is_end[hi + rows] = True
    token = np.empty(len(is_end), dtype=values.dtype)
    token[~is_end], token[is_end] = values, end
    before = np.roll(token, 1)
    before[lo + rows] = start
    return before, token, np.repeat(rows, hi - lo + 1)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids as unsigned numbers; a null id gets a number of its own, far from usual ids."""
    return batch.column("id").fill_null(-(2**63) + 12345).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _tokens(batch: pa.RecordBatch, lexicon: Lexicon) -> Tokens:
    w = hashed(batch.column("text"))
    lo, hi = w.of_rows()
    before, token, text = _with_ends(_class_of(w.hashes | _WORD, lexicon.keys), lo, hi, np.uint64(lexicon.end), np.uint64(lexicon.start))
    place = np.arange(len(w.hashes)) - lo[w.text]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(w.hashes ^ mixed(place.astype(np.uint64))))))
    names = mixed(mixed(_ids(batch)) ^ (sums[hi] - sums[lo]) ^ (hi - lo).astype(np.uint64))
    return Tokens(before, token, text, names, hi - lo + 1)


def _class_of(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The class of frequent words, the key of all others."""
    if not len(frequent):
        return keys
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    return np.where(frequent[at] == keys, at.astype(np.uint64), keys)


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    texts = id_and_text(df, key, text)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(7)) == 2
    return texts.withColumn("held_out", held_out)


def _unigrams(texts: DataFrame) -> DataFrame:
    """A written table ``a, b, n, every``: training and all occurrences of words (b null), and all of pairs frequent in some batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            w = hashed(batch.column("text"))
            before, token, text = _with_ends(w.hashes | _WORD, *w.of_rows(), _END, _START)
            out = held_out[text]
            learnt, n = np.unique(token[~out], return_counts=True)
            other, o = np.unique(token[out], return_counts=True)
            # Pairs with a large enough share of the batch: first by coarse buckets, then exactly.
            least = max(2, 2 * len(token) // HOT_SHARE)
            pair = mixed(before ^ mixed(token))
            coarse = (pair >> np.uint64(48)).astype(np.int64)
            often = np.flatnonzero(np.bincount(coarse, minlength=1 << 16)[coarse] >= least)
            _, first, c = np.unique(pair[often], return_index=True, return_counts=True)
            first, c = often[first[c >= least]], c[c >= least]
            a = np.concatenate((learnt, other, before[first])).view(np.int64)
            b = pa.concat_arrays([pa.nulls(len(n) + len(o), pa.int64()), pa.array(token[first].view(np.int64))])
            trained = np.concatenate((n, np.zeros(len(o) + len(c), dtype=np.int64)))
            columns = [pa.array(a), b, pa.array(trained, pa.int64()), pa.array(np.concatenate((n, o, c)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "every"])

    counted = mapped(texts, count, "a long, b long, n long, every long", ROWS).groupBy("a", "b")
    return written(counted.agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "katz-words")


def _lexicon(counts: DataFrame, size: int) -> tuple[Lexicon, np.ndarray, int]:
    """The at most ``size`` frequent words, the frequent pairs as (before, token) classes, and the number of all tokens."""
    words, end = counts.where("b IS NULL"), F.col("a") == int(_END)
    total = words.agg(
        *[F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in (("n", F.col("n")), ("every", F.col("every")))],
        F.count_if(F.col("n") > 0).alias("v"), *[F.coalesce(F.sum(F.when(end, F.col(x))), F.lit(0)).alias(c) for c, x in (("texts", "n"), ("starts", "every"))],
        F.coalesce(F.sum(F.when(F.col("n") > TOP, F.col("n"))), F.lit(0)).alias("big"),
        *[F.count_if(F.col("n") == r).alias(m) for r, m in enumerate(_COUNTS, 1)],
    ).first()
    kept = words.where((F.col("every") >= max(2, -(-total["every"] // size))) & ~end).select("a", "n", "every").toArrow()
    keys, n, every = kept["a"].to_numpy().view(np.uint64), kept["n"].to_numpy(), kept["every"].to_numpy()
    order = np.argsort(keys)
    keys, n, every = keys[order], n[order], every[order]
    # A context with more tokens than a part should hold is dealt on by its followers.
    spread = np.maximum(1, np.append(every, [0, total["starts"]]) * 4 // PART_TOKENS).astype(np.uint64)
    by_count = np.array([total[m] for m in _COUNTS], dtype=np.float64)
    d = discounts(by_count)
    r = np.arange(1, TOP + 1)
    mass = float((d * r * by_count[:TOP]).sum() + total["big"])
    whole = float(total["n"] if by_count[:TOP].any() else total["n"] + 1)
    lexicon = Lexicon(keys, np.append(n, total["texts"]), spread, total["n"], total["v"], d, whole, 1 - mass / whole)

    # Pairs that may hold a large share are scored where they are read.
    share = max(HOT_PAIR, total["every"] // HOT_SHARE)
    hot = counts.where(F.col("b").isNotNull() & (F.col("every") >= share)).select("a", "b").toArrow()
    sides = []
    for c in ("a", "b"):
        k = hot[c].to_numpy().view(np.uint64)
        ends = np.where(k == _END, np.uint64(lexicon.end), np.uint64(lexicon.start))
        sides.append(np.where(k < _WORD, ends, _class_of(k, keys)))
    both = (sides[0] < _WORD) & (sides[1] < _WORD)
    return lexicon, np.unique(_pair(sides[0][both], sides[1][both])), total["every"]


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << _BITS | token.astype(np.uint64)


def _is_hot(before: np.ndarray, token: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(token), dtype=bool)
    pair = _pair(before, token)
    return (before < _WORD) & (token < _WORD) & (hot[np.minimum(np.searchsorted(hot, pair), len(hot) - 1)] == pair)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: small numbers compress well so."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).reshape(-1)


_RUN = "part int, names binary, train binary, text binary, x binary, y binary, z binary, seldom binary"


def _runs(texts: DataFrame, lexicon: Lexicon, hot: np.ndarray, parts: int) -> DataFrame:
    """Packed occurrences by part. Parts below ``parts`` hold pairs, the others counts of hot pairs.

    In a run a word is its class or, past all classes, its place among the run's ``seldom`` keys.
    """
    classes = lexicon.start + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _tokens(batch, lexicon)
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            often = _is_hot(t.before, t.token, hot)
            if often.any():
                seen, n = np.unique(_pair(t.before, t.token)[often & train[t.text]], return_counts=True)
                out.append((parts + int(t.names[0] % np.uint64(parts)), b"", b"", b"", seen.tobytes(), n.astype("<u8").tobytes(), b"", b""))
            before, token, text = t.before[~often], t.token[~often], t.text[~often]
            spread = np.where(before < _WORD, lexicon.spread[np.where(before < _WORD, before, np.uint64(0)).astype(np.int64)], np.uint64(1))
            part = (mixed(mixed(before) ^ mixed(token) % spread) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((token, before, part))
            before, token, text, part = before[order], token[order], text[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(part)], strict=True):
                mine, local = np.unique(text[lo:hi], return_inverse=True)
                v, n = np.unique(before[lo:hi], return_counts=True)
                both = np.concatenate((v, token[lo:hi]))
                far = both >= _WORD
                seldom, at = np.unique(both[far], return_inverse=True)
                codes = both.astype("<u4")
                codes[far] = at + classes
                out.append((
                    int(part[lo]), t.names[mine].tobytes(), train[mine].tobytes(), _planes(local.astype("<u2")),
                    _planes(codes[: len(v)]), _planes(n.astype("<u4")), _planes(codes[len(v) :]), seldom.tobytes(),
                ))
            types = [pa.int32(), *[pa.binary()] * 7]
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            names = [c.split()[0] for c in _RUN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return mapped(texts, pack, _RUN, ROWS)


#: Kinds of rows in the model's table: partial sums of a text; a context's statistics; a pair's count; a hot pair's
#: count; an occurrence that backs off, with its word where that is not a frequent one.
_TEXT, _CONTEXT, _GRAM, _HOT, _BACKOFF = range(5)
_MODEL = "kind int, name long, v long, w long, c long, s double, base double, known long, " + ", ".join(f"{m} long" for m in _COUNTS)


def _batches(kind: int, n: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one kind in batches of ``OUT``; the other kinds' columns are null."""
    for at in range(0, n, OUT):
        size = min(OUT, n - at)
        arrays, names = [pa.array(np.full(size, kind, np.int32))], ["kind"]
        for part in _MODEL.split(", ")[1:]:
            name, kind_of = part.split()
            arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind_of]
            given = columns.get(name)
            arrays.append(pa.nulls(size, arrow) if given is None else pa.array(given[at : at + size]).cast(arrow))
            names.append(name)
        yield pa.RecordBatch.from_arrays(arrays, names)


def _gathered(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names and training marks of the texts of several runs, and for every occurrence its text among them."""
    names = [np.frombuffer(r["names"], "<u8") for r in rows]
    first = np.concatenate(([0], np.cumsum([len(n) for n in names])))
    text = np.concatenate([_from_planes(r["text"], "<u2").astype(np.int32) + np.int32(f) for r, f in zip(rows, first, strict=False)])
    return np.concatenate(names), np.concatenate([np.frombuffer(r["train"], bool) for r in rows]), text


def _decoded(rows: list[dict], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes or keys of all contexts and tokens of several runs."""
    v, w = [], []
    for row in rows:
        seldom = np.frombuffer(row["seldom"], "<u8")
        for name, out in (("x", v), ("z", w)):
            code = _from_planes(row[name], "<u4").astype(np.uint64)
            far = code >= classes
            code[far] = seldom[(code[far] - np.uint64(classes)).astype(np.int64)]
            out.append(code)
        v[-1] = np.repeat(v[-1], _from_planes(row["y"], "<u4"))
    return np.concatenate(v), np.concatenate(w)


def _counted_pairs(rows: list[dict], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of some contexts, and what each text gets from its occurrences of them.

    All occurrences of a context that is not a frequent word are here, so its count is its word's own: it gives the
    base score of the word, and the denominator of what follows.
    """
    names, train, text = _gathered(rows)
    v, w = _decoded(rows, lexicon.start + 1)
    order = np.lexsort((w, v))
    v, w, text = v[order], w[order], text[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
    size = np.diff(np.append(first, len(v)))
    c = np.add.reduceat(train[text].astype(np.int64), first)
    v, w = v[first], w[first]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    add = lambda x: np.add.reduceat(x, start)
    context = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(v))))
    total = add(c)
    by_count = {m: add((c == r).astype(np.int64)) for r, m in enumerate(_COUNTS, 1)}
    big = add(np.where(c > TOP, c, 0))
    seldom = v[start] >= _WORD
    under = np.where(seldom & (total > 0), -np.log10(np.maximum(total + (big == total), 1)), 0.0)
    near = w < _WORD
    p = np.zeros(len(w))
    p[near] = lexicon.p(lexicon.counts)[w[near].astype(np.int64)]

    # log10 of the count where the pair was seen, else of a frequent word's probability; other things are joined later.
    with np.errstate(divide="ignore"):
        value = np.where(c > 0, np.log10(np.maximum(c, 1)) + under[context], np.where(near, np.log10(p), 0.0))
    base = np.where(seldom, lexicon.base(total), 0.0)[context]
    known = (seldom & (total > 0))[context]
    n, each = len(names), np.repeat(c, size)
    sums = {"s": np.bincount(text, np.repeat(value, size), n), "base": np.bincount(text, np.repeat(base, size), n)}
    sums["known"] = np.bincount(text[np.repeat(known, size)], minlength=n)
    counts = {m: np.bincount(text[each == r], minlength=n) for r, m in enumerate(_COUNTS[:TOP], 1)}
    yield from _batches(_TEXT, n, name=names.view(np.int64), **sums, **counts)

    wanted = (c == 0) & (~near | ~seldom[context] | (total > 0)[context])
    missed = np.flatnonzero(np.repeat(wanted, size))
    if len(missed):
        pair = np.repeat(np.arange(len(c)), size)[missed]
        word = pa.array(w[pair].view(np.int64), mask=near[pair])
        yield from _batches(_BACKOFF, len(missed), name=names[text[missed]].view(np.int64), v=v[pair].view(np.int64), w=word)
        del pair, word
    seen = c > 0
    if seen.any():
        yield from _batches(_GRAM, int(seen.sum()), v=v[seen].view(np.int64), w=w[seen].view(np.int64), c=c[seen])
        held = total > 0
        stats = {k: x[held] for k, x in {"c": big, "s": add(np.where(seen, p, 0.0)), **by_count}.items()}
        yield from _batches(_CONTEXT, int(held.sum()), v=v[start][held].view(np.int64), **stats)


def _counted_hot(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    pair, which = np.unique(np.concatenate([np.frombuffer(r["x"], "<u8") for r in rows]), return_inverse=True)
    c = np.bincount(which, np.concatenate([np.frombuffer(r["y"], "<u8") for r in rows]))
    yield from _batches(_HOT, len(pair), v=pair >> _BITS, w=pair & ((np.uint64(1) << _BITS) - np.uint64(1)), c=c)


def _model(runs: DataFrame, lexicon: Lexicon, parts: int) -> DataFrame:
    """The written table of pair counts, context statistics and the texts' partial sums; a task works part by part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def finished() -> Iterator[pa.RecordBatch]:
            if held:
                part = held[0]["part"]
                yield from _counted_pairs(held, lexicon) if part < parts else _counted_hot(held)
                held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from finished()
                held.append(row)
        yield from finished()

    placed = runs.repartition(2 * parts, "part").sortWithinPartitions("part")
    return written(placed.mapInArrow(count, _MODEL), "katz-pairs")


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's discounts for counts 1..TOP from the numbers ``n[r - 1]`` of pairs seen r times, r up to TOP + 1.

    Where too few counts make one of them fall outside (0, 1), all come from the mean discount n1 / (n1 + 2 n2) instead.
    """
    r = np.arange(1, TOP + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        star = (r + 1) * n[1:] / n[:-1] / r
        tail = (TOP + 1) * n[TOP] / n[0]
        d = (star - tail) / (1 - tail)
    if np.all(np.isfinite(d)) and np.all((d > 0) & (d < 1)):
        return d
    mean = (n[0] + 0.5) / (n[0] + 2 * n[1] + 1)
    return 1 - mean / r


def _contexts(model: DataFrame, words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A written table of all contexts ``v``: what their followers of over ``TOP`` occurrences add up to (``c``), followers by
    count, and the word model's probability of all followers (``s``).

    Followers that are not frequent words get their probability by a join with the table of words; such a word has a
    share below 1 / ``FREQUENT`` of all tokens, so no key of the join is hot.
    """
    fields = ["c", *_COUNTS]
    told = model.where(F.col("kind") == _CONTEXT).select("v", "s", *fields)
    far = model.where((F.col("kind") == _GRAM) & (F.col("w") < 0)).select("v", "w").join(words, "w")
    far = far.select("v", lexicon.p_column(F.col("n")).alias("s"), *[F.lit(0).cast("long").alias(c) for c in fields])
    return written(told.unionByName(far).groupBy("v").agg(*[F.sum(c).alias(c) for c in ("s", *fields)]), "katz-contexts")


def _weights(
    contexts: DataFrame, model: DataFrame, lexicon: Lexicon, hot: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By frequent context: log10 of one over its denominator, and of its backoff weight; the discounts; the hot pairs' values.

    A context's seen followers have the mass sum(d c) / C; the rest goes to the others in proportion to the word model,
    so each context's probabilities sum to one. Without anything discounted the denominator grows by one.
    """
    size = lexicon.start + 1
    by_context = contexts.where("v >= 0").toArrow()
    counted = model.where(F.col("kind") == _HOT).groupBy("v", "w").agg(F.sum("c").alias("c")).toArrow()
    far = contexts.where("v < 0").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in _COUNTS]).first()
    v = by_context["v"].to_numpy()
    m = np.zeros((TOP + 1, size))
    big, seen = np.zeros(size), np.zeros(size)
    for r, name in enumerate(_COUNTS):
        m[r, v] = by_context[name].to_numpy()
    big[v], seen[v] = by_context["c"].to_numpy(), by_context["s"].to_numpy()
    hot_v, hot_w = (hot >> _BITS).astype(np.int64), (hot & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    hot_c = np.zeros(len(hot), dtype=np.int64)
    pairs = _pair(counted["v"].to_numpy().view(np.uint64), counted["w"].to_numpy().view(np.uint64))
    hot_c[np.searchsorted(hot, pairs)] = counted["c"].to_numpy()
    few = (hot_c > 0) & (hot_c <= TOP + 1)
    p = lexicon.p(lexicon.counts)
    np.add.at(m, (hot_c[few] - 1, hot_v[few]), 1)
    np.add.at(big, hot_v, np.where(hot_c > TOP, hot_c, 0))
    np.add.at(seen, hot_v, np.where(hot_c > 0, p[hot_w], 0.0))

    d = discounts(m.sum(axis=1) + np.array([far[c] for c in _COUNTS]))
    r = np.arange(1, TOP + 1)[:, None]
    total = (r * m[:TOP]).sum(axis=0) + big
    mass = (d[:, None] * r * m[:TOP]).sum(axis=0) + big
    whole = total + (total == big)
    rest = np.maximum(1 - seen, lexicon.left)
    alpha = np.where(total > 0, np.log10((1 - mass / whole) / rest), 0.0)
    under = np.where(total > 0, -np.log10(whole), 0.0)
    cut = np.append(np.append(1.0, d), 1.0)[np.minimum(hot_c, TOP + 1)]
    backed = alpha[hot_v] - under[hot_v] + np.log10(p[hot_w])
    return under, alpha, d, np.where(hot_c > 0, np.log10(np.maximum(hot_c, 1) * cut), backed)


def _far_weight(lexicon: Lexicon, d: np.ndarray) -> Column:
    """log10 of the backoff weight of a row of ``_contexts``."""
    plus = lambda terms: sum(terms, F.lit(0.0))
    total = plus(r * F.col(m) for r, m in enumerate(_COUNTS[:TOP], 1)) + F.col("c")
    mass = plus(float(x) * r * F.col(m) for r, (x, m) in enumerate(zip(d, _COUNTS, strict=False), 1)) + F.col("c")
    whole = total + F.when(total == F.col("c"), 1).otherwise(0)
    return F.log10((1 - mass / whole) / F.greatest(1 - F.col("s"), F.lit(lexicon.left)))


def katz_scores(df: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A text is its words and one end; null and empty texts are the end alone. Texts whose id has crc32 mod 7 = 2 are held
    out, and a null id counts as the empty text there; all others train. ``score`` is the model's log10 probability of the
    text, ``base_score`` that of the add-one model. Without training texts every count is 0 and scores stay finite.
    Repeated rows train as often as they occur and get one score each: partial sums meet by a 64-bit name of id and words
    and are shared evenly. Only the two named columns are read. Tasks and driver hold at most ``frequent`` words, about 40
    bytes each; scores do not depend on it, nor on ``part_tokens``, which a task counts at a time.
    """
    texts = _marked(df, key, text)
    counts = _unigrams(texts)
    lexicon, hot, tokens = _lexicon(counts, frequent)
    words = counts.where("b IS NULL AND a < 0 AND n > 0").select(F.col("a").alias("w"), "n")
    parts = max(4, -(-tokens // part_tokens))
    model = _model(_runs(texts, lexicon, hot, parts), lexicon, parts)
    contexts = _contexts(model, words, lexicon)
    under, alpha, d, hot_logs = _weights(contexts, model, lexicon, hot)
    word_known = (lexicon.counts > 0).astype(np.int64)
    word_base = lexicon.base(lexicon.counts)

    def backed_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(alpha[v] - under[v])], ["name", "s"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One class more, for all words that are not frequent: they get theirs from the tables.
        denominator, known, base = np.append(under, 0.0), np.append(word_known, [0, 0]), np.append(word_base, [0.0, 0.0])
        for batch in batches:
            t = _tokens(batch, lexicon)
            n = batch.num_rows
            far = np.uint64(lexicon.start + 1)
            before, token = np.minimum(t.before, far).astype(np.int64), np.minimum(t.token, far).astype(np.int64)
            value = denominator[before]
            often = np.flatnonzero(_is_hot(t.before, t.token, hot))
            if len(often):
                value[often] += hot_logs[np.searchsorted(hot, _pair(t.before[often], t.token[often]))]
            known_of, base_of = known[np.minimum(token, lexicon.end + 1)], base[np.minimum(token, lexicon.end + 1)]
            columns = [
                batch.column("id"), batch.column("held_out"), pa.array(t.names.view(np.int64)), pa.array(t.lengths, pa.int64()),
                pa.array(np.bincount(t.text, known_of, n).astype(np.int64)), pa.array(np.bincount(t.text, base_of, n)),
                pa.array(np.bincount(t.text, value, n)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "name", "n_tokens", "known", "base", "s"])

    backoff = model.where(F.col("kind") == _BACKOFF).select("name", "v", "w")
    weights = contexts.where("v < 0").select("v", _far_weight(lexicon, d).alias("s"))
    late = backoff.where("v >= 0").select("name", "v").mapInArrow(backed_off, "name long, s double")
    late = late.unionByName(backoff.where("v < 0").join(weights, "v").select("name", "s"))
    lower = backoff.where("w IS NOT NULL").join(words, "w", "left").select("name", F.log10(lexicon.p_column(F.col("n"))).alias("s"))
    late = late.unionByName(lower)
    discounted = sum((F.coalesce(m, F.lit(0)) * float(x) for m, x in zip(_COUNTS, np.log10(d), strict=False)), F.lit(0.0))
    early = model.where(F.col("kind") == _TEXT).select("name", (F.col("s") + discounted).alias("s"), "base", "known")
    late = late.select("name", "s", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"))
    rows = mapped(texts, read, "id long, held_out boolean, name long, n_tokens long, known long, base double, s double", ROWS)
    rows = written(rows, "katz-texts")
    copies = rows.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))
    sums = early.unionByName(late).groupBy("name").agg(*[F.sum(c).alias(f"sum_{c}") for c in ("s", "base", "known")])
    shared = sums.join(copies, "name").select("name", *[(F.col(f"sum_{c}") / F.col("copies")).alias(f"sum_{c}") for c in ("s", "base", "known")])
    joined = rows.join(shared, "name", "left")
    whole = lambda c: F.coalesce(f"sum_{c}", F.lit(0.0))
    return joined.select(
        "id", "held_out", "n_tokens", (F.col("known") + F.round(whole("known")).cast("long")).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"), (F.col("base") + whole("base")).alias("base_score"), (F.col("s") + whole("s")).alias("score"),
    )
