"""Plain re-statements of the operators, one document at a time or all pairs; no Spark."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(UPPER))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def best_fit(lengths, limit):
    """Remaining capacities after best-fit decreasing, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(bins) if room >= n]
        if fitting:
            i = min(fitting, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(limit - n)
    return bins


def later_lines(docs, percent=80, least=1):
    """{doc_id: line numbers} with an earlier similar line, by comparing with all earlier ones."""
    lines = sorted(
        (doc, no, frozenset(words(line))) for doc, text in docs for no, line in enumerate((text or "").split("\n"))
    )
    lines = [x for x in lines if len(x[2]) >= least]
    first = {}
    for doc, no, s in lines:
        first.setdefault(s, (doc, no))
    by_size = defaultdict(list)
    for s, at in first.items():
        by_size[len(s)].append((s, at))
    gone = defaultdict(set)
    for doc, no, s in lines:
        here = (doc, no)
        if first[s] < here:
            gone[doc].add(no)
            continue
        for size in range(math.ceil(len(s) * percent / 100), len(s) * 100 // percent + 1):
            if any(at < here and 100 * len(s & t) >= percent * len(s | t) for t, at in by_size[size]):
                gone[doc].add(no)
                break
    return {d: sorted(x) for d, x in gone.items()}


def shingle_set(text, width=5):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near(docs, percent=85):
    """{doc_id: (set size, smallest id reachable)} over all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    holders = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            holders[s].append(d)
    for d in ids:
        common = Counter(e for s in sets[d] for e in holders[s] if e > d)
        for e, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in ids}


def leaked(docs, items, window=10):
    """{doc_id: (words, hit words, items, hit places)}."""
    windows = defaultdict(set)
    for name, text in items:
        w = words(text, MARKED)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(name)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w = words(text, MARKED)
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out[doc] = (len(w), len(hit), sorted(map(str, names)), hit)
    return out


def _luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _digits(value):
    return sum(c in "0123456789" for c in value)


PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= _digits(v) <= 19 and _luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= _digits(v) <= 15),
}
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = {
    "assign": (ASSIGN, lambda v: len(re.match(ASSIGN, v)[1]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda v: len(v) >= 20),
    "hex": (r"[0-9a-f]+", lambda v: len(v) >= 24),
}


def spans(text, kinds):
    """[(kind, start, end, value)] by kind as listed, then start."""
    out = []
    for kind, (pattern, test) in kinds.items():
        out += [(kind, m.start(), m.end(), m[0]) for m in re.finditer(pattern, text or "", re.ASCII) if test(m[0])]
    return out


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in found)


def quality(text):
    """The base measures of one text."""
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


class Katz:
    """The backoff model over dictionaries."""

    def __init__(self, docs, top=5):
        train = [words(t) + [None] for d, t in docs if not held_out(d)]
        self.c = Counter(w for t in train for w in t)
        self.n, self.v, self.top = sum(self.c.values()), len(self.c), top
        self.d1 = self.discounts(self.numbers(self.c.values()))
        self.mass1 = sum(self.cut(self.d1, c) for c in self.c.values())
        self.whole1 = self.n + (not any(c <= top for c in self.c.values()))
        self.follow = defaultdict(Counter)
        for t in train:
            for a, b in zip(["<start>", *t], t):
                self.follow[a][b] += 1
        self.d = self.discounts(self.numbers(c for f in self.follow.values() for c in f.values()))

    def numbers(self, counts):
        seen = Counter(counts)
        return [seen[r] for r in range(1, self.top + 2)]

    def cut(self, d, c):
        return c * (d[c - 1] if c <= self.top else 1)

    def p1(self, w):
        """The word model: V + 1 words never seen share what discounting leaves."""
        if self.c[w]:
            return self.cut(self.d1, self.c[w]) / self.whole1
        return (1 - self.mass1 / self.whole1) / (max(self.v, 1) + 1)

    def discounts(self, n):
        top = self.top
        try:
            tail = (top + 1) * n[top] / n[0]
            d = [((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail) for r in range(1, top + 1)]
            if all(0 < x < 1 for x in d):
                return d
        except ZeroDivisionError:
            pass
        mean = (n[0] + 0.5) / (n[0] + 2 * n[1] + 1)
        return [1 - mean / r for r in range(1, top + 1)]

    def p(self, a, b):
        seen = self.follow.get(a)
        if not seen:
            return self.p1(b)
        whole = sum(seen.values()) + (not any(c <= self.top for c in seen.values()))
        if b in seen:
            return self.cut(self.d, seen[b]) / whole
        mass = sum(self.cut(self.d, c) for c in seen.values())
        return (1 - mass / whole) * self.p1(b) / (1 - sum(self.p1(w) for w in seen))

    def scores(self, text):
        t = words(text) + [None]
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in t)
        score = sum(math.log10(self.p(a, b)) for a, b in zip(["<start>", *t], t))
        return len(t), sum(self.c[w] > 0 for w in t), base, score
