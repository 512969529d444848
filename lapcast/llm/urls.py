"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.common import let

# One strict term rejects a url; soft terms reject together.
STRICT = (
    "adult bet bets betting casino casinos escort escorts hentai nude nudes pills porn porno poker sex spam "
    "viagra cialis warez xxx xxxx"
).split()
SOFT = (
    "bonus cheap click coupon crack deal deals download free gamble game hack hot jackpot keygen live loan loans lottery "
    "lucky meds money prize pharmacy promo rich torrent win winner slots"
).split()
SOFT_HITS = 2


@dataclass(frozen=True)
class HostRule:
    """Fits the host and all its subdomains where the url's path starts with the rule's path."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    HostRule("allow", "com/"),
    HostRule("block", "example.com/en/"),
    HostRule("allow", "www.example.com/en/"),
    HostRule("block", "net/es/"),
    HostRule("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    cut = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    known = F.coalesce(url, F.lit(""))
    return let(F.instr(known, "://"), lambda at: F.when(at > 0, F.substring(known, at + 3, F.char_length(known))).otherwise(""))


def rule_for(host: Column, path: Column, rules: Iterable[HostRule] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; both null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r.rule))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, fit in reversed(list(zip(ordered, fits, strict=True))):
        text, verdict = F.when(fit, r.rule).otherwise(text), F.when(fit, r.verdict).otherwise(verdict)
    return text, verdict


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word in soft:
        machine.add_word(word, (word, False))
    for word in strict:
        machine.add_word(word, (word, True))
    machine.make_automaton()
    return machine


def _letter_or_digit(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at] in "abcdefghijklmnopqrstuvwxyz0123456789"


def term_counts(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Hits of strict terms and number of distinct soft terms that stand between characters other than a-z and 0-9."""
    text, hits, distinct = (url or "").lower(), 0, set()
    for end, (word, is_strict) in _automaton(strict, soft).iter(text):
        if _letter_or_digit(text, end - len(word)) or _letter_or_digit(text, end + 1):
            continue
        if is_strict:
            hits += 1
        else:
            distinct.add(word)
    return hits, len(distinct)


def judged_urls(
    df: DataFrame, key: str = "page_id", url: str = "url", rules: Iterable[HostRule] = RULES,
    strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """One row per input row: ``id, url, host, path, rule, strict_hits, soft_terms, verdict``.

    A url that no rule fits is blocked by one strict hit or ``soft_hits`` distinct soft terms, else allowed. Null
    urls and those without ``://`` have an empty host and path; the vocabulary is still counted in them. Repeated
    rows keep one result each. The vocabulary is a fixed parameter; only the two named columns are read.
    """
    strict_terms, soft_terms = tuple(strict), tuple(soft)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(u, strict_terms, soft_terms) for u in batch.column("url").to_pylist()]
            extra = [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["id", "url", "strict_hits", "soft_terms"])

    plain = df.select(df[key].cast("long").alias("id"), df[url].cast("string").alias("url"))
    counts = plain.mapInArrow(counted, "id long, url string, strict_hits int, soft_terms int")
    parts = counts.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("strict_hits") > 0) | (F.col("soft_terms") >= soft_hits), "block").otherwise("allow")
    return parts.select("id", "url", "host", "path", text.alias("rule"), "strict_hits", "soft_terms", F.coalesce(verdict, method).alias("verdict"))
