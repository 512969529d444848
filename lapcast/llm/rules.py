"""Quality rules: a table of thresholds becomes one projection over measures of the text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapcast.llm.common import SPACE, let, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au dans de des du elle est et il la le les pas pour que qui sur un une "
    "con del el en es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie within the bounds; a text without the denominator passes."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None

    def passes(self) -> Column:
        value = F.col(self.numerator) / F.greatest(F.col(self.denominator), F.lit(1))
        sides = [value >= self.least] if self.least is not None else []
        sides += [value <= self.most] if self.most is not None else []
        return reduce(lambda a, b: a & b, sides)


#: Bounds were read off the labelled rows and then widened: no labelled good text of 50 words comes near them.
RULES = (
    Rule("mean word length", "word_chars", "n_words", least=2.5, most=12.0),
    Rule("symbols per word", "n_symbols", "n_words", most=0.1),
    Rule("stop words per word", "n_stop_words", "n_words", least=0.02),
    Rule("share of repeated lines", "n_dup_lines", "n_lines", most=0.5),
)
LEAST_WORDS = 50
MOST_REPEATED = 50


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds at least twice; each word counts once.

    The windows' 64-bit hashes are sorted with their places; equal neighbours are repeats.
    """
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )
    same = lambda s, x, k: F.get(s, k)["h"] == x["h"]
    repeats = let(windows, lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))
    covered = F.aggregate(
        F.sort_array(F.transform(repeats, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(covered)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the measures that rules may name.

    A null text has no words and every measure is 0. The input's other columns stay as they are; if one is
    called like a measure or like ``_text``, ``_words`` or ``_lines``, the measure replaces it.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = df.withColumn("_text", F.coalesce(df[text].cast("string"), F.lit("")))
    held = held.withColumns({"_words": words_of(F.col("_text")), "_lines": lines})
    w, number = F.col("_words"), lambda c: c.cast("long")
    return held.withColumns(
        {
            "n_words": number(F.size(w)),
            "word_chars": number(F.char_length(F.regexp_replace("_text", SPACE, ""))),
            "n_symbols": number(F.regexp_count(F.col("_text"), F.lit("[#*$%&|<>]"))),
            "n_lines": number(F.size("_lines")),
            "n_dup_lines": number(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": number(repeated_words(w)),
            "n_stop_words": number(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))),
        }
    ).drop("_text", "_words", "_lines")


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` rows with ``base_failed``, ``kept`` and ``failed_rules`` (names, in table order).

    Empty and null texts fail, as they have fewer than ``LEAST_WORDS`` words. Repeated rows are judged alike.
    """
    m = measured(df, text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    named = F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules])
    return m.withColumns({"base_failed": failed, "failed_rules": F.array_compact(named)}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, with the input's columns.

    The row number keeps the filter above the projection: pushed below it, the verdict would spell out, and compute,
    every measure again and again.
    """
    fields = df.columns
    marked = df.select(F.struct(*[df[c] for c in fields]).alias("_row"), df[text].alias("_judged"))
    verdicts = judged(marked, "_judged", rules).withColumn("_number", F.monotonically_increasing_id())
    return verdicts.where("kept AND _number >= 0").select("_row.*")
