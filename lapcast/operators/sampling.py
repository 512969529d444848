"""Sampling and splitting by entity, repeatable by seed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapcast.functions.columns import unit_hash
from lapcast.operators.filters import keep_members
from lapcast.plans.ordered import ranked
from lapcast.plans.skew import lookup_join, salted_join
from lapcast.roles import Roles
from lapcast.session import broadcast_rows


def _by_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_u", unit_hash(seed, key))


def bottom_k(hashed: DataFrame, strata: Sequence[str], key: str, k: int) -> DataFrame:
    """The ``k`` different keys with the smallest hash ``_u`` of every stratum, each once.

    Every task first keeps only its own ``k`` smallest of each stratum, so at most k x strata x tasks rows are shuffled, however many
    rows and keys there are. Ties of the hash go to the smaller key. Null keys take no part.
    """
    strata = list(strata)
    slim = hashed.select(*strata, "_u", key).where(F.col(key).isNotNull())

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = (batch if held is None else pd.concat([held, batch])).drop_duplicates([*strata, key]).sort_values(["_u", key], kind="stable")
            held = rows.groupby(strata, sort=False, dropna=False).head(k) if strata else rows.head(k)
        if held is not None:
            yield held

    # The second round is one row a key and stratum again, from every task's smallest.
    few = slim.mapInPandas(smallest, slim.schema).distinct()
    order = Window.partitionBy(*strata).orderBy("_u", key)
    return few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)


def sample_entities(df: DataFrame, key: str, seed: int = 42, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """All rows of ``n`` entities, or of about a ``fraction`` of them (no shuffle at all)."""
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    if fraction is not None:
        return df.where(unit_hash(seed, key) < fraction)
    if n <= broadcast_rows(df.sparkSession):
        chosen = bottom_k(df.select(key, unit_hash(seed, key).alias("_u")), [], key, n)
    else:
        chosen = ranked(_by_hash(df, key, seed), [], ["_u", key], "_r").where(F.col("_r") <= n)
    return keep_members(df, chosen, [key])


def split_entities(df: DataFrame, key: str, ratios: dict[str, float], seed: int = 42, exact: bool = False) -> DataFrame:
    """Label every row with a ``split``; an entity is never in two.

    The default cuts the entity's hash: proportions are approximate and nothing is shuffled.
    ``exact`` cuts the hash-ordered entities at truncated cumulative counts.
    """
    names, total, cut_at = list(ratios), 0.0, []
    for r in ratios.values():
        total += r
        cut_at.append(round(total, 12))
    if not exact:
        place, table = unit_hash(seed, key), df
    else:
        order = ranked(_by_hash(df, key, seed), [], ["_u", key], "_r")
        n = order.count()
        cut_at = [int(c * n) for c in cut_at]
        table = salted_join(df, order.select(key, (F.col("_r") - 1).alias("_place")), [key])
        place = F.col("_place")
    label = F.lit(names[-1])
    for name, cut in reversed(list(zip(names[:-1], cut_at))):
        label = F.when(place < cut, F.lit(name)).otherwise(label)
    return table.withColumn("split", label).drop("_place")


def first_category(df: DataFrame, roles: Roles, category: str) -> DataFrame:
    """Each entity's category on its first row in (series text, time) order."""
    text = F.concat_ws("_", *[F.col(c).cast("string") for c in roles.keys])
    first = F.min_by(category, F.struct(text, *[F.col(c) for c in roles.order]))
    return df.groupBy(roles.entity).agg(first.alias("stratum"))


def stratum_quotas(strata: DataFrame, n: int) -> DataFrame:
    """Split ``n`` over strata in proportion to ``size``; the rest goes to the largest fractions."""
    total = strata.agg(F.sum("size")).first()[0]
    shares = strata.withColumn("_exact", F.col("size") * n / F.lit(total)).withColumn("_floor", F.floor("_exact"))
    short = n - (shares.agg(F.sum("_floor")).first()[0] or 0)
    order = ranked(shares.withColumn("_f", F.round(F.col("_floor") - F.col("_exact"), 9)), [], ["_f", "stratum"], "_r")
    return order.select("stratum", "size", (F.col("_floor") + (F.col("_r") <= short).cast("int")).alias("quota"))


def stratified_entities(
    df: DataFrame, roles: Roles, category: str, fraction: float = 0.05, at_least: int = 500, seed: int = 42
) -> DataFrame:
    """Entities sampled in proportion to their first category, with that category.

    n = max(int(fraction * N), min(at_least, N)). A plain sample of n is taken when a
    stratum has a single entity or there are too few entities on either side for all strata.
    """
    firsts = first_category(df, roles, category)
    strata = firsts.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    kinds, total, smallest = strata.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.min("size")).first()
    n = max(int(fraction * total), min(at_least, total))
    hashed = firsts.withColumn("_u", unit_hash(seed, roles.entity))
    if not total or smallest < 2 or n < kinds or total - n < kinds:
        return ranked(hashed, [], ["_u", roles.entity], "_r").where(F.col("_r") <= n).drop("_u", "_r")
    quotas = stratum_quotas(strata, n).select("stratum", "quota")
    largest = quotas.agg(F.max("quota")).first()[0]
    if largest <= broadcast_rows(df.sparkSession):
        placed = bottom_k(hashed, ["stratum"], roles.entity, largest)
    else:
        placed = ranked(hashed, ["stratum"], ["_u", roles.entity], "_r")
    return lookup_join(placed, quotas, ["stratum"]).where("_r <= quota").select(roles.entity, "stratum")


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """A row sample; with an id ``key`` it is the same on every run and engine."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(unit_hash(seed, F.concat_ws(":", *[F.col(k).cast("string") for k in key])) < fraction)


def last_n(df: DataFrame, roles: Roles, n: int) -> DataFrame:
    """The last ``n`` rows of every series (Spark limits each map task to n per series first)."""
    newest = Window.partitionBy(*roles.keys).orderBy(*[F.col(c).desc() for c in roles.order])
    return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")
