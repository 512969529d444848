"""Experiments over many runs: search, early stopping, median stopping, curves."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapcast.functions.columns import unit_hash
from lapcast.operators.evaluate import evaluate
from lapcast.plans.ordered import arrange, ranked
from lapcast.plans.skew import hot_keys, salted_join
from lapcast.session import block_rows, written


def draw(kind: tuple, u: Column) -> Column:
    """One random setting from a uniform number: ("log", a, b), ("uniform", a, b), ("int", a, b, step), ("choice", [..])."""
    name, *spec = kind
    if name == "log":
        low, high = math.log(spec[0]), math.log(spec[1])
        return F.exp(F.lit(low) + u * F.lit(high - low))
    if name == "uniform":
        return F.lit(float(spec[0])) + u * F.lit(float(spec[1] - spec[0]))
    if name == "int":
        low, high, step = spec
        return F.lit(low) + F.floor(u * ((high - low) // step + 1)).cast("int") * step
    if name == "choice":
        return F.get(F.lit(spec[0]), F.floor(u * len(spec[0])).cast("int"))
    raise ValueError(f"unknown kind {name!r}")


def candidates(spark: SparkSession, space: dict[str, tuple], n: int = 30, seed: int = 42) -> DataFrame:
    """(trial, settings): ``n`` settings drawn from ``space``, the same for one seed everywhere."""
    trials = spark.range(n).select(F.col("id").cast("int").alias("trial"))
    drawn = {k: draw(kind, unit_hash(seed, F.concat(F.lit(f"{k}:"), F.col("trial").cast("string")))) for k, kind in space.items()}
    return trials.withColumns(drawn)


def search(trials: DataFrame, run: Callable[[dict], DataFrame], metric: str = "pinball") -> tuple[DataFrame, dict]:
    """Score every candidate and return (scores, best settings).

    ``run`` takes one candidate and returns its validation forecasts; each candidate is one
    distributed fit, and only its single row of metrics comes back.
    """
    spark = trials.sparkSession
    rows = []
    for r in trials.orderBy("trial").toLocalIterator():
        settings = r.asDict()
        score = evaluate(run(settings)).first()
        rows.append({**settings, "pinball": score["pinball"], "penalised_score": score["penalised_score"]})
    kinds = {f.name: f.dataType.simpleString() for f in trials.schema.fields}
    columns = [*kinds, "pinball", "penalised_score"]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns)
    scores = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)
    best = scores.agg(F.min_by(F.struct(*kinds), F.struct(metric, "trial")).alias("b")).first()["b"].asDict()
    return scores, best


def early_stop_trace(curves: DataFrame, patience: int, delta: float, run: str = "run_id", loss: str = "val_loss") -> DataFrame:
    """Per (run, epoch): save flag, patience counter and whether the run is still going.

    A strictly new minimum saves and resets the counter; a loss above min + delta adds one;
    the run stops at the first epoch where the counter reaches ``patience``.
    """
    value = F.col(loss)
    a = arrange(curves, [run], ["epoch"]).running("_best", "min", value, before=True)
    best = F.col("_best")
    save = best.isNull() | (value < best)
    bad = ~save & (value > best + delta)
    a = a.running("_bad", "sum", bad.cast("long"))
    # Bad epochs so far never decrease, so their number at the last save is the largest at any save.
    a = a.running("_at_save", "max", F.when(save, F.col("_bad")))
    a.df = a.df.withColumns({"save": save, "counter": (F.col("_bad") - F.col("_at_save")).cast("int")})
    a = a.running("_stops", "sum", (F.col("counter") >= patience).cast("long"), before=True)
    return a.finish().select(
        run, "epoch", value.alias("loss"), "save", "counter", (F.coalesce("_stops", F.lit(0)) == 0).alias("ran")
    )


def early_stop(curves: DataFrame, patience: int, delta: float, run: str = "run_id", loss: str = "val_loss") -> DataFrame:
    """Per run: epochs run, whether it was stopped, best loss and its epoch, number of saves."""
    trace = early_stop_trace(curves, patience, delta, run, loss).where("ran")
    return trace.groupBy(run).agg(
        F.max("epoch").alias("last_epoch"),
        F.max((F.col("counter") >= patience).cast("int")).alias("stopped"),
        F.min("loss").alias("best_loss"),
        F.max(F.when(F.col("save"), F.col("epoch"))).alias("best_epoch"),
        F.count_if("save").alias("saves"),
    )


def median_stop(
    curves: DataFrame, startup: int = 5, warmup: int = 3, run: str = "run_id", loss: str = "val_loss"
) -> DataFrame:
    """Per (run, epoch): own best loss so far, number of earlier runs at that epoch, and
    whether the best so far is worse than those runs' median loss there.

    Runs are taken in ``run`` order and every earlier run counts. The verdict is given from the
    run after ``startup`` runs on and for epochs after ``warmup``; a run equal to the median goes
    on; without an earlier run at that epoch there is no median and the run goes on.
    Medians of all prefixes come from counting: a prefix of runs is a union of at most log2(runs)
    aligned blocks, and inside a block one sorted pass counts the smaller losses. No pairs of
    runs are formed and no epoch is gathered in one place.
    """
    runs = ranked(curves.select(run).distinct(), [], [run], "_nth").withColumn("_nth", F.col("_nth") - 1)
    numbered = salted_join(curves.select(run, "epoch", F.col(loss).cast("double").alias("_loss")), runs, [run])
    own = written(arrange(numbered, [run], ["epoch"]).running("best_so_far", "min", F.col("_loss")).finish(), "runs")
    levels = max(1, math.ceil(math.log2(max(2, runs.count()))) + 1)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    # Every loss belongs to one block per level; only blocks of even number are ever looked at.
    values = own.select("epoch", level.alias("_level"), "_nth", F.col("_loss").alias("_v")).select(
        "epoch", "_level", F.expr("shiftright(_nth, _level)").alias("_block"), "_v",
        F.lit(None).cast("long").alias("_run"),
    ).where("_block % 2 = 0")
    # A run looks at the blocks that make up all runs before it: one per set bit of its number.
    queries = (
        own.where((F.col("_nth") >= startup) & (F.col("epoch") > warmup))
        .select("epoch", "_nth", F.col("best_so_far").alias("_v"), level.alias("_level"))
        .where("shiftright(_nth, _level) & 1 = 1")
        .select("epoch", "_level", F.expr("shiftright(_nth, _level) - 1").alias("_block"), "_v", F.col("_nth").alias("_run"))
    )
    return _prefix_medians(own, values, queries, run)


def _prefix_medians(own: DataFrame, values: DataFrame, queries: DataFrame, run: str) -> DataFrame:
    """Compare each query with the median of its blocks' values by counting from below and from above."""
    keys = ["epoch", "_level", "_block"]
    is_value = F.col("_run").isNull()
    both = values.unionByName(queries).withColumns(
        {"_run": F.coalesce("_run", F.lit(-1)), "_value": is_value, "_first": (~is_value).cast("int") * -1, "_neg": -F.col("_v")}
    )
    # A block holds at most the epoch's losses and as many queries, so short epochs need not be counted block by block.
    longest = own.groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hot = hot_keys(both, keys) if 2 * longest > block_rows(own.sparkSession) else None
    seen = F.when(F.col("_value"), F.col("_v"))
    # Upwards a query precedes equal losses, downwards it follows them: below is strict.
    up = arrange(both, keys, ["_v", "_first", "_run"], True, hot)
    up = up.running("below", "sum", F.col("_value").cast("long")).running("lower", "max", seen).finish()
    # Without an over-full block both directions share one shuffle.
    down = arrange(both if hot is not None else up, keys, ["_neg", "_run"], True, hot)
    down = down.running("above", "sum", F.col("_value").cast("long")).running("upper", "min", seen).finish()
    told = down.where(~F.col("_value"))
    if hot is not None:
        none = F.lit(None)
        told = up.where(~F.col("_value")).select("epoch", "_run", "below", "lower", none.cast("long").alias("above"), none.cast("double").alias("upper")).unionByName(
            told.select("epoch", "_run", none.cast("long").alias("below"), none.cast("double").alias("lower"), "above", "upper")
        )
    counted = told.groupBy("epoch", F.col("_run").alias("_nth")).agg(
        F.sum("below").alias("below"), F.sum("above").alias("above"), F.max("lower").alias("lower"), F.min("upper").alias("upper")
    )
    m, c, b = F.col("earlier_runs"), F.col("below"), F.col("best_so_far")
    worse = F.when(m % 2 == 1, c >= (m + 1) / 2).otherwise((c > m / 2) | ((c == m / 2) & (b > (F.col("lower") + F.col("upper")) / 2)))
    joined = own.join(counted, ["epoch", "_nth"], "left").withColumn("earlier_runs", F.coalesce(F.col("below") + F.col("above"), F.lit(0)))
    return joined.select(
        run, "epoch", "best_so_far", "earlier_runs", F.when(m > 0, worse).otherwise(F.lit(False)).alias("stop")
    )


def loss_curves(history: DataFrame, weight: str = "rows") -> DataFrame:
    """Row-weighted mean train and validation loss per (run, epoch)."""
    w = F.col(weight)
    return history.groupBy("run_id", "epoch").agg(
        (F.sum(F.col("train_loss") * w) / F.nullif(F.sum(w), F.lit(0))).alias("train_loss"),
        (F.sum(F.col("val_loss") * w) / F.nullif(F.sum(w), F.lit(0))).alias("val_loss"),
    )


def best_run(curves: DataFrame, loss: str = "val_loss") -> DataFrame:
    """The (run, epoch) with the lowest loss; ties go to the first run and epoch."""
    return curves.agg(F.min_by(F.struct("run_id", "epoch", loss), F.struct(loss, "run_id", "epoch")).alias("b")).select("b.*")
