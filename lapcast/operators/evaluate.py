"""Forecast metrics for any grouping, in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinball_of(y: Column, forecast: Column, q: float) -> Column:
    e = y - forecast
    return F.greatest(q * e, (q - 1) * e)


def pinball(pred: DataFrame, by: Sequence[str] = (), quantiles: dict[str, float] | None = None) -> DataFrame:
    """Mean pinball loss per quantile column, and their mean."""
    quantiles = quantiles or {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    losses = {c: F.avg(pinball_of(F.col("y"), F.col(c), q)) for c, q in quantiles.items()}
    overall = sum(list(losses.values())[1:], list(losses.values())[0]) / len(losses)
    return pred.groupBy(*by).agg(*[v.alias(f"pinball_{c}") for c, v in losses.items()], overall.alias("pinball"))


def interval_score(alpha: float = 0.2) -> Column:
    """Winkler score of one row: width plus 2/alpha times the miss."""
    y, low, high = F.col("y"), F.col("q10"), F.col("q90")
    zero = F.lit(0.0)
    miss = F.greatest(low - y, zero) + F.greatest(y - high, zero)
    return high - low + (2 / alpha) * miss


def evaluate(pred: DataFrame, by: Sequence[str] = (), alpha: float = 0.2) -> DataFrame:
    """MAE, RMSE, MAPE, pinball, coverage, Winkler and the coverage-penalised score per group.

    ``pred`` has y, q10, q50, q90 with crossing already removed. MAPE leaves out rows whose
    true value is 0 and reports how many there were.
    """
    y, mid = F.col("y"), F.col("q50")
    inside = F.avg(y.between(F.col("q10"), F.col("q90")).cast("double"))
    winkler = F.avg(interval_score(alpha))
    losses = [F.avg(pinball_of(y, F.col(c), q)) for c, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))]
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(mid - y)).alias("mae"),
        F.sqrt(F.avg((mid - y) * (mid - y))).alias("rmse"),
        (F.avg(F.abs((y - mid) / F.nullif(y, F.lit(0.0)))) * 100).alias("mape"),
        F.count_if(y == 0).alias("mape_excluded"),
        losses[0].alias("pinball_q10"),
        losses[1].alias("pinball_q50"),
        losses[2].alias("pinball_q90"),
        ((losses[0] + losses[1] + losses[2]) / 3).alias("pinball"),
        (inside * 100).alias("coverage"),
        winkler.alias("winkler"),
        (winkler / 10 + 20 * F.abs(inside - (1 - alpha))).alias("penalised_score"),
    )
