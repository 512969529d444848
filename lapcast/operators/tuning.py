"""Searching settings of the quantile regression with all candidates in the same scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapcast.operators.forecast import _matrix, _moments
from lapcast.schema import QUANTILES

#: What a scan adds up over the validation rows of a candidate: rows, three pinball losses, rows inside the band, interval score.
_SCORES = 6


@dataclass
class Candidate:
    """One setting: the features it uses (by place), its ridge and the least absolute residual in its weights."""

    trial: int
    columns: np.ndarray
    ridge: float
    epsilon: float
    coef: np.ndarray | None = None  # (horizon, quantile, 1 + columns)
    going: bool = True


@dataclass
class Search:
    """``curves``: trial, epoch, pinball, coverage, winkler, penalised_score, one row for each round a candidate took part in.
    ``scores``: trial, settings, epochs, stopped and the figures of its last round. ``best``: the settings with the lowest score."""

    curves: DataFrame
    scores: DataFrame
    best: dict
    candidates: list[Candidate]
    scans: int


def _scan(table: DataFrame, going: list[Candidate], p: int, h: int, levels: np.ndarray, scale: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of all candidates' fits over training rows and scores of their coefficients over the others, in one pass.

    A task sends a row for each (candidate, horizon, quantile, feature); Spark adds them up.
    """
    mean, std, centre, spread = scale
    q, c, width = len(levels), len(going), max(p + 2, _SCORES)
    plans = [(np.concatenate([[0], g.columns + 1]), g.coef, g.epsilon) for g in going]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, scores = np.zeros((c, h, q, p + 1, width)), np.zeros((c, _SCORES))
        for b in batches:
            x = (_matrix(b.column(0), p) - mean) / std
            y = (_matrix(b.column(1), h) - centre) / spread
            train = np.asarray(b.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for k, (columns, coef, epsilon) in enumerate(plans):
                own = x[:, columns]
                lines = np.einsum("nf,hqf->nhq", own, coef)
                _add_scores(scores[k], y[~train], lines[~train], levels)
                own, size = own[train], len(columns)
                for i in range(h):
                    target = y[train, i]
                    for j in range(q):
                        e = target - lines[train, i, j]
                        w = np.where(e >= 0, levels[j], 1 - levels[j]) / np.maximum(np.abs(e), epsilon)
                        weighted = own * w[:, None]
                        gram[k, i, j, :size, :size] += weighted.T @ own
                        gram[k, i, j, :size, p + 1] += weighted.T @ target
        flat = np.concatenate([gram.reshape(-1, width), np.pad(scores, ((0, 0), (0, width - _SCORES)))])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), lists], names=["i", "g"])

    added = table.select("x", "target", "train").mapInArrow(partial, "i int, g array<double>").groupBy("i")
    out = np.zeros((c * h * q * (p + 1) + c, width))
    for row in added.agg(F.array(*[F.sum(F.get("g", F.lit(w))) for w in range(width)]).alias("g")).collect():
        out[row["i"]] = row["g"]
    return out[:-c].reshape(c, h, q, p + 1, width), out[-c:, :_SCORES]


def _add_scores(total: np.ndarray, y: np.ndarray, lines: np.ndarray, levels: np.ndarray) -> None:
    """Sums over rows and horizons, crossing removed as :func:`finish_quantiles` does."""
    low, mid, high = np.minimum(lines[..., 0], lines[..., 1]), lines[..., 1], np.maximum(lines[..., 2], lines[..., 1])
    total[0] += y.size
    for j, line in enumerate((low, mid, high)):
        e = y - line
        total[1 + j] += np.maximum(levels[j] * e, (levels[j] - 1) * e).sum()
    total[4] += ((y >= low) & (y <= high)).sum()
    total[5] += (high - low + 10 * (np.maximum(low - y, 0) + np.maximum(y - high, 0))).sum()


def _solve(g: np.ndarray, candidate: Candidate, n: int, p: int) -> np.ndarray:
    """New coefficients; the weights are brought to mean 1, so that the ridge means the same in every round."""
    size = len(candidate.columns) + 1
    penalty = candidate.ridge * n * np.eye(size)
    penalty[0, 0] = 1e-9 * n
    out = np.zeros((*g.shape[:2], size))
    for i, j in np.ndindex(*g.shape[:2]):
        weight = g[i, j, 0, 0] / n
        out[i, j] = np.linalg.solve(g[i, j, :size, :size] / weight + penalty, g[i, j, :size, p + 1] / weight)
    return out


def _figures(sums: np.ndarray, unit: float) -> tuple[float, ...]:
    """Pinball, coverage, interval score and the coverage-penalised score, in the target's unit times ``unit``."""
    n = max(sums[0], 1)
    inside, winkler = sums[4] / n, sums[5] / n * unit
    return sums[1:4].sum() / 3 / n * unit, inside * 100, winkler, winkler / 10 + 20 * abs(inside - 0.8)


def _to_stop(curves: list[tuple], trials: list[int], epoch: int, startup: int) -> set[int]:
    """The verdict of :func:`lapcast.operators.runs.median_stop` on pinball losses at one epoch: trials x epochs numbers, so it is given here."""
    losses = {t: {} for t in trials}
    for trial, at, loss, *_ in curves:
        losses[trial][at] = loss
    stop = set()
    for i, trial in enumerate(trials):
        earlier = [losses[t][epoch] for t in trials[:i] if epoch in losses[t]]
        if i >= startup and epoch in losses[trial] and earlier and min(losses[trial].values()) > np.median(earlier):
            stop.add(trial)
    return stop


def search_together(
    table: DataFrame,
    features: Sequence[str],
    trials: DataFrame,
    uses: Callable[[dict], Sequence[str]],
    rounds: int = 5,
    metric: str = "penalised_score",
    startup: int = 5,
    warmup: int = 1,
    unit: float = 1.0,
) -> Search:
    """Fit every row of ``trials`` (``trial``, ``ridge``, ``epsilon`` and whatever ``uses`` reads) for ``rounds`` rounds.

    ``table`` has ``x``, ``target`` and ``train``; rows that are not for training are scored. ``uses`` names the features of a
    candidate. Every round is one scan for all candidates, which also scores the coefficients of the round before; after it
    candidates that ``median_stop`` tells to stop by their pinball loss (in trial order, after ``startup`` trials and ``warmup``
    rounds) take part no longer. So ``rounds`` + 2 scans in all, however many candidates. A candidate's coefficients are those it
    would get alone. The best candidate is one that was not stopped; ties go to the first trial.
    """
    features, levels = list(features), np.array(QUANTILES)
    first = table.select(F.size("target").alias("h"), F.size("x").alias("p")).first()
    if first is None:
        raise ValueError("no windows to search on")
    h, p, place = first["h"], len(features), {f: i for i, f in enumerate(features)}
    if first["p"] != p:
        raise ValueError(f"windows have {first['p']} features, {p} names given")
    n, mean, std, centre, spread = _moments(table.where("train").select("x", "target"), p, h)
    settings = [r.asDict() for r in trials.orderBy("trial").toLocalIterator()]
    candidates = []
    for s in settings:
        columns = np.array([place[f] for f in uses(s)], dtype=int)
        candidates.append(Candidate(s["trial"], columns, s["ridge"], s["epsilon"], np.zeros((h, len(levels), len(columns) + 1))))
    curves: list[tuple] = []
    spark = table.sparkSession
    schema = "trial int, epoch int, pinball double, coverage double, winkler double, penalised_score double"
    for scan in range(rounds + 1):
        going = [c for c in candidates if c.going]
        gram, scores = _scan(table, going, p, h, levels, (mean, std, centre, spread))
        if scan:
            curves += [(c.trial, scan, *(float(v) for v in _figures(s, unit * spread))) for c, s in zip(going, scores)]
            if scan > warmup and scan < rounds:
                stop = _to_stop(curves, [c.trial for c in candidates], scan, startup)
                for c in going:
                    c.going = c.trial not in stop
        if scan < rounds:
            for c, g in zip(going, gram):
                if c.going:
                    c.coef = _solve(g, c, n, p)
    made = spark.createDataFrame(curves, schema)
    kinds = {f.name: f.dataType.simpleString() for f in trials.schema.fields}
    last = {t: row for t, *row in curves}
    stopped = {c.trial: not c.going for c in candidates}
    rows = [(*(s[k] for k in kinds), last[s["trial"]][0], stopped[s["trial"]], *last[s["trial"]][1:]) for s in settings]
    names = ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    scored = spark.createDataFrame(rows, f"{names}, epochs int, stopped boolean, pinball double, coverage double, winkler double, penalised_score double")
    at = ["epoch", "pinball", "coverage", "winkler", "penalised_score"].index(metric)
    best = min((s for s in settings if not stopped[s["trial"]]), key=lambda s: (last[s["trial"]][at], s["trial"]))
    return Search(made, scored, best, candidates, rounds + 2)
