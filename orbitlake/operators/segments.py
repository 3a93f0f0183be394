"""Segments of timelines: hidden states shared by all runs, and changes of level run by run.

``obs`` has one row per run (the columns ``by``), step ``t`` and value ``v``.
Values of one run come together; runs spread over all tasks.  What a round of
the hidden Markov model moves is one row of expected counts per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite
from ..sources.shared import materialised
from .quantiles import quantiles

#: Numbers (runs x steps x states) that are held at once, and the least variance of a state in units of the whole.
TOGETHER, LEAST_VARIANCE = 1 << 20, 1e-3


def series(obs: DataFrame, by: list[str]) -> DataFrame:
    """One row per run: its steps ``ts`` and values ``x`` in order; what is no finite number is NaN."""
    pairs = F.sort_array(F.collect_list(F.struct("t", F.coalesce(finite(F.col("v")), F.lit(float("nan"))).alias("v"))))
    made = obs.filter(F.col("t").isNotNull()).groupBy(*by).agg(pairs.alias("__p"))
    return made.select(*by, F.col("__p.t").alias("ts"), F.col("__p.v").alias("x"))


@dataclass
class Model:
    """A hidden Markov model with Gaussian values; states in order of their means."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log densities of the values (runs, steps) in each state; a missing value says nothing."""
        out = -0.5 * (np.log(2 * np.pi * self.variance) + (x[..., None] - self.mean) ** 2 / self.variance)
        return np.where(np.isnan(x)[..., None], 0.0, out)


def padded(rows: list[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs side by side, TOGETHER numbers at once: place of the first, values (NaN behind a run's end), lengths."""
    lo = 0
    while lo < len(rows):
        hi, longest = lo, 0
        while hi < len(rows) and (hi == lo or (hi + 1 - lo) * max(longest, len(rows[hi])) * width <= TOGETHER):
            longest, hi = max(longest, len(rows[hi])), hi + 1
        x = np.full((hi - lo, longest), np.nan)
        for i, row in enumerate(rows[lo:hi]):
            x[i, : len(row)] = row
        yield lo, x, np.array([len(r) for r in rows[lo:hi]])
        lo = hi


def expected(model: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Expected counts of runs, flat: starts, moves, values' weights, sums and squares by state, and the log likelihood."""
    k, (n, steps) = len(model.start), x.shape
    log_b = model.densities(x)
    top = log_b.max(2, keepdims=True)
    b, here = np.exp(log_b - top), np.arange(steps) < lengths[:, None]
    alpha, scale = np.empty((n, steps, k)), np.ones((n, steps))
    now = model.start * b[:, 0]
    for t in range(steps):
        if t:
            now = np.where(here[:, t, None], (alpha[:, t - 1] @ model.move) * b[:, t], alpha[:, t - 1])
        scale[:, t] = np.where(here[:, t], now.sum(1), 1.0)
        now = alpha[:, t] = now / scale[:, t, None]
    beta, moves = np.ones((n, steps, k)), np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        on = here[:, t + 1]
        ahead = b[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        moves += model.move * (alpha[on, t].T @ ahead[on])
        beta[:, t] = np.where(on[:, None], ahead @ model.move.T, 1.0)
    gamma = alpha * beta
    weight = np.where(np.isnan(x)[..., None], 0.0, gamma)
    value = np.nan_to_num(x)[..., None]
    fit = float((np.log(scale) + top[..., 0])[here].sum())
    return np.concatenate([gamma[:, 0].sum(0), moves.ravel(), weight.sum((0, 1)), (weight * value).sum((0, 1)), (weight * value**2).sum((0, 1)), [fit]])


def improved(model: Model, counts: np.ndarray) -> Model:
    """The model that the expected counts make likeliest; a state that nothing visits stays as it is."""
    k = len(model.start)
    start, moves, rest = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k : -1].reshape(3, k)
    total, weight = moves.sum(1, keepdims=True), rest[0]
    seen = weight > 1e-9
    mean = np.where(seen, rest[1] / np.where(seen, weight, 1), model.mean)
    variance = np.where(seen, np.maximum(rest[2] / np.where(seen, weight, 1) - mean**2, LEAST_VARIANCE), model.variance)
    return Model(start / max(start.sum(), 1e-300), np.where(total > 1e-9, moves / np.where(total > 1e-9, total, 1), model.move), mean, variance)


def likeliest(model: Model, x: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The likeliest path of states of every run (Viterbi); ties go to the lower state."""
    with np.errstate(divide="ignore"):
        log_start, log_move, log_b = np.log(model.start), np.log(model.move), model.densities(x)
    n, steps = x.shape
    came = np.zeros((n, steps, len(log_start)), np.int32)
    now = log_start + log_b[:, 0]
    for t in range(1, steps):
        options = now[:, :, None] + log_move
        came[:, t] = options.argmax(1)
        now = np.where((t < lengths)[:, None], options.max(1) + log_b[:, t], now)
    paths, at = np.zeros((n, steps), np.int32), now.argmax(1)
    for t in range(steps - 1, -1, -1):
        paths[:, t] = at
        at = np.where(t < lengths, came[np.arange(n), t, at], at) if t else at
    return [p[:m] for p, m in zip(paths, lengths, strict=True)]


def fit_states(runs: DataFrame, n_states: int = 3, rounds: int = 30, gain: float = 1e-4) -> tuple[Model, list[float]]:
    """Baum-Welch over all runs of :func:`series`: the model and the log likelihood before each round.

    Every round is one pass over the stored runs; a task adds up the expected
    counts of its runs, so one row per task is shuffled and n_states squared
    numbers reach the driver.  It starts from quantiles of all values and ends
    when a round gains less than ``gain`` of the likelihood a value.
    """
    values = runs.select(F.explode("x").alias("v")).filter("NOT isnan(v)")
    n, centre, spread = values.agg(F.count("v"), F.coalesce(F.avg("v"), F.lit(0.0)), F.coalesce(F.stddev_pop("v"), F.lit(0.0))).first()
    spread = spread or 1.0
    places = [(i + 0.5) / n_states for i in range(n_states)]
    found = quantiles(values.withColumn("one", F.lit(1)), ["one"], "v", places).collect()
    mean = (np.array(found[0]["q"] if found else np.arange(n_states)) - centre) / spread
    mean = mean + np.arange(n_states) * 1e-3  # equal quantiles would stay equal for ever
    stay = 0.9 if n_states > 1 else 1.0
    move = np.full((n_states, n_states), (1 - stay) / max(n_states - 1, 1)) + np.eye(n_states) * (stay - (1 - stay) / max(n_states - 1, 1))
    model, fits = Model(np.full(n_states, 1 / n_states), move, mean, np.full(n_states, max(1 / n_states**2, LEAST_VARIANCE))), []
    for _ in range(rounds):
        counts = _counts(runs, model, centre, spread)
        fits.append(float(counts[-1]) - n * float(np.log(spread)))
        if len(fits) > 1 and fits[-1] - fits[-2] < gain * max(n, 1):
            break
        model = improved(model, counts)
    order = np.argsort(model.mean, kind="stable")
    return Model(model.start[order], model.move[order][:, order], model.mean[order] * spread + centre, model.variance[order] * spread**2), fits


def _counts(runs: DataFrame, model: Model, centre: float, spread: float) -> np.ndarray:
    width = len(model.start)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width * width + 4 * width + 1)
        for frame in frames:
            for _, x, lengths in padded([(np.asarray(v, float) - centre) / spread for v in frame["x"] if len(v)], width):
                total += expected(model, x, lengths)
        yield pd.DataFrame({"counts": [total]})

    rows = runs.select("x").mapInPandas(step, "counts array<double>").select(F.posexplode("counts").alias("i", "c"))
    return np.array([r["c"] for r in rows.groupBy("i").agg(F.sum("c").alias("c")).orderBy("i").collect()])


def state_segments(obs: DataFrame, by: list[str], n_states: int = 3, rounds: int = 30, gain: float = 1e-4) -> DataFrame:
    """(by, segment, state, t_first, t_last, n, mean): each run cut where its likeliest hidden state changes.

    States are numbered by their means.  Missing values count as steps and say
    nothing of the state; rows without ``t`` are left out; an empty table gives
    an empty one.
    """
    runs = materialised(series(obs, by), "series")
    model, _ = fit_states(runs, n_states, rounds, gain)
    schema = T.StructType([*runs.schema.fields, T.StructField("states", T.ArrayType(T.IntegerType()))])

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            states = [p for _, x, lengths in padded([np.asarray(v, float) for v in frame["x"]], len(model.start)) for p in likeliest(model, x, lengths)]
            yield frame.assign(states=[list(map(int, s)) for s in states])

    return _cut(runs.mapInPandas(step, schema), by, "states").withColumnRenamed("mark", "state")


def _cut(runs: DataFrame, by: list[str], marks: str) -> DataFrame:
    """Stretches of equal marks of each run."""
    points = runs.select(*by, F.posexplode(F.arrays_zip("ts", "x", marks)).alias("__i", "__p")).select(*by, "__i", F.col("__p.ts").alias("t"), F.col("__p.x").alias("x"), F.col(f"__p.{marks}").alias("mark"))
    along = Window.partitionBy(*by).orderBy("__i")
    segment = F.sum(F.coalesce((F.col("mark") != F.lag("mark").over(along)).cast("int"), F.lit(0))).over(along)
    kept = F.when(~F.isnan("x"), F.col("x"))
    return points.withColumn("segment", segment).groupBy(*by, "segment", "mark").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count("*").alias("n"), F.avg(kept).alias("mean"))


def optimal_cuts(x: np.ndarray, penalty: float) -> list[int]:
    """Where a series is best cut into stretches of constant level: least squared error plus ``penalty`` a cut.

    Exact, by dynamic programming; a start that is already worse than the best
    by the error alone can never win and leaves the candidates.
    """
    n = len(x)
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best, came, open_ = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.zeros(1, np.int64)
    best[0] = -penalty
    for t in range(1, n + 1):
        cost = best[open_] + (q[t] - q[open_]) - (s[t] - s[open_]) ** 2 / (t - open_)
        at = int(cost.argmin())
        best[t], came[t] = cost[at] + penalty, open_[at]
        open_ = np.append(open_[cost <= best[t]], t)
    cuts, t = [], n
    while came[t]:
        t = int(came[t])
        cuts.append(t)
    return cuts[::-1]


def level_changes(obs: DataFrame, by: list[str], strength: float = 2.0) -> DataFrame:
    """(by, segment, t_first, t_last, n, mean): each run cut where its level changes, at any number of places.

    A cut costs ``strength`` x ln(n) x the variance of the noise, which is half
    the mean squared step.  Missing values are left out; a run without any has
    no row.
    """
    runs = series(obs.filter(finite(F.col("v")).isNotNull()), by)
    schema = T.StructType([*runs.schema.fields, T.StructField("levels", T.ArrayType(T.IntegerType()))])

    def one(values) -> list[int]:
        x = np.asarray(values, float)
        x = x - x.mean()
        noise = float(np.mean(np.diff(x) ** 2)) / 2 if len(x) > 1 else 0.0
        return np.searchsorted(optimal_cuts(x, strength * np.log(max(len(x), 2)) * noise), np.arange(len(x)), side="right").tolist()

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(levels=[one(v) for v in frame["x"]])

    return _cut(runs.mapInPandas(step, schema), by, "levels").drop("mark")
