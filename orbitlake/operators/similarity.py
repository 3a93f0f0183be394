"""Likeness of timelines: repeated motifs within a run, and nearest runs under time warping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite
from ..sources.shared import materialised
from .segments import series

#: Diagonals of a run's distances that one row stands for; a run is as many rows as it has blocks of them.
DIAGONALS = 256
#: Values (queries x length) that a job sends to its tasks, candidates that are warped together, and runs that are looked at together.
QUERY_VALUES, CHUNK, TOGETHER = 1 << 20, 1024, 1024
#: Salts of the groups that are ranked apart first.
SALTS = 16


def windows(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of all windows; a window that hardly varies has deviation 0."""
    views = np.lib.stride_tricks.sliding_window_view(x, width)
    mean, spread = views.mean(1), views.std(1)
    return mean, np.where(spread < 1e-12 * (1 + np.abs(x).max()), 0.0, spread)


def diagonal(x: np.ndarray, width: int, lag: int, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Distances of the z-normalised windows at i and i + lag, from running products of the values."""
    products = np.concatenate([[0.0], np.cumsum(x[:-lag] * x[lag:])])
    dots = products[width:] - products[:-width]
    a, b = spread[:-lag], spread[lag:]
    flat = (a == 0) | (b == 0)
    alike = (dots - width * mean[:-lag] * mean[lag:]) / np.where(flat, 1.0, width * a * b)
    apart = np.sqrt(2 * width * np.maximum(1 - alike, 0.0))
    return np.where(flat, np.where((a == 0) & (b == 0), 0.0, np.sqrt(width)), apart)


def matrix_profile(obs: DataFrame, by: list[str], width: int = 8) -> DataFrame:
    """(by, i, j, distance): for each window of ``width`` values of a run its nearest other one at least ``width`` values away.

    i and j count the run's values from 0; distances are Euclidean between
    z-normalised windows, two constant windows are 0 apart and one is sqrt(width)
    from all others.  Ties go to the smaller j.  Missing values are left out, so
    windows run over them; runs too short for two windows have no rows.  A run's
    diagonals are dealt to tasks in blocks, so a long one is no task of its own.
    """
    runs = series(obs.filter(finite(F.col("v")).isNotNull()), by).drop("ts")
    n = F.size("x") - width + 1
    blocks = runs.filter(n > width).withColumn("first", F.explode(F.sequence(F.lit(width), n - 1, F.lit(DIAGONALS))))
    blocks = blocks.repartition(*by, "first")
    schema = T.StructType([*[f for f in runs.schema if f.name != "x"], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("other", T.ArrayType(T.IntegerType())), T.StructField("apart", T.ArrayType(T.DoubleType()))])

    def one(values, first: int) -> tuple[list, list, list]:
        x = np.asarray(values, float)
        x = x - x.mean()
        mean, spread = windows(x, width)
        best, other = np.full(len(mean), np.inf), np.full(len(mean), len(mean))
        for lag in range(first, min(first + DIAGONALS, len(mean))):
            d, i = diagonal(x, width, lag, mean, spread), np.arange(len(mean) - lag)
            for here, there in ((i, i + lag), (i + lag, i)):
                nearer = (d < best[here]) | ((d == best[here]) & (there < other[here]))
                best[here[nearer]], other[here[nearer]] = d[nearer], there[nearer]
        at = np.flatnonzero(np.isfinite(best))
        return at.tolist(), other[at].tolist(), best[at].tolist()

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [one(v, int(f)) for v, f in zip(frame["x"], frame["first"], strict=True)]
            out = frame[list(by)].copy()
            for c, i in (("at", 0), ("other", 1), ("apart", 2)):
                out[c] = [m[i] for m in made]
            yield out

    rows = blocks.mapInPandas(step, schema).select(*by, F.explode(F.arrays_zip("at", "other", "apart")).alias("p"))
    best = F.min(F.struct(F.col("p.apart").alias("d"), F.col("p.other").alias("j")))
    return rows.groupBy(*by, F.col("p.at").alias("i")).agg(best.alias("b")).select(*by, "i", F.col("b.j").alias("j"), F.col("b.d").alias("distance"))


def motifs(profile: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, distance): each run's two most alike windows, the first pair among ties."""
    best = F.min(F.struct("distance", "i", "j"))
    return profile.groupBy(*by).agg(best.alias("b")).select(*by, "b.i", "b.j", "b.distance")


def shaped(values, length: int) -> np.ndarray:
    """A series z-normalised and drawn at ``length`` even places by linear interpolation; a constant one is 0."""
    x = np.asarray(values, float)
    x = np.interp(np.linspace(0, len(x) - 1, length), np.arange(len(x)), x)
    spread = x.std()
    return (x - x.mean()) / spread if spread > 1e-12 else np.zeros(length)


def warped(query: np.ndarray, rows: np.ndarray, band: int) -> np.ndarray:
    """Warped distances (squared steps, band around the diagonal) of one series, or one a row, to many of its length."""
    n = rows.shape[1]
    above = np.full((len(rows), n + 1), np.inf)
    above[:, 0] = 0.0
    for i in range(n):
        now = np.full((len(rows), n + 1), np.inf)
        for j in range(max(0, i - band), min(n, i + band + 1)):
            now[:, j + 1] = (query.T[i] - rows[:, j]) ** 2 + np.minimum(np.minimum(above[:, j], above[:, j + 1]), now[:, j])
        above = now
    return np.sqrt(above[:, n])


def envelope(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values of a series within ``band`` places of each."""
    wide = np.pad(x, band, mode="edge")
    views = np.lib.stride_tricks.sliding_window_view(wide, 2 * band + 1)
    return views.min(1), views.max(1)


def lower_bounds(query: np.ndarray, rows: np.ndarray, band: int) -> np.ndarray:
    """What no warped distance goes below: how far each series leaves the query's envelope."""
    low, high = envelope(query, band)
    return np.sqrt((np.maximum(rows - high, 0) ** 2 + np.maximum(low - rows, 0) ** 2).sum(1))


def lower_bounds_of(query: np.ndarray, columns: np.ndarray, band: int) -> np.ndarray:
    """:func:`lower_bounds` of the series that are the columns, in single precision."""
    low, high = (e.astype(np.float32)[:, None] for e in envelope(query, band))
    out = np.maximum(columns, low)
    np.minimum(out, high, out=out)
    np.subtract(columns, out, out=out)
    np.multiply(out, out, out=out)
    return np.sqrt(out.sum(axis=0))


def upper_bounds(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What no warped distance of these queries to these series exceeds: the distance without warping."""
    squares = (query * query).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2 * (query @ rows.T)
    return np.sqrt(np.maximum(squares, 0.0))


def widened(distance):
    """What a distance in double precision is at most, by its value in single precision."""
    return np.sqrt(distance * distance * (1 + 1e-4) + 1e-3)


def warped_within(query: np.ndarray, columns: np.ndarray, band: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (single precision) of the series, the columns, whose warped distance to ``query`` may be ``most`` or less.

    Cells are summed in single precision, row by row of the warping matrix; what
    the sums of a row, and what the rest must add at least, put beyond ``most``
    is dropped on the way.  The margin is far above what rounding adds up to.
    """
    n = len(query)
    limit = np.float32(widened(most) ** 2)
    q, at, wide = query.astype(np.float32), np.arange(columns.shape[1]), 2 * band + 1
    side = np.full((band, len(at)), np.inf, np.float32)
    columns = np.concatenate([side, columns, side])
    above = np.full((wide + 1, len(at)), np.inf, np.float32)  # the cells within the band of a row, from the left
    above[band] = 0
    now, cost = np.empty_like(above), np.empty_like(above[1:])
    for i in range(n):
        np.subtract(columns[i : i + wide], q[i], out=cost)
        np.multiply(cost, cost, out=cost)
        np.minimum(above[:-1], above[1:], out=now[:-1])
        now[0] += cost[0]
        for c in range(1, wide):
            cell = now[c]
            np.minimum(cell, now[c - 1], out=cell)
            np.add(cell, cost[c], out=cell)
        now[wide] = np.inf
        above, now = now, above
        if i % 8 == 7 and i + 1 < n:
            able = np.flatnonzero(above.min(axis=0) <= limit)
            if len(able) < 0.8 * len(at):
                if not len(able):
                    return at[:0], np.zeros(0)
                at, columns, above = at[able], columns.take(able, axis=1), above.take(able, axis=1)
                now, cost = np.empty_like(above), np.empty_like(above[1:])
    near = above[band] <= limit
    return at[near], np.sqrt(above[band][near].astype(float))


def nearest_runs(obs: DataFrame, key: str, asked: Column, k: int = 3, length: int = 64, band: int = 6) -> DataFrame:
    """(query, key, rank, distance, n_runs, n_warped): for each run that ``asked`` holds for, the k nearest others under time warping.

    Runs are z-normalised and brought to ``length`` places, and stored.  The
    asked runs are sent to all tasks in blocks of QUERY_VALUES.  A first pass
    finds each query's k nearest runs without warping, over all runs: a bound of
    its k-th warped distance that all tasks of the second pass begin with.
    There, runs whose lower bound exceeds the best bound so far are never warped,
    others are warped together in single precision until they exceed it, and
    what may remain is warped in double precision: none that could be among the
    k is left out, and distances are exact.  ``n_warped`` of the ``n_runs``
    others were warped.  Ties go to the smaller key; missing values are left
    out, keys are distinct and not null.  k rows per query leave a task.
    """
    kind = obs.schema[key].dataType
    raw = series(obs.filter(finite(F.col("v")).isNotNull() & F.col(key).isNotNull()), [key]).drop("ts")

    def shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "x": [shaped(x, length).tobytes() for x in frame["x"]]})

    runs = materialised(raw.mapInPandas(shape, T.StructType([T.StructField(key, kind), T.StructField("x", T.BinaryType())])), "runs")
    tasks = max(1, runs.sparkSession.sparkContext.defaultParallelism)
    dealt = runs.repartition(tasks)
    chosen = runs.filter(asked)
    n_blocks = max(1, -(-chosen.count() * length // QUERY_VALUES))
    schema = T.StructType([T.StructField("query", kind), T.StructField(key, kind), T.StructField("distance", T.DoubleType()), T.StructField("n_runs", T.LongType()), T.StructField("n_warped", T.LongType())])

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for frame in frames:
            for lo in range(0, len(frame), TOGETHER):
                part = frame.iloc[lo : lo + TOGETHER]
                yield part[key].to_numpy(), np.frombuffer(b"".join(part["x"])).reshape(-1, length)

    out = None
    for block in range(n_blocks):
        mine = chosen if n_blocks == 1 else chosen.filter(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == block)
        asked_rows = [(r[key], np.frombuffer(r["x"])) for r in mine.collect()]
        names = [n for n, _ in asked_rows]
        queries = np.stack([x for _, x in asked_rows]) if asked_rows else np.zeros((0, length))

        def plain(frames: Iterator[pd.DataFrame], names=names, queries=queries) -> Iterator[pd.DataFrame]:
            best = np.full((len(names), k), np.inf)
            place = {n: i for i, n in enumerate(names)}
            for keys, rows in matrices(frames):
                own = [(place[n], i) for i, n in enumerate(keys.tolist()) if n in place]
                for lo in range(0, len(names), TOGETHER // 4):
                    d = upper_bounds(queries[lo : lo + TOGETHER // 4], rows)
                    for q, i in own:
                        if lo <= q < lo + len(d):
                            d[q - lo, i] = np.inf
                    near = np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d
                    best[lo : lo + len(d)] = np.sort(np.concatenate([best[lo : lo + len(d)], near], axis=1), axis=1)[:, :k]
            for c in range(k if len(names) else 0):
                yield pd.DataFrame({"at": np.arange(len(names)), "bound": best[:, c]})

        kth = F.row_number().over(Window.partitionBy("at").orderBy("bound"))
        ranked = dealt.mapInPandas(plain, "at int, bound double").withColumn("r", kth).filter(F.col("r") == k)
        bounds = np.full(len(names), np.inf)
        for r in ranked.collect():
            bounds[r["at"]] = r["bound"] + 1e-6

        def step(frames: Iterator[pd.DataFrame], names=names, queries=queries, bounds=bounds) -> Iterator[pd.DataFrame]:
            least = bounds.copy()
            apart, places, held, held_keys = [np.zeros(0)] * len(names), [np.zeros(0, np.int64)] * len(names), [], []
            seen, done, base = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), 0
            for keys, rows in matrices(frames):
                columns, here = np.ascontiguousarray(rows.T, np.float32), {n: i for i, n in enumerate(keys.tolist())}
                kept = []
                for q, (name, query) in enumerate(zip(names, queries, strict=True)):
                    seen[q] += len(rows) - (name in here)
                    low = lower_bounds_of(query, columns, band)
                    part = np.flatnonzero(low <= widened(least[q]))
                    part = part[part != here.get(name, -1)]
                    for lo in range(0, len(part), CHUNK):
                        some = part[lo : lo + CHUNK]
                        some = some[low[some] <= widened(least[q])]
                        done[q] += len(some)
                        if not len(some):
                            continue
                        at, d = warped_within(query, columns if len(some) == columns.shape[1] else columns.take(some, axis=1), band, least[q])
                        if len(at):
                            both, where = np.append(apart[q], d), np.append(places[q], base + some[at])
                            if len(both) >= k:
                                least[q] = min(least[q], widened(np.partition(both, k - 1)[k - 1]))
                            near = both <= widened(least[q])
                            apart[q], places[q] = both[near], where[near]
                            kept.append(some[at])
                some = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
                held.append((base + some, rows[some]))
                held_keys += keys[some].tolist()
                base += len(rows)
            if not base:
                return
            at, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            owner = np.repeat(np.arange(len(names)), [len(p) for p in places])
            place = np.searchsorted(at, np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64))
            exact = np.concatenate([warped(queries[owner[lo : lo + CHUNK]], rows[place[lo : lo + CHUNK]], band) for lo in range(0, len(place), CHUNK)] or [np.zeros(0)])
            best: list[list[tuple]] = [[] for _ in names]
            for q, i, d in zip(owner.tolist(), place.tolist(), exact.tolist(), strict=True):
                best[q].append((d, held_keys[i]))
            for q, found in enumerate(best):
                made = [(names[q], name, d) for d, name in sorted(found)[:k]] or [(names[q], None, float("inf"))]
                yield pd.DataFrame([(*m, int(seen[q]) * (i == 0), int(done[q]) * (i == 0)) for i, m in enumerate(made)], columns=schema.names)

        made = dealt.mapInPandas(step, schema)
        out = made if out is None else out.unionByName(made)
    totals = Window.partitionBy("query")
    made = out.withColumns({"n_runs": F.sum("n_runs").over(totals), "n_warped": F.sum("n_warped").over(totals)})
    made = made.filter(F.col(key).isNotNull())
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", key)))
    return ranked.filter(F.col("rank") <= k).select("query", key, "rank", "distance", "n_runs", "n_warped")
