"""Comparisons of runs: healthy cousins of failed runs, agreement of phases, frontiers of viability."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import join_on

#: Salts of a design key that many failed runs share.
SALTS = 16
#: Fewest observations that a comparison of phases is trusted with: fixed value of the charter.
FEWEST = 10


def cousins(runs: DataFrame, run_id: str, axes: list[str], healthy: Column, value: str) -> DataFrame:
    """(run_id, axis, n_cousins, cousin_mean, cousin_min, cousin_max, gap): per failed run and axis the healthy runs that differ in that axis alone.

    A run's wildcard keys are its design key with one axis left out, one key an
    axis.  Healthy runs are first added up by wildcard key and value of the axis
    left out, then by wildcard key alone; a run's cousins are what the key holds
    less what has the run's own value there, so runs never meet in pairs and the
    work grows with runs times axes.  Null is a value of an axis like any other;
    null values of ``value`` count as cousins without a value; ``gap`` is the
    run's value less the cousins' mean.  Runs without cousins have 0 and nulls.
    A key that holds a third of all failed runs is met in SALTS parts.
    """
    wild = F.array(*[F.struct(F.lit(a).alias("axis"), F.struct(*[F.when(F.lit(a != b), F.col(b)).alias(b) for b in axes]).alias("key"), F.col(a).cast("string").alias("own")) for a in axes])
    rows = runs.select(run_id, F.coalesce(healthy, F.lit(False)).alias("__ok"), F.col(value).cast("double").alias("__v"), F.explode(wild).alias("__w"))
    rows = rows.select(run_id, "__ok", "__v", F.col("__w.axis").alias("axis"), F.col("__w.key").alias("__key"), F.col("__w.own").alias("__own"))
    parts = rows.filter("__ok").groupBy("axis", "__key", "__own").agg(F.count("*").alias("n"), F.count("__v").alias("m"), F.sum("__v").alias("s"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    #: Least and greatest of the others: a key's two outermost values by different ones of the axis are enough.
    by_key = Window.partitionBy("axis", "__key")
    low, high = by_key.orderBy(F.asc_nulls_last("lo"), "__own"), by_key.orderBy(F.desc_nulls_last("hi"), "__own")
    ranked = parts.withColumns({"__low": F.row_number().over(low), "__high": F.row_number().over(high)})
    outer = lambda order, c: F.sort_array(F.collect_list(F.when(F.col(order) <= 2, F.struct(F.col(order).alias("place"), F.col("__own").alias("own"), F.col(c).alias("x")))))
    whole = ranked.groupBy("axis", "__key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s"), outer("__low", "lo").alias("lows"), outer("__high", "hi").alias("highs"))
    salted = whole.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    failed = rows.filter("NOT __ok").withColumn("__salt", F.pmod(F.xxhash64(run_id), F.lit(SALTS)).cast("int"))
    met = join_on(failed, salted, ["axis", "__key", "__salt"], how="left")
    own = parts.select("axis", "__key", "__own", F.col("n").alias("__n"), F.col("m").alias("__m"), F.col("s").alias("__s")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = join_on(met, own, ["axis", "__key", "__own", "__salt"], how="left")
    n, m = F.coalesce("n", F.lit(0)) - F.coalesce("__n", F.lit(0)), F.coalesce("m", F.lit(0)) - F.coalesce("__m", F.lit(0))
    mean = F.when(m > 0, (F.col("s") - F.coalesce("__s", F.lit(0.0))) / m)
    other = lambda c: F.get(F.filter(c, lambda e: ~e["own"].eqNullSafe(F.col("__own"))), F.lit(0))["x"]
    return met.select(run_id, "axis", n.alias("n_cousins"), mean.alias("cousin_mean"), other("lows").alias("cousin_min"), other("highs").alias("cousin_max"), (F.col("__v") - mean).alias("gap"))


def contingency(first: DataFrame, second: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(a, b, n): how many of the keys that both phases have carry label a in the first and b in the second.

    Keys are unique in a phase; rows with a null label or key are left out.
    """
    held = [df.select(*keys, F.col(label).alias(c)).filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in [*keys, c]])) for df, c in ((first, "a"), (second, "b"))]
    return held[0].join(held[1], keys).groupBy("a", "b").agg(F.count("*").alias("n"))


def agreement(counts: DataFrame) -> DataFrame:
    """One row from :func:`contingency`: ``n``, labels on both sides, the adjusted Rand index and whether it is reliable (FEWEST observations).

    Labels that are all one, or all different, on both sides agree fully: 1.
    """
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    side = lambda c: counts.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias(f"p{c}"), F.count("*").alias(f"k{c}"))
    cells = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("p"))
    one = cells.crossJoin(F.broadcast(side("a"))).crossJoin(F.broadcast(side("b")))  # one row each
    chance = F.try_divide(F.col("pa") * F.col("pb"), pairs("n"))
    most = (F.col("pa") + F.col("pb")) / 2
    index = F.when(most == F.coalesce(chance, F.lit(0.0)), 1.0).otherwise((F.col("p") - chance) / (most - chance))
    return one.select("n", F.col("ka").alias("n_first"), F.col("kb").alias("n_second"), index.alias("adjusted_rand"), (F.col("n") >= FEWEST).alias("reliable"))


def assigned(gain: np.ndarray) -> np.ndarray:
    """The column of each row in the assignment of greatest total gain, -1 for rows left over.

    Shortest augmenting paths with potentials, a row at a time.
    """
    rows, columns = gain.shape
    if rows > columns:
        back = assigned(gain.T)
        out = np.full(rows, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    cost = gain.max(initial=0) - gain.astype(float)
    u, v, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for row in range(rows):
        least, came, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        here, at, base = row, -1, 0.0
        while True:
            reduced = base + cost[here] - u[here] - v
            nearer = ~done & (reduced < least)
            least[nearer], came[nearer] = reduced[nearer], at
            at = int(np.where(done, np.inf, least).argmin())
            base, done[at] = least[at], True
            if owner[at] < 0:
                break
            here = owner[at]
        settled = done & (owner >= 0)
        u[row] += base
        u[owner[settled]] += base - least[settled]
        v[settled] -= base - least[settled]
        while came[at] >= 0:
            owner[at], at = owner[came[at]], came[at]
        owner[at] = row
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def matched_labels(counts: DataFrame) -> DataFrame:
    """(a, b, n): each label of the first phase with its counterpart in the second, so that most observations agree in all.

    Labels without a counterpart have null and 0.  The cells of the labels
    reach the driver: as many as label pairs that occur, which are clusters and
    few by nature.
    """
    cells = counts.orderBy("a", "b").collect()
    first, second = sorted({c["a"] for c in cells}), sorted({c["b"] for c in cells})
    gain = np.zeros((len(first), len(second)))
    for c in cells:
        gain[first.index(c["a"]), second.index(c["b"])] = c["n"]
    found = assigned(gain) if cells else []
    schema = T.StructType([T.StructField("a", counts.schema["a"].dataType), T.StructField("b", counts.schema["b"].dataType), T.StructField("n", T.LongType())])
    return counts.sparkSession.createDataFrame([(a, second[j] if j >= 0 and gain[i, j] else None, int(gain[i, j]) if j >= 0 else 0) for i, (a, j) in enumerate(zip(first, found, strict=True))], schema)


def drifts(first: DataFrame, second: DataFrame, matches: DataFrame, entity: str, label: str) -> DataFrame:
    """(entity, first, second, expected, drifted): each entity's dominant label in both phases (ties: the least), and whether the second is not the first's counterpart."""

    def dominant(df: DataFrame, name: str) -> DataFrame:
        counted = df.filter(F.col(entity).isNotNull() & F.col(label).isNotNull()).groupBy(entity, label).agg(F.count("*").alias("n"))
        return counted.groupBy(entity).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b")).select(entity, F.col("b.l").alias(name))

    both = dominant(first, "first").join(dominant(second, "second"), entity)
    told = both.join(F.broadcast(matches.select(F.col("a").alias("first"), F.col("b").alias("expected"))), "first", "left")  # a row a label
    return told.select(entity, "first", "second", "expected", (~F.col("second").eqNullSafe(F.col("expected"))).alias("drifted"))


def concordance(first: DataFrame, second: DataFrame, keys: list[str], entity: str, label: str) -> dict[str, Any]:
    """What two phases say of their common runs: ``summary``, ``matches`` and ``drifts`` as tables, and a ``warning`` under FEWEST observations."""
    counts = contingency(first, second, keys, label).persist()
    summary, matches = agreement(counts), matched_labels(counts)
    common = [df.join(other.select(*keys), keys, "left_semi") for df, other in ((first, second), (second, first))]
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return {"summary": summary, "matches": matches, "drifts": drifts(*common, matches, entity, label), "warning": f"only {n} common observations, {FEWEST} are needed" if n < FEWEST else None}


def monotone(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing rates nearest to ``rate`` in weighted squares: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for r, w in zip(rate, weight, strict=True):
        pools.append([r * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2] + n]
    return np.repeat([s / w for s, w, _ in pools], [int(n) for *_, n in pools])


def frontiers(runs: DataFrame, entity: str, parameters: list[str], viable: Column, level: float = 0.5) -> DataFrame:
    """(entity, parameter, n, n_values, direction, least, most, threshold): where along a parameter an entity stops being viable.

    Rates of viable runs by value of the parameter are made monotone, upwards
    or downwards, whichever is nearer to them (ties: upwards).  ``threshold`` is
    the first value, from the low end, on the other side of ``level`` than the
    lowest value's fitted rate; null if the rate does not cross it.  Runs are
    counted by entity, parameter and value before they meet, so an entity's
    task holds as many rows as its parameter has values.  Null values of the
    parameter are left out, a null ``viable`` is not viable.
    """
    long = runs.select(F.col(entity).alias("entity"), F.coalesce(viable, F.lit(False)).cast("long").alias("ok"), *[F.col(p).cast("double").alias(p) for p in parameters]).unpivot(["entity", "ok"], parameters, "parameter", "x")
    counts = long.filter("x IS NOT NULL").groupBy("entity", "parameter", "x").agg(F.count("*").alias("n"), F.sum("ok").alias("k"))
    rows = counts.groupBy("entity", "parameter").agg(F.sort_array(F.collect_list(F.struct("x", "n", "k"))).alias("p")).select("entity", "parameter", F.col("p.x").alias("x"), F.col("p.n").alias("n"), F.col("p.k").alias("k"))
    schema = T.StructType([T.StructField(entity, rows.schema["entity"].dataType), T.StructField("parameter", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_values", T.LongType()), T.StructField("direction", T.StringType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType()), T.StructField("threshold", T.DoubleType())])

    def one(x, n, k) -> tuple:
        x, n, rate = np.asarray(x, float), np.asarray(n, float), np.asarray(k, float) / np.asarray(n, float)
        up, down = monotone(rate, n), -monotone(-rate, n)
        loss = [float((n * (fit - rate) ** 2).sum()) for fit in (up, down)]
        fit = up if loss[0] <= loss[1] + 1e-12 else down
        across = np.flatnonzero((fit >= level) != (fit[0] >= level))
        return int(n.sum()), len(x), "up" if fit is up else "down", float(fit.min()), float(fit.max()), float(x[across[0]]) if len(across) else None

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(e, p, *one(*v)) for e, p, *v in f.itertuples(index=False)], columns=schema.names)

    return rows.mapInPandas(step, schema)
