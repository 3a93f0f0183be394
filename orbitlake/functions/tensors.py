"""Observables of a state tensor as array expressions: no Python, and an array column is all they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .constants import EPS


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def squares(a: Column) -> Column:
    return total(F.transform(a, lambda v: v * v))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def observables(states: DataFrame, by: list[str], order: str, state: str, n_dof: int, rank: int = 2) -> DataFrame:
    """Layer A: the eleven uniform observables of every state, with the one before it in its run.

    Distances to the previous state are null at the first step, the log ratio
    of two distances at the first two.  ``state`` is row-major; its leading
    n_dof x n_dof block of the unfolding along the first axis gives the
    asymmetry, and ``frob_gradient`` is null for rank 2.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = states.select(*by, order, F.transform(F.col(state), lambda v: v.cast("double")).alias("x"))
    rows = rows.withColumn("p", F.lag("x").over(w))
    rows = rows.withColumns({"s1": total(F.transform("x", F.abs)), "s2": squares(F.col("x")), "sp": squares(F.col("p")), "xp": dot(F.col("x"), F.col("p")), "d2": squares(F.zip_with("x", "p", lambda a, b: a - b))})
    rows = rows.withColumns({"frob": F.sqrt("s2"), "delta_D": F.sqrt("d2") / (F.sqrt("s2") + EPS)})
    width = n_dof ** (rank - 1)
    block = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_dof - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n_dof - 1)), lambda j: F.struct(F.get("x", i * width + j).alias("a"), F.get("x", j * width + i).alias("b")))))
    rows = rows.withColumn("m", block)
    q = lambda v: F.abs(v) / (F.col("s1") + EPS)
    fourth = total(F.transform("x", lambda v: v * v * v * v))
    out = {
        "cos_dissim": 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xp") / (F.col("frob") * F.sqrt("sp") + EPS))),
        "is_finite": F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).cast("double"),
        "shannon_comp": -total(F.transform("x", lambda v: q(v) * F.log(q(v) + EPS))),
        "ipr": F.col("s2") * F.col("s2") / (fourth + EPS) / F.size("x"),
        "mode_asymmetry_o2": F.sqrt(total(F.transform("m", lambda c: (c["a"] - c["b"]) * (c["a"] - c["b"])))) / (F.sqrt(total(F.transform("m", lambda c: c["a"] * c["a"]))) + EPS),
        "bregman_cost": F.col("d2") / (F.col("s2") + EPS),
        "lyap_empirical": F.log((F.sqrt("d2") + EPS) / (F.lag(F.sqrt("d2")).over(w) + EPS)),
        "frob_gradient": _gradient(n_dof, rank),
        "volume_proxy": F.col("frob") * F.array_max(F.transform("x", F.abs)) / (F.col("s1") + EPS),
    }
    return rows.select(*by, order, "frob", "delta_D", *[c.alias(k) for k, c in out.items()])


def _spread(norms: Column, n: int) -> Column:
    mean = total(norms) / n
    return F.sqrt(total(F.transform(norms, lambda v: (v - mean) * (v - mean))) / n)


def _gradient(n: int, rank: int) -> Column:
    """Spread of the row norms of the first unfolding over that of the second."""
    if rank < 3:
        return F.lit(None).cast("double")
    width, below = n ** (rank - 1), n ** (rank - 2)
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sqrt(squares(F.slice("x", i * width + 1, width))))
    across = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.sqrt(total(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: squares(F.slice("x", i * width + j * below + 1, below))))))
    return _spread(rows, n) / (_spread(across, n) + EPS)


def renyi2(state: Column, n: int) -> Column:
    """Renyi-2 entropy of the squared singular values of an n x n state, from the Gram matrix instead of a decomposition."""
    row = lambda i: F.slice(state, i * n + 1, n)
    index = F.sequence(F.lit(0), F.lit(n - 1))
    gram = F.flatten(F.transform(index, lambda i: F.transform(index, lambda j: dot(row(i), row(j)))))
    whole = squares(state)
    return -F.log(squares(gram) / ((whole + EPS) * (whole + EPS)) + EPS)
