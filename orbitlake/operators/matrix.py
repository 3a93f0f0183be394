"""The feature matrix: strata, imputation, scaling and the choice of features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EPS_SCALE
from .quantiles import column_quantiles

SKIPPED_PREFIXES = ("health_", "meta_")


def feature_columns(columns: list[str]) -> list[str]:
    """Features that a model may see."""
    return [c for c in columns if not c.startswith(SKIPPED_PREFIXES)]


def strata(df: DataFrame, atomics: DataFrame, trace: str = "f4_trace_J_mean") -> DataFrame:
    """``df`` plus ``differentiable`` and ``strate``; an operator without metadata is taken for differentiable if any run of it has a trace."""
    known = atomics.select(F.col("id").alias("gamma_id"), F.col("differentiable").alias("__known"))
    seen = df.groupBy("gamma_id").agg(F.max(F.col(trace).isNotNull()).alias("__seen"))
    out = df.join(known, "gamma_id", "left").join(seen, "gamma_id", "left")
    out = out.withColumn("differentiable", F.coalesce("__known", "__seen", F.lit(False))).drop("__known", "__seen")
    return out.withColumn("strate", F.concat(F.lit("rank"), F.col("rank_eff").cast("string"), F.when(F.col("differentiable"), "_diff").otherwise("_nodiff")))



def strata_in_order(df: DataFrame) -> DataFrame:
    """(rank_eff, differentiable, strate, n, place): the strata of :func:`strata` with their rows, by rank, then those without derivatives first."""
    found = df.groupBy("rank_eff", "differentiable", "strate").agg(F.count("*").alias("n"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("rank_eff", "differentiable")))  # a few rows


def correlations(df: DataFrame, first: str, others: list[str]) -> DataFrame:
    """One row: the correlation of ``first`` with each other column, named r1, r2, ... in their order."""
    return df.agg(*[F.corr(first, c).alias(f"r{i}") for i, c in enumerate(others, 1)])


def correlation_by(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, r, n): the correlation of two columns in each group, null where one does not vary."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.groupBy(by).agg(r.alias("r"), F.count("*").alias("n"))


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column's median, or 0 if it has none; the medians are exact and stand in the plan as numbers."""
    medians = column_quantiles(df, columns, [0.5])
    return df.select(*[F.coalesce(F.col(c), F.lit(medians.get(c, [0.0])[0])).alias(c) if c in columns else F.col(c) for c in df.columns])


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def compress(df: DataFrame, columns: list[str], limit: float = 1e6) -> DataFrame:
    """Columns whose magnitudes span more than ``limit`` times go through a signed logarithm."""
    size = lambda c: F.abs(c)
    spans = df.agg(*[(F.max(size(F.col(c))) / (F.min(F.when(F.col(c) != 0, size(F.col(c)))) + EPS_SCALE)).alias(f"__s{i}") for i, c in enumerate(columns)])
    one = lambda c: F.when(F.coalesce(F.col(f"__s{columns.index(c)}"), F.lit(0.0)) > limit, signed_log(F.col(c))).otherwise(F.col(c)).alias(c)
    return df.crossJoin(F.broadcast(spans)).select(*[one(c) if c in columns else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR with exact quantiles; an IQR of 0 counts as 1, a column without values stays as it is."""
    found = column_quantiles(df, columns, [0.25, 0.5, 0.75])

    def one(c: str) -> Column:
        low, middle, high = found.get(c, [0.0, 0.0, 0.0])
        return ((F.col(c) - F.lit(middle)) / F.lit(high - low if high != low else 1.0)).alias(c)

    return df.select(*[one(c) if c in columns else F.col(c) for c in df.columns])


def select_features(df: DataFrame, columns: list[str], protected: tuple[str, ...] = (), limit: float = 0.98) -> list[str]:
    """Features in order of variance (protected ones first), each kept if it correlates below ``limit`` with all kept before.

    Constant features go; a correlation that is not a number counts as 1.  The
    rows must have no nulls.  Correlations are sums that tasks gather and merge
    as a tree; a matrix of features squared reaches the driver.
    """
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    spread = {c: row[c] or 0.0 for c in columns}
    varied = [c for c in columns if spread[c] > 0]
    corr: dict[tuple[str, str], float] = {}
    if len(varied) > 1:
        rows = VectorAssembler(inputCols=varied, outputCol="__x").transform(df.select(*varied)).select("__x")
        found = np.abs(np.nan_to_num(Correlation.corr(rows, "__x").first()[0].toArray(), nan=1.0))
        corr = {(a, b): float(found[i, j]) for i, a in enumerate(varied) for j, b in enumerate(varied)}
    kept = [c for c in protected if c in columns and spread[c] > 0]
    rest = sorted((c for c in columns if c not in kept and spread[c] > 0), key=lambda c: (-spread[c], columns.index(c)))
    for c in rest:
        if all(corr[c, k] < limit for k in kept):
            kept.append(c)
    return kept


def matrix(df: DataFrame, columns: list[str], protected: tuple[str, ...] = (), limit: float = 0.98, log_limit: float = 1e6, select: bool = True) -> tuple[DataFrame, list[str]]:
    """Imputed, compressed and scaled features, and those that are not redundant (all of them without ``select``)."""
    made = robust_scale(compress(impute(df, columns), columns, log_limit), columns)
    return made, select_features(made, columns, protected, limit) if select else list(columns)
