"""Filters, joins, set operations and deduplication of run tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import HEALTHY


def scope_filter(df: DataFrame, scope: dict[str, Any]) -> DataFrame:
    """Rows whose columns are among the scope's values; ``None`` and ``"all"`` leave a column free, a single value is a list of one.

    ``seeds: one`` keeps the first row of each gamma and encoding.
    """
    tests = []
    for name, wanted in scope.items():
        if wanted is None or wanted == "all" or name == "seeds":
            continue
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        tests.append(F.col(name).isin(values))
    out = df.filter(reduce(Column.__and__, tests)) if tests else df
    return one_seed(out) if scope.get("seeds") == "one" else out


def one_seed(df: DataFrame, keys: tuple[str, ...] = ("gamma_id", "encoding_id"), order: tuple[str, ...] = ("seed_CI", "seed_run")) -> DataFrame:
    return first_by_key(df, list(keys), [F.col(c) for c in order if c in df.columns] or [F.lit(1)])


def exclude_ids(df: DataFrame, excluded: dict[str, list]) -> DataFrame:
    """Rows none of whose ids is excluded; null ids stay."""
    for name, ids in excluded.items():
        if ids:
            df = df.filter(~F.coalesce(F.col(name).isin(list(ids)), F.lit(False)))
    return df


def range_filter(df: DataFrame, name: str, least: float | None = None, most: float | None = None) -> DataFrame:
    if least is not None:
        df = df.filter(F.col(name) >= least)
    return df if most is None else df.filter(F.col(name) <= most)


def triage(df: DataFrame, status: str = "run_status") -> tuple[DataFrame, DataFrame]:
    """Healthy runs, and all others with a status."""
    return df.filter(F.col(status).isin(*HEALTHY)), df.filter(~F.col(status).isin(*HEALTHY))


def anomalies(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows with at least one NaN, null or infinity among ``columns``, with their numbers, in order."""
    nan = lambda c: (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")
    inf = lambda c: F.coalesce((F.abs(F.col(c).cast("double")) == float("inf")).cast("int"), F.lit(0))
    counted = df.withColumns({"n_nan": reduce(Column.__add__, map(nan, columns)), "n_inf": reduce(Column.__add__, map(inf, columns))})
    return counted.filter("n_nan + n_inf > 0").orderBy(*order)


def structural_null(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Columns overwritten with null where their rule holds; arrays keep their length."""
    kinds = dict(df.dtypes)
    new = {c: F.when(rule, F.transform(c, lambda _: F.lit(None)).cast(kinds[c]) if kinds[c].startswith("array") else F.lit(None)).otherwise(F.col(c)) for c, rule in rules.items()}
    return df.withColumns(new)


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (add a unique column to make ties certain)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


#: What makes two runs the same: by ids, size and seeds, or by their parameters as well.
DEDUP_KEYS = {
    "ids": ["gamma_id", "encoding_id", "modifier_id", "n_dof", "max_it", "seed_CI", "seed_run"],
    "full": ["gamma_id", "encoding_id", "modifier_id", "n_dof", "max_it", "seed_CI", "seed_run", "gamma_params", "encoding_params", "modifier_params", "rank_eff"],
}


def dedup_runs(df: DataFrame, keys: str = "ids", order: list[Column] | None = None) -> DataFrame:
    """One row of each run; without ``order`` the least by a hash of all its columns, so that reruns agree."""
    every = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    return first_by_key(df, [k for k in DEDUP_KEYS[keys] if k in df.columns], order or [every])


def union_common(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, with the columns that every one has, sorted by name."""
    common = sorted(set.intersection(*[set(t.columns) for t in tables]))
    return reduce(lambda a, b: a.unionByName(b), [t.select(*common) for t in tables])


def lookup(df: DataFrame, table: DataFrame, key: str, name: str, default: str = "?", small: bool = False) -> DataFrame:
    """``df`` plus ``name`` from a table with unique keys, ``default`` where the key is unknown.

    ``small`` says that the caller has checked the table's size; else Spark decides by its statistics.
    """
    side = table.select(key, name)
    return df.join(F.broadcast(side) if small else side, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def strict_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner lookup that fails if a key is unknown."""
    known = df.join(table.withColumn("__known", F.lit(True)), key, "left")
    checked = F.when(F.col("__known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))))
    return known.filter(checked).drop("__known")


def grid(df: DataFrame, rows: str, columns: str, status: str | None = None) -> DataFrame:
    """Every pair of a row and a column value with its number of rows; pairs without any are ``missing``.

    With ``status`` a cell also has ``statuses``, the map of its statuses to
    numbers of rows (null where it is missing).  The two lists of distinct
    values are dimensions of a design and small by nature.
    """
    counted = df.groupBy(rows, columns, *([status] if status else [])).agg(F.count("*").alias("__n"))
    cell = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(status).isNotNull(), F.struct(status, "__n"))))).alias("statuses")] if status else []
    counts = counted.groupBy(rows, columns).agg(F.sum("__n").alias("n"), *cell)
    pairs = counts.select(rows).distinct().crossJoin(counts.select(columns).distinct())
    return pairs.join(counts, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"), *(["statuses"] if status else []))


def overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Sizes of two subsets, of what they share and have alone, and their Jaccard index (1 if both are empty)."""
    n = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    counted = df.select(F.coalesce(a, F.lit(False)).alias("a"), F.coalesce(b, F.lit(False)).alias("b"))
    x, y = F.col("a"), F.col("b")
    return counted.agg(
        n(x & y).alias("n_both"),
        n(x & ~y).alias("n_only_a"),
        n(~x & y).alias("n_only_b"),
        F.when(n(x | y) == 0, 1.0).otherwise(n(x & y) / n(x | y)).alias("jaccard"),
    )


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if fewer) drawn by a hash of the seed and the keys, so that reruns agree; rows of equal keys are drawn in any order."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return df.orderBy(drawn, *keys).limit(n)


def first_rows(df: DataFrame, order: list[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows in an order, each task keeping its own first ones only."""
    return df.orderBy(*order).limit(k)


def split_noise(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Clustered rows (label from 0 on), and the rest, which has no cluster (below 0 or null)."""
    clustered = F.coalesce(F.col(label) >= 0, F.lit(False))
    return df.filter(clustered), df.filter(~clustered)
