"""Run tables: schemas, column roles, reading with tolerance and writing with none."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C

MASKS = ("mask_n_transitions", "mask_t_first_norm", "mask_t_last_norm", "mask_mean_amplitude", "mask_max_amplitude", "mask_mean_spacing_norm", "mask_coverage_frac")


def feature_names() -> list[str]:
    """The 127 scalar features of a run."""
    names = [*C.c1_names(), *C.DMD_SCALARS, *C.LAGGED_PAIRS, "f6_causal_asymmetry_index"]
    names += [f"ps_first_min_ac_{k}" for k in C.AUTOCORRELATED] + [f"ps_pnn40_{k}" for k in C.PNN]
    names += [f"temporal_{k}_{x}" for k in C.TEMPORAL for x in ("iqr", "plateau_frac", "cusum_delta", "changepoint_t_norm")]
    names += [f"stat_delta_{k}" for k in C.TIMELINES_A] + ["f2_entropy_production_rate"]
    names += [f"phasic_{k}_{x}" for k in C.PHASIC for x in ("n_reversals", "max_monotone_frac", "range_ratio")]
    names += ["p1_cos_dissim_mean", "p1_cos_dissim_std", "p1_cos_dissim_cv", "p1_estimated_period", "p1_n_zero_crossings"]
    return [*names, *MASKS, "meta_n_svd", "meta_turbulence", "meta_t_effective"]


def run_schema() -> T.StructType:
    """The 168 columns of a run: metadata, features, timelines."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType()}
    fields = [T.StructField(n, kinds[k]) for n, k in C.METADATA.items()]
    fields += [T.StructField(n, T.FloatType()) for n in feature_names()]
    fields += [T.StructField(n, T.ArrayType(T.IntegerType() if n == "mask_t_indices" else T.FloatType())) for n in C.TIMELINE_COLUMNS]
    return T.StructType(fields)


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns as metadata, features, timelines and unregistered; warns of missing and unknown ones, drops none."""
    known = {"metadata": list(C.METADATA), "features": feature_names(), "timelines": list(C.TIMELINE_COLUMNS)}
    roles = {k: [c for c in df.columns if c in set(v)] for k, v in known.items()}
    taken = {c for v in roles.values() for c in v}
    roles["unregistered"] = [c for c in df.columns if c not in taken]
    missing = [c for v in known.values() for c in v if c not in df.columns]
    if missing:
        warnings.warn(f"columns missing: {', '.join(missing[:5])}{' ...' if len(missing) > 5 else ''}", stacklevel=2)
    if roles["unregistered"]:
        warnings.warn(f"columns unknown: {', '.join(roles['unregistered'][:5])}", stacklevel=2)
    return roles


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Run tables of one or more paths, united over the columns that all have; NaN becomes null."""
    from ..operators.relational import union_common

    tables = [spark.read.parquet(p) for p in paths]
    return nan_to_null(tables[0] if len(tables) == 1 else union_common(tables))


#: Columns that :func:`read_in_order` adds.
PLACE = ["source_file", "source_row"]


def read_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """:func:`read_runs` plus where each row stands: ``source_file`` (place of its path, then the file's name) and ``source_row`` (its place in the file).

    Ordered by these two, rows come as from files read one after the other, so
    the first of several equal runs is the same in every run of a job.
    """
    from ..operators.relational import union_common

    return nan_to_null(union_common([with_place(spark, i, p) for i, p in enumerate(paths)]))


def with_place(spark: SparkSession, place: int, path: str) -> DataFrame:
    """The rows of one path with their PLACE; columns of these names are replaced."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c not in PLACE]
    return rows.select(*kept, F.format_string("%06d:%s", F.lit(place), F.col("_metadata.file_path")).alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def nan_to_null(df: DataFrame) -> DataFrame:
    numbers = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c, k in df.dtypes if k in ("float", "double")}
    return df.withColumns(numbers) if numbers else df


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature columns as floats, nulls for what is missing or not finite."""
    present = {f.name for f in df.schema}
    one = lambda c: (F.when(~F.isnan(F.col(c).cast("float")) & (F.abs(F.col(c).cast("float")) < float("inf")), F.col(c).cast("float")) if c in present else F.lit(None).cast("float")).alias(c)
    return df.select(*[one(c) for c in columns])


def series(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Timeline columns, empty arrays for nulls, beside the columns to ``keep``."""
    return df.select(*(keep or []), *[F.coalesce(c, F.array().cast(dict(df.dtypes)[c])).alias(c) for c in columns])


def conform(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """``df`` in the columns and types of ``schema``.

    ``strict`` fails on a missing column; else it gets the type's default: an
    empty text, -1, NaN or an empty array, which also replaces nulls.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if strict and missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")

    def one(f: T.StructField):
        kind = f.dataType
        value = F.col(f.name).cast(kind) if f.name in df.columns else F.lit(None).cast(kind)
        default = F.lit("") if isinstance(kind, T.StringType) else F.lit(-1) if isinstance(kind, T.IntegralType) else F.lit(float("nan")) if isinstance(kind, T.FractionalType) else F.array().cast(kind)
        return (F.coalesce(value, default.cast(kind)) if not strict or isinstance(kind, T.FractionalType) else value).alias(f.name)

    return df.select(*[one(f) for f in schema])


def write_runs(df: DataFrame, path: str, mode: str = "append", rows_per_file: int | None = 1_000_000) -> None:
    """Append runs, a folder for each phase; a job that fails leaves nothing behind."""
    out = df.write.mode(mode).partitionBy("phase")
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(path)


def structural_null(name: str, rank: int, differentiable: bool) -> bool:
    """Whether a column cannot apply to runs of a rank and differentiability."""
    bare = name.removeprefix("timeline_").removeprefix("stat_delta_")
    flat = ("frob_gradient", "f3_entanglement_entropy_mode1", "f3_inter_mode_sv_var")
    return (rank == 2 and bare.startswith(flat)) or (not differentiable and bare.startswith("f4_"))


def features_for(rank: int, differentiable: bool) -> list[str]:
    """The features that apply to a stratum."""
    return [c for c in feature_names() if not structural_null(c, rank, differentiable)]


def apply_structural_null(df: DataFrame, rank: str = "rank_eff", differentiable: str = "differentiable") -> DataFrame:
    """Columns overwritten with null where they cannot apply; timelines keep their length."""
    from ..operators.relational import structural_null as overwrite

    rules = {}
    for c in df.columns:
        flat, smooth = structural_null(c, 2, True), structural_null(c, 3, False)
        if flat or smooth:
            rules[c] = (F.col(rank) == 2) if flat else ~F.col(differentiable)
    return overwrite(df, rules) if rules else df
