"""The scalar features of simulated runs, one row per run, from their timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from . import timelines
from .simulate import timelines_long


#: Marks the key of a series at the places of the mask.
MASKED = "@"


def scalar_features(runs: DataFrame, by: list[str]) -> DataFrame:
    """Reducers, stationarity, texture, autocorrelation, temporal, ordinal, lagged and mask features.

    ``by`` names the run.  All series of a run become rows in one task, which
    its windows, aggregates and pivot do not leave; lagged features come from
    its arrays.  Null stands for what does not apply.
    """
    runs = runs.repartition(*by)
    masked = {f"{MASKED}{n}": at_mask(F.col(f"timeline_{k}"), F.col("mask_t_indices")) if k in C.TIMELINES_A else F.col(f"timeline_{k}") for n, k in C.PHASIC.items()}
    long = timelines_long(runs.withColumns({f"timeline_{k}": c for k, c in masked.items()}), by, (*C.TIMELINES_A, *C.TIMELINES_B, *masked))
    long = long.filter(~F.col("key").startswith(MASKED) | F.col("v").isNotNull())
    made = timelines.first_minimum_of(timelines.everything(long, [*by, "key"], F.col("key").isin(*C.TEMPORAL)))
    names = {(k, r): f"{k}_{r}" for table in (C.AGG_MAP_A, C.AGG_MAP_B) for k, rs in table.items() for r in rs}
    names |= {(k, "stat_delta"): f"stat_delta_{k}" for k in C.TIMELINES_A}
    names |= {(k, "pnn40"): f"ps_pnn40_{n}" for n, k in C.PNN.items()}
    names |= {(k, "first_min_ac"): f"ps_first_min_ac_{n}" for n, k in C.AUTOCORRELATED.items()}
    names |= {(k, c): f"temporal_{k}_{c}" for k in C.TEMPORAL for c in ("iqr", "plateau_frac", "cusum_delta", "changepoint_t_norm")}
    names |= {("shannon_comp", "slope"): "f2_entropy_production_rate"}
    names |= {(f"{MASKED}{n}", c): f"phasic_{n}_{c}" for n in C.PHASIC for c in ("n_reversals", "max_monotone_frac", "range_ratio")}
    wide = made.groupBy(*by).agg(*[F.max(F.when(F.col("key") == k, F.col(c))).alias(n) for (k, c), n in names.items()])
    values = lambda k: F.transform(f"timeline_{k}", lambda v: F.when(~F.isnan(v), v.cast("double")))
    lagged = {n: timelines.lagged_asymmetry_of(values(x), values(y)) for n, (x, y) in C.LAGGED_PAIRS.items()}
    out = runs.join(wide, by, "left").withColumns(lagged)
    out = out.withColumn("f6_causal_asymmetry_index", sum(F.abs(n) for n in C.LAGGED_PAIRS) / len(C.LAGGED_PAIRS))
    return runtime_null(out.withColumns(mask_features()))


def at_mask(series: Column, indices: Column) -> Column:
    """The values of a series at the places of a mask; a place beyond its end gives null."""
    return F.transform(indices, lambda i: F.get(series, i))


def runtime_null(df: DataFrame, transitions: str = "mask_n_transitions", points: str = "meta_n_svd", period: str = "p1_estimated_period") -> DataFrame:
    """Features that say nothing about a run become null: places of a mask without transitions, spacings of fewer than two, orders of fewer than two points.

    Columns that ``df`` lacks are skipped; a null count counts as 0.
    """
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {C.NO_TRANSITION: count(transitions) == 0, C.ONE_TRANSITION: count(transitions) < 2, C.ONE_POINT: count(points) < 2, C.NO_PERIOD: F.col(period).isNull() | F.isnan(F.col(period).cast("double"))}
    needs = {C.NO_TRANSITION: transitions, C.ONE_TRANSITION: transitions, C.ONE_POINT: points, C.NO_PERIOD: period}
    new = {c: F.when(~rules[why], F.col(c)) for c, why in C.RUNTIME_NULL.items() if c in df.columns and needs[why] in df.columns}
    return df.withColumns(new) if new else df


def mask_features() -> dict[str, object]:
    """Geometry of a run's mask and its meta features, from the arrays of the run itself."""
    at, size = F.col("mask_t_indices"), F.col("max_it")
    starts = F.size(F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i) > F.get(at, i - 1) + 1)))
    n = F.when(F.size(at) > 0, starts).otherwise(0)
    amplitude = F.filter(F.transform(at, lambda i: F.get("timeline_cos_dissim", i)), lambda v: ~F.isnan(v))
    total = F.aggregate(amplitude, F.lit(0.0), lambda s, v: s + v)
    first, last = F.get(at, 0), F.get(at, F.size(at) - 1)
    some = F.size(at) > 0
    return {
        "mask_n_transitions": n.cast("double"),
        "mask_t_first_norm": F.when(some, first / size),
        "mask_t_last_norm": F.when(some, last / size),
        "mask_mean_amplitude": F.when(some, total / (F.size(at) + C.EPS)),
        "mask_max_amplitude": F.array_max(amplitude),
        "mask_mean_spacing_norm": F.when(n >= 2, (last - first) / (n - 1) / size),
        "mask_coverage_frac": F.size(at) / size,
        "meta_n_svd": F.size(at).cast("double"),
        "meta_turbulence": (F.get("timeline_frob", F.size("timeline_frob") - 1) - F.get("timeline_frob", 0)) / (size + C.EPS),
        "meta_t_effective": F.col("t_effective").cast("double"),
    }
