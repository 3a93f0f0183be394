"""Status, regime and adaptive mask of runs, as windows over the screening observables.

``obs`` has a row per run and step with ``frob``, ``cos`` (dissimilarity to the
state before), ``delta`` (relative step), ``fin`` (whether the state is finite)
and ``spread`` (standard deviation over mean magnitude of the run's last state,
the same in all rows of a run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.constants import EPS
from .timelines import along, autocorrelation


def ranked(values: Column, q: float) -> Column:
    """Nearest-rank percentile of a sorted array: its floor(n q)-th value."""
    return F.get(values, F.floor(F.size(values) * F.lit(q)).cast("int"))


def _statuses(obs: DataFrame, by: list[str]) -> DataFrame:
    """``obs`` plus the run's ``steps``, ``run_status`` and ``t_effective`` in every row; all windows share one exchange by run."""
    whole = Window.partitionBy(*by)
    rows = obs.withColumn("steps", F.count("*").over(whole).cast("int"))
    rows = rows.withColumn("__base", F.percentile(F.when(F.col("t") < F.floor(F.col("steps") / 2), F.col("frob")), 0.5).over(whole))
    grew = F.coalesce((F.col("frob") - F.lag("frob").over(along(by)) > 0).cast("int"), F.lit(0))
    rows = rows.withColumn("__grew", grew)
    rows = rows.withColumn("__last", F.sum("__grew").over(along(by).rowsBetween(1 - C.MONOTONE_STEPS, 0)))
    over = F.col("frob") > F.col("__base") * C.TRUNCATION_FACTOR
    rows = rows.withColumns({"__bad": F.min(F.when(~F.col("fin"), F.col("t"))).over(whole), "__over": F.min(F.when(over, F.col("t"))).over(whole)})
    monotone = F.col("__last") >= F.least(F.lit(C.MONOTONE_STEPS), F.col("steps") - 1)
    grown = F.max((monotone & (F.col("t") == F.greatest(F.col("__over"), F.lit(1)))).cast("int")).over(whole)
    truncated = F.col("__over").isNotNull() & (F.coalesce(grown, F.lit(0)) == 1)
    collapsed = F.coalesce(F.first("spread").over(whole) < C.COLLAPSE_VARIATION, F.lit(False))
    rows = rows.withColumns({"__truncated": truncated, "__collapsed": collapsed})
    bad = F.col("__bad").isNotNull()
    status = F.when(bad, "EXPLOSION").when(F.col("__collapsed"), "COLLAPSED").when(F.col("__truncated"), "OK_TRUNCATED").otherwise("OK")
    until = F.when(bad, F.col("__bad")).when(~F.col("__collapsed") & F.col("__truncated"), F.col("__over")).otherwise(F.col("steps"))
    return rows.withColumns({"run_status": status, "t_effective": until.cast("int")}).drop("__base", "__grew", "__last", "__bad", "__over", "__truncated", "__collapsed")


def statuses(obs: DataFrame, by: list[str]) -> DataFrame:
    """(run, steps, run_status, t_effective).

    EXPLOSION from the first state that is not finite; COLLAPSED if the last
    state is almost constant; OK_TRUNCATED from the first norm far over the
    median of the first half, if the norm had been growing; else OK.
    """
    return _statuses(obs, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("steps", "run_status", "t_effective")])


def _changes(x: Column, by: list[str]) -> Column:
    return (F.abs(x - F.lag(x).over(along(by))) > 0).cast("int")


def _valid(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with steps beyond the run's end marked, values there set to 0, and differences to the next step."""
    w = along(by)
    ok = F.col("t") < F.col("t_effective")
    clean = lambda c: F.when(ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)).otherwise(0.0)
    rows = rows.withColumns({"ok": ok, "cz": clean("cos"), "dz": clean("delta"), "fz": F.when(ok, F.col("frob")).otherwise(0.0)})
    rows = rows.withColumn("pair", F.col("ok") & F.coalesce(F.lead("ok").over(w), F.lit(False)))
    step = lambda c: F.when(F.col("pair"), F.abs(F.lead(c).over(w) - F.col(c)))
    small = lambda c: F.when(c < C.EPS_VARIATION, 0.0).otherwise(c)
    return rows.withColumns({"dc": step("cz"), "dd": small(step("dz"))})


def _fences(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows plus whether the step to the next is an outlier: over q3 + 2 (q3 - q1).

    The quartiles are found by the rows' places in the run: no list of a run is made.
    """
    whole = Window.partitionBy(*by)
    for c in ("dc", "dd"):
        rows = rows.withColumns({f"__at_{c}": F.row_number().over(whole.orderBy(F.asc_nulls_last(c))), f"__n_{c}": F.count(c).over(whole)})
        rank = lambda q, c=c: F.max(F.when(F.col(f"__at_{c}") == F.floor(F.col(f"__n_{c}") * F.lit(q)) + 1, F.col(c))).over(whole)
        rows = rows.withColumns({f"__low_{c}": rank(0.25), f"__high_{c}": rank(0.75)})
    far = lambda c: F.coalesce(F.col(c) > F.col(f"__high_{c}") + C.TUKEY * (F.col(f"__high_{c}") - F.col(f"__low_{c}")), F.lit(False))
    return rows.withColumns({"far_c": far("dc"), "far_d": far("dd")}).drop(*[f"__{k}_{c}" for k in ("at", "n", "low", "high") for c in ("dc", "dd")])


def _steps(obs: DataFrame, by: list[str]) -> DataFrame:
    """Every step with its run's status and what regime and mask are made of."""
    return _fences(_valid(_statuses(obs, by), by), by)


def regimes(obs: DataFrame, by: list[str]) -> DataFrame:
    """Statuses plus cos_dissim's mean, std and cv, the period, zero crossings and the regime class."""
    return _regimes(_steps(obs, by), by)


def _regimes(rows: DataFrame, by: list[str]) -> DataFrame:
    whole = Window.partitionBy(*by)
    n = F.sum(F.col("ok").cast("int")).over(whole)
    mean = F.coalesce(F.sum(F.when(F.col("ok"), F.col("cz"))).over(whole), F.lit(0.0)) / (n + EPS)
    sign = F.when((F.abs(F.lead("cz").over(along(by)) - F.col("cz")) < EPS) | ~F.col("pair"), 0.0).otherwise(F.signum(F.lead("cz").over(along(by)) - F.col("cz")))
    rows = rows.withColumns({"__mean": mean, "__sign": F.when(F.col("t") < F.col("steps") - 1, sign)})
    rows = rows.withColumn("__turn", _changes(F.col("__sign"), by))
    spread = F.sqrt(F.coalesce(F.sum(F.when(F.col("ok"), (F.col("cz") - F.col("__mean")) ** 2)), F.lit(0.0)) / (F.sum(F.col("ok").cast("int")) + EPS))
    series = F.transform(F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("t", "cz")))), lambda p: p["cz"])
    once = [F.first(c).alias(c) for c in ("steps", "run_status", "t_effective")]
    out = rows.groupBy(*by).agg(*once, F.first("__mean").alias("p1_cos_dissim_mean"), F.max(F.col("far_c").cast("int")).alias("__far"), spread.alias("p1_cos_dissim_std"), (F.coalesce(F.sum("__turn"), F.lit(0)) / 2).alias("p1_n_zero_crossings"), series.alias("x"))
    out = out.withColumn("p1_cos_dissim_cv", F.col("p1_cos_dissim_std") / (F.col("p1_cos_dissim_mean") + EPS))
    out = _with_period(out)
    regime = F.when(F.col("run_status") == "OK_TRUNCATED", "EXPLOSIVE").when(F.col("p1_estimated_period").isNull() & (F.col("p1_cos_dissim_cv") < C.FLAT_CV), "FLAT").when(F.col("p1_estimated_period").isNotNull(), "OSCILLATING").when(F.col("__far") == 1, "TRANSITIONAL").otherwise("MIXED")
    return out.withColumn("p1_regime_class", regime).drop("__far")


def _with_period(runs: DataFrame) -> DataFrame:
    """``runs`` plus the first peak of the autocorrelation of ``x`` among lags under a quarter of the valid length."""
    lags = F.floor(F.col("t_effective") / 4).cast("int")
    columns = [c for c in runs.columns if c != "x"]
    made = autocorrelation(runs, F.when(lags >= 1, F.sequence(F.lit(0), lags - 1)))
    made = made.withColumn("ac", F.transform("ac", lambda v: F.when(F.col("energy") > 0, v * F.col("energy") / (F.col("energy") + EPS)).otherwise(0.0)))
    # Lags beyond the run's own quarter count as -1, up to a quarter of the design's length.
    room = F.floor(F.col("steps") / 4).cast("int")
    at = lambda i: F.when(i < lags, F.get("ac", i)).otherwise(-1.0)
    peak = F.filter(F.when(room >= 3, F.sequence(F.lit(1), room - 2)), lambda i: (at(i) > at(i - 1)) & (at(i) > at(i + 1)) & (at(i) > C.PERIOD_CORRELATION))
    return made.select(*columns, F.get(peak, 0).cast("double").alias("p1_estimated_period"))


def masks(obs: DataFrame, by: list[str]) -> DataFrame:
    """``obs`` plus the run's status, length and period and ``mask``: the steps worth a closer look."""
    rows = _steps(obs, by)
    rows = rows.join(_regimes(rows, by).select(*by, "p1_estimated_period"), by)
    w = along(by)
    count = F.greatest(F.lit(C.MASK_LEAST), (F.col("steps") * C.MASK_FLOOR).cast("int"))
    floor_points = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor(i * (F.col("steps") - 1) / (count - 1)).cast("int"))
    out_here = F.col("far_c") | F.col("far_d")
    rows = rows.withColumn("__far", out_here | F.coalesce(F.lag(out_here).over(w), F.lit(False)))
    rows = rows.withColumn("__seed", F.col("__far") | F.array_contains(floor_points, F.col("t")))
    margin = F.greatest(F.lit(1), (F.col("steps") * C.MASK_MARGIN).cast("int"))
    # The margin depends on the run's length: a step is in it if the nearest marked step is near enough.
    before = F.last(F.when(F.col("__seed"), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(F.when(F.col("__seed"), F.col("t")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.coalesce(F.col("t") - before <= margin, F.lit(False)) | F.coalesce(behind - F.col("t") <= margin, F.lit(False))
    sign = lambda c: F.when(F.abs(F.lead(c).over(w) - F.col(c)) < EPS, 0.0).otherwise(F.signum(F.lead(c).over(w) - F.col(c)))
    rows = rows.withColumns({"__near": near, "__sf": sign("fz"), "__sc": sign("cz")})
    rows = rows.withColumns({"__cf": _changes(F.col("__sf"), by), "__cc": _changes(F.col("__sc"), by)})
    whole = Window.partitionBy(*by)
    monotone = (F.coalesce(F.sum("__cf").over(whole), F.lit(0)) < 2) & (F.coalesce(F.sum("__cc").over(whole), F.lit(0)) < 2)
    ends = (F.col("t") == 0) | (F.col("t") == F.greatest(F.col("t_effective") - 1, F.lit(0)))
    p = F.col("p1_estimated_period")
    beat = (F.col("run_status") == "OK") & p.isNotNull() & ((F.col("t") % p < C.PERIOD_NEAR) | (F.col("t") % p > p - C.PERIOD_NEAR))
    mask = (F.when(monotone, ends).otherwise(F.col("__near")) | F.coalesce(beat, F.lit(False))) & F.col("ok") & F.col("run_status").isin("OK", "OK_TRUNCATED")
    return rows.withColumn("mask", mask).drop("__far", "__seed", "__near", "__sf", "__sc", "__cf", "__cc", "far_c", "far_d", "dc", "dd", "pair", "cz", "dz", "fz")


def mask_geometry(masked: DataFrame, by: list[str]) -> DataFrame:
    """The seven features of a mask, one row per run."""
    starts = F.col("mask") & ~F.coalesce(F.lag("mask").over(along(by)), F.lit(False))
    rows = masked.withColumn("__start", starts.cast("int"))
    on = lambda c: F.when(F.col("mask"), c)
    n, first, last, active, size = F.sum("__start"), F.min(on(F.col("t"))), F.max(on(F.col("t"))), F.sum(F.col("mask").cast("int")), F.first("steps")
    return rows.groupBy(*by).agg(
        n.cast("double").alias("mask_n_transitions"),
        (first / size).alias("mask_t_first_norm"),
        (last / size).alias("mask_t_last_norm"),
        F.when(active > 0, F.coalesce(F.sum(on(F.col("cos"))), F.lit(0.0)) / (active + EPS)).alias("mask_mean_amplitude"),
        F.max(on(F.col("cos"))).alias("mask_max_amplitude"),
        F.when(n >= 2, (last - first) / (n - 1) / size).alias("mask_mean_spacing_norm"),
        (active / size).alias("mask_coverage_frac"),
        active.alias("meta_n_svd"),
    )


