"""Features of time series as windows and aggregates over a long table.

``obs`` has one row per run (the columns ``by``), step ``t`` (0, 1, ...) and
value ``v`` (null where not applicable).  Each function gives one row per run.
Rows of one run come together in one task; a run is as long as its design says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EPS
from ..functions.numbers import finite

REDUCERS = ("mean", "std", "total", "final", "delta")


def along(by: list[str]):
    return Window.partitionBy(*by).orderBy("t")


def reducers() -> dict[str, Column]:
    """Reducers of a series; mean, std and total see infinities, final and delta skip them."""
    v = F.col("v")
    last, first = F.max_by(finite(v), F.when(finite(v).isNotNull(), F.col("t"))), F.min_by(finite(v), F.when(finite(v).isNotNull(), F.col("t")))
    return {"mean": F.avg(v), "std": F.stddev_pop(v), "total": F.coalesce(F.sum(v), F.lit(0.0)), "final": last, "delta": last - first}


def aggregate_series(obs: DataFrame, by: list[str], which: tuple[str, ...] = REDUCERS) -> DataFrame:
    made = reducers()
    return obs.groupBy(*by).agg(*[made[w].alias(w) for w in which])


def stationarity(obs: DataFrame, by: list[str], share: float = 0.2) -> DataFrame:
    """``stat_delta``: distance of the means of the last and first fifth in standard deviations; null under 10 steps."""
    n = F.count("*").over(Window.partitionBy(*by))
    tail = F.greatest((n * F.lit(share)).cast("int"), F.lit(1))
    marked = obs.withColumns({"__n": n, "__tail": tail})
    gap = F.abs(F.avg(F.when(F.col("t") >= F.col("__n") - F.col("__tail"), F.col("v"))) - F.avg(F.when(F.col("t") < F.col("__tail"), F.col("v"))))
    return marked.groupBy(*by).agg(F.when(F.max("__n") >= 10, gap / (F.stddev_pop("v") + EPS)).alias("stat_delta"))


def slope(obs: DataFrame, by: list[str], name: str = "slope") -> DataFrame:
    """Least-squares slope over t; null under three values or without spread in t."""
    t = F.when(F.col("v").isNotNull(), F.col("t"))
    return obs.groupBy(*by).agg(F.when((F.count("v") >= 3) & (F.var_pop(t) > EPS), F.regr_slope("v", "t")).alias(name))


def iqr(obs: DataFrame, by: list[str]) -> DataFrame:
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    return obs.groupBy(*by).agg((q[1] - q[0]).alias("iqr"))


def _steps(obs: DataFrame, by: list[str]) -> DataFrame:
    return obs.withColumn("d", F.col("v") - F.lag("v").over(along(by)))


def plateau(obs: DataFrame, by: list[str]) -> DataFrame:
    """``plateau_frac``: share of steps that are small against the median step."""
    size = F.abs(F.col("d"))
    steps = _steps(obs, by)
    middle = steps.groupBy(*by).agg(F.percentile(size, 0.5).alias("__m"))
    small = size < F.greatest(F.col("__m") * 0.1, F.lit(1e-10))
    return steps.join(middle, by).groupBy(*by).agg((F.sum(small.cast("int")) / F.greatest(F.count("d"), F.lit(1))).alias("plateau_frac"))


def half_shift(obs: DataFrame, by: list[str]) -> DataFrame:
    """``cusum_delta``: mean of the second half of the values less that of the first (0 for a half without values)."""
    so_far = F.count("v").over(along(by).rowsBetween(Window.unboundedPreceding, 0))
    counted = obs.withColumns({"__c": so_far, "__n": F.count("v").over(Window.partitionBy(*by))})
    # The first half ends with the first step at which half of the values have been seen.
    split = counted.withColumn("__split", F.min(F.when(F.col("__c") >= F.floor(F.col("__n") / 2), F.col("t"))).over(Window.partitionBy(*by)))
    half = lambda test: F.coalesce(F.avg(F.when(test, F.col("v"))), F.lit(0.0))
    return split.groupBy(*by).agg((half(F.col("t") > F.col("__split")) - half(F.col("t") <= F.col("__split"))).alias("cusum_delta"))


def changepoint(obs: DataFrame, by: list[str]) -> DataFrame:
    """``changepoint_t_norm``: where the widest step begins, as a share of the length; null under three values."""
    steps = obs.withColumn("d", F.abs(F.lead("v").over(along(by)) - F.col("v")))
    at = F.min_by("t", F.when(F.col("d").isNotNull(), F.struct(-F.col("d"), F.col("t"))))
    return steps.groupBy(*by).agg(F.when(F.count("v") >= 3, at / F.greatest(F.count("*"), F.lit(1))).alias("changepoint_t_norm"))


def settling(obs: DataFrame, by: list[str], share: float = 0.2) -> DataFrame:
    """Where a run's signal settles: reducers, spread, slope, stationarity and share of small steps, from one pass over the run's rows."""
    whole = Window.partitionBy(*by)
    rows = _steps(obs, by).withColumn("__n", F.count("*").over(whole))
    size = F.abs(F.col("d"))
    rows = rows.withColumns({"__tail": F.greatest((F.col("__n") * F.lit(share)).cast("int"), F.lit(1)), "__m": F.percentile(size, 0.5).over(whole)})
    v, t, made = F.col("v"), F.when(F.col("v").isNotNull(), F.col("t")), reducers()
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    gap = F.abs(F.avg(F.when(F.col("t") >= F.col("__n") - F.col("__tail"), v)) - F.avg(F.when(F.col("t") < F.col("__tail"), v)))
    small = size < F.greatest(F.col("__m") * 0.1, F.lit(1e-10))
    return rows.groupBy(*by).agg(
        *[made[c].alias(c) for c in ("mean", "std", "final", "delta")],
        (q[1] - q[0]).alias("iqr"),
        F.when((F.count("v") >= 3) & (F.var_pop(t) > EPS), F.regr_slope("v", "t")).alias("slope"),
        F.when(F.max("__n") >= 10, gap / (F.stddev_pop("v") + EPS)).alias("stat_delta"),
        (F.sum(small.cast("int")) / F.greatest(F.count("d"), F.lit(1))).alias("plateau_frac"),
    )


def everything(obs: DataFrame, by: list[str], temporal: Column, share: float = 0.2, wide: float = 0.4) -> DataFrame:
    """One row per series with all of the features above and its values in order as ``x``, from one pass over its rows.

    ``by`` names the series.  Spread, plateaus, shifts and changepoints are made
    where ``temporal`` holds, else null.
    """
    whole, w = Window.partitionBy(*by), along(by)
    size, v, t = F.abs(F.col("d")), F.col("v"), F.col("t")
    rows = _steps(obs, by).withColumns({"__n": F.count("*").over(whole), "__sd": F.stddev_pop("v").over(whole), "__next": F.abs(F.lead("v").over(w) - v), "__c": F.count("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__nv": F.count("v").over(whole), "__temporal": temporal})
    sign = F.when(size < EPS, 0.0).otherwise(F.signum("d"))
    middle = F.percentile(F.when(F.col("__temporal"), size), 0.5).over(whole)
    rows = rows.withColumns({"__tail": F.greatest((F.col("__n") * F.lit(share)).cast("int"), F.lit(1)), "__m": middle, "__split": F.min(F.when(F.col("__c") >= F.floor(F.col("__nv") / 2), t)).over(whole), "__s": sign})
    before = F.lag("__s").over(w)
    rows = rows.withColumns({"__turn": (F.abs(F.col("__s") - before) > 0).cast("int"), "__run": F.sum(F.coalesce((F.col("__s") != before).cast("int"), F.lit(1))).over(w)})
    rows = rows.withColumn("__in", F.when(F.coalesce(F.col("__s"), F.lit(0.0)) != 0, F.count("*").over(Window.partitionBy(*by, "__run"))).otherwise(0))
    made, n = reducers(), F.count("*")
    q = F.percentile(F.when(F.col("__temporal"), v), F.array(F.lit(0.25), F.lit(0.75)))
    gap = F.abs(F.avg(F.when(t >= F.col("__n") - F.col("__tail"), v)) - F.avg(F.when(t < F.col("__tail"), v)))
    half = lambda test: F.coalesce(F.avg(F.when(test, v)), F.lit(0.0))
    at = F.min_by("t", F.when(F.col("__next").isNotNull(), F.struct(-F.col("__next"), t)))
    small = size < F.greatest(F.col("__m") * 0.1, F.lit(1e-10))
    only = lambda c: F.when(F.first("__temporal"), c)
    return rows.groupBy(*by).agg(
        *[made[c].alias(c) for c in REDUCERS],
        F.when(F.max("__n") >= 10, gap / (F.stddev_pop("v") + EPS)).alias("stat_delta"),
        F.when((F.count("v") >= 3) & (F.var_pop(F.when(v.isNotNull(), t)) > EPS), F.regr_slope("v", "t")).alias("slope"),
        F.when(n > 1, F.sum(F.coalesce((size > F.lit(wide) * F.col("__sd")).cast("int"), F.lit(0))) / (n - 1)).alias("pnn40"),
        (q[1] - q[0]).alias("iqr"),
        only(F.sum(small.cast("int")) / F.greatest(F.count("d"), F.lit(1))).alias("plateau_frac"),
        only(half(t > F.col("__split")) - half(t <= F.col("__split"))).alias("cusum_delta"),
        only(F.when(F.count("v") >= 3, at / F.greatest(n, F.lit(1)))).alias("changepoint_t_norm"),
        F.when(n >= 2, F.coalesce(F.sum("__turn"), F.lit(0))).alias("n_reversals"),
        F.when(n == 2, F.lit(1.0)).when(n > 2, (F.greatest(F.max("__in"), F.lit(1)) + 1) / n).alias("max_monotone_frac"),
        F.when(n >= 2, (F.max("v") - F.min("v")) / (F.avg(F.abs("v")) + EPS)).alias("range_ratio"),
        F.transform(F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct("t", "v")))), lambda p: p["v"]).alias("x"),
    )


def pnn(obs: DataFrame, by: list[str], share: float = 0.4) -> DataFrame:
    """``pnn40``: steps wider than 0.4 standard deviations among all length - 1 steps."""
    steps = _steps(obs, by).withColumn("__s", F.stddev_pop("v").over(Window.partitionBy(*by)))
    wide = F.coalesce((F.abs("d") > F.lit(share) * F.col("__s")).cast("int"), F.lit(0))
    return steps.groupBy(*by).agg(F.when(F.count("*") > 1, F.sum(wide) / (F.count("*") - 1)).alias("pnn40"))


def sign_changes(obs: DataFrame, by: list[str], name: str = "sign_changes") -> DataFrame:
    """How often the sign of the step changes; steps under EPS have sign 0."""
    steps = _steps(obs, by).withColumn("__s", F.when(F.abs("d") < EPS, 0.0).otherwise(F.signum("d")))
    turned = steps.withColumn("__c", (F.abs(F.col("__s") - F.lag("__s").over(along(by))) > 0).cast("int"))
    return turned.groupBy(*by).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias(name))


def turns(obs: DataFrame, by: list[str]) -> DataFrame:
    """Ordinal features of masked points: reversals, longest monotone share and range; null under two points.

    Points without a value are left out and the rest numbered anew.
    """
    points = obs.filter(F.col("v").isNotNull()).withColumn("t", F.row_number().over(along(by)) - 1)
    steps = _steps(points, by).withColumn("__s", F.when(F.abs("d") < EPS, 0.0).otherwise(F.signum("d")))
    marked = steps.withColumn("__new", F.coalesce((F.col("__s") != F.lag("__s").over(along(by))).cast("int"), F.lit(1)))
    marked = marked.withColumn("__run", F.sum("__new").over(along(by)))
    marked = marked.withColumn("__in", F.when(F.coalesce(F.col("__s"), F.lit(0.0)) != 0, F.count("*").over(Window.partitionBy(*by, "__run"))).otherwise(0))
    marked = marked.withColumn("__turn", (F.abs(F.col("__s") - F.lag("__s").over(along(by))) > 0).cast("int"))
    n = F.count("*")
    return marked.groupBy(*by).agg(
        F.when(n >= 2, F.coalesce(F.sum("__turn"), F.lit(0))).alias("n_reversals"),
        F.when(n == 2, F.lit(1.0)).when(n > 2, (F.greatest(F.max("__in"), F.lit(1)) + 1) / n).alias("max_monotone_frac"),
        F.when(n >= 2, (F.max("v") - F.min("v")) / (F.avg(F.abs("v")) + EPS)).alias("range_ratio"),
    )


def lagged_asymmetry(obs: DataFrame, by: list[str], a: str, b: str, name: str = "asymmetry") -> DataFrame:
    """|corr(a now, b next)| - |corr(b now, a next)|, every mean over its own values; null under three steps."""

    led = obs.withColumns({"__a": F.lead(a).over(along(by)), "__b": F.lead(b).over(along(by)), "__last": F.lead("t").over(along(by)).isNull()})
    pairs = led.filter("not __last")

    whole = Window.partitionBy(*by)
    centred = pairs.select(*by, *[(F.col(c) - F.avg(c).over(whole)).alias(f"__c{i}") for i, c in enumerate((a, "__b", b, "__a"))])

    def corr(x: str, y: str) -> Column:
        both = F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0))
        spread = F.coalesce(F.sum(F.col(x) ** 2), F.lit(0.0)) * F.coalesce(F.sum(F.col(y) ** 2), F.lit(0.0))
        return both / (F.sqrt(spread) + EPS)

    return centred.groupBy(*by).agg(F.when(F.count("*") >= 2, F.abs(corr("__c0", "__c1")) - F.abs(corr("__c2", "__c3"))).alias(name))


def lagged_asymmetry_of(a: Column, b: Column) -> Column:
    """:func:`lagged_asymmetry` of two arrays of equal length, whose missing values are null."""
    n = F.size(a) - 1

    def corr(x: Column, y: Column) -> Column:
        now, ahead = F.slice(x, 1, F.greatest(n, F.lit(0))), F.slice(y, 2, F.greatest(n, F.lit(0)))
        total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda s, e: s + F.coalesce(f(e), F.lit(0.0)))
        centred = lambda v: F.transform(v, lambda e: e - F.try_divide(total(v, lambda q: q), total(v, lambda q: F.when(q.isNotNull(), 1.0))))
        p, q = centred(now), centred(ahead)
        both = total(F.zip_with(p, q, lambda s, t: s * t), lambda e: e)
        return both / (F.sqrt(total(p, lambda e: e * e) * total(q, lambda e: e * e)) + EPS)

    return F.when(n >= 2, F.abs(corr(a, b)) - F.abs(corr(b, a)))


def values_in_order(obs: DataFrame, by: list[str]) -> DataFrame:
    """One row per run with its values as an array ``x``, in order, nulls left out."""
    kept = obs.filter(F.col("v").isNotNull())
    return kept.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("x"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def autocorrelation(rows: DataFrame, lags: Column) -> DataFrame:
    """``rows`` plus centred values ``c``, ``energy`` and ``ac``, the sums of products at ``lags`` over the energy."""
    centred = rows.withColumn("__mean", F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x"))
    centred = centred.withColumn("c", F.transform("x", lambda v: v - F.col("__mean"))).drop("__mean")
    centred = centred.withColumn("energy", _dot(F.col("c"), F.col("c")))
    n = F.size("c")
    product = lambda k: F.try_divide(_dot(F.slice("c", 1, n - k), F.slice("c", k + 1, n - k)), F.col("energy"))
    return centred.withColumn("ac", F.transform(lags, product))


def first_minimum(obs: DataFrame, by: list[str]) -> DataFrame:
    """``first_min_ac``: the first lag with a negative autocorrelation or before an upturn, at most half the length.

    Null under six values or without energy.
    """
    return first_minimum_of(values_in_order(obs, by)).select(*by, "first_min_ac")


def first_minimum_of(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``first_min_ac`` of the values in their array ``x``; what the search needs goes."""
    half = F.floor(F.size("x") / 2).cast("int")
    made = autocorrelation(rows, F.when(half >= 3, F.sequence(F.lit(1), half - 1)))
    lag = lambda test: F.transform(F.filter(F.sequence(F.lit(1), F.size("ac")), test), lambda i: i)
    negative = F.get(lag(lambda i: F.element_at("ac", i) < 0), 0)
    upturn = F.get(lag(lambda i: (i < F.size("ac")) & (F.get("ac", i) > F.element_at("ac", i))), 0)
    least = F.least(F.coalesce(negative, half), F.coalesce(upturn, half))
    return made.select(*rows.columns, F.when((half >= 3) & (F.col("energy") >= EPS), least).alias("first_min_ac"))


def period(obs: DataFrame, by: list[str], least_correlation: float = 0.3) -> DataFrame:
    """``period``: the first lag under a quarter of the length whose autocorrelation is a peak above 0.3, else null."""
    rows = values_in_order(obs, by)
    quarter = F.floor(F.size("x") / 4).cast("int")
    centred = autocorrelation(rows, F.when(quarter >= 1, F.sequence(F.lit(0), quarter - 1)))
    ac = centred.withColumn("ac", F.transform("ac", lambda v: v * F.col("energy") / (F.col("energy") + EPS)))
    at = lambda i: F.get("ac", i)
    after = lambda i: F.when(i + 1 < F.size("ac"), at(i + 1)).otherwise(-1.0)
    peak = F.filter(F.sequence(F.lit(1), F.size("ac") - 1), lambda i: (at(i) > at(i - 1)) & (at(i) > after(i)) & (at(i) > least_correlation))
    return ac.select(*by, F.when(F.size("ac") >= 2, F.get(peak, 0)).alias("period"))
