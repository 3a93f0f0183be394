"""Exact quantiles of many columns and groups together, by narrowing ranges.

An order statistic is looked for in a range of values that is known to hold it.
Each round counts, for every range at once, how many values fall into each of
BINS parts of it; the part that holds the wanted rank is the next range.  What
is shuffled are counts of parts, added up before they leave a task: no task
holds a column's values, or its distinct values, and a hot group is as cheap as
any other.  A range ends at its least and greatest value, so it shrinks in
every round.  It is done when both are equal, or when it holds no more than
GATHERED values, as its count says: these are sorted in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised

#: Parts of a range, and values of a range that are sorted in one place.
BINS, GATHERED = 1024, 4096
#: Ranges that are kept on the driver and broadcast (about 100 bytes each); more are stored and joined by a shuffle.
BROADCAST_RANGES = 50_000
#: Infinities count as the greatest finite double: differences of values stay numbers.
TOP = 1.7976931348623157e308


def _bin(v: Column, lo: Column, hi: Column, even: bool) -> Column:
    """The part of lo..hi that v is in: parts of equal width, or of equal ratio (on both sides of 0, down to tiny magnitudes)."""
    half = lambda x: x * 0.5
    if even:
        share = F.try_divide(half(v) - half(lo), half(hi) - half(lo))
    else:
        scale = F.greatest((half(hi) - half(lo)) * 1e-290, F.lit(1e-300))
        warp = lambda x: F.when((lo > 0) | (hi < 0), F.signum(x) * F.ln(F.abs(x))).otherwise(F.signum(x) * F.log1p(F.abs(half(x)) / scale))
        share = F.try_divide(warp(v) - warp(lo), warp(hi) - warp(lo))
    inner = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
    return F.when(v >= hi, BINS - 1).when(v <= lo, 0).otherwise(inner)


def _held(df: DataFrame, few: bool) -> DataFrame:
    """``df`` computed once: a few rows as a local table, more in the shared folder."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema) if few else materialised(df, "ranges")


def join_on(a: DataFrame, b: DataFrame, keys: list[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on ``keys``, null keys with null keys; the other columns differ in name."""
    named = {k: f"__right{i}" for i, k in enumerate(keys)}
    test = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()] + ([] if more is None else [more])
    return a.join(b.withColumnsRenamed(named), reduce(Column.__and__, test, F.lit(True)), how).drop(*named.values())


def _inside(rows: DataFrame, ranges: DataFrame, by: list[str], few: bool) -> DataFrame:
    """(by, __v, __lo, __hi): every value with each range of its group that it is in."""
    parts = ranges.select(*by, "__lo", "__hi").distinct()
    return join_on(rows, F.broadcast(parts) if few else parts, by, F.col("__v").between(F.col("__lo"), F.col("__hi")))


def _narrowed(rows: DataFrame, ranges: DataFrame, by: list[str], few: bool, even: bool) -> DataFrame:
    """The parts of ``ranges`` that hold their ranks, as ranges."""
    met = _inside(rows, ranges, by, few)
    counted = met.groupBy(*by, "__lo", "__hi", _bin(F.col("__v"), F.col("__lo"), F.col("__hi"), even).alias("__bin")).agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    upto = F.sum("__n").over(Window.partitionBy(*by, "__lo", "__hi").orderBy("__bin"))  # at most BINS rows
    counted = counted.withColumn("__upto", upto)
    asked = ranges.select(*by, "__lo", "__hi", "__below", F.explode("__ranks").alias("__rank"))
    place = F.col("__rank") - F.col("__below")
    found = join_on(asked, counted, [*by, "__lo", "__hi"], (place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__n")))
    found = found.select(*by, "__rank", F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), (F.col("__below") + F.col("__upto") - F.col("__n")).alias("__below"), "__n")
    return found.groupBy(*by, "__lo", "__hi", "__below", "__n").agg(F.collect_list("__rank").alias("__ranks"))


def _order_statistics(rows: DataFrame, sizes: DataFrame, by: list[str], few: bool) -> DataFrame:
    """(by, __found): per group a map from each of its ``__ranks`` (from 0) to the value at that place in order.

    ``rows`` is (by, __v); ``sizes`` one row a group, with ``__n``, ``__lo``, ``__hi`` and ``__ranks``.
    """
    ranges = sizes.withColumn("__below", F.lit(0).cast("long"))
    wide = (F.col("__lo") < F.col("__hi")) & (F.col("__n") > GATHERED)
    even = True
    while not ranges.filter(wide).isEmpty():
        ranges = _held(_narrowed(rows, ranges.filter(wide), by, few, even).unionByName(ranges.filter(~wide), allowMissingColumns=True), few)
        even = not even
    lists = _inside(rows, ranges.filter("__lo < __hi"), by, few).groupBy(*by, "__lo", "__hi").agg(F.sort_array(F.collect_list("__v")).alias("__sorted"))
    found = join_on(ranges, lists, [*by, "__lo", "__hi"], how="left")
    value = lambda r: F.coalesce(F.get("__sorted", (r - F.col("__below")).cast("int")), F.col("__lo"))
    entries = found.select(*by, F.explode(F.transform("__ranks", lambda r: F.struct(r.alias("rank"), value(r).alias("x")))).alias("__e"))
    return entries.groupBy(*by).agg(F.map_from_entries(F.collect_list("__e")).alias("__found"))


def quantiles(long: DataFrame, by: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """(by, ``name``): per group the array of its linear quantiles at ``shares``; groups without a value are left out.

    Infinite values count, nulls and NaN do not; groups may be null.
    """
    number = F.col(value).cast("double")
    rows = long.select(*by, F.when(number.isNotNull() & ~F.isnan(number), F.least(F.greatest(number, F.lit(-TOP)), F.lit(TOP))).alias("__v")).filter("__v IS NOT NULL")
    at = [F.lit(float(s)) * (F.col("__n") - 1) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a).cast("long"), F.ceil(a).cast("long")) for a in at])))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).withColumn("__ranks", ranks)
    head = sizes.limit(BROADCAST_RANGES // (2 * len(shares)) + 1).collect()
    few = len(head) <= BROADCAST_RANGES // (2 * len(shares))
    sizes = long.sparkSession.createDataFrame(head, sizes.schema) if few else materialised(sizes, "sizes")
    if few and all(r["__n"] <= GATHERED for r in head):
        one_list = F.sort_array(F.collect_list("__v"))
        held = rows.groupBy(*by).agg(one_list.alias("__sorted"), F.count("*").alias("__n"))
        pick = lambda k: F.get("__sorted", k.cast("int"))
    else:
        found = _order_statistics(rows, sizes, by, few)
        held = join_on(sizes, found, by)
        pick = lambda k: F.element_at("__found", k.cast("long"))
    whole = lambda x: F.when(F.abs(x) >= TOP, F.signum(x) * F.lit(float("inf"))).otherwise(x)

    def one(a: Column) -> Column:
        low, high, rest = whole(pick(F.floor(a))), whole(pick(F.ceil(a))), a - F.floor(a)
        return F.when(low == high, low).otherwise((1 - rest) * low + rest * high)

    return held.select(*by, F.array(*[one(a) for a in at]).alias(name))


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Per column its quantiles at ``shares``, as numbers; columns without values are left out.  As many numbers as columns times shares reach the driver."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "__column", "__value")
    return {r["__column"]: list(r["q"]) for r in quantiles(long, ["__column"], "__value", shares).collect()}
