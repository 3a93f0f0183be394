"""Counts, statistics and verdicts of run tables and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import join_on
from .quantiles import quantiles as exact_quantiles


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, feature, v): one row per value, as doubles; text that is no number gives null."""
    return df.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in columns]).unpivot(ids, columns, "feature", "v")


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def whole_and_subset(df: DataFrame, by: str, subset: Column) -> DataFrame:
    """Per group its rows and those of them in a subset, from one pass; a null test is not in it."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.coalesce(subset, F.lit(False)).cast("long")).alias("n_subset"))


def count_map(df: DataFrame, by: list[str], item: str, name: str) -> DataFrame:
    """(by, ``name``): per group a map from each item to its number of rows; null items are left out.

    Rows are counted by group and item first, so a map is as large as a group
    has different items, however many rows it has.
    """
    counts = df.groupBy(*by, item).agg(F.count("*").alias("__n"))
    entries = F.collect_list(F.when(F.col(item).isNotNull(), F.struct(F.col(item), "__n")))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(entries)).alias(name))


def add_maps(a: Column, b: Column) -> Column:
    """The counts of two maps added up; a null map is empty."""
    whole = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(whole)


def shares(counts: Column) -> Column:
    """A map of counts as one of shares of their sum."""
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform_values(counts, lambda _, n: n / total)


def map_text(counts: Column) -> Column:
    """A map as text, ``key:value`` in order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")


def top_per_group(df: DataFrame, group: str, item: str, k: int = 10) -> DataFrame:
    """The k most frequent items of each group with their share; ties by the item."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counts.withColumns({"fraction": share, "place": place}).filter(F.col("place") <= k)


def _is(test: str) -> Column:
    return {"nan": F.col("v").isNull() | F.isnan("v"), "inf": F.abs("v") == float("inf"), "valid": F.col("v").isNotNull() & ~F.isnan("v"), "finite": F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))}[test]


QUARTILES = [0.25, 0.5, 0.75]


def _with_quartiles(stats: DataFrame, long: DataFrame, by: list[str], name: str = "__q") -> DataFrame:
    """``stats`` (one row for each ``by``) plus the exact quartiles of the values of ``long``."""
    return join_on(stats, exact_quantiles(long, by, "v", QUARTILES, name), by, how="left")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: numbers of valid, missing and infinite values and, over the finite, mean, median, sample std and quartiles.

    Infinities are valid and counted once more on their own; they have no place
    in the statistics.  Text is read as numbers, what is none is missing.
    """
    long = unpivot(df, [], columns)
    v = F.when(_is("finite"), F.col("v"))
    n = lambda t: F.sum(F.coalesce(_is(t), F.lit(False)).cast("long"))
    made = long.groupBy("feature").agg(n("valid").alias("n_valid"), n("nan").alias("n_nan"), n("inf").alias("n_inf"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    made = _with_quartiles(made, long.filter(_is("finite")), ["feature"])
    return made.select("feature", "n_valid", "n_nan", "n_inf", "mean", F.get("__q", F.lit(1)).alias("median"), "std", "min", "max", F.get("__q", F.lit(0)).alias("q1"), F.get("__q", F.lit(2)).alias("q3"))


def flag_stats(df: DataFrame, flag: Column) -> DataFrame:
    yes = F.sum(flag.cast("int"))
    return df.agg(yes.alias("n_true"), (F.count(flag) - yes).alias("n_false"), F.round(yes / F.count(flag), 4).alias("fraction"))


def group_stats(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group and feature: mean and sample std over finite values, shares of missing and infinite ones."""
    long = unpivot(df, [by], columns)
    v = F.when(_is("finite"), F.col("v"))
    rate = lambda t: F.avg(F.coalesce(_is(t), F.lit(False)).cast("double"))
    return long.groupBy(by, "feature").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), rate("nan").alias("nan_rate"), rate("inf").alias("inf_rate"), F.count("*").alias("n"))


# Families of encodings by the head of their ids.
FAMILIES = ("SYM", "ASY", "R3", "RN")


def family(encoding_id: Column) -> Column:
    head = F.upper(F.split(encoding_id, "-")[0])
    return F.when(head.isin(*FAMILIES), head).otherwise("UNKNOWN")


def cluster_profile(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Per cluster and feature: median, IQR, mean, population std, share of missing values and rows."""
    long = unpivot(df, [cluster], columns)
    v = F.when(_is("finite"), F.col("v"))
    made = long.groupBy(cluster, "feature").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg((~_is("finite")).cast("double")).alias("nan_frac"), F.count("*").alias("n"))
    made = _with_quartiles(made, long.filter(_is("finite")), [cluster, "feature"])
    return made.select(cluster, "feature", F.get("__q", F.lit(1)).alias("median"), (F.get("__q", F.lit(2)) - F.get("__q", F.lit(0))).alias("iqr"), "mean", "std", "nan_frac", "n")


def quartiles(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    long = unpivot(df, [by], columns)
    made = _with_quartiles(long.groupBy(by, "feature").agg(F.count("v").alias("n")), long, [by, "feature"])
    return made.select(by, "feature", F.get("__q", F.lit(1)).alias("median"), F.get("__q", F.lit(0)).alias("q1"), F.get("__q", F.lit(2)).alias("q3"), "n")


def distribution(df: DataFrame, group: str, item: str) -> DataFrame:
    """Shares of the items in each group and the group's dominant one (ties: the smallest)."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    best = F.first(item).over(w.orderBy(F.desc("n"), item))
    return counts.withColumns({"fraction": F.col("n") / F.sum("n").over(w), "dominant": best})


def coherence(df: DataFrame, group: str, item: str, pure: float = 0.7, mixed: float = 0.5) -> DataFrame:
    """Normalised entropy of the items in each group, the largest share and whether that makes it pure or mixed."""
    shares = distribution(df, group, item)
    kinds = F.count("*")
    entropy = F.when(kinds <= 1, 0.0).otherwise(-F.sum(F.col("fraction") * F.log2("fraction")) / F.log2(kinds.cast("double")))
    made = shares.groupBy(group).agg(F.sum("n").alias("n"), F.first("dominant").alias("dominant"), F.max("fraction").alias("dominant_fraction"), entropy.alias("entropy"))
    return made.withColumns({"is_pure": F.col("dominant_fraction") > pure, "is_mixed": F.col("dominant_fraction") < mixed})


def entity_profiles(df: DataFrame, entity: str, label: str, exploded: Column, maps: dict[str, str] | None = None) -> DataFrame:
    """Per entity: clustered runs (label >= 0), dominant cluster (ties: the least) with its share, and the share of explosions.

    ``maps`` names map columns to add: (new column: counted column); a column
    that is the label is counted over clustered runs only.
    """
    clustered = df.filter(F.col(label) >= 0).groupBy(entity, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(entity)
    ranked = clustered.withColumns({"n_clustered": F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), label))})
    best = ranked.filter("place = 1").select(entity, "n_clustered", F.col(label).alias("dominant"), (F.col("n") / F.col("n_clustered")).alias("concentration"))
    whole = df.groupBy(entity).agg(F.count("*").alias("n_runs"), F.avg(F.coalesce(exploded, F.lit(False)).cast("double")).alias("explosion_rate"))
    out = whole.join(best, entity, "left").withColumn("n_clustered", F.coalesce("n_clustered", F.lit(0)))
    for name, item in (maps or {}).items():
        out = join_on(out, count_map(df.filter(F.col(label) >= 0) if item == label else df, [entity], item, name), [entity], how="left")
    return out


def universality(df: DataFrame, cluster: str, entity: str, least: float = 0.7, enforce_min: int | None = None, other: str | None = None) -> DataFrame:
    """Clusters that hold more than ``least`` of an entity's runs.

    ``enforce_min`` asks for runs of that many different ``other`` entities (a
    gamma's encodings, an encoding's gammas) in the cluster as well.
    """
    if enforce_min is not None and other is None:
        raise ValueError("enforce_min counts the column that other names")
    wide = [F.count_distinct(other).alias("__k")] if enforce_min is not None else []
    shares = df.groupBy(entity, cluster).agg(F.count("*").alias("n"), *wide)
    kept = shares.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(entity))).filter(F.col("fraction") > least)
    return kept.filter(F.col("__k") >= enforce_min).drop("__k") if enforce_min is not None else kept


def verdict(explosion: Column, concentration: Column, n: Column) -> Column:
    """What to do with an entity: EXCLURE, EXPLORER or CONSERVER."""
    return F.when(explosion > 0.8, "EXCLURE").when(explosion > 0.3, "EXPLORER").when((concentration > 0.9) & (n >= 3), "CONSERVER").when(concentration > 0.7, "CONSERVER").otherwise("EXPLORER")


def omega_squared(df: DataFrame, factor: str, value: str) -> DataFrame:
    """Effect of a factor on a value: (SSB - dfB MSW) / (SST + MSW)."""
    per = df.filter(F.col(value).isNotNull()).groupBy(factor).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("w"))
    whole = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    ssb = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    msw = F.col("ssw") / (F.col("n") - F.col("k"))
    return whole.select(((ssb - (F.col("k") - 1) * msw) / (ssb + F.col("ssw") + msw)).alias("omega_squared"), F.col("n"), F.col("k"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V of two categorical columns, from the counts of their pairs."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    cells = cells.withColumns({"ra": F.sum("n").over(Window.partitionBy(a)), "rb": F.sum("n").over(Window.partitionBy(b))})
    out = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))).alias("q"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    return out.select(F.sqrt((F.col("q") - 1) / (F.least("ka", "kb") - 1)).alias("cramers_v"), "n")


#: Rows of places to rank that are broadcast (about 50 bytes each); beyond it the values are joined to them by a shuffle.
BROADCAST_PLACES = 200_000


def ranks(long: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (feature, x, ...) plus ``rank``: the share of the feature's values in ``long`` (feature, v) at most x.

    Each value falls between two of the feature's places, found in a sorted
    array, and values are counted by that in one pass; no value meets a row of
    ``at``.  A null x has rank 0, a feature without values none.
    """
    places = at.filter(F.col("x").isNotNull()).groupBy("feature").agg(F.sort_array(F.collect_set(F.col("x").cast("double"))).alias("xs"))
    small = at.count() <= BROADCAST_PLACES
    values = long.filter(F.col("v").isNotNull())
    met = values.join(F.broadcast(places) if small else places, "feature", "left")
    between = F.coalesce(F.size(F.filter("xs", lambda x: x < F.col("v"))), F.lit(0))
    counted = met.groupBy("feature", between.alias("b")).agg(F.count("*").alias("n"))
    per = counted.groupBy("feature").agg(F.collect_list(F.struct("b", "n")).alias("counts"), F.sum("n").alias("total"))  # as many as places
    out = at.join(places, "feature", "left").join(per, "feature", "left")
    place = F.array_position("xs", F.col("x").cast("double")) - 1
    upto = F.aggregate(F.filter("counts", lambda c: c["b"] <= place), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    rank = F.when(F.col("total").isNull(), None).when(F.col("x").isNull(), 0.0).otherwise(upto / F.col("total"))
    return out.select(*at.columns, rank.alias("rank"))


def percentile_rank(df: DataFrame, value: str, at: DataFrame, key: str) -> DataFrame:
    """For each row (key, x) of a small table ``at``: the share of values at most x, from one pass over the values."""
    named = at.select(key, "x").distinct().withColumn("feature", F.lit(value))
    return ranks(df.select(F.lit(value).alias("feature"), F.col(value).cast("double").alias("v")), named).drop("feature")
