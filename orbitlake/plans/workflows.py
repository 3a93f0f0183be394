"""The three workflows: run a design, give a verdict on runs, audit a run table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atomics
from ..operators import clustering, comparison, features, matrix, naming, planning, quantiles, relational, simulate, summaries
from ..sources import configs, shared, tables


def run_design(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """All runs of a design with every column of the run table; null stands for what does not apply."""
    runs = planning.design(spark, config, atomics.registries())
    runs = runs.withColumn("run_id", F.xxhash64(*[F.col(c).cast("string") for c in relational.DEDUP_KEYS["full"]]))
    runs = shared.materialised(simulate.simulate(runs, simulate.tasks_for(runs.count())), "runs")  # the families of features read it, none runs it again
    return features.scalar_features(runs, ["run_id"])


def dry_run(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """How many runs and homogeneous groups a design has."""
    return planning.dry_run(planning.design(spark, config, atomics.registries()))


def pool(spark: SparkSession, paths: list[str], pool_config: dict[str, Any], scope: dict[str, Any], keys: str = "ids") -> DataFrame:
    """Run tables united, without exclusions and duplicates (the first in the order of the files stays), in scope."""
    runs = relational.exclude_ids(tables.read_in_order(spark, *paths), pool_config.get("excluded", {}))
    limits = pool_config.get("n_dof", {})
    runs = relational.range_filter(runs, "n_dof", limits.get("min"), limits.get("max"))
    kept = relational.dedup_runs(runs, keys, [F.col(c) for c in tables.PLACE])
    return relational.scope_filter(kept.drop(*tables.PLACE), scope)


def verdict(runs: DataFrame, atomics_table: DataFrame, analysis: dict[str, Any] | None = None, least_runs: int = 5, aliases: bool = False, plots: bool = False) -> dict[str, Any]:
    """Strata of the healthy runs with their clusters, names, coherence and profiles, and the pathological runs by id.

    ``analysis`` is what ``configs.load_analysis`` gives.  With ``plots`` a
    stratum also has the data of its two pictures, as tables: ``points``,
    ``centroids`` and ``signature``.  ``runs`` needs a unique ``run_id``.  Strata are few (rank and
    differentiability); per stratum, one row per cluster, entity or feature
    reaches the driver.
    """
    analysis = configs.load_analysis(None) | (analysis or {})
    healthy, sick = relational.triage(runs)
    healthy = matrix.strata(healthy, atomics_table).persist()
    out: dict[str, Any] = {"strata": {}, "pathological": pathological(sick)}
    sizes = matrix.strata_in_order(healthy).orderBy("place").collect()
    for r in sizes:
        if r["n"] >= least_runs:
            out["strata"][r["strate"]] = _stratum(healthy.filter(F.col("strate") == r["strate"]), runs, analysis, aliases, plots) | {"n_runs": r["n"]}
    out["n_strata"] = len(out["strata"])
    out["n_clusters"] = sum(len(s["clusters"]) for s in out["strata"].values())
    healthy.unpersist()
    return out


def pathological(sick: DataFrame) -> dict[str, dict[str, Any]]:
    """Per status of failed runs: their number, and the ten gammas and encodings with most of them (number, total and share)."""
    totals = {r["run_status"]: r["n"] for r in summaries.value_counts(sick, ["run_status"]).collect()}
    out: dict[str, dict[str, Any]] = {s: {"n": totals.get(s, 0), "gamma_id": [], "encoding_id": []} for s in sorted({"EXPLOSION", "COLLAPSED", *totals})}
    for entity in ("gamma_id", "encoding_id"):
        for r in summaries.top_per_group(sick, "run_status", entity).orderBy("run_status", "place").collect():  # ten rows a status
            out[r["run_status"]][entity].append({entity: r[entity], "count": r["n"], "total": totals[r["run_status"]], "fraction": r["fraction"]})
    return out


def signature(clusters: dict[int, dict], spark: SparkSession) -> DataFrame:
    """(cluster, name, n, slot, confidence): the heat map of clusters by slots; a slot without a term has null."""
    rows = [(int(k), c["name"], int(c["n"]), slot, float((c["slots"] | c["secondary"])[slot][1]) if slot in (c["slots"] | c["secondary"]) else None) for k, c in clusters.items() for slot in naming.SLOTS]
    return spark.createDataFrame(rows, "cluster long, name string, n long, slot string, confidence double")


def centroids(points: DataFrame) -> DataFrame:
    """(label, x, y, n): where each cluster's name stands in the picture, the median of its points."""
    placed = points.filter("label >= 0 AND x IS NOT NULL")
    long = placed.select("label", "x", "y").unpivot(["label"], ["x", "y"], "axis", "v")
    middle = quantiles.quantiles(long, ["label", "axis"], "v", [0.5])
    wide = middle.groupBy("label").agg(*[F.max(F.when(F.col("axis") == a, F.get("q", F.lit(0)))).alias(a) for a in ("x", "y")])
    return wide.join(placed.groupBy("label").agg(F.count("*").alias("n")), "label")


def _stratum(rows: DataFrame, runs: DataFrame, analysis: dict[str, Any], aliases: bool, plots: bool) -> dict[str, Any]:
    names = [c for c in matrix.feature_columns(tables.feature_names()) if c in rows.columns]
    some = rows.agg(*[F.count(c).alias(c) for c in names]).first()
    names = [c for c in names if some[c]]
    made, kept = matrix.matrix(rows.select("strate", "run_id", *[F.col(c).cast("double").alias(c) for c in names]), names, analysis["protected"], analysis["correlation"], analysis["log_limit"], analysis["select"])
    labels = clustering.peel_strata(made, "strate", kept, "run_id", clustering.Peeling(**analysis["peeling"])).drop("strate").persist()
    isolated = clustering.outliers_of_strata(made, "strate", kept, "run_id", analysis["outliers"]).drop("strate")
    joined = rows.join(labels, "run_id").persist()
    named = naming.name_clusters(joined, "label", names, aliases)
    clustered, loose = relational.split_noise(joined)
    regimes = {r["label"]: r for r in summaries.coherence(clustered, "label", "p1_regime_class").collect()}
    shares = {r["label"]: r for r in clustered.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("run_status") == "OK_TRUNCATED").cast("double")).alias("truncated"), F.max("level").alias("level"), F.max("homogeneity").alias("homogeneity")).collect()}
    clusters = {}
    for k, n in named.items():
        s, g = shares[k], regimes.get(k)
        dominant = g["dominant"] if g else None
        clusters[k] = n | {"n": s["n"], "level": s["level"], "homogeneity": s["homogeneity"], "truncated": s["truncated"], "regime": dominant, "entropy": g["entropy"] if g else None, "interpretation": naming.interpret(n["slots"], dominant, s["truncated"])}
    everyone = runs.join(labels.select("run_id", "label"), "run_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    profiles = {}
    for entity in (c for c in ("gamma_id", "encoding_id", "modifier_id") if c in everyone.columns):
        made_profiles = summaries.entity_profiles(everyone, entity, "label", F.col("run_status").isin("EXPLOSION", "COLLAPSED"), maps={"clusters": "label", "regimes": "p1_regime_class", "statuses": "run_status"})
        made_profiles = made_profiles.withColumn("verdict", summaries.verdict(F.col("explosion_rate"), F.coalesce("concentration", F.lit(0.0)), F.col("n_clustered")))
        profiles[entity] = [r.asDict() for r in made_profiles.orderBy(entity).collect()]
    flags = labels.join(isolated, "run_id")
    agreement = relational.overlap(flags, F.col("label") < 0, F.col("is_outlier")).first().asDict()
    gathered = lambda entity, other: [r.asDict() for r in summaries.universality(clustered, "label", entity, other=other).orderBy(F.desc("fraction"), entity).collect()]
    residue = [r.asDict() for r in summaries.coherence(loose, "label", "p1_regime_class").collect()]
    noise = labels.filter("label < 0").count()
    pictures = {}
    if plots:
        flat = clustering.project_strata(made, "strate", kept, "run_id", most=analysis["projection"]).drop("strate")
        points = shared.materialised(flat.join(labels, "run_id"), "points")
        pictures = {"points": points, "centroids": centroids(points), "signature": signature(clusters, rows.sparkSession)}
    for df in (labels, joined):
        df.unpersist()
    return pictures | {"clusters": clusters, "features": kept, "profiles": profiles, "outliers": agreement, "universal": gathered("gamma_id", "encoding_id"), "convergent": gathered("encoding_id", "gamma_id"), "residue": residue[0] if residue else None, "n_noise": noise}


def phase_concordance(runs: DataFrame, labels: DataFrame, first: str, second: str, entity: str = "gamma_id") -> dict[str, Any]:
    """What two phases say of the design points they share (an extension): see :func:`comparison.concordance`."""
    keys = ["gamma_id", "encoding_id", "modifier_id", "n_dof", "seed_CI", "seed_run"]
    side = lambda phase: runs.filter(F.col("phase") == phase).join(labels, "run_id").select(*keys, "label")
    return comparison.concordance(side(first), side(second), keys, entity, "label")


def viability(runs: DataFrame, entity: str) -> DataFrame:
    """Share of each status per entity and its parameters (an extension): where truncated and exploding runs begin."""
    rate = lambda s: F.avg((F.col("run_status") == s).cast("double")).alias(s.lower())
    return runs.groupBy(f"{entity}_id", f"{entity}_params").agg(F.count("*").alias("n"), *[rate(s) for s in ("OK", "OK_TRUNCATED", "EXPLOSION", "COLLAPSED")])


def audit(runs: DataFrame, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Statistics by column, gamma and encoding, rows with missing values, and the manifest of the design."""
    columns = columns or [c for c in tables.feature_names() if c in runs.columns]
    return {
        "stats": summaries.column_stats(runs, columns),
        "by_gamma": summaries.group_stats(runs, "gamma_id", columns),
        "by_encoding": summaries.group_stats(runs, "encoding_id", columns),
        "anomalies": relational.anomalies(runs, columns, ["gamma_id", "encoding_id"]),
        "manifest": relational.grid(runs, "gamma_id", "encoding_id", "run_status"),
        "statuses": summaries.value_counts(runs, ["run_status"]),
    }
