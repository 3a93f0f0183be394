"""``python -m orbitlake run DESIGN.yaml OUT | verdict OUT RUNS... | audit OUT RUNS... | dump OUT RUNS...``"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import atomics
from .plans import workflows
from .sources import configs, filesystem, reports, tables


def parse(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="orbitlake", description=__doc__)
    what = parser.add_subparsers(dest="what", required=True)
    run = what.add_parser("run", help="expand a design, simulate its runs and write them")
    run.add_argument("design")
    run.add_argument("out")
    run.add_argument("--dry-run", action="store_true", help="only count the runs and their groups")
    for name, text in (("verdict", "cluster, name and profile runs"), ("audit", "statistics, anomalies and the manifest"), ("dump", "statistics and rows as JSON")):
        p = what.add_parser(name, help=text)
        p.add_argument("out")
        p.add_argument("runs", nargs="+", help="one or more run tables; of equal runs the first stays")
        p.add_argument("--pool", help="YAML file with excluded operators and ranges")
        p.add_argument("--cfg", "--scope", help="YAML file of an analysis: scope, thresholds, protected features")
        if name == "verdict":
            p.add_argument("--plot", action="store_true", help="also write the data of the pictures")
            p.add_argument("--verbose", action="store_true", help="a longer text report")
        if name == "dump":
            p.add_argument("--sample", type=int, help="so many rows, drawn by a seeded hash")
            p.add_argument("--stats", action="store_true", help="the statistics only")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = SparkSession.builder.appName("orbitlake").getOrCreate()
    if args.what == "run":
        config = configs.load_yaml(args.design, spark)
        if args.dry_run:
            workflows.dry_run(spark, config).show()
            return
        tables.write_runs(tables.conform(workflows.run_design(spark, config), tables.run_schema(), strict=False), args.out)
        return
    analysis = configs.load_analysis(args.cfg, spark)
    rows = workflows.pool(spark, args.runs, configs.load_pool(args.pool, spark) if args.pool else {}, analysis["scope"])
    {"audit": audit, "dump": dump, "verdict": verdict}[args.what](spark, args, analysis, rows)


def audit(spark: SparkSession, args: argparse.Namespace, analysis: dict, rows: DataFrame) -> None:
    for name, df in workflows.audit(rows).items():
        df.write.mode("overwrite").json(f"{args.out}/{name}")


def dump(spark: SparkSession, args: argparse.Namespace, analysis: dict, rows: DataFrame) -> None:
    columns = [c for c in tables.feature_names() if c in rows.columns]
    stats = {r["feature"]: {k: v for k, v in r.asDict().items() if k != "feature"} for r in workflows.audit(rows, columns)["stats"].collect()}  # a row a feature
    reports.write_json(spark, f"{args.out}/stats.json", {"n_observations": rows.count(), "n_features": len(rows.columns), "feature_stats": stats})
    if not args.stats:
        axes = [c for c in tables.C.METADATA if c in rows.columns]
        reports.dump(rows, f"{args.out}/rows", axes, columns, args.sample)


def verdict(spark: SparkSession, args: argparse.Namespace, analysis: dict, rows: DataFrame) -> None:
    known = spark.createDataFrame(atomics.metadata(), atomics.METADATA_SCHEMA).filter("kind = 'gamma'")
    rows = rows.withColumn("run_id", F.xxhash64(*[F.col(c).cast("string") for c in rows.columns if c in tables.C.METADATA]))
    found = workflows.verdict(rows, known, analysis, plots=args.plot)
    for name, s in found["strata"].items():
        for picture in ("points", "centroids", "signature"):
            if picture in s:
                s.pop(picture).write.mode("overwrite").parquet(f"{args.out}/plots/{name}/{picture}")
    reports.write_json(spark, f"{args.out}/verdict.json", found)
    filesystem.write_text(spark, f"{args.out}/verdict.txt", reports.text_report(found["strata"], args.verbose))


if __name__ == "__main__":
    main()
