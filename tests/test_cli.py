import json

import yaml
from pyspark.sql import functions as F

from orbitlake.__main__ import main
from orbitlake.plans import workflows
from orbitlake.sources import configs, reports, tables
from orbitlake.streaming import live


def test_run_audit_verdict(spark, tmp_path):
    design = {"phase": "demo", "gamma": [{"id": "GAM-001", "params": {"beta": [0.5, 1.0, 2.0]}}, {"id": "GAM-004", "params": {"gamma": [0.01, 0.1, 0.5]}}, {"id": "GAM-009"}], "encoding": [{"id": "SYM-001"}, {"id": "ASY-001"}], "n_dof": [4], "max_it": 20, "seed_CI": [1, 2], "seed_run": [1]}
    (tmp_path / "design.yaml").write_text(yaml.safe_dump(design))
    main(["run", str(tmp_path / "design.yaml"), str(tmp_path / "runs")])
    runs = tables.read_runs(spark, str(tmp_path / "runs"))
    assert runs.count() == 7 * 2 * 2 and set(tables.run_schema().names) <= set(runs.columns)
    assert runs.filter(F.isnan("frob_gradient_mean")).isEmpty() and runs.filter("frob_gradient_mean is not null").isEmpty()
    main(["audit", str(tmp_path / "audit"), str(tmp_path / "runs")])
    assert spark.read.json(str(tmp_path / "audit" / "stats")).count() == 127
    (tmp_path / "pool.yaml").write_text("excluded: {gammas: [GAM-009]}\n")
    (tmp_path / "scope.yaml").write_text("scope: {rank_eff: 2, run_status: [OK, COLLAPSED]}\n")
    main(["verdict", str(tmp_path / "verdict"), str(tmp_path / "runs"), "--pool", str(tmp_path / "pool.yaml"), "--cfg", str(tmp_path / "scope.yaml"), "--plot", "--verbose"])
    found = json.loads((tmp_path / "verdict" / "verdict.json").read_text())
    # Runs that differ in parameters alone are one run by the default keys.
    assert set(found["strata"]) <= {"rank2_diff"} and "n_clusters" in found
    assert (tmp_path / "verdict" / "verdict.txt").exists()
    for name, s in found["strata"].items():
        points = spark.read.parquet(str(tmp_path / "verdict" / "plots" / name / "points"))
        heat = spark.read.parquet(str(tmp_path / "verdict" / "plots" / name / "signature"))
        assert points.count() == s["n_runs"] and heat.select("cluster").distinct().count() == len(s["clusters"])
        assert all(set(p) >= {"clusters", "regimes", "statuses"} for ps in s["profiles"].values() for p in ps)
    main(["dump", str(tmp_path / "dump"), str(tmp_path / "runs"), "--sample", "3"])
    stats = json.loads((tmp_path / "dump" / "stats.json").read_text())
    # 28 runs, 14 of which differ from another in parameters alone.
    assert stats["n_observations"] == spark.read.json(str(tmp_path / "audit" / "manifest")).agg(F.sum("n")).first()[0] and len(stats["feature_stats"]) == 127
    assert spark.read.json(str(tmp_path / "dump" / "rows")).count() == 3
    manifest = spark.read.json(str(tmp_path / "audit" / "manifest")).filter("NOT missing")
    assert all(sum(v for v in r["statuses"].asDict().values() if v) == r["n"] for r in manifest.collect())


def test_first_run_by_file(spark, tmp_path):
    """Conflicting copies of a run in two tables, one of several files: the first by path, then file, then row stays."""
    schema = "gamma_id string, encoding_id string, phase string, v double"
    spark.createDataFrame([("g1", "e", "b", 1.0), ("g2", "e", "b", 2.0), ("g1", "e", "b", 3.0)], schema).coalesce(1).write.parquet(str(tmp_path / "z"))
    spark.createDataFrame([("g1", "e", "a", 4.0), ("g3", "e", "a", 5.0)], schema).coalesce(1).write.parquet(str(tmp_path / "a"))
    for paths, expected in ((("z", "a"), {"g1": 1.0, "g2": 2.0, "g3": 5.0}), (("a", "z"), {"g1": 4.0, "g2": 2.0, "g3": 5.0})):
        made = workflows.pool(spark, [str(tmp_path / p) for p in paths], {}, {})
        assert {r["gamma_id"]: r["v"] for r in made.collect()} == expected and made.columns == sorted(schema.replace(" string", "").replace(" double", "").split(", "))


def test_analysis_settings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("scope: {modifiers: [M0], seeds: one}\northogonalization: {protected_features: [x], correlation_threshold: 0.9}\npeeling: {max_levels: 2, level_0: {metric: euclidean, selection: leaf}}\noutliers: {contamination: 0.2}\n")
    made = configs.load_analysis(str(tmp_path / "a.yaml"), spark)
    assert made["scope"] == {"modifier_id": ["M0"], "seeds": "one"} and made["protected"] == ("x",) and made["correlation"] == 0.9 and made["outliers"] == 0.2
    assert made["peeling"] == {"levels": 2, "first": (("euclidean", "leaf", None),)} and configs.load_analysis(None)["correlation"] == 0.98


def test_json_dump(spark, tmp_path):
    df = spark.createDataFrame([(f"g{i}", float(i) if i else float("nan"), float("inf")) for i in range(9)], "gamma_id string, a double, b double")
    reports.dump(df, str(tmp_path / "all"), ["gamma_id"], ["a", "b"])
    rows = [json.loads(line) for p in sorted((tmp_path / "all").glob("*.json")) for line in p.read_text().splitlines()]
    assert len(rows) == 9 and {r["features"]["b"] for r in rows} == {"inf"} and sum("a" not in r["features"] for r in rows) == 1
    for out in ("x", "y"):
        reports.dump(df, str(tmp_path / out), ["gamma_id"], ["a"], sample=4)
    read = lambda out: sorted(p.read_text() for p in (tmp_path / out).glob("*.json") if p.read_text())
    assert sorted("".join(read("x")).splitlines()) == sorted("".join(read("y")).splitlines()) and len("".join(read("x")).splitlines()) == 4


def test_windows_of_event_time(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, if(id % 2 = 0, 'a', 'b') AS event_type FROM range(30)").write.parquet(str(tmp_path / "in"))
    stream = live.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = live.timed_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("timed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("timed").collect()) == [5] * 6
