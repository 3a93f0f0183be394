import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import clustering, features, matrix, naming, ordered, relational, summaries
from orbitlake.plans import extensions, workflows
from orbitlake.sources import configs, reports


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(i, f"GAM-00{i % 3 + 1}", f"SYM-00{i % 2 + 1}", "M0", 10 * (i % 4 + 1), 5, i % 5, 0, ("OK", "EXPLOSION", "OK_TRUNCATED", "COLLAPSED")[i % 4]) for i in range(40)]
    return spark.createDataFrame(rows, "run_id int, gamma_id string, encoding_id string, modifier_id string, n_dof int, max_it int, seed_CI int, seed_run int, run_status string")


def test_filters(spark, runs):
    assert relational.scope_filter(runs, {"run_status": "all", "n_dof": None}).count() == 40
    assert relational.scope_filter(runs, {"n_dof": 10}).count() == 10
    assert relational.scope_filter(runs, {"seeds": "one"}).count() == 6
    assert relational.exclude_ids(runs, {"gamma_id": ["GAM-001"], "encoding_id": []}).filter("gamma_id = 'GAM-001'").isEmpty()
    nulls = spark.createDataFrame([(None,), ("a",), ("b",)], "id string")
    assert relational.exclude_ids(nulls, {"id": ["a"]}).count() == 2
    good, bad = relational.triage(runs)
    assert (good.count(), bad.count()) == (20, 20)


def test_dedup_and_union(spark, runs):
    twice = runs.union(runs)
    assert relational.dedup_runs(twice, order=[F.col("run_id")]).count() == relational.dedup_runs(runs, order=[F.col("run_id")]).count()
    both = relational.union_common([runs, runs.drop("max_it").withColumn("extra", F.lit(1))])
    assert "max_it" not in both.columns and "extra" not in both.columns and both.count() == 80


def test_joins(spark, runs):
    names = spark.createDataFrame([("GAM-001", "one")], "gamma_id string, name string")
    got = {r["name"] for r in relational.lookup(runs, names, "gamma_id", "name").select("name").collect()}
    assert got == {"one", "?"}
    with pytest.raises(Exception, match="unknown gamma_id"):
        relational.strict_lookup(runs, names, "gamma_id").collect()
    cells = relational.grid(runs.filter("run_id < 2"), "gamma_id", "encoding_id").collect()
    assert sorted(r["n"] for r in cells) == [0, 0, 1, 1] and sum(r["missing"] for r in cells) == 2
    empty = relational.overlap(runs, F.lit(False), F.lit(False)).first()
    assert empty["jaccard"] == 1.0


def test_coherence(spark):
    df = spark.createDataFrame([(0, "a")] * 8 + [(0, "b")] * 2 + [(1, "a"), (1, "b"), (2, "z")], "g int, item string")
    rows = {r["g"]: r for r in summaries.coherence(df, "g", "item").collect()}
    assert rows[0]["is_pure"] and rows[0]["entropy"] == pytest.approx(-(0.8 * np.log2(0.8) + 0.2 * np.log2(0.2)))
    assert rows[1]["entropy"] == pytest.approx(1) and rows[1]["dominant"] == "a" and rows[2]["entropy"] == 0


def test_matrix(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    rows = [(i, float(a[i]), float(a[i] * 2 + 1e-9), None if i % 4 == 0 else float(rng.normal() * 5), 7.0, float(10 ** rng.uniform(-4, 6))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, twin double, gaps double, flat double, wide double")
    made, kept = matrix.matrix(df, ["a", "twin", "gaps", "flat", "wide"], protected=("a",))
    assert "a" in kept and "twin" not in kept and "flat" not in kept and "gaps" in kept
    x = made.toPandas()
    assert x["a"].median() == pytest.approx(0, abs=1e-12) and x["a"].quantile(0.75) - x["a"].quantile(0.25) == pytest.approx(1)
    assert not x["gaps"].isna().any()


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 10)])
    labels, strength = clustering.hdbscan(x, 10, 4)
    assert sorted(np.bincount(labels[labels >= 0])) == pytest.approx([60, 60, 60], abs=6) and strength.max() <= 1
    assert clustering.hdbscan(x[:2], 10, 4)[0].tolist() == [-1, -1]
    df = spark.createDataFrame([(i, "s", *map(float, r)) for i, r in enumerate(x)], "id int, strate string, a double, b double, c double")
    got = clustering.peel_strata(df, "strate", ["a", "b", "c"], "id").toPandas()
    assert len(got) == 180 and got.label.nunique() >= 3
    far = clustering.outliers_of_strata(df.union(spark.createDataFrame([(999, "s", 80.0, 80.0, 80.0)], df.schema)), "strate", ["a", "b", "c"], "id").toPandas()
    assert far.set_index("id").is_outlier[999]
    assert np.isfinite(clustering.tsne(x[:40], 30)).all()


def test_cohesion_by_hand():
    labels, x = np.array([0, 0, 0]), np.array([[0.0], [1.0], [2.0]])
    assert clustering.homogeneity(x, labels, np.ones(3), 0) == pytest.approx(0.8125)
    x, labels = np.array([[0.0], [1.0], [10.0], [12.0], [50.0]]), np.array([0, 0, 1, 1, -1])
    # a and b of the four rows: 1, 11; 1, 10; 2, 9.5; 2, 11.5 -> silhouettes (b - a) / b
    s = np.mean([10 / 11, 9 / 10, 7.5 / 9.5, 9.5 / 11.5])
    assert clustering.silhouette(x, np.array([0, 1]), np.array([2, 3])) == pytest.approx(s)
    assert clustering.homogeneity(x, labels, np.array([0.5, 1, 1, 1, 0]), 0) == pytest.approx((0.5 * 0.75 + 0.3 * (s + 1) / 2) / 0.8)


def test_retries_keep_what_they_took_out():
    rng = np.random.default_rng(3)
    big = [rng.normal(0, 0.05, (150, 3)) + np.eye(3)[k] * 5 for k in range(2)]
    small = [rng.normal(0, 0.02, (12, 3)) + np.array(c) for c in ([-5.0, 5, 1], [5.0, -5, 1], [5.0, 1, -5], [-5.0, -5, 5])]
    made = clustering.peel(np.concatenate([*big, *small, rng.normal(0, 3, (140, 3))]))
    assert made.label[:150].mode()[0] >= 0 and made.label[150:300].mode()[0] >= 0 and made.label[0] != made.label[200]
    assert sorted(set(made.label) - {-1}) == list(range(made.label.max() + 1))


def test_distances_by_block_are_those_of_the_matrix():
    x = np.random.default_rng(1).normal(size=(700, 4))
    for metric in ("euclidean", "cosine"):
        space = clustering.Space(x, metric)
        d = np.stack([space.of(slice(i, i + 1))[0] for i in range(700)])
        assert np.allclose(clustering.core_distances(space, 5), np.sort(d, axis=1)[:, 5])
        tree = clustering.spanning_tree(space, np.zeros(700))
        assert len(tree) == 699 and (np.diff(tree[:, 2]) >= 0).all()
        inside, best = {0}, 0.0  # the same weight as growing the tree by the nearest row
        near = d[0].copy()
        for _ in range(699):
            near[list(inside)] = np.inf
            k = int(near.argmin())
            best += near[k]
            inside.add(k)
            near = np.minimum(near, d[k])
        assert tree[:, 2].sum() == pytest.approx(best)


def test_universality_asks_for_other_entities(spark):
    rows = [("g1", 0, "e1")] * 9 + [("g1", 1, "e2")] + [("g2", 0, f"e{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "gamma string, label int, encoding string")
    assert {r["gamma"] for r in summaries.universality(df, "label", "gamma").collect()} == {"g1", "g2"}
    assert {r["gamma"] for r in summaries.universality(df, "label", "gamma", enforce_min=3, other="encoding").collect()} == {"g2"}


def test_interpretation():
    slots = {"RNK": ("RNK-", 1), "ENT": ("ENT-", 1), "DMD": ("DMD<1", 1), "AMP": ("AMP~0", 1)}
    assert naming.interpret(slots, "FLAT", 0.0) == {"information": ["effective rank shrinks", "entropy shrinks"], "action": ["damped modes", "size is kept"], "emergence": ["candidate attractor"], "onset": ["candidate for a holographic attractor"]}
    assert naming.interpret({"CND": ("CND!", 1)}, None, 0.75) == {"emergence": ["75% truncated, often unstable"], "onset": ["numerically unsound, not to be judged"]}


def test_ranks_without_pairs(spark):
    rng = np.random.default_rng(2)
    values = [("a", float(v)) for v in rng.integers(0, 20, 300)] + [("b", float(v)) for v in rng.normal(size=50)] + [("a", None)]
    places = [("a", 1, 5.0), ("a", 2, 19.0), ("a", 3, -1.0), ("a", 4, None), ("b", 1, 0.0), ("b", 2, 0.0), ("c", 1, 1.0)]
    got = {(r["feature"], r["k"]): r["rank"] for r in summaries.ranks(spark.createDataFrame(values, "feature string, v double"), spark.createDataFrame(places, "feature string, k int, x double")).collect()}
    share = lambda f, x: np.mean([v <= x for g, v in values if g == f and v is not None])
    assert got == {(f, k): None if f == "c" else 0.0 if x is None else pytest.approx(share(f, x)) for f, k, x in places}


def test_names():
    c = naming.Cluster({"ps_norm_ratio": 5.0, "f2_von_neumann_entropy_delta": -0.2, "f7_dmd_spectral_radius": 0.5}, {"ps_norm_ratio": 0.9, "f2_von_neumann_entropy_delta": 0.1, "f7_dmd_spectral_radius": 0.2})
    assert naming.name(c)["name"] == "AMP++·ENT-·DMD<1"
    assert naming.name(naming.Cluster({}, {}))["name"] == "UNCATEGORIZED"
    assert naming.name(naming.Cluster({"health_has_inf": 0.5}, {"health_has_inf": 0.95}))["name"] == "CND!·AMP>>"


def test_verdict_and_audit(spark):
    from orbitlake.functions import atomics

    rng = np.random.default_rng(5)
    rows = [(i, "GAM-001" if i % 2 else "GAM-004", "SYM-001", 2, "OK" if i < 110 else "EXPLOSION", "FLAT" if i % 2 else "MIXED", float(rng.normal(8 * (i % 2))), float(rng.normal(8 * (i % 2))), float(rng.normal())) for i in range(120)]
    runs = spark.createDataFrame(rows, "run_id long, gamma_id string, encoding_id string, rank_eff int, run_status string, p1_regime_class string, frob_mean double, frob_final double, f4_trace_J_mean double")
    known = spark.createDataFrame(atomics.metadata(), atomics.METADATA_SCHEMA).filter("kind = 'gamma'")
    found = workflows.verdict(runs, known)
    assert found["strata"]["rank2_diff"]["n_runs"] == 110 and found["n_clusters"] >= 2
    assert found["pathological"]["EXPLOSION"]["n"] == 10 and found["pathological"]["COLLAPSED"] == {"n": 0, "gamma_id": [], "encoding_id": []}
    assert sum(r["count"] for r in found["pathological"]["EXPLOSION"]["gamma_id"]) == 10 and found["pathological"]["EXPLOSION"]["encoding_id"] == [{"encoding_id": "SYM-001", "count": 10, "total": 10, "fraction": 1.0}]
    one = found["strata"]["rank2_diff"]
    assert {r["encoding_id"] for r in one["convergent"]} <= {"SYM-001"} and {p["gamma_id"]: round(p["explosion_rate"] * 60) for p in one["profiles"]["gamma_id"]} == {"GAM-001": 5, "GAM-004": 5}
    json.dumps(reports.plain(found))
    assert "rank2_diff" in reports.text_report(found["strata"])
    made = workflows.audit(runs, ["frob_mean", "frob_final"])
    assert made["stats"].count() == 2 and made["anomalies"].isEmpty() and made["statuses"].count() == 2


def test_configs(tmp_path):
    (tmp_path / "pool.yaml").write_text("deprecated: {gammas: [GAM-001]}\nn_dof: {min: 5}\n")
    assert configs.load_pool(tmp_path / "pool.yaml") == {"excluded": {"gamma_id": ["GAM-001"]}, "n_dof": {"min": 5}}
    with pytest.warns(UserWarning):
        assert configs.load_pool(tmp_path / "none.yaml")["excluded"] == {}
    (tmp_path / "op.py").write_text("METADATA = {'id': 'X-1', 'rank': 2}\nraise RuntimeError\n")
    assert configs.discover(tmp_path) == {"X-1": {"id": "X-1", "rank": 2}}


def test_stream(spark, tmp_path):
    from orbitlake.streaming import live

    spark.range(10).selectExpr("if(id < 3, 'OK', 'EXPLOSION') run_status").write.parquet(str(tmp_path / "in"))
    stream = live.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    live.append(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    q = live.status_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["run_status"]: r["n"] for r in spark.table("counts").collect()} == {"OK": 3, "EXPLOSION": 7}


def test_places_in_a_hot_group(spark):
    """Half of all rows in one group, null keys, ties: places are gapless in the group's order, and no range of rows holds much more than its share."""
    rows = [("hot", int(i * 7919 % 5003), i) for i in range(5000)] + [(None if i % 3 == 0 else f"k{i % 40}", i % 17, 10_000 + i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(6)
    got = ordered.numbered(df, ["k"], ["o"]).collect()
    assert len(got) == len(rows) and {r["id"] for r in got} == {r[2] for r in rows}
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["place"], r["o"]))
    for places in by_key.values():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places))) and [o for _, o in places] == sorted(o for _, o in places)
    ranged = df.repartitionByRange(4, "k", "o").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 0.45 * len(rows)
    assert ordered.numbered(df.limit(0), ["k"], ["o"]).count() == 0


def test_maps_of_counts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), (None, "x")], "g string, s string")
    got = {r["g"]: r["m"] for r in summaries.count_map(df, ["g"], "s", "m").collect()}
    assert got == {"a": {"x": 2, "y": 1}, "b": {}, None: {"x": 1}}
    two = spark.createDataFrame([({"x": 2, "y": 1}, {"y": 3, "z": 4}), (None, {"z": 1}), (None, None)], "a map<string,bigint>, b map<string,bigint>")
    added = two.select(summaries.add_maps(F.col("a"), F.col("b")).alias("m"), summaries.shares(F.col("a")).alias("s"), summaries.map_text(F.col("b")).alias("t")).collect()
    assert [r["m"] for r in added] == [{"x": 2, "y": 4, "z": 4}, {"z": 1}, None] and added[0]["t"] == "y:3,z:4" and abs(added[0]["s"]["x"] - 2 / 3) < 1e-12


def test_runtime_nulls(spark):
    columns = "mask_n_transitions double, meta_n_svd double, p1_estimated_period double, mask_t_first_norm double, mask_mean_spacing_norm double, phasic_svn_n_reversals double, other double"
    df = spark.createDataFrame([(0.0, 0.0, None, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 4.0, 1.0, 1.0, 1.0, 1.0), (2.0, 2.0, float("nan"), 1.0, 1.0, 1.0, 1.0), (None, None, 3.0, 1.0, 1.0, 1.0, 1.0)], columns)
    got = [tuple(r)[2:] for r in features.runtime_null(df).collect()]
    assert got == [(None, None, None, None, 1.0), (4.0, 1.0, None, None, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (3.0, None, None, None, 1.0)]
    assert features.runtime_null(df.select("mask_t_first_norm")).columns == ["mask_t_first_norm"]


def test_cases_reach_every_status_and_regime(spark):
    path = "/root/testdata/sf0.01"
    found = extensions.regime_cases(spark, path).collect()
    assert {r["run_status"] for r in found} == {"OK", "OK_TRUNCATED", "EXPLOSION", "COLLAPSED"}
    assert {r["p1_regime_class"] for r in found} == {"FLAT", "OSCILLATING", "TRANSITIONAL", "EXPLOSIVE", "MIXED"}


def test_trees_of_blocks_are_those_of_all_rows(spark, monkeypatch):
    """Strata that no task holds: the same spanning trees, and clusters, as of all rows at once."""
    from orbitlake.operators import density

    monkeypatch.setattr(density, "ROWS", 64)
    monkeypatch.setattr(density, "TOGETHER", 2)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (n, 4)) for c, n in ((0, 130), (4, 90), (9, 70))] + [rng.uniform(-4, 12, (40, 4))])
    x[200] = x[10]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "place long, x array<double>").repartition(5)
    for metric in ("euclidean", "cosine"):
        space = clustering.Space(x, metric)
        core = clustering.core_distances(space, 5)
        got = density.spanning_tree(rows, len(x), 4, metric == "cosine", 5, clustering._turned(metric == "cosine", None, None)).first()
        tree = np.stack([np.frombuffer(got["a"], np.int64), np.frombuffer(got["b"], np.int64), np.frombuffer(got["w"])], axis=1)
        reach = np.maximum(space.of(slice(None)), np.maximum(core[:, None], core[None, :]))
        a, b = np.triu_indices(len(x), 1)
        whole = density.forest(a, b, reach[a, b])
        assert len(tree) == len(x) - 1 and np.allclose(tree[:, 2], clustering.spanning_tree(space, core)[:, 2]) and np.allclose(tree[:, 2], whole[2])
    mean, covariance = density.moments(rows, 4)
    assert np.allclose((x - mean) @ density.axes(covariance, 2).T, clustering.pca(x, 2))

    monkeypatch.setattr(clustering, "WHOLE", 100)
    both = np.concatenate([x, x[:60] + 50])
    df = spark.createDataFrame([("big" if i < len(x) else None, 1000 - i, *map(float, r)) for i, r in enumerate(both)], "strate string, id int, a double, b double, c double, d double").repartition(3)
    got = clustering.peel_strata(df, "strate", ["a", "b", "c", "d"], "id").toPandas().sort_values("id")
    assert len(got) == len(both) and got.id.is_unique
    for big, part in ((True, both[: len(x)]), (False, both[len(x) :])):
        mine, truth = got[(got.strate == "big") == big], clustering.peel(part[::-1])
        pairs = pd.crosstab(mine.label.to_numpy(), truth.label.to_numpy())
        assert pairs.max(axis=1).sum() > 0.97 * len(part) and pairs.max(axis=0).sum() > 0.97 * len(part)
        assert sorted(set(mine.label) - {-1}) == list(range(mine.label.max() + 1)) and (mine.level >= 0).equals(mine.label >= 0)


def test_attempts_on_the_same_rows_share_their_distances(spark, monkeypatch):
    """Nearest rows are looked for once while no cluster is taken out; trees of fewer of them, of far groups too, are those of all pairs."""
    from orbitlake.operators import density

    monkeypatch.setattr(density, "ROWS", 128)
    written = []
    monkeypatch.setattr(density, "materialised", lambda df, name, f=density.materialised: (written.append(name), f(df, name))[1])
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1, (n, 3)) for c, n in ((0, 180), (40, 90), (90, 60))])
    x[5:30] = x[4]  # copies
    rows = spark.createDataFrame([(i, i, r.tolist()) for i, r in enumerate(x)], "id long, place long, x array<double>").repartition(3)
    plan = clustering.Peeling(levels=1, base=2.0, most=2.0, first=(("euclidean", "leaf", None),))
    made = clustering._peel_large(rows, "id", len(x), 3, plan)
    assert made.count() == len(x) and made.filter("label >= 0").count() == 0
    assert written.count("blocks") == 1
    near = density.Near(rows, len(x), 3, False, 12, clustering._turned(False, None, None))
    space = clustering.Space(x)
    for k in (3, 12):
        tree = near.tree(k).first()
        a, b, w = np.frombuffer(tree["a"], np.int64), np.frombuffer(tree["b"], np.int64), np.frombuffer(tree["w"])
        core = clustering.core_distances(space, k)
        reach = np.maximum(np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1)), np.maximum(core[a], core[b]))
        assert len(w) == len(x) - 1 == len(density.forest(a, b, w)[0]) and np.allclose(w, reach, atol=1e-6) and np.allclose(w, clustering.spanning_tree(space, core)[:, 2], atol=1e-6)


def test_projection_of_drawn_rows(spark):
    """Only drawn rows reach a stratum's task, with the coordinates that they have by themselves; steps hold four matrices of their pairs at most."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([("big" if i < 70 else None, 500 - i, *map(float, r)) for i, r in enumerate(x)], "strate string, id int, a double, b double, c double, d double").repartition(4)
    made = clustering.project_strata(df, "strate", ["a", "b", "c", "d"], "id", most=40)
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.toPandas().sort_values("id").reset_index(drop=True)
    big, small = got[got.strate == "big"], got[got.strate.isna()]
    drawn = np.sort(np.random.RandomState(clustering.SEED).choice(70, 40, replace=False))
    assert len(big) == 70 and np.flatnonzero(big.x.notna()).tolist() == drawn.tolist()
    alone = lambda part: clustering.tsne(pd.DataFrame({c: part[:, i] for i, c in enumerate("abcd")}).sort_values("a").sort_index().to_numpy(float)[np.arange(len(part))])
    assert np.allclose(big[["x", "y"]].to_numpy(float)[drawn], alone(x[:70][::-1][drawn]))
    assert np.allclose(small[["x", "y"]].to_numpy(float), alone(x[70:][::-1]))
    n = 400
    tracemalloc.start()
    clustering.tsne(rng.normal(size=(n, 4)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.5 * n * n * 8


def test_large_strata_are_projected_whole(spark, monkeypatch):
    """Every row of a stratum that no task holds has coordinates, near rows near; forces are those of all pairs."""
    from orbitlake.operators import density, embedding

    rng = np.random.default_rng(6)
    z = rng.normal(size=(400, 2)) * 12
    d = z[:, None] - z[None]
    q = 1 / (1 + (d * d).sum(axis=2))
    np.fill_diagonal(q, 0)
    force, total = embedding.push(z)
    whole = ((q * q)[:, :, None] * d).sum(axis=1)
    assert total == pytest.approx(q.sum(), rel=1e-3) and np.abs(force - whole).max() < 0.05 * np.abs(whole).max()
    p = embedding.affinities((rng.normal(size=(50, 30)) * np.logspace(-3, 3, 50)[:, None]) ** 2, np.log(6))
    assert np.allclose(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1), np.log(6), atol=1e-4)

    monkeypatch.setattr(clustering, "TSNE_ROWS", 100)
    monkeypatch.setattr(density, "ROWS", 64)
    monkeypatch.setattr(embedding, "ROWS", 90)
    monkeypatch.setattr(embedding, "STEPS", 3)
    monkeypatch.setattr(embedding, "EARLY", 2)
    x = rng.normal(size=(240, 4)) + 6 * np.eye(4)[np.repeat([0, 1, 2], [100, 60, 80])]
    df = spark.createDataFrame([("big" if i < 240 else None, 900 - i, *map(float, r)) for i, r in enumerate(np.concatenate([x, x[:50] + 1]))], "strate string, id int, a double, b double, c double, d double").repartition(3)
    got = clustering.project_strata(df, "strate", ["a", "b", "c", "d"], "id").toPandas().sort_values("id")
    assert len(got) == 290 and got.id.is_unique and np.isfinite(got[["x", "y"]].to_numpy(float)).all()

    n, k = 240, 15  # the same steps with matrices of all pairs
    near = clustering.distances(clustering.pca(x[::-1], 4))
    np.fill_diagonal(near, -1)
    ids = np.argsort(near, axis=1)[:, 1 : k + 1]
    p = np.zeros((n, n))
    np.put_along_axis(p, ids, embedding.affinities(np.take_along_axis(near, ids, axis=1) ** 2, np.log(5)), axis=1)
    p = (p + p.T) / (2 * n)
    z = np.concatenate([np.random.default_rng([42, b]).standard_normal((m, 2)) for b, m in ((0, 90), (1, 90), (2, 60))]) * 1e-4
    speed = np.zeros_like(z)
    for i in range(3):
        d = z[:, None] - z[None]
        q = 1 / (1 + (d * d).sum(axis=2))
        np.fill_diagonal(q, 0)
        weight = ((12 if i < 2 else 1) * p - q / q.sum()) * q
        speed = (0.5 if i < 2 else 0.8) * speed - 50 * 4 * (weight[:, :, None] * d).sum(axis=1)
        z = z + speed
        z -= z.mean(axis=0)
    assert np.allclose(got[got.strate == "big"][["x", "y"]].to_numpy(float), z, rtol=1e-3, atol=1e-3 * np.abs(z).max())
