"""Quantiles, segments, likeness and comparisons of runs against brute force, optima and edge cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import comparison, matrix, quantiles, segments, similarity, summaries


# Quantiles


@pytest.mark.parametrize("gathered", [4096, 3])
def test_quantiles_of_hard_values(spark, monkeypatch, gathered):
    """Many magnitudes, ties, infinities, NaN and nulls; also with hardly any values gathered, so that ranges narrow to the end."""
    monkeypatch.setattr(quantiles, "GATHERED", gathered)
    rng = np.random.default_rng(0)
    groups = {
        "even": rng.random(3000),
        "magnitudes": np.concatenate([10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 200)), np.zeros(20)]),
        "ties": rng.integers(0, 3, 900).astype(float),
        "one": np.array([3.0]),
        "tiny": np.array([0.0, 5e-324, 1e-323]),
        "ends": np.array([-1.7e308, 1.7e308, 0.0, 1.0]),
        None: np.array([1.0, 4.0]),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("none", math.nan), ("even", None), ("even", math.nan), ("wide", -math.inf), ("wide", 1.0), ("wide", 2.0), ("wide", math.inf), ("wide", math.inf)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in quantiles.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {*groups, "wide"} and got["wide"] == [-math.inf, 1.0, 2.0, math.inf, math.inf]
    for g, x in groups.items():
        expected = np.quantile(x / 2, shares) * 2 if g == "ends" else np.quantile(x, shares)
        assert np.allclose(got[g], expected, rtol=1e-9, atol=1e-322), g
    assert quantiles.quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_quantiles_of_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", 4)
    monkeypatch.setattr(quantiles, "GATHERED", 8)
    df = spark.range(3000).select((F.col("id") % 30).alias("g"), ((F.col("id") * 7919) % 3001).cast("double").alias("v"))
    expected = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect()}
    got = {r["g"]: r["q"] for r in quantiles.quantiles(df, ["g"], "v", [0.25, 0.5]).collect()}
    assert all(np.allclose(got[g], q) for g, q in expected.items()) and len(got) == 30


def test_statistics_with_infinities_text_and_nulls(spark):
    rows = [(1.0, "2"), (math.inf, "x"), (math.nan, None), (None, "4"), (3.0, "inf")]
    df = spark.createDataFrame(rows, "a double, b string")
    got = {r["feature"]: r for r in summaries.column_stats(df, ["a", "b"]).collect()}
    assert (got["a"]["n_valid"], got["a"]["n_nan"], got["a"]["n_inf"], got["a"]["median"], got["a"]["max"]) == (3, 2, 1, 2.0, 3.0)
    assert (got["b"]["n_valid"], got["b"]["n_nan"], got["b"]["median"]) == (3, 2, 3.0)
    scaled = matrix.robust_scale(matrix.impute(df.select("a", F.lit(None).cast("double").alias("empty")).filter("a IS NULL OR a < 10"), ["a", "empty"]), ["a", "empty"]).collect()
    assert [r["empty"] for r in scaled] == [0.0] * 3 and sorted(r["a"] for r in scaled) == [-1.0, 0.0, 1.0]


# Segments


def obs_of(spark, runs):
    return spark.createDataFrame([(k, t, None if v is None or math.isnan(v) else float(v)) for k, x in runs.items() for t, v in enumerate(x)], "run string, t int, v double").repartition(3)


def test_hidden_states_by_enumeration():
    """Forward-backward counts and the Viterbi path against sums over all paths."""
    rng = np.random.default_rng(3)
    model = segments.Model(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([0.0, 2.0]), np.array([1.0, 0.5]))
    rows = [rng.normal(size=5), np.array([0.1, math.nan, 2.2]), np.array([1.5])]
    total, fit = np.zeros(2 + 4 + 6), 0.0
    for x in rows:
        b = np.exp(model.densities(x[None])[0])
        weights = {}
        for path in itertools.product((0, 1), repeat=len(x)):
            w = model.start[path[0]] * b[0, path[0]]
            for t in range(1, len(x)):
                w *= model.move[path[t - 1], path[t]] * b[t, path[t]]
            weights[path] = w
        whole = sum(weights.values())
        fit += math.log(whole)
        for path, w in weights.items():
            total[path[0]] += w / whole
            for t, s in enumerate(path):
                if t:
                    total[2 + 2 * path[t - 1] + s] += w / whole
                if not math.isnan(x[t]):
                    total[[6 + s, 8 + s, 10 + s]] += np.array([1, x[t], x[t] ** 2]) * w / whole
        ((_, side, lengths),) = segments.padded([x], 2)
        assert tuple(segments.likeliest(model, side, lengths)[0]) == max(weights, key=weights.get)
    counts = sum(segments.expected(model, x, n) for _, x, n in segments.padded(rows, 2))
    assert np.allclose(counts, [*total, fit])


def test_planted_states_come_back(spark):
    rng = np.random.default_rng(5)
    truth, runs = {}, {}
    for k in range(12):
        states = np.repeat(rng.permutation(np.arange(9) % 3), rng.integers(8, 20, 9))
        truth[f"r{k}"], runs[f"r{k}"] = states, np.array([-4.0, 0.0, 5.0])[states] + rng.normal(size=len(states))
    runs["r0"][4] = math.nan
    obs = obs_of(spark, runs | {"gone": [None, None]})
    fitted = segments.series(obs, ["run"]).cache()
    model, fits = segments.fit_states(fitted, 3)
    assert np.allclose(model.mean, [-4, 0, 5], atol=0.3) and all(b >= a - 1e-6 for a, b in itertools.pairwise(fits)) and len(fits) > 2
    right = total = 0
    for r in segments.state_segments(obs, ["run"]).collect():
        if r["run"] in truth:
            mine = truth[r["run"]][r["t_first"] : r["t_last"] + 1]
            right, total = right + int((mine == r["state"]).sum()), total + len(mine)
    assert total == sum(map(len, truth.values())) and right > 0.98 * total
    assert segments.state_segments(obs.limit(0), ["run"]).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 40):
        for penalty in (0.1, 2.0, 20.0):
            x = rng.normal(size=n) + np.repeat(rng.normal(size=n // 8 + 1) * 4, 8)[:n]
            cost = lambda a, b, x=x: ((x[a:b] - x[a:b].mean()) ** 2).sum()
            best = [-penalty]
            for t in range(1, n + 1):
                best.append(min(best[s] + cost(s, t) + penalty for s in range(t)))
            edges = [0, *segments.optimal_cuts(x, penalty), n]
            assert math.isclose(sum(cost(a, b) for a, b in itertools.pairwise(edges)) + penalty * (len(edges) - 2), best[n], abs_tol=1e-9)


def test_level_changes(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=40), 6 + rng.normal(size=25), -3 + rng.normal(size=50)])
    obs = obs_of(spark, {"jumps": [*x[:50], None, *x[50:]], "flat": [2.0] * 30, "one": [1.0], "none": [None]})
    got = sorted((r["run"], r["t_first"], r["t_last"]) for r in segments.level_changes(obs, ["run"]).collect())
    assert got == [("flat", 0, 29), ("jumps", 0, 39), ("jumps", 40, 65), ("jumps", 66, 115), ("one", 0, 0)]


# Likeness


@pytest.mark.parametrize("block", [256, 5])
def test_profile_against_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "DIAGONALS", block)
    rng = np.random.default_rng(11)
    runs = {"a": rng.normal(size=70), "flat": np.concatenate([np.ones(30), rng.normal(size=20), np.full(15, 3.0)]), "short": rng.normal(size=14), "big": rng.normal(size=40) + 1e6}
    runs["a"][50:58] = runs["a"][10:18] * 3 + 1
    got = {(r["run"], r["i"]): (r["j"], r["distance"]) for r in similarity.matrix_profile(obs_of(spark, runs), ["run"], 8).collect()}
    m = 8
    for k, x in runs.items():
        n = len(x) - m + 1
        z = []
        for i in range(n):
            w = x[i : i + m]
            z.append(None if w.std() < 1e-9 else (w - w.mean()) / w.std())
        for i in range(n):
            options = {j: (0.0 if z[i] is None and z[j] is None else math.sqrt(m) if z[i] is None or z[j] is None else float(np.linalg.norm(z[i] - z[j]))) for j in range(n) if abs(i - j) >= m}
            if not options:
                assert (k, i) not in got
                continue
            j, d = got[k, i]
            assert math.isclose(d, min(options.values()), abs_tol=1e-3 if k == "big" else 1e-5) and math.isclose(options[j], d, abs_tol=1e-3 if k == "big" else 1e-5)
    found = {r["run"]: (r["i"], r["j"]) for r in similarity.motifs(similarity.matrix_profile(obs_of(spark, runs), ["run"], 8), ["run"]).collect()}
    assert found["a"] == (10, 50)


def test_nearest_runs_against_all_distances(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 8)
    rng = np.random.default_rng(13)
    base = [np.cumsum(rng.normal(size=60)) for _ in range(12)]
    runs = {f"r{k:03d}": np.interp(np.linspace(0, 59, int(rng.integers(40, 80))), np.arange(60), base[k % 12]) + rng.normal(size=1) + rng.normal(size=1)[0] * 0 for k in range(120)}
    runs = {k: x + rng.normal(size=len(x)) * 0.3 for k, x in runs.items()} | {"flat": np.ones(30)}

    def full(a, b, band=6):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(max(0, i - band), min(len(b), i + band + 1)):
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return math.sqrt(d[-1, -1])

    shaped = {k: similarity.shaped(x, 64) for k, x in runs.items()}
    asked = ["r000", "r050", "flat"]
    for block in (1 << 20, 64):
        monkeypatch.setattr(similarity, "QUERY_VALUES", block)
        got = similarity.nearest_runs(obs_of(spark, runs), "run", F.col("run").isin(asked), k=4).collect()
        for q in asked:
            best = sorted((full(shaped[q], x), k) for k, x in shaped.items() if k != q)[:4]
            mine = sorted((r["rank"], r["run"], r["distance"]) for r in got if r["query"] == q)
            assert [m[1] for m in mine] == [b[1] for b in best] and np.allclose([m[2] for m in mine], [b[0] for b in best])
        assert all(r["n_runs"] == 120 for r in got) and all(r["n_warped"] < 90 for r in got if r["query"] != "flat")
    a, b = shaped["r000"], np.stack(list(shaped.values()))
    assert (similarity.lower_bounds(a, b, 6) <= similarity.warped(a, b, 6) + 1e-9).all()


# Comparisons


def test_cousins_against_pairs(spark):
    rng = np.random.default_rng(17)
    rows = [(i, f"g{int(rng.zipf(1.5)) % 4}", None if rng.random() < 0.1 else int(rng.integers(0, 3)), int(rng.integers(0, 2)), ["OK", "EXPLOSION", None][int(rng.integers(0, 3))], None if rng.random() < 0.1 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id int, gamma string, n int, rank int, status string, v double").repartition(4)
    got = {(r["run_id"], r["axis"]): r for r in comparison.cousins(df, "run_id", ["gamma", "n", "rank"], F.col("status") == "OK", "v").collect()}
    failed = [r for r in rows if r[4] != "OK"]
    assert len(got) == 3 * len(failed)
    for r in failed:
        for at, axis in enumerate(("gamma", "n", "rank"), 1):
            others = [h for h in rows if h[4] == "OK" and all((h[b] == r[b]) == (b != at) for b in (1, 2, 3))]
            values, mine = [h[5] for h in others if h[5] is not None], got[r[0], axis]
            assert mine["n_cousins"] == len(others)
            for name, value in (("cousin_mean", float(np.mean(values)) if values else None), ("cousin_min", min(values, default=None)), ("cousin_max", max(values, default=None)), ("gap", r[5] - float(np.mean(values)) if values and r[5] is not None else None)):
                assert mine[name] is None if value is None else math.isclose(mine[name], value, abs_tol=1e-9), name


def test_matching_against_permutations():
    rng = np.random.default_rng(19)
    for _ in range(60):
        rows, columns = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        gain = rng.integers(0, 6, (rows, columns))
        found = comparison.assigned(gain)
        wide = gain if rows <= columns else gain.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        used = [(i, j) for i, j in enumerate(found) if j >= 0]
        assert sum(gain[i, j] for i, j in used) == best and len({j for _, j in used}) == len(used) == min(rows, columns)


def test_concordance(spark):
    """Labels renamed between the phases agree fully; a moved entity drifts; few observations are warned of."""
    first = [(k, k % 3, k % 3) for k in range(30)] + [(100, 7, 1), (None, 0, 1), (31, 0, None)]
    second = [(k, k % 3, (k % 3 + 1) % 3 + 10) for k in range(30)] + [(100, 7, 10), (200, 0, 11)]
    a, b = (spark.createDataFrame(x, "key int, entity int, label int") for x in (first, second))
    made = comparison.concordance(a, b, ["key"], "entity", "label")
    assert made["warning"] is None and {(r["a"], r["b"]) for r in made["matches"].collect()} == {(0, 11), (1, 12), (2, 10)}
    assert {r["entity"]: r["drifted"] for r in made["drifts"].collect()} == {0: False, 1: False, 2: False, 7: True}
    whole = comparison.concordance(a.filter("key < 30"), b, ["key"], "entity", "label")["summary"].first()
    assert whole["adjusted_rand"] == 1.0 and whole["n"] == 30 and whole["reliable"]
    few = comparison.concordance(a.filter("key < 6"), b, ["key"], "entity", "label")
    assert "6 common" in few["warning"] and not few["summary"].first()["reliable"]
    none = comparison.concordance(a.limit(0), b, ["key"], "entity", "label")
    assert none["warning"] and none["matches"].count() == 0 and none["drifts"].count() == 0 and none["summary"].first()["n"] == 0


def test_monotone_rates_are_nearest():
    """Pooling against the min-max form of isotonic regression."""
    rng = np.random.default_rng(23)
    for n in (1, 2, 5, 12):
        rate, weight = rng.random(n).round(1), rng.integers(1, 5, n)
        mean = lambda a, b, r=rate, w=weight: float((r[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum())
        best = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(comparison.monotone(rate, weight), best)


def test_frontiers(spark):
    rows = [("g", n, 0.5, n < 40) for n in range(10, 80, 10) for _ in range(20)] + [("g", 90, None, None), ("h", 10, 1.0, True), (None, 10, 2.0, False)]
    df = spark.createDataFrame(rows, "gamma string, n_dof int, rate double, ok boolean")
    got = {(r["gamma"], r["parameter"]): r for r in comparison.frontiers(df, "gamma", ["n_dof", "rate"], F.col("ok")).collect()}
    g = got["g", "n_dof"]
    assert (g["direction"], g["threshold"], g["most"], g["least"], g["n"], g["n_values"]) == ("down", 40.0, 1.0, 0.0, 141, 8)
    assert got["h", "n_dof"]["threshold"] is None and got[None, "rate"]["n"] == 1
    assert comparison.frontiers(df.limit(0), "gamma", ["n_dof"], F.col("ok")).count() == 0


def test_warping_drops_only_what_is_too_far():
    """Warped together in single precision: every series within the bound stays, and what a far bound lets pass is little."""
    rng = np.random.default_rng(29)
    rows = np.stack([similarity.shaped(rng.normal(size=70) + (np.sin(np.arange(70) / 5) * 2 if k % 3 else 0), 64) for k in range(300)])
    columns = np.ascontiguousarray(rows.T, np.float32)
    for q in (0, 1, 7):
        d = similarity.warped(rows[q], rows, 6)
        for most in (0.0, *np.quantile(d, [0.01, 0.1, 0.5, 1.0]), np.inf):
            near = np.flatnonzero(d <= most)
            got, roughly = similarity.warped_within(rows[q], columns, 6, most)
            assert set(near) <= set(got) and (d[got] <= most + 0.1).all() and (d[got] <= similarity.widened(roughly)).all()
        assert np.allclose(similarity.lower_bounds_of(rows[q], columns, 6), similarity.lower_bounds(rows[q], rows, 6), atol=1e-5)
        assert (d <= similarity.upper_bounds(rows[q : q + 1], rows)[0] + 1e-6).all()


def test_bounds_of_all_runs_reach_every_task(spark):
    """Copies of a run in other tasks bound the search in each: hardly any other run is warped (without the shared bound each task warped its nearest ones)."""
    rng = np.random.default_rng(31)
    base = {f"b{k:03d}": np.cumsum(rng.normal(size=60)) for k in range(160)}
    runs = base | {f"c{c}": base["b000"] for c in range(3)}
    got = similarity.nearest_runs(obs_of(spark, runs), "run", F.col("run") == "b000").collect()
    assert sorted((r["rank"], r["run"]) for r in got) == [(1, "c0"), (2, "c1"), (3, "c2")] and all(r["distance"] == 0 and r["n_runs"] == 162 and r["n_warped"] < 10 for r in got)
