"""Density clustering, peeling, outliers and projections of a stratum's feature matrix.

These algorithms look at all rows of a stratum together, so each stratum is one
group of an Arrow function; strata run in parallel.  Distances are computed a
block of rows at a time, so memory grows with the rows of a stratum and not with
their square (time does).  Strata of more than WHOLE rows are peeled in jobs over
blocks of their rows (see :mod:`density`).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import cluster_size, core_size, level_threshold
from ..sources.shared import materialised
from . import density, embedding
from .ordered import numbered

#: Rows of a stratum that one task peels, and larger strata that are peeled at a time.
WHOLE, STRATA = 8192, 4

#: Rows whose distances to all others are computed at once.
BLOCK = 256
#: Rows of a stratum that one task projects by t-SNE (larger ones by jobs), rows that silhouettes are taken of, drawn with this seed.
TSNE_ROWS, SILHOUETTE_ROWS, SEED = 5000, 2000, 42
#: Rows whose forces are made at once.
TSNE_BLOCK = 16


class Space:
    """Distances between rows, without a matrix of all of them."""

    def __init__(self, x: np.ndarray, metric: str = "euclidean"):
        self.cosine = metric == "cosine"
        x = np.asarray(x, float)
        self.x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) if self.cosine else x
        self.square = np.sum(self.x * self.x, axis=1)

    def __len__(self) -> int:
        return len(self.x)

    def of(self, rows: np.ndarray | slice) -> np.ndarray:
        """Distances of ``rows`` to all rows."""
        products = self.x[rows] @ self.x.T
        if self.cosine:
            return np.clip(1 - products, 0, 2)
        return np.sqrt(np.maximum(self.square[rows][:, None] + self.square[None, :] - 2 * products, 0))


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    return Space(x, metric).of(slice(None))


def core_distances(space: Space, k: int) -> np.ndarray:
    """Distance of every row to its ``k``-th nearest other row."""
    n = len(space)
    k = min(k, n - 1)
    return np.concatenate([np.partition(space.of(slice(i, i + BLOCK)), k, axis=1)[:, k] for i in range(0, n, BLOCK)])


def spanning_tree(space: Space, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of the minimum spanning tree under mutual reachability, in order of weight (Prim's method, a row of distances at a time)."""
    n = len(space)
    out, done = np.zeros((n - 1, 3)), np.zeros(n, bool)
    near, source, at = np.full(n, np.inf), np.zeros(n, int), 0
    for i in range(n - 1):
        done[at] = True
        reach = np.maximum(np.maximum(space.of(slice(at, at + 1))[0], core), core[at])
        closer = ~done & (reach < near)
        near[closer], source[closer] = reach[closer], at
        at = int(np.argmin(np.where(done, np.inf, near)))
        out[i] = source[at], at, near[at]
    return out[np.argsort(out[:, 2], kind="stable")]


def condense(tree: np.ndarray, n: int, smallest: int) -> list[tuple[int, int, float, int]]:
    """The condensed tree: (parent, child, lambda, size); children below n are points, the root is n."""
    parent, size, children, height = list(range(2 * n - 1)), [1] * (2 * n - 1), {}, {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b, w) in enumerate(tree):
        x, y, new = find(int(a)), find(int(b)), n + k
        children[new], height[new], size[new] = (x, y), w, size[x] + size[y]
        parent[x] = parent[y] = new

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack.extend(children[i])
        return out

    out, label, stack = [], n + 1, [(2 * n - 2, n)]
    while stack:
        node, name = stack.pop()
        if node < n:
            continue
        level = 1 / height[node] if height[node] > 0 else np.inf
        big = [c for c in children[node] if size[c] >= smallest]
        for c in children[node]:
            if len(big) == 2:
                out.append((name, label, level, size[c]))
                stack.append((c, label))
                label += 1
            elif size[c] >= smallest:
                stack.append((c, name))
            else:
                out += [(name, p, level, 1) for p in leaves(c)]
    return out


def hdbscan(x: np.ndarray, smallest: int, core_neighbours: int, metric: str = "euclidean", selection: str = "eom") -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and membership strengths of hierarchical density clusters."""
    n = len(x)
    if n < max(smallest, 3):
        return np.full(n, -1), np.zeros(n)
    space = Space(x, metric)
    return clusters(spanning_tree(space, core_distances(space, core_neighbours)), n, smallest, selection)


def clusters(tree: np.ndarray, n: int, smallest: int, selection: str) -> tuple[np.ndarray, np.ndarray]:
    """Labels and strengths of the clusters that a spanning tree's condensed tree holds."""
    rows = condense(tree, n, smallest)
    born, kids, members = {n: 0.0}, {}, {}
    for p, c, level, _ in rows:
        (kids if c > n else members).setdefault(p, []).append((c, level))
        if c > n:
            born[c] = level
    weight = dict.fromkeys(born, 0.0)
    for p, _, level, many in rows:
        weight[p] += (min(level, 1e12) - min(born[p], 1e12)) * many
    chosen: set[int] = set()
    if selection == "leaf":
        chosen = {c for c in born if c not in kids and c != n}
    else:
        best: dict[int, float] = {}
        for c in sorted(born, reverse=True):
            below = sum(best[k] for k, _ in kids.get(c, []))
            if c != n and weight[c] >= below:
                best[c] = weight[c]
                chosen.add(c)
            else:
                best[c] = below
        for c in sorted(chosen):  # what lies inside a chosen cluster goes
            stack = [k for k, _ in kids.get(c, [])] if c in chosen else []
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += [j for j, _ in kids.get(k, [])]
    labels, strength = np.full(n, -1), np.zeros(n)
    for i, c in enumerate(sorted(chosen)):
        stack, found = [c], []
        while stack:
            k = stack.pop()
            found += members.get(k, [])
            stack += [j for j, _ in kids.get(k, [])]
        top = max((min(level, 1e12) for _, level in found), default=0.0)
        for p, level in found:
            labels[p], strength[p] = i, min(level, 1e12) / top if top > 0 else 1.0
    return labels, strength


def silhouette(x: np.ndarray, mine: np.ndarray, others: np.ndarray, most: int = SILHOUETTE_ROWS) -> float | None:
    """Mean silhouette, in [-1, 1], of two groups of rows against each other (of ``most`` of them, drawn with a fixed seed); None without two rows in each.

    A row alone in its group counts 0.
    """
    rows, group = drawn_rows(mine, others, most)
    return silhouette_of(x[rows], group)


def drawn_rows(mine: np.ndarray, others: np.ndarray, most: int = SILHOUETTE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a silhouette is taken of, and their group, 0 or 1; none without two rows in each."""
    rows, group = np.append(mine, others), np.repeat([0, 1], [len(mine), len(others)])
    if len(mine) < 2 or len(others) < 2:
        return rows[:0], group[:0]
    if len(rows) > most:
        drawn = np.random.RandomState(SEED).choice(len(rows), most, replace=False)
        rows, group = rows[drawn], group[drawn]
    return rows, group


def silhouette_of(x: np.ndarray, group: np.ndarray) -> float | None:
    sizes, rows = np.bincount(group, minlength=2), x
    if not sizes.all():
        return None
    d = distances(x)
    np.fill_diagonal(d, 0)
    sums = np.stack([d[:, group == k].sum(axis=1) for k in (0, 1)])
    at = np.arange(len(rows))
    a, b = sums[group, at] / np.maximum(sizes[group] - 1, 1), sums[1 - group, at] / sizes[1 - group]
    return float(np.where(sizes[group] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).mean())


def homogeneity(x: np.ndarray, labels: np.ndarray, strength: np.ndarray, label: int) -> float:
    """Cohesion of a cluster in [0, 1]: 5 parts its mean membership, 3 parts its silhouette against all other clusters, scaled to [0, 1] (0.5 if there are none)."""
    s = silhouette(x, np.flatnonzero(labels == label), np.flatnonzero((labels != label) & (labels != -1)))
    return cohesion(strength[labels == label].mean(), s)


def cohesion(member: float, s: float | None) -> float:
    return float(np.clip((0.5 * member + 0.3 * (0.5 if s is None else (s + 1) / 2)) / 0.8, 0, 1))


@dataclass(frozen=True)
class Peeling:
    """Levels, thresholds of cohesion and configurations (metric, selection, components) of the first and the later levels."""

    levels: int = 6
    base: float = 0.55
    step: float = 0.05
    most: float = 0.80
    retries: int = 3
    residual_share: float = 0.30
    least: int = 8
    first: tuple[tuple[str, str, int | None], ...] = (("cosine", "eom", None),)
    residual: tuple[tuple[str, str, int | None], ...] = (("cosine", "eom", None), ("euclidean", "leaf", 20), ("cosine", "leaf", None))


def _score(k: int, noise: float) -> float:
    return (3 if 3 <= k <= 10 else max(0.0, 3 - 0.5 * min(abs(k - 3), abs(k - 10)))) - 0.03 * noise


def _level(x: np.ndarray, level: int, smallest: int, plan: Peeling) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """Clusters extracted from rows (rows, cohesion) and the rows left, by the configuration with the best number of clusters and least noise."""
    best = None
    for metric, selection, dims in plan.residual if level else plan.first:
        safe = min(dims or 0, x.shape[1] - 1, len(x) - 1)
        seen = pca(x, safe) if dims and dims < x.shape[1] and safe >= 2 else x
        labels, strength = hdbscan(seen, smallest, core_size(smallest), metric, selection)
        score = _score(labels.max() + 1, float(np.mean(labels < 0)) * 100)
        if best is None or score > best[0]:
            best = (score, labels, strength, seen)
    _, labels, strength, seen = best
    least = level_threshold(level, plan.base, plan.step, plan.most)
    found = [(np.flatnonzero(labels == k), homogeneity(seen, labels, strength, k)) for k in range(labels.max() + 1)]
    kept = [(rows, h) for rows, h in found if h >= least]
    rest = np.setdiff1d(np.arange(len(x)), np.concatenate([r for r, _ in kept]) if kept else np.zeros(0, int))
    return kept, rest


def _spread(x: np.ndarray) -> float:
    return float(np.trace(np.atleast_2d(np.cov(x.T)))) + 1e-10


def _residual_size(whole: int, n: int, left: int, spread: float, spread_left: float) -> int:
    return int(whole * np.sqrt(left / n) / np.clip((left / spread_left) / (n / spread), 0.5, 2))


def peel(x: np.ndarray, plan: Peeling = Peeling()) -> pd.DataFrame:
    """Label, level and cohesion of every row: clusters are taken out level by level and the residual clustered again.

    While a level leaves too many rows, what is left is clustered at once with
    a smaller least size; what earlier attempts have taken out stays.  Labels
    are numbered in order of extraction.
    """
    n = len(x)
    out = pd.DataFrame({"label": np.full(n, -1), "level": np.full(n, -1), "homogeneity": np.zeros(n)})
    left, label, whole = np.arange(n), 0, cluster_size(n)
    for level in range(plan.levels):
        if len(left) < plan.least:
            break
        size = whole
        if level and len(left) < n:
            size = _residual_size(whole, n, len(left), _spread(x), _spread(x[left]))
        size, taken = max(plan.least, size), 0
        for attempt in range(plan.retries + 1):
            kept, rest = _level(x[left], level, size, plan)
            for rows, h in kept:
                out.loc[left[rows], ["label", "level", "homogeneity"]] = label, level, h
                label, taken = label + 1, taken + len(rows)
            left = left[rest]
            if len(left) / n <= plan.residual_share or size <= plan.least or len(left) < 2:
                break
            size = max(plan.least, size // 2)
        if not taken and level:
            break
    return out.astype({"label": int, "level": int})


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Anomaly scores in (0, 1] of an isolation forest; rows that are parted early score high."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    average = lambda m: 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1) if m > 2 else float(m == 2)
    depth = np.zeros(n)
    for _ in range(trees):
        stack = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while stack:
            own, all_rows, level = stack.pop()
            low, high = (x[own].min(axis=0), x[own].max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
            split = np.flatnonzero(high > low)
            if len(own) <= 1 or level >= np.ceil(np.log2(max(size, 2))) or not len(split):
                depth[all_rows] += level + average(len(own))
                continue
            f = rng.choice(split)
            cut = rng.uniform(low[f], high[f])
            stack.append((own[x[own, f] < cut], all_rows[x[all_rows, f] < cut], level + 1))
            stack.append((own[x[own, f] >= cut], all_rows[x[all_rows, f] >= cut], level + 1))
    return 2 ** (-(depth / trees) / max(average(size), 1e-12))


def outliers(x: np.ndarray, share: float = 0.10) -> tuple[np.ndarray, np.ndarray]:
    """Mask and scores: the given share of rows with the highest isolation scores; none among fewer than two rows."""
    if len(x) < 2:
        return np.zeros(len(x), bool), np.zeros(len(x))
    scores = isolation_scores(np.where(np.isfinite(x), x, 0.0))
    return scores > np.quantile(scores, 1 - share), scores


def pca(x: np.ndarray, dims: int) -> np.ndarray:
    centred = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    v = v[:dims] * np.sign(v[np.arange(min(dims, len(v))), np.abs(v[:dims]).argmax(axis=1)])[:, None]  # a sign that does not depend on the library
    return centred @ v.T


def tsne(x: np.ndarray, steps: int = 250, seed: int = 42) -> np.ndarray:
    """Two coordinates by t-SNE after PCA to 50; perplexity min(50, max(5, sqrt(n) // 3))."""
    n = len(x)
    y = pca(x, min(50, x.shape[1]))
    d, goal = distances(y).astype(float) ** 2, np.log(min(50, max(5, int(np.sqrt(n)) // 3)))
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta, own = 0.0, np.inf, 1.0, np.delete(d[i], i)
        for _ in range(50):
            w = np.exp(-(own - own.min()) * beta)
            entropy = np.log(w.sum()) + beta * np.sum((own - own.min()) * w) / w.sum()
            if abs(entropy - goal) < 1e-5:
                break
            lo, hi = (beta, hi) if entropy > goal else (lo, beta)
            beta = beta * 2 if np.isinf(hi) else (lo + hi) / 2
        p[i, np.arange(n) != i] = w / w.sum()
    del d
    p += p.T.copy()
    np.maximum(np.divide(p, 2 * n, out=p), 1e-12, out=p)
    rng = np.random.default_rng(seed)
    z, speed, q, force = rng.standard_normal((n, 2)) * 1e-4, np.zeros((n, 2)), np.empty((n, n)), np.empty((n, n))
    blocks = [slice(lo, lo + TSNE_BLOCK) for lo in range(0, n, TSNE_BLOCK)]  # that the cache holds
    for step in range(steps):
        square = np.sum(z * z, axis=1)
        np.matmul(z, z.T, out=q)
        for rows in blocks:
            part = q[rows]
            part *= 2
            np.subtract(square[rows][:, None] + square[None, :], part, out=part)
            np.sqrt(np.maximum(part, 0, out=part), out=part)
            part *= part
            part += 1
            np.divide(1, part, out=part)
        np.fill_diagonal(q, 0)
        total = q.sum()
        for rows in blocks:
            part = np.divide(q[rows], total, out=force[rows])
            np.maximum(part, 1e-12, out=part)
            np.subtract(p[rows] * (12 if step < 100 else 1), part, out=part)
            part *= q[rows]
        gradient = 4 * (force.sum(axis=1)[:, None] * z - force @ z)
        speed = (0.5 if step < 100 else 0.8) * speed - max(n / 48, 50) * gradient
        z = z + speed
        z -= z.mean(axis=0)
    return z


def _grouped(df: DataFrame, by: str, columns: list[str], key: str, fields: list[T.StructField], f) -> DataFrame:
    schema = T.StructType([df.schema[by], df.schema[key], *fields])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key).reset_index(drop=True)
        return pd.concat([frame[[by, key]], f(frame[columns].to_numpy(float))], axis=1)

    return df.select(by, key, *columns).groupBy(by).applyInPandas(one, schema)


def peel_strata(df: DataFrame, by: str, columns: list[str], key: str, plan: Peeling = Peeling()) -> DataFrame:
    """(by, key, label, level, homogeneity) for every row of every stratum."""
    fields = [T.StructField("label", T.LongType()), T.StructField("level", T.LongType()), T.StructField("homogeneity", T.DoubleType())]
    large = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE).collect()}
    if not large:
        return _grouped(df, by, columns, key, fields, lambda x: peel(x, plan))
    one_of = F.lit(False)
    for name in large:
        one_of = one_of | F.col(by).eqNullSafe(F.lit(name))
    out = _grouped(df.filter(~one_of), by, columns, key, fields, lambda x: peel(x, plan))
    rows = df.filter(one_of).select(by, key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    placed = materialised(numbered(rows, [by], [key]), "strata")
    with ThreadPoolExecutor(STRATA) as pool:  # jobs of several strata fill the cluster
        peeled = {name: pool.submit(_peel_large, placed.filter(F.col(by).eqNullSafe(F.lit(name))).drop(by), key, n, len(columns), plan) for name, n in large.items()}
    for name in large:
        made = peeled[name].result()
        out = out.unionByName(made.select(F.lit(name).cast(df.schema[by].dataType).alias(by), key, "label", "level", "homogeneity"))
    return out


def _peel_large(rows: DataFrame, key: str, n: int, width: int, plan: Peeling) -> DataFrame:
    """:func:`peel` of (key, place, x) by jobs: only figures of clusters reach the driver."""
    done: list[DataFrame] = []
    left, m, label, whole = rows, n, 0, cluster_size(n)
    spread, seen = None, {}
    for level in range(plan.levels):
        if m < plan.least:
            break
        size = whole
        if level and m < n:
            spread = spread or float(np.trace(density.moments(rows, width)[1])) + 1e-10
            size = _residual_size(whole, n, m, spread, float(np.trace(density.moments(left, width)[1])) + 1e-10)
        size, taken = max(plan.least, size), 0
        for _ in range(plan.retries + 1):
            made = _attempt_whole(left, m, width, level, size, plan) if m <= density.ROWS else _attempt(left, m, width, level, size, plan, seen)
            found = made.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n")).collect()
            if found:
                marked = materialised(left.join(made, "place"), "marked")
                labels = (F.col("cluster") + label).cast("long").alias("label")
                done.append(marked.filter("cluster >= 0").select(key, labels, F.lit(level).cast("long").alias("level"), "homogeneity"))
                label, taken = label + len(found), taken + sum(r["n"] for r in found)
                m -= sum(r["n"] for r in found)
                left = materialised(numbered(marked.filter("cluster < 0").select(F.lit(0).alias("all"), key, "x"), ["all"], [key]).drop("all"), "left")
                seen = {}
            if m / n <= plan.residual_share or size <= plan.least or m < 2:
                break
            size = max(plan.least, size // 2)
        if not taken and level:
            break
    done.append(left.select(key, F.lit(-1).cast("long").alias("label"), F.lit(-1).cast("long").alias("level"), F.lit(0.0).alias("homogeneity")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


MARKS = "place long, cluster int, homogeneity double"


def _attempt_whole(left: DataFrame, m: int, width: int, level: int, size: int, plan: Peeling) -> DataFrame:
    """(place, cluster, homogeneity): the clusters taken out of few rows, from 0, else -1."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place").reset_index(drop=True)
        out = pd.DataFrame({"place": frame["place"], "cluster": -1, "homogeneity": 0.0})
        kept, _ = _level(np.stack(frame["x"]).astype(float), level, size, plan)
        for i, (rows, h) in enumerate(kept):
            out.loc[rows, ["cluster", "homogeneity"]] = i, h
        return out

    return materialised(left.select("place", "x").groupBy().applyInPandas(one, MARKS), "attempt")


def _attempt(left: DataFrame, m: int, width: int, level: int, size: int, plan: Peeling, seen: dict) -> DataFrame:
    """As :func:`_attempt_whole`, of rows that no task holds: a task has the edges of their tree (24 bytes a row) but not the rows.

    ``seen`` keeps what attempts on the same rows share: axes and nearest rows.
    """
    made, best, core = seen.setdefault("axes", {}), None, core_size(size)
    configs = []
    for metric, selection, dims in plan.residual if level else plan.first:
        safe = min(dims or 0, width - 1, m - 1)
        reduced = safe if dims and dims < width and safe >= 2 else None
        if reduced and reduced not in made:
            mean, covariance = density.moments(left, width)
            made[reduced] = (mean, density.axes(covariance, reduced))
        configs.append((metric, selection, reduced))

    def tree(space: tuple[str, int | None]) -> DataFrame:
        metric, reduced = space
        if space not in seen or seen[space].k < core:
            turn = _turned(metric == "cosine", *made.get(reduced, (None, None)))
            seen[space] = density.Near(left, m, reduced or width, metric == "cosine", core, turn)
        return seen[space].tree(core)

    with ThreadPoolExecutor(STRATA) as pool:
        spaces = dict.fromkeys((metric, reduced) for metric, _, reduced in configs)
        trees = dict(zip(spaces, pool.map(tree, spaces), strict=True))
        every = list(pool.map(lambda c: materialised(_labels(trees[c[0], c[2]], m, size, c[1]), "labels"), configs))
    for (_, _, reduced), labels in zip(configs, every, strict=True):
        r = labels.select("n_clusters", "n_noise").first()
        score = _score(r["n_clusters"], r["n_noise"] / m * 100)
        if best is None or score > best[0]:
            best = (score, labels, _turned(False, *made.get(reduced, (None, None))))
    _, labels, turn = best

    def drawn(frames):
        for frame in frames:
            for raw, more in zip(frame["labels"], frame["strength"], strict=True):
                own, strength = np.frombuffer(raw, np.int64), np.frombuffer(more)
                for k in range(own.max() + 1):
                    rows, group = drawn_rows(np.flatnonzero(own == k), np.flatnonzero((own != k) & (own != -1)))
                    if len(rows):
                        yield pd.DataFrame({"cluster": k, "at": np.arange(len(rows)), "place": rows, "side": group, "member": strength[own == k].mean()})
                    else:
                        yield pd.DataFrame({"cluster": [k], "at": [0], "place": [None], "side": [0], "member": [strength[own == k].mean()]})

    def cohesions(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        s = None if frame["place"].isna().any() else silhouette_of(turn(np.stack(frame["x"]).astype(float)), frame["side"].to_numpy())
        return pd.DataFrame({"cluster": [frame["cluster"].iloc[0]], "homogeneity": [cohesion(frame["member"].iloc[0], s)]})

    pairs = labels.select("labels", "strength").mapInPandas(drawn, "cluster int, at int, place long, side int, member double")
    scored = pairs.join(left.select("place", "x"), "place", "left").groupBy("cluster").applyInPandas(cohesions, "cluster int, homogeneity double")
    least = level_threshold(level, plan.base, plan.step, plan.most)
    kept = sorted((r["cluster"], r["homogeneity"]) for r in scored.collect() if r["homogeneity"] >= least)
    names = np.full(max((k for k, _ in kept), default=-1) + 2, -1)  # the last for noise and what is not kept
    values = np.zeros(len(names))
    for i, (k, h) in enumerate(kept):
        names[k], values[k] = i, h

    def marks(frames):
        for frame in frames:
            for raw in frame["labels"]:
                own = np.minimum(np.frombuffer(raw, np.int64), len(names) - 1)
                for lo in range(0, len(own), density.ROWS):
                    part = own[lo : lo + density.ROWS]
                    yield pd.DataFrame({"place": np.arange(lo, lo + len(part)), "cluster": names[part], "homogeneity": values[part]})

    return materialised(labels.select("labels").mapInPandas(marks, MARKS), "attempt")


def _turned(unit: bool, mean: np.ndarray | None, axes: np.ndarray | None) -> density.Turn:
    def turn(x: np.ndarray) -> np.ndarray:
        x = x if axes is None else (x - mean) @ axes.T
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) if unit else x

    return turn


def _labels(tree: DataFrame, n: int, size: int, selection: str) -> DataFrame:
    """One row: the bytes of the labels and strengths of all places, and the numbers of clusters and of noise."""

    def step(frames):
        for frame in frames:
            for a, b, w in zip(frame["a"], frame["b"], frame["w"], strict=True):
                labels, strength = clusters(np.stack([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(w)], axis=1), n, size, selection)
                yield pd.DataFrame({"labels": [labels.astype(np.int64).tobytes()], "strength": [strength.tobytes()], "n_clusters": [int(labels.max()) + 1], "n_noise": [int((labels < 0).sum())]})

    return tree.mapInPandas(step, "labels binary, strength binary, n_clusters int, n_noise long")


def outliers_of_strata(df: DataFrame, by: str, columns: list[str], key: str, share: float = 0.10) -> DataFrame:
    fields = [T.StructField("is_outlier", T.BooleanType()), T.StructField("score", T.DoubleType())]
    return _grouped(df, by, columns, key, fields, lambda x: pd.DataFrame(dict(zip(("is_outlier", "score"), outliers(x, share), strict=True))))


def project_strata(df: DataFrame, by: str, columns: list[str], key: str, method: str = "tsne", most: int | None = None) -> DataFrame:
    """Two coordinates of every row; ``method`` is ``tsne`` or ``pca`` (also what stands in for UMAP).

    Strata of more than TSNE_ROWS rows are projected by jobs over blocks of their
    rows (see :mod:`embedding`).  A caller that asks for ``most`` rows of a stratum
    has so many drawn with a fixed seed, and only these reach a task; the others
    have no coordinates.
    """
    fields = [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]

    def f(x: np.ndarray) -> pd.DataFrame:
        z = pca(x, 2) if method != "tsne" or len(x) <= 5 else tsne(x[np.arange(len(x))])  # a copy: sums in another layout round otherwise, and steps magnify that
        return pd.DataFrame(np.pad(z, ((0, 0), (0, 2 - z.shape[1]))), columns=["x", "y"])

    limit = max(TSNE_ROWS if most is None else most, 5)
    large = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > limit).collect()} if method == "tsne" else {}
    if not large:
        return _grouped(df, by, columns, key, fields, f)
    one_of = F.lit(False)
    for name in large:
        one_of = one_of | F.col(by).eqNullSafe(F.lit(name))
    if most is None:
        rows = df.filter(one_of).select(by, key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
        placed = materialised(numbered(rows, [by], [key]), "strata")
        of = lambda name: placed.filter(F.col(by).eqNullSafe(F.lit(name)))
        with ThreadPoolExecutor(STRATA) as pool:
            made = {name: pool.submit(embedding.coordinates, of(name).select("place", "x"), n, len(columns)) for name, n in large.items()}
        out = _grouped(df.filter(~one_of), by, columns, key, fields, f)
        for name in large:
            out = out.unionByName(of(name).select(by, key, "place").join(made[name].result(), "place").drop("place"))
        return out
    placed = numbered(df.filter(one_of).select(by, key, *columns), [by], [key])
    drawn = [(name, place) for name, n in large.items() for place in np.random.RandomState(SEED).choice(n, most, replace=False).tolist()]
    picks = F.broadcast(df.sparkSession.createDataFrame(drawn, T.StructType([T.StructField("__by", df.schema[by].dataType), T.StructField("__place", T.LongType())])))
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("place") == F.col("__place"))
    made = project_strata(df.filter(~one_of).select(by, key, *columns).unionByName(placed.join(picks, same, "left_semi").drop("place")), by, columns, key)
    rest = placed.join(picks, same, "left_anti").select(by, key, *[F.lit(None).cast("double").alias(c) for c in ("x", "y")])
    return made.unionByName(rest)
