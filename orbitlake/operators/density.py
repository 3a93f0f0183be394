"""Density trees of strata that no task holds whole.

Rows lie in blocks.  Distances of two blocks are made in one task each, so the
work (all pairs, by nature) spreads over the executors and a task's memory does
not depend on the stratum.  A first pass finds each row's nearest rows.  Under
mutual reachability a pair outside these lists weighs its bare distance, so the
spanning tree of the lists is nearly the whole one: a second pass holds every
pair against the heaviest edge of the tree's path between its rows, which is a
running maximum once rows lie in the order in which the tree joins them, and the
few pairs below it are merged with the tree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised

#: Rows of a block, trees that are merged by side, rows of distances made at once, partitions of a shuffle of pairs.
ROWS, TOGETHER, SLICE, PARTITIONS = 4096, 8, 128, 1024
#: Pairs whose distances are made at once, blocks that one task looks at for a block's nearest rows, partitions for each of its groups, so that few share one.
PAIRS, LOOKED, SPREAD = 65536, 4, 2

Turn = Callable[[np.ndarray], np.ndarray]


def between(x: np.ndarray, y: np.ndarray, cosine: bool) -> np.ndarray:
    """Distances of the rows of ``x`` (of unit length for cosines) to those of ``y``; what is no number is the greatest."""
    d = x @ y.T
    if cosine:
        np.subtract(1, d, out=d)
        np.clip(d, 0, 2, out=d)
    else:
        d *= -2
        d += np.sum(x * x, axis=1)[:, None]
        d += np.sum(y * y, axis=1)
        np.sqrt(np.maximum(d, 0, out=d), out=d)
    if not np.isfinite(d.sum()):
        np.nan_to_num(d, copy=False, nan=np.finfo(float).max, posinf=np.finfo(float).max)
    return d


def exact(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, cosine: bool) -> np.ndarray:
    """Distances of the rows ``r`` of x to the rows ``c`` of y, pair by pair."""
    made = [np.zeros(0)]
    for lo in range(0, len(r), PAIRS):
        p, q = x[r[lo : lo + PAIRS]], y[c[lo : lo + PAIRS]]
        if cosine:
            made.append(np.clip(1 - np.einsum("ij,ij->i", p, q), 0, 2))
        else:
            p -= q
            made.append(np.sqrt(np.einsum("ij,ij->i", p, p)))
    return np.nan_to_num(np.concatenate(made), nan=np.finfo(float).max, posinf=np.finfo(float).max)


def likeness(d: np.ndarray, cosine: bool) -> np.ndarray:
    """What :func:`coarse` makes of a distance; the less, the farther."""
    with np.errstate(over="ignore"):
        return np.where(d < 0, np.inf, 1 - d if cosine else -0.5 * d * d)


def coarse(x: np.ndarray, y: np.ndarray, cosine: bool) -> tuple[Callable[[slice], np.ndarray], float]:
    """A function that gives the likeness of some rows of x to those of y by a product in single precision, and the most that this is off.

    Where single precision does not reach, it is made of distances in double.
    """
    a, b = x, y
    with np.errstate(over="ignore", invalid="ignore"):
        if not cosine:
            a = np.column_stack([x, -0.5 * np.sum(x * x, axis=1), np.ones(len(x))])
            b = np.column_stack([y, np.ones(len(y)), -0.5 * np.sum(y * y, axis=1)])
        off = 1.2e-7 * (x.shape[1] + 8) * np.sqrt(np.sum(a * a, axis=1).max() * np.sum(b * b, axis=1).max())
    if not off < 1e30:
        return lambda rows: likeness(between(x[rows], y, cosine), cosine), 1e-9
    a, b = a.astype(np.float32), b.astype(np.float32).T
    return lambda rows: a[rows] @ b, float(off)


def _merged(part: np.ndarray, roots: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Parts after each of ``roots`` has taken its least edge, between the rows x and y."""
    every = np.arange(len(part))
    ahead = every.copy()
    ahead[roots] = part[x] + part[y] - roots
    both = (ahead[ahead] == every) & (every < ahead)  # two parts that took the same edge
    ahead[both] = every[both]
    while (ahead != ahead[ahead]).any():
        ahead = ahead[ahead]
    return ahead[part]


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (a < b) of the least spanning forest, in order of weight, a and b (Boruvka's method)."""
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    part, alive, taken = np.arange(len(names)), np.arange(len(a)), []
    while True:
        p, q = part[x[alive]], part[y[alive]]
        apart = p != q
        alive, p, q = alive[apart], p[apart], q[apart]
        if not len(alive):
            break
        best = np.full(len(names), len(a))
        np.minimum.at(best, p, alive)
        np.minimum.at(best, q, alive)
        roots = np.flatnonzero(best < len(a))
        mine = best[roots]
        taken.append(np.unique(mine))
        part = _merged(part, roots, x[mine], y[mine])
    kept = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    return a[kept], b[kept], w[kept]


def blocks(rows: DataFrame, turn: Turn) -> DataFrame:
    """(block, x): ROWS rows of (place, x), each ``turn`` made, as the bytes of one array."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = turn(np.stack(frame.sort_values("place")["x"]).astype(float))
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "x": [np.ascontiguousarray(x).tobytes()]})

    dealt = rows.select(F.floor(F.col("place") / ROWS).cast("int").alias("block"), "place", "x")
    return dealt.groupBy("block").applyInPandas(pack, "block int, x binary")


def _array(raw: bytes, width: int | None = None) -> np.ndarray:
    x = np.frombuffer(raw)
    return x if width is None else x.reshape(-1, width)


def neighbours(packed: DataFrame, n: int, width: int, cosine: bool, k: int) -> DataFrame:
    """(block, ids, near): the ``k`` + 1 nearest rows of each row, itself one of them, in order of distance; as many leave a task."""
    count = -(-n // ROWS)
    groups = -(-count // LOOKED)
    k = min(k, n - 1)

    def least(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if d.shape[1] <= k + 1:
            return d, ids
        at = np.argpartition(d, k, axis=1)[:, : k + 1]
        return np.take_along_axis(d, at, axis=1), np.take_along_axis(ids, at, axis=1)

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        own = _array(frame["x"][frame["own"]].iloc[0], width)
        others = [(int(b) * ROWS, _array(raw, width)) for b, raw in zip(frame["block"][~frame["own"]], frame["x"][~frame["own"]], strict=True)]
        others = [(first, other, *coarse(own, other, cosine)) for first, other in others]
        made = []
        for lo in range(0, len(own), SLICE):
            part = own[lo : lo + SLICE]
            found, ids = np.zeros((len(part), 0)), np.zeros((len(part), 0), np.int32)
            for first, other, like, off in others:
                seen = like(slice(lo, lo + SLICE))
                if found.shape[1] > k:
                    limit = likeness(found.max(axis=1), cosine) - off
                elif len(other) > k + 1:
                    limit = np.partition(seen, len(other) - k - 1, axis=1)[:, len(other) - k - 1] - 2 * off
                else:
                    limit = np.full(len(part), -np.inf)
                rows, columns = np.divmod(np.flatnonzero(seen >= limit.astype(seen.dtype)[:, None]), len(other))
                many = np.bincount(rows, minlength=len(part))
                more, names = np.full((len(part), many.max()), np.inf), np.zeros((len(part), many.max()), np.int32)
                at = rows, np.arange(len(rows)) - (np.cumsum(many) - many)[rows]
                more[at], names[at] = exact(part, other, rows, columns, cosine), columns + first
                found, ids = least(np.concatenate([found, more], axis=1), np.concatenate([ids, names], axis=1))
            made.append((found, ids))
        found, ids = (np.concatenate(m) for m in zip(*made, strict=True))
        return pd.DataFrame({"at": [frame["at"].iloc[0]], "ids": [ids.tobytes()], "near": [found.tobytes()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        at = int(frame["at"].iloc[0])
        rows = min(ROWS, n - at * ROWS)
        found, ids = np.zeros((rows, 0)), np.zeros((rows, 0), np.int32)
        for raw, names in zip(frame["near"], frame["ids"], strict=True):
            found, ids = least(np.concatenate([found, _array(raw).reshape(rows, -1)], axis=1), np.concatenate([ids, np.frombuffer(names, np.int32).reshape(rows, -1)], axis=1))
        order = np.argsort(found, axis=1)
        return pd.DataFrame({"block": [at], "ids": [np.take_along_axis(ids, order, axis=1).tobytes()], "near": [np.take_along_axis(found, order, axis=1).tobytes()]})

    own = packed.select(F.col("block").alias("at"), _each(groups).alias("part"), "block", F.lit(True).alias("own"), "x")
    others = packed.select(_each(count).alias("at"), F.floor(F.col("block") / LOOKED).cast("int").alias("part"), "block", F.lit(False).alias("own"), "x")
    dealt = own.unionByName(others).repartition(min(PARTITIONS, SPREAD * count * groups), "at", "part")
    found = dealt.groupBy("at", "part").applyInPandas(near, "at int, ids binary, near binary")
    return found.repartition(min(PARTITIONS, count), "at").groupBy("at").applyInPandas(merge, "block int, ids binary, near binary")


def _each(most: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(most - 1)))


EDGES = "i int, j int, a binary, b binary, w binary"


def _edges(i: int, j: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": [i], "j": [j], "a": [np.asarray(a, np.int64).tobytes()], "b": [np.asarray(b, np.int64).tobytes()], "w": [np.asarray(w, float).tobytes()]})


def _joined_trees(made: DataFrame, count: int) -> DataFrame:
    """One row of EDGES: the least spanning forest of all edges, merged by squares of ``TOGETHER`` pairs of blocks a side."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.concatenate([np.frombuffer(r, np.int64) for r in frame[c]]) for c in ("a", "b"))
        return _edges(frame["i"].iloc[0], frame["j"].iloc[0], *forest(a, b, np.concatenate([_array(r) for r in frame["w"]])))

    while True:
        count = -(-count // TOGETHER)
        made = made.select(F.floor(F.col("i") / TOGETHER).cast("int").alias("i"), F.floor(F.col("j") / TOGETHER).cast("int").alias("j"), "a", "b", "w")
        made = made.repartition(min(PARTITIONS, count * (count + 1) // 2), "i", "j").groupBy("i", "j").applyInPandas(merge, EDGES)
        if count == 1:
            return made


def joining_order(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order in which a forest's edges join them, the weight that joins each with the next (inf between trees), and the tree of each.

    The heaviest edge of the path between two rows is the greatest weight between their places.
    """
    parent, head, tail, after, gap = list(range(n)), list(range(n)), list(range(n)), [-1] * n, [np.inf] * n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j, weight in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        p, q = find(i), find(j)
        after[tail[p]], gap[tail[p]], tail[p], parent[q] = head[q], weight, tail[q], p
    order, trees = [], []
    for tree, root in enumerate(i for i in range(n) if parent[i] == i):
        i = head[root]
        while i >= 0:
            order.append(i)
            trees.append(tree)
            i = after[i]
    order = np.array(order)
    return order, np.array(gap)[order], np.array(trees)


def _least(names: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...]:
    return forest(*names) if len(names[0]) > most else names


def lighter(x, y, core_x, core_y, name_x, name_y, gap, above, pre, cosine):
    """Edges (a, b, weight) between two blocks, or inside one (``pre`` is None), that weigh less than the path of the tree between their rows.

    ``gap``: weights that join each row of x with the next; ``above``: the
    greatest such weight between the blocks; ``pre``: weights that join each row
    of y with the one before it, but the first.
    """
    like, off = coarse(x, y, cosine)
    if pre is None:
        places = np.arange(len(x))
    else:
        suffix = np.maximum.accumulate(gap[::-1])[::-1]
        prefix = np.maximum.accumulate(np.append(above, pre))
        least_x, least_y = (likeness(v, cosine) - off for v in (suffix, prefix))
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for lo in range(0, len(x), SLICE):
        rows = slice(lo, lo + SLICE)
        seen = like(rows)
        if pre is None:
            path = np.where(places[None, 1:] > places[rows, None], gap[None, :-1], -np.inf)
            path = np.concatenate([np.full((len(seen), 1), -np.inf), np.maximum.accumulate(path, axis=1)], axis=1)
            r, c = np.divmod(np.flatnonzero(seen > likeness(path, cosine) - off), len(y))
            path = path[r, c]
        else:
            near = seen > least_x[rows, None].astype(seen.dtype)
            near |= seen > least_y.astype(seen.dtype)
            r, c = np.divmod(np.flatnonzero(near), len(y))
            path = np.maximum(suffix[rows][r], prefix[c])
        w = np.maximum(core_x[rows][r], core_y[c])  # most are pairs of the lists, which their path cannot exceed
        r, c, w, path = (v[w < path] for v in (r, c, w, path))
        w = np.maximum(w, exact(x[rows], y, r, c, cosine))
        less = w < path
        if less.any():
            p, q = name_x[rows][r[less]], name_y[c[less]]
            found = tuple(map(np.concatenate, zip(found, (np.minimum(p, q), np.maximum(p, q), w[less]), strict=True)))
            found = _least(found, 4 * (len(x) + len(y)))
    return found


def links(x, y, name_x, name_y, tree_x, tree_y, cosine):
    """The shortest edges (a, b, weight) that join different trees, whose rows lie together, as a forest of the trees."""
    starts_x, starts_y = (np.flatnonzero(np.append(True, t[1:] != t[:-1])) for t in (tree_x, tree_y))
    least = np.full((len(starts_x), len(starts_y)), np.inf)
    at = np.zeros((*least.shape, 2), np.int64)
    which = np.cumsum(np.append(0, tree_x[1:] != tree_x[:-1]))
    for lo in range(0, len(x), SLICE):
        rows = slice(lo, lo + SLICE)
        d = between(x[rows], y, cosine)
        own = which[rows]
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        low = np.minimum.reduceat(np.minimum.reduceat(d, starts_y, axis=1), cuts, axis=0)
        for i, j in zip(*np.nonzero(low < least[own[cuts]]), strict=True):
            one, other = own[cuts[i]], slice(starts_y[j], starts_y[j + 1] if j + 1 < len(starts_y) else len(y))
            if tree_x[starts_x[one]] == tree_y[starts_y[j]]:
                continue
            part = d[cuts[i] : cuts[i + 1] if i + 1 < len(cuts) else len(d), other]
            r, c = np.unravel_index(part.argmin(), part.shape)
            least[one, j], at[one, j] = low[i, j], (lo + cuts[i] + r, other.start + c)
    i, j = np.nonzero(np.isfinite(least))
    p, q, w = tree_x[starts_x[i]], tree_y[starts_y[j]], least[i, j]
    ends = np.stack([name_x[at[i, j, 0]], name_y[at[i, j, 1]]])
    kept = {(a, b, v) for a, b, v in zip(*forest(np.minimum(p, q), np.maximum(p, q), w), strict=True)}
    mine = [k for k in range(len(w)) if (min(p[k], q[k]), max(p[k], q[k]), w[k]) in kept]
    return ends.min(axis=0)[mine], ends.max(axis=0)[mine], w[mine]


def spanning_tree(rows: DataFrame, n: int, width: int, cosine: bool, k: int, turn: Turn) -> DataFrame:
    """One row (a, b, w): the bytes of the spanning tree's edges under mutual reachability, in order of weight; ``width`` numbers a row after its ``turn``."""
    return Near(rows, n, width, cosine, k, turn).tree(k)


class Near:
    """The nearest rows of all rows, stored, and the trees that they give for as many of them or fewer."""

    def __init__(self, rows: DataFrame, n: int, width: int, cosine: bool, k: int, turn: Turn):
        self.n, self.width, self.cosine, self.k = n, width, cosine, k
        self.packed = materialised(blocks(rows, turn), "blocks")
        self.lists = materialised(neighbours(self.packed, n, width, cosine, k), "near")
        self.trees: dict[int, DataFrame] = {}

    def tree(self, k: int) -> DataFrame:
        if k not in self.trees:
            first, trees = self._of_lists(k)
            if trees > 1:
                first = self._ordered(self._passed(first, k, "links"))[0]
            self.trees[k] = materialised(self._passed(first, k, "lighter").select("a", "b", "w"), "tree")
        return self.trees[k]

    def _cores(self, k: int) -> DataFrame:
        """(block, core): distance of each row to its ``k``-th nearest other row."""
        k = min(k, self.n - 1)

        def step(frames):
            for frame in frames:
                for block, raw in zip(frame["block"], frame["near"], strict=True):
                    near = _array(raw).reshape(-1, min(self_k, n - 1) + 1)
                    yield pd.DataFrame({"block": [block], "core": [near[:, k].tobytes()]})

        self_k, n = self.k, self.n
        return self.lists.select("block", "near").mapInPandas(step, "block int, core binary")

    def _of_lists(self, k: int) -> tuple[DataFrame, int]:
        """The forest of the lists' edges (see :meth:`_ordered`)."""
        n, most, rows, count = self.n, min(self.k, self.n - 1), ROWS, -(-self.n // ROWS)
        k = min(k, n - 1)

        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"all": [b"".join(frame.sort_values("block")["core"])]})

        def edges(frames):
            for frame in frames:
                for block, raw, every in zip(frame["block"], frame["ids"], frame["all"], strict=True):
                    core, ids = _array(every), np.frombuffer(raw, np.int32).reshape(-1, most + 1)[:, : k + 1]
                    a = np.repeat(np.arange(block * rows, block * rows + len(ids)), ids.shape[1])
                    b = ids.ravel().astype(np.int64)
                    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                    yield _edges(block, block, *forest(a, b, np.maximum(core[a], core[b])))

        cores = self._cores(k).groupBy().applyInPandas(whole, "all binary").select(_each(count).alias("block"), "all")
        made = self.lists.select("block", "ids").join(cores, "block").mapInPandas(edges, EDGES)
        return self._ordered(_joined_trees(made, count))

    def _ordered(self, tree: DataFrame) -> tuple[DataFrame, int]:
        """A forest's edges and the order of its rows, and the number of its trees."""
        n, rows = self.n, ROWS

        def step(frames):
            for frame in frames:
                for a, b, w in zip(frame["a"], frame["b"], frame["w"], strict=True):
                    order, gap, trees = joining_order(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), _array(w), n)
                    tops = np.maximum.reduceat(gap, np.arange(0, n, rows))
                    yield pd.DataFrame({"a": [a], "b": [b], "w": [w], "order": [order.astype(np.int64).tobytes()], "gap": [gap.tobytes()], "tree": [trees.astype(np.int64).tobytes()], "tops": [tops.tobytes()], "trees": [int(trees.max()) + 1]})

        made = materialised(tree.select("a", "b", "w").mapInPandas(step, "a binary, b binary, w binary, order binary, gap binary, tree binary, tops binary, trees int"), "order")
        return made, made.select("trees").first()["trees"]

    def _passed(self, first: DataFrame, k: int, what: str) -> DataFrame:
        """EDGES of ``first`` and of what a pass over all pairs of rows, in its order, adds to them."""
        n, width, cosine, rows, count = self.n, self.width, self.cosine, ROWS, -(-self.n // ROWS)

        def places(frames):
            for frame in frames:
                for order, gap, tree, tops in zip(frame["order"], frame["gap"], frame["tree"], frame["tops"], strict=True):
                    order, gap, tree = np.frombuffer(order, np.int64), _array(gap), np.frombuffer(tree, np.int64)
                    place = np.empty(n, np.int64)
                    place[order] = np.arange(n)
                    for block in range(count):
                        mine = place[block * rows : (block + 1) * rows]
                        yield pd.DataFrame({"block": [block], "place": [mine.tobytes()], "gap": [gap[mine].tobytes()], "tree": [tree[mine].tobytes()], "tops": [tops]})

        def deal(frames):
            for frame in frames:
                for r in frame.itertuples():
                    place, x = np.frombuffer(r.place, np.int64), _array(r.x, width)
                    of, name = place // rows, np.arange(r.block * rows, r.block * rows + len(place))
                    arrays = {"x": x, "place": place, "name": name, "core": _array(r.core), "gap": _array(r.gap), "tree": np.frombuffer(r.tree, np.int64)}
                    for to in np.unique(of):
                        yield pd.DataFrame({"to": [to], "tops": [r.tops], **{c: [v[of == to].tobytes()] for c, v in arrays.items()}})

        kinds = {"name": np.int64, "core": float, "gap": float, "tree": np.int64}

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(np.concatenate([np.frombuffer(r, np.int64) for r in frame["place"]]))
            x = np.concatenate([_array(r, width) for r in frame["x"]])[order]
            rest = {c: [np.concatenate([np.frombuffer(r, kind) for r in frame[c]])[order].tobytes()] for c, kind in kinds.items()}
            return pd.DataFrame({"block": [frame["to"].iloc[0]], "tops": [frame["tops"].iloc[0]], "x": [x.tobytes()], **rest})

        def pair(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("block")
            i, j, tops = int(frame["i"].iloc[0]), int(frame["j"].iloc[0]), _array(frame["tops"].iloc[0])
            x, y = (_array(frame["x"].iloc[s], width) for s in (0, -1))
            sides = {c: [np.frombuffer(frame[c].iloc[s], kind) for s in (0, -1)] for c, kind in kinds.items()}
            if what == "links":
                made = links(x, y, *sides["name"], *sides["tree"], cosine)
            else:
                made = lighter(x, y, *sides["core"], *sides["name"], sides["gap"][0], tops[i + 1 : j].max(initial=-np.inf), None if i == j else sides["gap"][1][:-1], cosine)
            return _edges(i, j, *made) if len(made[0]) else pd.DataFrame({c: [] for c in ("i", "j", "a", "b", "w")})

        columns = ", ".join(f"{c} binary" for c in ("tops", "x", *kinds))
        placed = first.select("order", "gap", "tree", "tops").mapInPandas(places, "block int, place binary, gap binary, tree binary, tops binary")
        dealt = self.packed.join(self._cores(k), "block").join(placed, "block").mapInPandas(deal, f"to int, place binary, {columns}")
        packed = materialised(dealt.repartition(min(PARTITIONS, count), "to").groupBy("to").applyInPandas(pack, f"block int, {columns}"), "ordered")
        each = packed.withColumn("other", _each(count))
        each = each.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *packed.columns)
        made = each.repartition(min(PARTITIONS, SPREAD * count * (count + 1) // 2), "i", "j").groupBy("i", "j").applyInPandas(pair, EDGES)
        return _joined_trees(made.unionByName(first.select(F.lit(0).alias("i"), F.lit(0).alias("j"), "a", "b", "w")), count)


def moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of (x): two passes of sums, ``width`` and its square a task."""

    def summed(f: Turn, size: int) -> np.ndarray:
        def step(frames):
            total, n = np.zeros(size), 0
            for frame in frames:
                if len(frame):
                    total, n = total + f(np.stack(frame["x"]).astype(float)).ravel(), n + len(frame)
            yield pd.DataFrame({"s": [np.append(total, n).tobytes()]})

        return np.sum([_array(r["s"]) for r in rows.select("x").mapInPandas(step, "s binary").collect()], axis=0)

    first = summed(lambda x: x.sum(axis=0), width)
    mean = first[:-1] / first[-1]
    second = summed(lambda x: (x - mean).T @ (x - mean), width * width)
    return mean, second[:-1].reshape(width, width) / max(first[-1] - 1, 1)


def axes(covariance: np.ndarray, dims: int) -> np.ndarray:
    """The first ``dims`` principal axes, signed as :func:`clustering.pca` signs them."""
    _, v = np.linalg.eigh(covariance)
    v = v[:, ::-1].T[:dims]
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
