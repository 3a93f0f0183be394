"""t-SNE of strata that no task holds whole: every row has its place.

Affinities are those of each row's nearest rows, three times the perplexity of
them, found among all rows by blocks (:mod:`density`).  A step is a job over
blocks of rows with their affinities, which stay where they are stored; the
places of all rows (16 bytes a row, as many for their speeds) go to every task.
All rows push each other: their sums are interpolated on a grid (four nodes in
an interval of one unit or less) and convolved by Fourier transforms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised
from . import density

#: Rows of a block of affinities, rows that are pulled at once, intervals of a side of the grid at least and at most.
ROWS, SLICE, FEWEST, FINEST = 4096, 512, 50, 500
#: Nodes of a side of an interval.
NODES = 4

#: Steps; those of them that exaggerate affinities, and how much.
STEPS, EARLY, EXAGGERATED = 250, 100, 12

STATE = "block int, z binary, speed binary"


def perplexity(n: int) -> int:
    return min(50, max(5, int(np.sqrt(n)) // 3))


def affinities(square: np.ndarray, goal: float) -> np.ndarray:
    """Conditional probabilities of each row's neighbours at these squared distances, of entropy ``goal``."""
    square = square - square.min(axis=1, keepdims=True)
    low, high, beta = np.zeros(len(square)), np.full(len(square), np.inf), np.ones(len(square))
    open_ = np.arange(len(square))
    for _ in range(100):
        w = np.exp(-square[open_] * beta[open_, None])
        total = w.sum(axis=1)
        entropy = np.log(total) + beta[open_] * (square[open_] * w).sum(axis=1) / total
        far = np.abs(entropy - goal) >= 1e-5
        open_, above = open_[far], entropy[far] > goal
        if not len(open_):
            break
        low[open_[above]], high[open_[~above]] = beta[open_[above]], beta[open_[~above]]
        beta[open_] = np.where(np.isinf(high[open_]), beta[open_] * 2, (low[open_] + high[open_]) / 2)
    w = np.exp(-square * beta[:, None])
    return w / w.sum(axis=1, keepdims=True)


def graph(lists: DataFrame, n: int, k: int) -> DataFrame:
    """(block, counts, others, p): of each row of a block, the rows that it pulls or that pull it, and the sums' halves of their affinities."""
    goal, rows, count, dealt = np.log(perplexity(n)), ROWS, -(-n // ROWS), density.ROWS

    def edges(frames):
        for frame in frames:
            for block, ids, near in zip(frame["block"], frame["ids"], frame["near"], strict=True):
                ids, near = np.frombuffer(ids, np.int32).reshape(-1, k + 1), np.frombuffer(near).reshape(-1, k + 1)
                own = np.arange(block * dealt, block * dealt + len(ids), dtype=np.int32)
                itself = ids == own[:, None]
                itself[~itself.any(axis=1), -1] = True  # among many copies a row may not be in its own list
                to = ids[~itself]
                p = (affinities(near[~itself].reshape(-1, k) ** 2, goal).ravel() / (2 * n)).astype(np.float32)
                own = np.repeat(own, k)
                for a, b in ((own, to), (to, own)):
                    of = a // rows
                    order = np.argsort(of, kind="stable")
                    cuts = np.searchsorted(of[order], np.arange(count + 1))
                    for at in np.unique(of):
                        mine = order[cuts[at] : cuts[at + 1]]
                        yield pd.DataFrame({"block": [at], "row": [a[mine].tobytes()], "others": [b[mine].tobytes()], "p": [p[mine].tobytes()]})

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        at = int(frame["block"].iloc[0])
        row, others = (np.concatenate([np.frombuffer(r, np.int32) for r in frame[c]]) for c in ("row", "others"))
        p = np.concatenate([np.frombuffer(r, np.float32) for r in frame["p"]])
        order = np.argsort(row, kind="stable")
        counts = np.bincount(row - at * rows, minlength=min(rows, n - at * rows)).astype(np.int32)
        return pd.DataFrame({"block": [at], "counts": [counts.tobytes()], "others": [others[order].tobytes()], "p": [p[order].tobytes()]})

    made = lists.mapInPandas(edges, "block int, row binary, others binary, p binary").repartition(density.SPREAD * count, "block")
    return made.groupBy("block").applyInPandas(pack, "block int, counts binary, others binary, p binary")


def pull(z: np.ndarray, first: int, counts: np.ndarray, others: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of p q (z_i - z_j) of the rows from ``first``, over their edges."""
    out, ends = np.zeros((len(counts), 2)), np.append(0, np.cumsum(counts))
    for lo in range(0, len(counts), SLICE):
        own = counts[lo : lo + SLICE]
        part = slice(ends[lo], ends[lo + len(own)])
        d = np.repeat(z[first + lo : first + lo + len(own)], own, axis=0)
        d -= z[others[part]]
        d *= (p[part] / (1 + np.einsum("ij,ij->i", d, d)))[:, None]
        out[lo : lo + len(own)] = np.add.reduceat(d, ends[lo : lo + len(own)] - ends[lo], axis=0)
    return out


def push(z: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums of q^2 (z_i - z_j) of every row over all rows, and the sum of q over all pairs, with q = 1 / (1 + d^2)."""
    low = z.min(axis=0)
    span = max(float((z.max(axis=0) - low).max()), 1e-9)
    z = z - low - span / 2
    boxes = int(min(max(FEWEST, np.ceil(span)), FINEST))
    size, step = NODES * boxes, span / (NODES * boxes)
    u = (z + span / 2) / (NODES * step)
    box = np.clip(u.astype(np.int64), 0, boxes - 1)
    places, t = (np.arange(NODES) + 0.5) / NODES, u - box
    weights = np.stack([np.prod([(t - r) / (q - r) for r in places if r != q], axis=0) for q in places], axis=2)  # Lagrange's
    nodes = NODES * box[:, :, None] + np.arange(NODES)
    at = (nodes[:, 0, :, None] * size + nodes[:, 1, None, :]).reshape(len(z), -1)
    w = (weights[:, 0, :, None] * weights[:, 1, None, :]).reshape(len(z), -1)
    charges = [np.bincount(at.ravel(), (w * q).ravel(), size * size).reshape(size, size) for q in (1.0, z[:, :1], z[:, 1:])]
    offset = np.minimum(np.arange(2 * size), 2 * size - np.arange(2 * size)) * step
    kernel = 1 / (1 + offset[:, None] ** 2 + offset[None, :] ** 2)
    spectrum = np.fft.rfft2(np.stack(charges), s=(2 * size, 2 * size))
    of = lambda made: np.fft.irfft2(made, s=(2 * size, 2 * size))[..., :size, :size]
    itself = np.stack([(2 if k else 1) * np.sum(weights[:, :, k:] * weights[:, :, : NODES - k], axis=2) for k in range(NODES)])
    itself = np.einsum("an,ab,bn->", itself[:, :, 0], kernel[:NODES, :NODES], itself[:, :, 1], optimize=True)  # as the grid makes it
    total = float((w * of(spectrum[0] * np.fft.rfft2(kernel)).ravel()[at]).sum() - itself)
    ones, x, y = (np.sum(w * field.ravel()[at], axis=1) for field in of(spectrum * np.fft.rfft2(kernel * kernel)))
    return z * ones[:, None] - np.stack([x, y], axis=1), total


def coordinates(rows: DataFrame, n: int, width: int, seed: int = 42) -> DataFrame:
    """(place, x, y) of every row of (place, x) by t-SNE after PCA to 50."""
    dims, k, size = min(50, width), min(3 * perplexity(n), n - 1), ROWS
    mean, covariance = density.moments(rows, width)
    axes = density.axes(covariance, dims)
    packed = materialised(density.blocks(rows, lambda x: (x - mean) @ axes.T), "blocks")
    pulls = materialised(graph(density.neighbours(packed, n, dims, False, k), n, k), "affinities")

    def start(frames):
        for frame in frames:
            for block in frame["block"]:
                z = np.random.default_rng([seed, block]).standard_normal((min(size, n - block * size), 2)) * 1e-4
                yield pd.DataFrame({"block": [block], "z": [z.tobytes()], "speed": [np.zeros_like(z).tobytes()]})

    state = materialised(pulls.select("block").mapInPandas(start, STATE), "places")
    for i in range(STEPS):
        exaggerated, momentum = (EXAGGERATED, 0.5) if i < EARLY else (1, 0.8)
        rate = max(n / (4 * EXAGGERATED), 50)

        def step(frames, exaggerated=exaggerated, momentum=momentum, rate=rate):
            z = None
            for frame in frames:
                for block, counts, others, p, every in zip(frame["block"], frame["counts"], frame["others"], frame["p"], frame["every"], strict=True):
                    if z is None:  # the same for all blocks
                        z = np.concatenate([np.frombuffer(r["z"]).reshape(-1, 2) for r in every])
                        z = z - z.mean(axis=0)
                        away, total = push(z)
                    speed = np.frombuffer(every[block]["speed"]).reshape(-1, 2)
                    own = slice(block * size, block * size + len(speed))
                    toward = pull(z, own.start, np.frombuffer(counts, np.int32), np.frombuffer(others, np.int32), np.frombuffer(p, np.float32))
                    speed = momentum * speed - rate * 4 * (exaggerated * toward - away[own] / total)
                    yield pd.DataFrame({"block": [block], "z": [(z[own] + speed).tobytes()], "speed": [speed.tobytes()]})

        every = state.agg(F.sort_array(F.collect_list(F.struct("block", "z", "speed"))).alias("every"))
        state = materialised(pulls.crossJoin(F.broadcast(every)).mapInPandas(step, STATE), "places")

    def unpack(frames):
        for frame in frames:
            for block, raw, *middle in zip(frame["block"], frame["z"], frame["mx"], frame["my"], strict=True):
                z = np.frombuffer(raw).reshape(-1, 2) - middle
                yield pd.DataFrame({"place": np.arange(block * size, block * size + len(z)), "x": z[:, 0], "y": z[:, 1]})

    def sums(frames):
        for frame in frames:
            for raw in frame["z"]:
                z = np.frombuffer(raw).reshape(-1, 2)
                yield pd.DataFrame({"sx": [z[:, 0].sum()], "sy": [z[:, 1].sum()]})

    middle = state.select("z").mapInPandas(sums, "sx double, sy double").agg((F.sum("sx") / n).alias("mx"), (F.sum("sy") / n).alias("my"))
    return state.select("block", "z").crossJoin(F.broadcast(middle)).mapInPandas(unpack, "place long, x double, y double")
