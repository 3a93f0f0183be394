"""Simulation of designed runs: both passes over a trajectory in one Arrow function, one row in and one out.

A run is independent of all others and keyed by its own seeds, so a design is
dealt evenly and a lost task is simply run again.  The first pass screens the
trajectory; the mask it gives decides where the second measures the costly
observables.  A state lives in a task only while its run is iterated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import atomics, spectra
from ..functions import constants as C
from ..functions.constants import EPS


def initial(row: dict) -> tuple[np.ndarray, atomics.Operator, dict]:
    """Initial state, operator and its parameters of one run; unknown ids raise."""
    for kind, table in (("gamma_id", atomics.OPERATORS), ("encoding_id", atomics.SOURCES), ("modifier_id", atomics.MODIFIERS)):
        if row[kind] not in table and not (kind == "gamma_id" and row.get("is_composed")):
            raise KeyError(f"unknown {kind}: {row[kind]}")
    params = {k: json.loads(row[k] or "{}") for k in ("gamma_params", "encoding_params", "modifier_params")}
    rng = lambda what: atomics.generator(row["seed_CI"], row["gamma_id"], row["encoding_id"], what)
    x = np.asarray(atomics.SOURCES[row["encoding_id"]].create(row["n_dof"], params["encoding_params"], rng("state")), float)
    x = atomics.MODIFIERS[row["modifier_id"]](x, params["modifier_params"], rng("modifier"))
    op = composed(row) if row.get("is_composed") else atomics.OPERATORS[row["gamma_id"]]
    own = dict(params["gamma_params"])
    if op.prepare:
        own |= op.prepare(own, row["n_dof"], rng("operator"))
    return x, op, own


def composed(row: dict) -> atomics.Operator:
    """A composition applies its parts in order, each result scaled by its weight (an extension: parts share parameters by name)."""
    ids = [p for p in row["gamma_id"].replace("GAM-", " GAM-").split() if p.startswith("GAM-")]
    parts = [atomics.OPERATORS[i.rstrip("-")[:7]] for i in ids]
    weights = row.get("weights")
    weights = [1.0] * len(parts) if weights is None else list(weights)

    def step(x, p, a, r):
        for op, w in zip(parts, weights, strict=True):
            x = w * op.step(x, p, a, r)
        return x

    def prepare(a, n, r):
        out: dict = {}
        for op in parts:
            if op.prepare:
                out |= op.prepare(a, n, r)
        return out

    return atomics.Operator(row["gamma_id"], "composed", step, prepare=prepare, differentiable=False)


@np.errstate(over="ignore", invalid="ignore")
def measure(x: np.ndarray, p: np.ndarray | None, before: float | None) -> tuple[dict[str, float], float | None]:
    """Layer A of one state, and its distance to the state before."""
    size, flat = float(np.linalg.norm(x)), np.abs(x).ravel()
    q = flat / (flat.sum() + EPS)
    m0 = spectra.unfolding(x, 0)
    block = m0[:, : len(m0)]
    out = {
        "frob": size,
        "is_finite": float(np.isfinite(x).all()),
        "shannon_comp": float(-np.sum(q * np.log(q + EPS))),
        "ipr": float(np.sum(flat**2) ** 2 / (np.sum(flat**4) + EPS) / flat.size),
        "mode_asymmetry_o2": float(np.linalg.norm(block - block.T) / (np.linalg.norm(block) + EPS)),
        "volume_proxy": float(size * flat.max() / (flat.sum() + EPS)),
        "frob_gradient": float(np.std(np.linalg.norm(m0, axis=1)) / (np.std(np.linalg.norm(spectra.unfolding(x, 1), axis=1)) + EPS)) if x.ndim >= 3 else np.nan,
    }
    gap = None
    if p is not None:
        gap = float(np.linalg.norm(x - p))
        out |= {"delta_D": gap / (size + EPS), "cos_dissim": 1 - float(np.clip(np.sum(x * p) / (size * np.linalg.norm(p) + EPS), -1, 1)), "bregman_cost": gap**2 / (size**2 + EPS)}
    out["lyap_empirical"] = float(np.log((gap + EPS) / (before + EPS))) if gap is not None and before is not None else np.nan
    return out, gap


def trajectory(x: np.ndarray, op: atomics.Operator, params: dict, steps: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(state, state before) at every step, up to and with the first that is not finite."""
    p = x
    for _ in range(steps):
        yield x, p
        if not np.isfinite(x).all():
            return
        with np.errstate(all="ignore"):
            x, p = op.step(x, p, params, rng), x


def _rank(values: np.ndarray, q: float) -> float:
    return float(np.sort(values)[min(int(len(values) * q), len(values) - 1)]) if len(values) else np.inf


def _outliers(x: np.ndarray, floor: float = 0.0) -> np.ndarray:
    d = np.abs(np.diff(x))
    d = np.where(d < floor, 0.0, d)
    q1, q3 = _rank(d, 0.25), _rank(d, 0.75)
    return d > q3 + C.TUKEY * (q3 - q1)


def _turns(x: np.ndarray) -> int:
    d = np.diff(x)
    s = np.where(np.abs(d) < EPS, 0.0, np.sign(d))
    return int(np.sum(np.diff(s) != 0))


def find_period(cos: np.ndarray, steps: int) -> float:
    c = cos - cos.sum() / (len(cos) + EPS)
    room = steps // 4
    lags = min(len(cos) // 4, room)
    ac = np.full(room, -1.0)
    energy = float(c @ c) + EPS
    for k in range(lags):
        ac[k] = float(c[: len(c) - k] @ c[k:]) / energy
    for k in range(1, room - 1):
        if ac[k] > ac[k - 1] and ac[k] > ac[k + 1] and ac[k] > C.PERIOD_CORRELATION:
            return float(k)
    return np.nan


@np.errstate(over="ignore", invalid="ignore")
def screen(x: np.ndarray, op: atomics.Operator, params: dict, steps: int, rng) -> dict:
    """First pass: status, end, regime, period and mask of a trajectory."""
    frob, cos, delta, last, bad = [], [], [], x, None
    for t, (state, before) in enumerate(trajectory(x, op, params, steps, rng)):
        if not np.isfinite(state).all():
            bad = t
            break
        size, gap = float(np.linalg.norm(state)), float(np.linalg.norm(state - before))
        frob.append(size)
        cos.append(1 - float(np.clip(np.sum(state * before) / (size * np.linalg.norm(before) + EPS), -1, 1)))
        delta.append(gap / (size + EPS))
        last = state
    frob, cos, delta = np.array(frob), np.array(cos), np.array(delta)
    end, status = steps if bad is None else bad, "OK"
    if bad is not None:
        status = "EXPLOSION"
    elif np.std(last) / (np.mean(np.abs(last)) + EPS) < C.COLLAPSE_VARIATION:
        status = "COLLAPSED"
    elif steps >= 2:
        over = np.flatnonzero(frob > np.median(frob[: max(steps // 2, 1)]) * C.TRUNCATION_FACTOR)
        if len(over):
            m, at = min(C.MONOTONE_STEPS, steps - 1), max(int(over[0]) - 1, 0)
            grew = (np.diff(frob) > 0)[max(0, at - m + 1) : at + 1]
            if grew.sum() >= m:
                status, end = "OK_TRUNCATED", int(over[0])
    c, d, f = cos[:end], delta[:end], frob[:end]
    mean = c.sum() / (len(c) + EPS)
    std = float(np.sqrt(np.sum((c - mean) ** 2) / (len(c) + EPS)))
    period = find_period(c, steps) if len(c) else np.nan
    far = _outliers(c) if len(c) > 1 else np.zeros(0, bool)
    regime = "EXPLOSIVE" if status == "OK_TRUNCATED" else "FLAT" if std / (mean + EPS) < C.FLAT_CV and np.isnan(period) else "OSCILLATING" if not np.isnan(period) else "TRANSITIONAL" if far.any() else "MIXED"
    mask = np.zeros(steps, bool)
    if status in C.HEALTHY:
        mask[np.linspace(0, steps - 1, max(C.MASK_LEAST, int(steps * C.MASK_FLOOR))).astype(int)] = True
        out = np.flatnonzero(far | (_outliers(d, C.EPS_VARIATION) if len(d) > 1 else far))
        mask[out] = mask[np.minimum(out + 1, steps - 1)] = True
        margin = max(1, int(steps * C.MASK_MARGIN))
        mask = np.convolve(mask, np.ones(2 * margin + 1), "same") > 0.5
        pad = lambda v: np.append(v, np.zeros(steps - len(v)))
        if _turns(pad(f)) < 2 and _turns(pad(c)) < 2:
            mask = np.zeros(steps, bool)
            mask[[0, max(end - 1, 0)]] = True
        if status == "OK" and not np.isnan(period):
            beat = np.arange(steps) % period
            mask |= (beat < C.PERIOD_NEAR) | (beat > period - C.PERIOD_NEAR)
        mask &= np.arange(steps) < end
    turns = _turns(c) / 2 if len(c) > 2 else 0.0
    return {"run_status": status, "t_effective": end, "p1_regime_class": regime, "p1_estimated_period": period, "p1_cos_dissim_mean": mean, "p1_cos_dissim_std": std, "p1_cos_dissim_cv": std / (mean + EPS), "p1_n_zero_crossings": turns, "mask": mask}


@np.errstate(over="ignore", invalid="ignore")
def run(row: dict) -> dict:
    """Timelines and classification of one designed run."""
    x, op, params = initial(row)
    steps = int(row["max_it"])
    noise = lambda: atomics.generator(row["seed_run"], row["gamma_id"], row["encoding_id"], "steps")
    found = screen(x, op, params, steps, noise())
    mask, end = found.pop("mask"), found["t_effective"]
    a = np.full((steps, len(C.TIMELINES_A)), np.nan)
    at, b = [], []
    previous, gap = None, None
    probe = atomics.generator(row["seed_run"], row["gamma_id"], "probe")
    for t, (state, before) in enumerate(trajectory(x, op, params, steps, noise())):
        if t >= end:
            break
        values, gap = measure(state, previous, gap)
        a[t] = [values.get(k, np.nan) for k in C.TIMELINES_A]
        if mask[t]:
            values = spectra.spectrum(state) | spectra.jacobian(op, state, before, params, probe.standard_normal(state.shape))
            at.append(t)
            b.append([values[k] for k in C.TIMELINES_B])
        previous = state
    a, b = a[:end], np.array(b).reshape(len(at), len(C.TIMELINES_B))
    found |= {f"timeline_{k}": a[:, i].astype(np.float32) for i, k in enumerate(C.TIMELINES_A)}
    found |= {f"timeline_{k}": b[:, i].astype(np.float32) for i, k in enumerate(C.TIMELINES_B)}
    found["mask_t_indices"] = np.array(at, np.int32)
    found |= spectra.dynamic_modes(a[:, [C.TIMELINES_A.index(k) for k in C.DMD_OBSERVABLES]], end)
    return found


SCALARS = ("p1_cos_dissim_mean", "p1_cos_dissim_std", "p1_cos_dissim_cv", "p1_estimated_period", "p1_n_zero_crossings", *C.DMD_SCALARS)
RESULT = T.StructType(
    [
        T.StructField("run_status", T.StringType()),
        T.StructField("p1_regime_class", T.StringType()),
        T.StructField("t_effective", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in SCALARS],
        *[T.StructField(c, T.ArrayType(T.IntegerType() if c == "mask_t_indices" else T.FloatType())) for c in C.TIMELINE_COLUMNS],
    ]
)


#: Runs of a task: simulations take long and weigh little, so they are dealt by number and not by bytes.
RUNS_OF_A_TASK = 8


def tasks_for(runs: int) -> int:
    return max(1, -(-runs // RUNS_OF_A_TASK))


def simulate(design: DataFrame, tasks: int | None = None) -> DataFrame:
    """``design`` with the classification, dynamic modes and timelines of every run.

    Runs are dealt round by a hash of their design, so large states do not meet
    in one task; a null stands for a value that does not apply.
    """
    keys = [c for c in ("gamma_id", "encoding_id", "modifier_id", "gamma_params", "encoding_params", "n_dof", "seed_CI", "seed_run") if c in design.columns]
    dealt = design.repartition(tasks, *keys) if tasks else design.repartition(*keys)
    schema = T.StructType([*design.schema.fields, *RESULT.fields])

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
            for row in rows:
                row["n_dof"] = int(row["n_dof"])
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame([run(r) for r in rows])], axis=1)[schema.names]

    made = dealt.mapInPandas(step, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in SCALARS})


def timelines_long(runs: DataFrame, by: list[str], keys: tuple[str, ...]) -> DataFrame:
    """(by, key, t, v): the timelines of some keys, a row per step; NaN becomes null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"timeline_{k}").alias("x")) for k in keys])
    long = runs.select(*by, F.explode(pairs).alias("s")).select(*by, "s.key", F.posexplode("s.x").alias("t", "v"))
    return long.withColumn("v", F.when(~F.isnan("v"), F.col("v").cast("double")))
