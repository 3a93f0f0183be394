"""Observables that need decompositions or derivatives: singular values, Jacobian products, dynamic modes."""

from __future__ import annotations

import numpy as np

from .atomics import Operator
from .constants import EPS, TIMELINES_B


def unfolding(x: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(x, axis, 0).reshape(x.shape[axis], -1)


def _entropy(s: np.ndarray) -> np.ndarray:
    q = s**2 / (np.sum(s**2, axis=1, keepdims=True) + EPS)
    return -np.sum(q * np.log(q + EPS), axis=1)


def spectra(states: np.ndarray) -> dict[str, np.ndarray]:
    """Features of the singular values of many states of one shape: of the first unfolding, and of the second for rank 3 and more."""
    n = len(states)
    s = np.linalg.svd(states.reshape(n, states.shape[1], -1), compute_uv=False)
    p = s / (s.sum(1, keepdims=True) + EPS)
    size, k = np.sum(s**2, axis=1), s.shape[1]
    q = s**2 / (size[:, None] + EPS)
    i = np.arange(k) - (k - 1) / 2
    nothing = np.full(n, np.nan)
    out = {
        "f1_effective_rank": np.exp(-np.sum(p * np.log(p + EPS), axis=1)),
        "f1_spectral_gap": (s[:, 0] - s[:, 1]) / (s[:, 0] + EPS) if k > 1 else np.ones(n),
        "f1_nuclear_frobenius_ratio": s.sum(1) / (np.sqrt(size) + EPS),
        "f1_sv_decay_rate": -(np.log(s + EPS) @ i) / (i @ i) if k > 1 else np.zeros(n),
        "f1_rank1_residual": np.sqrt(np.sum(s[:, 1:] ** 2, axis=1)) / (np.sqrt(size) + EPS),
        "f1_condition_number": s[:, 0] / (s[:, -1] + EPS),
        "f2_von_neumann_entropy": _entropy(s),
        "f2_renyi2_entropy": -np.log(np.sum(q**2, axis=1) + EPS),
        "f3_entanglement_entropy_mode0": _entropy(s),
        "f3_entanglement_entropy_mode1": nothing,
        "f3_inter_mode_sv_var": nothing,
    }
    if states.ndim >= 4:
        t = np.linalg.svd(np.moveaxis(states, 2, 1).reshape(n, states.shape[2], -1), compute_uv=False)
        out["f3_entanglement_entropy_mode1"] = _entropy(t)
        out["f3_inter_mode_sv_var"] = np.var([s[:, 0], t[:, 0]], axis=0)
    return out


def spectrum(x: np.ndarray) -> dict[str, float]:
    """:func:`spectra` of one state."""
    return {k: float(v[0]) for k, v in spectra(x[None]).items()}


def jacobian(op: Operator, x: np.ndarray, p: np.ndarray, params: dict, v: np.ndarray) -> dict[str, float]:
    """Trace estimate, size, asymmetry and log size of the step's Jacobian along ``v``; NaN where it has none."""
    if not op.differentiable or op.jvp is None:
        return dict.fromkeys(TIMELINES_B[-4:], np.nan)
    jv, tv = op.jvp(v, x, p, params), op.vjp(v, x, p, params)
    size = float(np.linalg.norm(jv))
    return {"f4_trace_J": float(np.sum(v * jv)), "f4_jvp_norm": size, "f4_jacobian_asymmetry": float(np.linalg.norm(jv - tv)) / (size + EPS), "f4_local_lyapunov": float(np.log(size + EPS))}


def modes(series: list[np.ndarray], forget: float = 1.0, start: float = 1e4) -> dict[str, np.ndarray]:
    """Eigenvalue features of the linear maps from step to step of many runs, fitted by recursive least squares.

    A run's array is (time, observable); runs may differ in length, and one
    moves until its own end.
    """
    n, d = len(series), series[0].shape[1] if series else 0
    steps = np.array([len(x) for x in series])
    padded = np.zeros((n, steps.max(initial=0), d))
    for row, x in zip(padded, series, strict=True):
        row[: len(x)] = np.where(np.isfinite(x), x, 0.0)
    a, p = np.zeros((n, d, d)), np.tile(np.eye(d) * start, (n, 1, 1))
    for t in range(1, padded.shape[1]):
        on = np.flatnonzero(t < steps)
        x, y = padded[on, t - 1], padded[on, t]
        px = np.einsum("nij,nj->ni", p[on], x)
        gain = px / (forget + np.einsum("ni,ni->n", x, px) + EPS)[:, None]
        a[on] += np.einsum("ni,nj->nij", y - np.einsum("nij,nj->ni", a[on], x), gain)
        p[on] = (p[on] - np.einsum("ni,nj->nij", px, gain)) / forget
    values = np.linalg.eigvals(np.where(np.isfinite(a), a, 0.0))
    size = np.abs(values)
    share = size / (size.sum(1, keepdims=True) + EPS)
    known = lambda v: np.where(steps < 3, np.nan, v)
    return {
        "f7_dmd_spectral_radius": known(size.max(1, initial=0.0)),
        "f7_dmd_n_complex_pairs": np.sum(np.abs(values.imag) > 1e-4, axis=1).astype(float),
        "f7_dmd_spectral_entropy": known(-np.sum(share * np.log(share + EPS), axis=1)),
        "f7_dmd_decay_rate": known(np.log(size.max(1, initial=0.0) + EPS)),
    }


def dynamic_modes(series: np.ndarray, steps: int, forget: float = 1.0, start: float = 1e4) -> dict[str, float]:
    """:func:`modes` of the first ``steps`` steps of one run."""
    return {k: float(v[0]) for k, v in modes([series[:steps]], forget, start).items()}
