"""Names of clusters from slots: rules on medians, with confidences from percentile ranks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import summaries

# The slots in the order of a name.  A term is (token, kind, arguments, direction); the first that holds wins.
SLOTS = {
    "CND": {"mode": "threshold", "features": {"inf_frac": "health_has_inf", "condition": "f1_condition_number_mean"}, "terms": [("CND!", "inf_frac", 0.20, "upper"), ("CND~", "condition", 1e6, "upper")]},
    "AMP": {"mode": "zones", "features": {"value": "ps_norm_ratio", "iqr": "ps_frob_delta", "inf_frac": "health_has_inf"}, "terms": [("AMP>>", "inf", None, None), ("AMP<<", None, 0.10, "lower"), ("AMP~0", 0.10, 1.30, None), ("AMP+", 1.30, 3.0, "upper"), ("AMP++", 3.0, 10.0, "upper"), ("AMP>>>", 10.0, None, "upper")], "sentinel": 148.413},
    "ENT": {"mode": "delta", "features": {"value": "f2_von_neumann_entropy_delta"}, "neutral": 0.05, "terms": [("ENT+", 0.05, "upper"), ("ENT-", -0.05, "lower")]},
    "RNK": {"mode": "delta", "features": {"value": "f1_effective_rank_delta"}, "neutral": 0.5, "terms": [("RNK+", 0.5, "upper"), ("RNK-", -0.5, "lower")]},
    "LYA": {"mode": "delta", "features": {"value": "f4_lyapunov_empirical_mean", "std": "f4_lyapunov_empirical_std"}, "neutral": 0.05, "terms": [("LYA+", 0.05, "upper"), ("LYA-", -0.05, "lower")], "restless": ("LYA~", 0.3)},
    "DMD": {"mode": "zones", "features": {"value": "f7_dmd_spectral_radius", "complex": "f7_dmd_n_complex_pairs"}, "terms": [("DMD>>", 1.0, None, "upper"), ("DMDosc", "complex", None, None), ("DMD<1", None, 1.0, "lower")]},
    "LAG": {"mode": "delta", "features": {"value": "ps_first_min_ac_frob"}, "neutral": 5.0, "terms": [("LAG-", -5.0, "lower"), ("LAG+", 5.0, "upper")]},
    "PNN": {"mode": "delta", "features": {"value": "ps_pnn40_von_neumann"}, "neutral": 0.10, "terms": [("PNN+", 0.30, "upper"), ("PNN-", 0.05, "lower")]},
    "SEQ": {"mode": "uncalibrated", "features": {}, "terms": []},
}
SEPARATOR, LEAST_IN_NAME, LEAST_SHOWN = "·", 0.60, 0.50
# Features that today's run table has under other names; used only if asked for.
ALIASES = {
    "f4_lyapunov_empirical_mean": "lyap_empirical_mean",
    "f4_lyapunov_empirical_std": "lyap_empirical_std",
    "ps_pnn40_von_neumann": "ps_pnn40_shannon_comp",
}


def _clip(x: float, low: float = 0.0) -> float:
    return min(max(x, low), 1.0)


def confidence(rank: float, direction: str) -> float:
    return _clip(1 - rank if direction == "lower" else 0.5 + (rank - 0.5))


@dataclass
class Cluster:
    """Medians of a cluster's features, and the percentile rank of each among all values of its stratum."""

    medians: dict[str, float]
    ranks: dict[str, float]
    names: dict[str, str] = field(default_factory=dict)

    def get(self, name: str | None) -> float | None:
        return self.medians.get(self.names.get(name, name)) if name else None

    def rank(self, name: str) -> float:
        return self.ranks.get(self.names.get(name, name), 0.5)


def _zones(slot: dict, c: Cluster) -> tuple[str, float] | None:
    feature = slot["features"]["value"]
    value = c.get(feature)
    for token, low, high, direction in slot["terms"]:
        if low == "inf":
            if (c.get(slot["features"]["inf_frac"]) or 0) > 0:
                return token, 1.0
            continue
        if low == "complex":
            if (c.get(slot["features"]["complex"]) or 0) > 0:
                return token, 1.0
            continue
        if value is None or (low is not None and value < low) or (high is not None and value >= high):
            continue
        if "sentinel" in slot and abs(value - slot["sentinel"]) < 0.5:
            return token, 1.0
        if direction is None:
            spread = slot["features"].get("iqr")
            return token, _clip(1 - c.rank(spread), 0.3) if spread and c.get(spread) is not None else 0.5
        return token, confidence(c.rank(feature), direction)
    return None


def _delta(slot: dict, c: Cluster) -> tuple[str, float] | None:
    feature = slot["features"]["value"]
    value = c.get(feature)
    if value is None:
        return None
    if abs(value) < slot["neutral"]:
        token, least = slot.get("restless", (None, None))
        spread = c.get(slot["features"].get("std"))
        return (token, confidence(c.rank(slot["features"]["std"]), "upper")) if token and spread is not None and spread > least else None
    for token, limit, direction in slot["terms"]:
        if value > limit if direction == "upper" else value < limit:
            return token, confidence(c.rank(feature), direction)
    return None


def _threshold(slot: dict, c: Cluster) -> tuple[str, float] | None:
    for token, key, limit, direction in slot["terms"]:
        value = c.get(slot["features"][key])
        if value is not None and value > limit:
            return token, confidence(c.rank(slot["features"][key]), direction)
    return None


EVALUATORS = {"zones": _zones, "delta": _delta, "threshold": _threshold, "uncalibrated": lambda slot, c: None}


def name(c: Cluster) -> dict:
    """The cluster's name, its slots with confidences, and slots too unsure for the name."""
    slots = {k: EVALUATORS[s["mode"]](s, c) for k, s in SLOTS.items()}
    sure = {k: v for k, v in slots.items() if v and v[1] >= LEAST_IN_NAME}
    unsure = {k: v for k, v in slots.items() if v and LEAST_SHOWN <= v[1] < LEAST_IN_NAME}
    tokens = [v[0] for v in sure.values()]
    return {"name": SEPARATOR.join(tokens) if tokens else "UNCATEGORIZED", "slots": sure, "secondary": unsure, "open": ["[SEQ=?]"]}


def name_clusters(df: DataFrame, cluster: str, features: list[str], aliases: bool = False) -> dict[int, dict]:
    """Names of all clusters of a stratum (label >= 0) from their raw features.

    What reaches the driver is one row per cluster and feature.
    """
    clustered = df.filter(F.col(cluster) >= 0)
    medians = summaries.cluster_profile(clustered, cluster, features).select(cluster, "feature", "median")
    ranked = summaries.ranks(summaries.unpivot(df, [], features), medians.withColumn("x", F.col("median")))
    found: dict[int, Cluster] = {}
    for r in ranked.collect():
        c = found.setdefault(r[cluster], Cluster({}, {}, ALIASES if aliases else {}))
        if r["median"] is not None:
            c.medians[r["feature"]], c.ranks[r["feature"]] = r["median"], r["rank"] if r["rank"] is not None else 0.5
    return {k: name(c) for k, c in sorted(found.items())}


#: What a dominant regime says about emergence.
EMERGENCE = {"FLAT": "candidate attractor", "OSCILLATING": "limit cycle", "TRANSITIONAL": "passes between regimes", "EXPLOSIVE": "diverges", "MIXED": "mixed regime"}
#: What slots say about information (rank, entropy) and about what the transition does (exponent, modes, size), by the head of their terms.
INFORMATION = {"RNK": {"RNK+": "effective rank grows", "RNK-": "effective rank shrinks"}, "ENT": {"ENT+": "entropy grows", "ENT-": "entropy shrinks"}}
ACTION = {
    "LYA": {"LYA+": "amplifies", "LYA-": "contracts", "LYA~": "alternates"},
    "DMD": {"DMD>>": "unstable modes", "DMDosc": "oscillating modes", "DMD<1": "damped modes"},
    "AMP": {"AMP<<": "size collapses", "AMP>>": "size explodes", "AMP~0": "size is kept"},
}


def interpret(slots: dict, regime: str | None, truncated: float) -> dict[str, list[str]]:
    """Answers about a cluster to four questions; a question without an answer is left out.

    ``information``: does the state gain structure or order; ``action``: what
    does the transition do to it; ``emergence``: what its regime and truncated
    runs say; ``onset``: not to be judged where numbers are unsound, else
    whether shrinking entropy under damped modes makes it a candidate for a
    holographic attractor.
    """
    token = lambda k: (slots.get(k) or ("", 0))[0]
    said = lambda table: [text for k, terms in table.items() for text in [next((v for t, v in terms.items() if t in token(k)), None)] if text]
    emergence = [EMERGENCE[regime]] if regime in EMERGENCE else []
    if truncated > 0:
        emergence.append(f"{truncated:.0%} truncated" + (", often unstable" if truncated > 0.5 else ""))
    onset = ["numerically unsound, not to be judged"] if slots.get("CND") else ["candidate for a holographic attractor"] if "ENT-" in token("ENT") and "DMD<1" in token("DMD") else []
    answers = {"information": said(INFORMATION), "action": said(ACTION), "emergence": emergence, "onset": onset}
    return {k: v for k, v in answers.items() if v}
