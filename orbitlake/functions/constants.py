"""Names and constants of the run table.  Fixed values: results depend on them."""

from __future__ import annotations

# Guards against division by zero (observables and features; scaling and naming; variation).
EPS = 1e-8
EPS_SCALE = 1e-10
EPS_VARIATION = 1e-12

# Reducers of each timeline; a scalar is named {timeline}_{reducer}.
AGG_MAP_A = {
    "frob": ("mean", "final", "delta"),
    "delta_D": ("mean", "std", "total"),
    "cos_dissim": ("mean", "std", "final"),
    "is_finite": ("final",),
    "shannon_comp": ("mean", "std", "final", "delta"),
    "ipr": ("mean", "std", "final"),
    "mode_asymmetry_o2": ("mean", "std", "final", "delta"),
    "bregman_cost": ("mean", "total"),
    "lyap_empirical": ("mean", "std", "final"),
    "frob_gradient": ("mean", "final"),
    "volume_proxy": ("mean", "std", "final", "delta"),
}
AGG_MAP_B = {
    "f1_effective_rank": ("mean", "final", "delta"),
    "f1_spectral_gap": ("mean", "final"),
    "f1_nuclear_frobenius_ratio": ("mean", "final"),
    "f1_sv_decay_rate": ("mean", "final"),
    "f1_rank1_residual": ("mean", "final"),
    "f1_condition_number": ("mean", "delta"),
    "f2_von_neumann_entropy": ("mean", "std", "final", "delta"),
    "f2_renyi2_entropy": ("mean", "final", "delta"),
    "f3_entanglement_entropy_mode0": ("mean", "final"),
    "f3_entanglement_entropy_mode1": ("mean", "final"),
    "f3_inter_mode_sv_var": ("mean", "final"),
    "f4_trace_J": ("mean", "std", "final"),
    "f4_jvp_norm": ("mean", "final"),
    "f4_jacobian_asymmetry": ("mean", "final", "delta"),
    "f4_local_lyapunov": ("mean", "std", "final"),
}

# Columns of a run besides features and timelines, with their Parquet types.
METADATA = {
    "phase": "string",
    "gamma_id": "string",
    "encoding_id": "string",
    "modifier_id": "string",
    "gamma_params": "string",
    "encoding_params": "string",
    "modifier_params": "string",
    "n_dof": "int",
    "rank_eff": "int",
    "max_it": "int",
    "seed_CI": "bigint",
    "seed_run": "bigint",
    "run_status": "string",
    "p1_regime_class": "string",
}
STATUSES = ("OK", "OK_TRUNCATED", "EXPLOSION", "COLLAPSED")
HEALTHY = ("OK", "OK_TRUNCATED")
REGIMES = ("FLAT", "OSCILLATING", "TRANSITIONAL", "EXPLOSIVE", "MIXED")

# Thresholds of classification and of the mask.
TRUNCATION_FACTOR, COLLAPSE_VARIATION, MONOTONE_STEPS = 1e9, 1e-4, 10
FLAT_CV, PERIOD_CORRELATION, TUKEY = 0.3, 0.3, 2.0
MASK_FLOOR, MASK_LEAST, MASK_MARGIN, PERIOD_NEAR = 0.02, 4, 0.01, 1.5

# Designs.
KNUTH, RANK_DEFAULT, BIG_RANK, BIG_N_DOF, BATCH = 2654435761, 3, 3, 250, 512

TIMELINES_A, TIMELINES_B = tuple(AGG_MAP_A), tuple(AGG_MAP_B)
TIMELINE_COLUMNS = tuple(f"timeline_{k}" for k in (*TIMELINES_A, *TIMELINES_B)) + ("mask_t_indices",)

# Series behind the features that are not plain reducers.
DMD_OBSERVABLES = tuple(k for k in TIMELINES_A if k not in ("is_finite", "frob_gradient"))
DMD_SCALARS = ("f7_dmd_spectral_radius", "f7_dmd_n_complex_pairs", "f7_dmd_spectral_entropy", "f7_dmd_decay_rate")
LAGGED_PAIRS = {
    "f6_te_frob_to_shannon_comp": ("frob", "shannon_comp"),
    "f6_te_lyap_empirical_to_frob": ("lyap_empirical", "frob"),
    "f6_te_cos_dissim_to_mode_asym_o2": ("cos_dissim", "mode_asymmetry_o2"),
    "f6_te_delta_D_to_bregman_cost": ("delta_D", "bregman_cost"),
}
AUTOCORRELATED = {"frob": "frob", "shannon_comp": "shannon_comp", "mode_asym_o2": "mode_asymmetry_o2"}
PNN = {"shannon_comp": "shannon_comp", "mode_asym_o2": "mode_asymmetry_o2"}
TEMPORAL = ("frob", "shannon_comp")
PHASIC = {"svn": "f2_von_neumann_entropy", "rank": "f1_effective_rank", "mode_asym_o2": "mode_asymmetry_o2"}


def c1_names() -> list[str]:
    return [f"{k}_{a}" for table in (AGG_MAP_A, AGG_MAP_B) for k, aggs in table.items() for a in aggs]

# Why a feature says nothing about a run, and the features of each reason.
NO_TRANSITION, ONE_TRANSITION, ONE_POINT, NO_PERIOD = "no transition", "fewer than two transitions", "fewer than two points", "no period"
RUNTIME_NULL = {
    "p1_estimated_period": NO_PERIOD,
    "mask_t_first_norm": NO_TRANSITION,
    "mask_t_last_norm": NO_TRANSITION,
    "mask_mean_spacing_norm": ONE_TRANSITION,
    **{f"phasic_{k}_{x}": ONE_POINT for k in PHASIC for x in ("n_reversals", "max_monotone_frac", "range_ratio")},
}
