import json
import math

import numpy as np
import pytest

from orbitlake.functions import atomics, spectra
from orbitlake.operators import planning, simulate
from orbitlake.plans import workflows
from orbitlake.sources import tables

ROW = {"modifier_id": "M0", "gamma_params": "{}", "encoding_params": "{}", "modifier_params": "{}", "n_dof": 5, "max_it": 30, "seed_CI": 3, "seed_run": 4}


def run(gamma, encoding, **more):
    return simulate.run(ROW | {"gamma_id": gamma, "encoding_id": encoding} | more)


def test_decay_of_the_identity_is_exact():
    r = run("GAM-004", "SYM-001")
    assert r["timeline_frob"] == pytest.approx([math.sqrt(5) * math.exp(-0.05 * t) for t in range(30)], rel=1e-6)
    assert r["timeline_delta_D"][1:] == pytest.approx(math.exp(0.05) - 1, rel=1e-5)
    assert r["timeline_lyap_empirical"][2:] == pytest.approx(-0.05, abs=1e-5)
    assert np.isnan(r["timeline_delta_D"][0]) and np.isnan(r["timeline_lyap_empirical"][1])
    assert r["run_status"] == "OK"


def test_identity_spectrum():
    s = spectra.spectrum(np.eye(6))
    assert s["f2_von_neumann_entropy"] == pytest.approx(math.log(6), abs=1e-6)
    assert s["f1_effective_rank"] == pytest.approx(6, abs=1e-5)
    assert s["f1_rank1_residual"] == pytest.approx(math.sqrt(5 / 6), abs=1e-6)
    assert s["f1_condition_number"] == pytest.approx(1, abs=1e-6)


def test_a_separable_tensor_has_no_entropy():
    x = atomics.SOURCES["RN-004"].create(5, {"rank": 3}, atomics.generator(1))
    s = spectra.spectrum(x)
    assert s["f2_von_neumann_entropy"] == pytest.approx(0, abs=1e-5) and s["f3_entanglement_entropy_mode1"] == pytest.approx(0, abs=1e-5)


@pytest.mark.parametrize("op", [o for o in atomics.OPERATORS.values() if o.differentiable], ids=lambda o: o.id)
def test_derivatives(op):
    rng = np.random.default_rng(0)
    x, p, v, w = (rng.standard_normal((4, 4)) * 0.3 for _ in range(4))
    params = op.prepare({}, 4, rng) if op.prepare else {}
    h = 1e-6
    slope = (op.step(x + h * v, p, params, rng) - op.step(x - h * v, p, params, rng)) / (2 * h)
    assert op.jvp(v, x, p, params) == pytest.approx(slope, abs=1e-6)
    assert np.sum(w * op.jvp(v, x, p, params)) == pytest.approx(np.sum(v * op.vjp(w, x, p, params)))


def test_statuses():
    assert run("GAM-013", "ASY-001", gamma_params=json.dumps({"eta": 5.0}))["run_status"] == "EXPLOSION"
    assert run("GAM-007", "SYM-007", gamma_params=json.dumps({"epsilon": 0.9}), max_it=60)["run_status"] == "COLLAPSED"
    assert run("GAM-003", "SYM-001", gamma_params=json.dumps({"gamma": 2.0}), max_it=60)["run_status"] == "OK_TRUNCATED"


def test_all_sources_and_operators_run():
    for s in atomics.SOURCES:
        assert run("GAM-001", s)["t_effective"] == 30
    for o in atomics.OPERATORS:
        assert len(run(o, "ASY-001")["timeline_frob"]) > 0
    with pytest.raises(KeyError):
        run("GAM-999", "SYM-001")


def test_runs_are_reproducible():
    a, b = run("GAM-009", "ASY-001"), run("GAM-009", "ASY-001")
    assert (a["timeline_frob"] == b["timeline_frob"]).all()


def test_dynamic_modes_of_a_rotation():
    t = np.arange(200)
    found = spectra.dynamic_modes(np.stack([np.cos(0.3 * t), np.sin(0.3 * t)], 1), 200)
    assert found["f7_dmd_spectral_radius"] == pytest.approx(1, abs=1e-3) and found["f7_dmd_n_complex_pairs"] == 2


def test_expansion_rules(spark):
    regs = atomics.registries()
    design = {"phase": "x", "gamma": [{"id": "GAM-001", "params": {"beta": [1.0, 3.0]}}, {"id": "GAM-002"}], "encoding": [{"id": "SYM-001"}, {"id": "RN-001"}], "n_dof": [10, 250], "max_it": 5, "seed_CI": [1, 2]}
    runs = planning.design(spark, design, regs)
    # GAM-001 twice: two sizes at rank 2, one at rank 3; GAM-002 at rank 2 only; two seeds each.
    assert runs.count() == 2 * (2 * 3 + 2)
    assert planning.dry_run(runs).first()["n_groups"] == 2 + 1 + 2
    with pytest.raises(ValueError):
        planning.axis([{"id": "nope"}], regs["gamma"])
    with pytest.raises(ValueError):
        planning.design(spark, design | {"max_it": [1, 2]}, regs)
    assert len(planning.axis({"random": 3}, regs["gamma"])) == 3
    composed = planning.gamma_axis({"sequence": [["GAM-001"], ["GAM-004", "GAM-009"]], "weights": {"range": [0.5, 1.0], "step": 0.5}}, regs["gamma"])
    assert len(composed) == 2 * 4 and composed[0]["id"] == "w_0.50-GAM-001-w_0.50-GAM-004" and not composed[-1]["differentiable"]


def test_a_design_from_end_to_end(spark):
    design = {"phase": "x", "gamma": [{"id": "GAM-001"}, {"id": "GAM-004"}, {"id": "GAM-009"}], "encoding": [{"id": "SYM-001"}, {"id": "ASY-001"}], "n_dof": 4, "max_it": 24, "seed_CI": [1], "seed_run": [1]}
    made = workflows.run_design(spark, design).cache()
    rows = {(r["gamma_id"], r["encoding_id"]): r for r in made.collect()}
    assert len(rows) == 6
    still = rows["GAM-004", "SYM-001"]
    assert still["frob_mean"] == pytest.approx(np.mean([2 * math.exp(-0.05 * t) for t in range(24)]), rel=1e-5)
    assert rows["GAM-009", "ASY-001"]["f4_trace_J_mean"] is None and still["f4_trace_J_mean"] is not None
    assert still["frob_gradient_mean"] is None
    assert not [c for c in tables.feature_names() if c not in made.columns]
    full = tables.conform(made, tables.run_schema(), strict=False)
    assert len(full.columns) == 168
    roles = tables.column_roles(full)
    assert len(roles["features"]) == 127 and not roles["unregistered"]
    with pytest.raises(KeyError):
        tables.conform(made.drop("frob_mean"), tables.run_schema())
