"""YAML configurations and plug-in discovery."""

from __future__ import annotations

import ast
import warnings
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession

from . import filesystem


def load_yaml(path: str | Path, spark: SparkSession | None = None) -> dict[str, Any]:
    """A YAML file; with ``spark`` from any store that Spark reaches."""
    if spark is not None:
        return yaml.safe_load(filesystem.read_text(spark, str(path))) or {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_pool(path: str | Path | None, spark: SparkSession | None = None) -> dict[str, Any]:
    """Exclusions and ranges of a pool; a missing file gives none, with a warning; ``deprecated`` stands in for ``excluded``."""
    if path is None or not (Path(path).exists() if spark is None else filesystem.exists(spark, str(path))):
        warnings.warn(f"no pool configuration at {path}", stacklevel=2)
        return {"excluded": {}, "n_dof": {}}
    raw = load_yaml(path, spark)
    excluded = raw.get("excluded") or raw.get("deprecated") or {}
    names = {"gammas": "gamma_id", "encodings": "encoding_id", "modifiers": "modifier_id"}
    return {"excluded": {names[k]: v or [] for k, v in excluded.items() if k in names}, "n_dof": (raw.get("filters") or {}).get("n_dof") or raw.get("n_dof") or {}}


def load_analysis(path: str | Path | None, spark: SparkSession | None = None) -> dict[str, Any]:
    """What an analysis sets: ``scope``, ``protected`` features and ``correlation`` limit, ``log_limit``, ``peeling``, ``outliers`` share, ``projection`` rows (all, unless the file says how many).

    What the file leaves out has its default; a path of None gives the defaults
    alone.  Keys are those of the analysis files: scope, orthogonalization,
    log_dynamic_threshold, peeling, outliers, projection.
    """
    raw = load_yaml(path, spark) if path is not None else {}
    made, peeling = raw.get("orthogonalization") or {}, raw.get("peeling") or {}
    homogeneity, names = peeling.get("homogeneity") or {}, {"modifiers": "modifier_id", "gammas": "gamma_id", "encodings": "encoding_id", "phases": "phase"}
    config = lambda c: (c.get("metric", "cosine"), c.get("selection", "eom"), c.get("pca_dims"))
    plan = {
        "levels": peeling.get("max_levels"),
        "base": homogeneity.get("threshold_base"),
        "step": homogeneity.get("threshold_step"),
        "most": homogeneity.get("threshold_max"),
        "retries": peeling.get("max_resolution_steps"),
        "residual_share": peeling.get("residual_threshold"),
        "least": peeling.get("mcs_floor"),
        "first": (config(peeling["level_0"]),) if peeling.get("level_0") else None,
        "residual": tuple(map(config, peeling["residual_configs"])) if peeling.get("residual_configs") else None,
    }
    return {
        "scope": {names.get(k, k): v for k, v in (raw.get("scope") or {}).items()},
        "select": bool(made.get("enabled", True)),
        "protected": tuple(made.get("protected_features") or ()),
        "correlation": float(made.get("correlation_threshold", 0.98)),
        "log_limit": float(raw.get("log_dynamic_threshold", 1e6)),
        "peeling": {k: v for k, v in plan.items() if v is not None},
        "outliers": float((raw.get("outliers") or {}).get("contamination", 0.10)),
        "projection": (raw.get("projection") or {}).get("max_projection_samples"),
    }


def discover(folder: str | Path) -> dict[str, dict[str, Any]]:
    """``METADATA`` of every module in a folder, read from its syntax tree without importing it; deprecated files are skipped."""
    found = {}
    for path in sorted(Path(folder).glob("*.py")):
        if "_deprecated_" in path.name:
            continue
        for node in ast.parse(path.read_text(encoding="utf-8")).body:
            targets = node.targets if isinstance(node, ast.Assign) else []
            if any(isinstance(t, ast.Name) and t.id == "METADATA" for t in targets):
                meta = ast.literal_eval(node.value)
                if "id" not in meta:
                    raise ValueError(f"{path.name}: METADATA has no id")
                found[meta["id"]] = meta
    return found
