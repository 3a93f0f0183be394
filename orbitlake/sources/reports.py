"""JSON and text reports of small results."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import seeded_sample
from . import filesystem


def plain(value: Any) -> Any:
    """A value as JSON can hold it: NaN is null, infinities are text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else ("inf" if value > 0 else "-inf") if math.isinf(value) else value
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value if isinstance(value, (str, int, bool, type(None))) else str(value)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """A small result as JSON in any store that Spark reaches."""
    filesystem.write_text(spark, path, json.dumps(plain(value), indent=2, ensure_ascii=False))


def dump(df: DataFrame, path: str, axes: list[str], columns: list[str], sample: int | None = None, seed: int = 42) -> None:
    """Rows as JSON lines {composition, features}; ``sample`` takes that many, those first by a seeded hash."""
    if sample is not None:
        df = seeded_sample(df, axes, sample, seed)
    value = lambda c: F.when(F.isnan(c), None).when(F.abs(c) == float("inf"), F.when(F.col(c) > 0, "inf").otherwise("-inf")).otherwise(F.col(c).cast("string")).alias(c)
    df.select(F.struct(*axes).alias("composition"), F.struct(*[value(c) for c in columns]).alias("features")).write.mode("overwrite").json(path)


def text_report(strata: dict[str, dict], verbose: bool = False) -> str:
    """Strata and their clusters as text, a paragraph each; ``verbose`` adds levels, cohesion and slots."""
    lines = []
    for name, s in strata.items():
        lines += [f"== {name}: {s['n_runs']} runs, {len(s['clusters'])} clusters, {s['n_noise']} unclustered =="]
        lines += [f"  {k}: {c['name']} ({c['n']} runs, {'; '.join(f'{q}: ' + ', '.join(a) for q, a in c['interpretation'].items())})" for k, c in s["clusters"].items()]
        if verbose:
            lines += [f"    {k}: level {c['level']}, cohesion {c['homogeneity']:.3f}, slots {', '.join(f'{t} {w:.2f}' for t, w in c['slots'].values()) or 'none'}" for k, c in s["clusters"].items()]
            lines += [f"    features kept: {', '.join(s['features'])}"]
    return "\n".join(lines) + "\n"
