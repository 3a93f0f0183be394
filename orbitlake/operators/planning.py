"""Designs as relations: axes, their products with compatibility rules, seeds and batches."""

from __future__ import annotations

import itertools
import json
import random
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from .ordered import numbered

AXIS = "id string, params string, rank int, rank_constraint string, differentiable boolean, is_composed boolean, weights array<double>"


def expand(params: dict[str, Any]) -> list[dict[str, Any]]:
    """All combinations of list-valued parameters; scalars stay."""
    names = list(params)
    return [dict(zip(names, v, strict=True)) for v in itertools.product(*[p if isinstance(p, list) else [p] for p in params.values()])]


def axis(spec: Any, registry: dict[str, dict], seed: int = 0) -> list[dict]:
    """The entries of an axis: ``"all"``, ``{"random": n}`` or a list of ``{id, params}``."""
    if spec == "all":
        spec = [{"id": i} for i in sorted(registry)]
    elif isinstance(spec, dict) and "random" in spec:
        ids = sorted(registry)
        spec = [{"id": i} for i in random.Random(seed).sample(ids, min(int(spec["random"]), len(ids)))]
    out = []
    for entry in spec:
        entry = {"id": entry} if isinstance(entry, str) else entry
        if entry["id"] not in registry:
            raise ValueError(f"unknown id: {entry['id']}")
        meta = registry[entry["id"]]
        for params in expand(entry.get("params") or {}):
            out.append({"id": entry["id"], "params": params, "rank": meta.get("rank"), "rank_constraint": meta.get("rank_constraint"), "differentiable": meta.get("differentiable"), "is_composed": False, "weights": None})
    return out


def weight_grid(low: float, high: float, step: float, repeat: int) -> list[tuple[float, ...]]:
    values = [low + i * step for i in range(int((high - low) / step) + 1)]
    return list(itertools.product(values, repeat=repeat))


def gamma_axis(spec: Any, registry: dict[str, dict]) -> list[dict]:
    """A plain axis, or ``{sequence: [axis, ...], weights: {range, step}}`` composed line by line.

    A composition's id joins its parts', parameters merge with the last winning,
    and it is differentiable if all parts are.
    """
    if not (isinstance(spec, dict) and "sequence" in spec):
        return axis(spec, registry)
    lines = [axis(line, registry) for line in spec["sequence"]]
    weights = spec.get("weights")
    grid = weight_grid(*weights["range"], weights["step"], len(lines)) if weights else [None]
    out = []
    for parts in itertools.product(*lines):
        for w in grid:
            names = [p["id"] if w is None else f"w_{x:.2f}-{p['id']}" for p, x in zip(parts, w or [0] * len(parts), strict=True)]
            merged: dict[str, Any] = {}
            for p in parts:
                merged |= p["params"]
            out.append({"id": "-".join(names), "params": merged, "rank": None, "rank_constraint": None, "differentiable": all(p["differentiable"] for p in parts), "is_composed": True, "weights": None if w is None else list(w)})
    return out


def axis_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """A design's own entries as a table: as many rows as its YAML lists, so it may be broadcast."""
    rows = [(e["id"], json.dumps(e["params"]), e["rank"], None if e["rank_constraint"] is None else str(e["rank_constraint"]), e["differentiable"], e["is_composed"], e["weights"]) for e in entries]
    return spark.createDataFrame(rows, AXIS)


def effective_rank(meta_rank: Column, params: Column) -> Column:
    return F.coalesce(meta_rank, F.get_json_object(params, "$.rank").cast("int"), F.lit(C.RANK_DEFAULT))


def compatible(constraint: Column, rank: Column) -> Column:
    """Whether an operator's rank constraint allows a tensor's rank."""
    return F.when(constraint.isNull(), True).when(constraint.isin("2", "square"), rank == 2).otherwise(constraint.cast("int") == rank)


def small_enough(rank: Column, n_dof: Column) -> Column:
    return ~((rank >= C.BIG_RANK) & (n_dof >= C.BIG_N_DOF))


def seed_of_run(seed: Column, gamma_id: Column, encoding_id: Column) -> Column:
    """The seed with its low 32 bits mixed: (seed * 2654435761 + first 4 MD5 bytes of the ids, little endian) mod 2**32."""
    digest = F.md5(F.concat(gamma_id, F.lit(":"), encoding_id))
    word = F.conv(F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("decimal(38,0)")
    low = (seed.cast("decimal(20,0)") % F.lit(2**32)).cast("decimal(20,0)")
    mixed = ((low * F.lit(C.KNUTH).cast("decimal(12,0)") + word) % F.lit(2**32).cast("decimal(20,0)")).cast("bigint")
    return F.shiftleft(F.shiftright(seed.cast("bigint"), 32), 32) + mixed


def design(spark: SparkSession, config: dict[str, Any], registries: dict[str, dict[str, dict]]) -> DataFrame:
    """One row per run of a design: the product of its axes under the rank and size rules."""
    listed = lambda v, default: default if v is None else v if isinstance(v, list) else [v]
    max_it = listed(config.get("max_it"), [200])
    if len(max_it) != 1:
        raise ValueError("a design has one max_it")
    gammas = axis_table(spark, gamma_axis(config["gamma"], registries["gamma"])).selectExpr("id gamma_id", "params gamma_params", "rank_constraint", "differentiable", "is_composed", "weights")
    encodings = axis_table(spark, axis(config["encoding"], registries["encoding"]))
    encodings = encodings.select(F.col("id").alias("encoding_id"), F.col("params").alias("encoding_params"), effective_rank(F.col("rank"), F.col("params")).alias("rank_eff"))
    modifiers = axis_table(spark, axis(config.get("modifier") or [{"id": "M0"}], registries["modifier"])).selectExpr("id modifier_id", "params modifier_params")
    sizes = spark.createDataFrame([(int(n),) for n in listed(config.get("n_dof"), [10])], "n_dof int")
    # A null seed is drawn here, once, and stands in the run table like any other.
    drawn = lambda s: random.SystemRandom().getrandbits(31) if s is None else int(s)
    seeds = lambda name: spark.createDataFrame([(drawn(s),) for s in listed(config.get(name), [None])], f"{name} bigint")
    runs = product(gammas, F.broadcast(encodings), F.broadcast(sizes))
    for other in (modifiers, seeds("seed_CI"), seeds("seed_run")):
        runs = runs.crossJoin(F.broadcast(other))
    return runs.withColumns({"phase": F.lit(config.get("phase")), "max_it": F.lit(int(max_it[0])), "seed_run": seed_of_run(F.col("seed_run"), F.col("gamma_id"), F.col("encoding_id"))})


def product(gammas: DataFrame, encodings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every gamma (``rank_constraint``) with every encoding (``rank_eff``) that it allows and every size (``n_dof``) that is not too large for it."""
    runs = gammas.join(encodings, compatible(F.col("rank_constraint"), F.col("rank_eff")))
    return runs.crossJoin(sizes).filter(small_enough(F.col("rank_eff"), F.col("n_dof")))


def groups(runs: DataFrame) -> DataFrame:
    """The homogeneous groups of a design and their sizes."""
    return runs.groupBy("gamma_id", "rank_eff", "n_dof").agg(F.count("*").alias("n_runs"))


def dry_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("n_samples"), F.count_distinct("gamma_id", "rank_eff", "n_dof").alias("n_groups"), F.first("max_it").alias("max_it"))


def batches(df: DataFrame, keys: list[str], order: list[str], size: int = C.BATCH) -> DataFrame:
    """``df`` plus ``batch``: rows of a group numbered in chunks of ``size``; a group of any size is dealt to many tasks."""
    return numbered(df, keys, order, "__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def peak_bytes(n_dof: Column, rank: Column, batch: Column, max_it: Column, differentiable: Column, element: int = 2, jvp: float = 4.0, density: float = 0.3) -> Column:
    """What a batch holds at its peak: three states and the wider pass's timelines, masks, and products of differentiable operators."""
    state = F.pow(n_dof.cast("double"), rank.cast("double")) * element
    first, second = state * 3 + max_it * (4 * element), state * 3 + max_it * (26 * element) + 8
    extra = F.when(differentiable, state * jvp * density).otherwise(0.0)
    return batch * (F.greatest(first, second) + max_it * 4 + extra)


def split_size(batch: Column, peak: Column, budget: float, least: int = 1) -> Column:
    """The largest batch, by halving, whose share of ``peak`` fits the budget."""
    halvings = F.greatest(F.ceil(F.log2(peak / F.lit(budget))), F.lit(0))
    return F.greatest(F.floor(batch / F.pow(F.lit(2.0), halvings)), F.lit(least)).cast("int")


def split_jobs(jobs: DataFrame, batch: str, peak: Column, budget: float, least: int = 1) -> DataFrame:
    """A row for every chunk of a job: ``jobs`` plus ``chunk``, ``first`` (its first run) and ``n_chunk`` (its runs).

    A job of ``batch`` runs whose ``peak`` is over the budget is halved until its
    share fits, and cut into chunks of that size; jobs without runs have none.
    """
    size = split_size(F.col(batch), peak, budget, least)
    cut = jobs.withColumn("__size", size).filter(F.col(batch) > 0).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col(batch).cast("long") - 1, F.col("__size").cast("long"))))
    return cut.select(*jobs.columns, F.floor(F.col("first") / F.col("__size")).alias("chunk"), "first", F.least(F.col("__size").cast("long"), F.col(batch) - F.col("first")).alias("n_chunk"))
