"""K-d tree sharding: recursive weighted-median splits along the widest metadata dimension, in DataFrame functions only.

No row moves while the tree grows: each split point is found by refining
histograms that tasks pre-aggregate, so what reaches the driver is at most
(open nodes x BINS) rows whatever the input.  One shuffle at the end numbers
the rows of each shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import free_name
from .ordered import running_sums
from .storage import stored

#: Histogram bins of a node and pass; a cut is good enough if at most this part of a shard's bytes is off.
BINS, CLOSE_ENOUGH = 512, 0.0005
#: Levels of the tree that a pass follows for each row before the rows' nodes are stored anew.
STORED_LEVELS = 3
#: UTF-8 bytes of a text that one key compares (48 bits are exact in a double).
PIECE = 6
_LEAST_LOG = math.log(5e-324)


@dataclass
class Dimension:
    """A metadata column as numbers in its own order, the first key before the second and so on.

    A number has one key, a text one for every PIECE bytes behind what all
    texts of the table begin with, then its length.  Nulls (and NaN) come first;
    ``width`` is the stored column whose extent says how wide a node is.
    """

    name: str
    width: str
    keys: list[Callable[[], Column]]
    bounds: list[tuple[float, float]]


def _numeric(kind: str, column: Column) -> Column:
    value = column.cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else column.cast("double")
    value = F.nanvl(value, F.lit(None).cast("double"))
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.7e308)), F.lit(-1.7e308)))


def _piece(text: Column, at: int) -> Column:
    """Bytes ``at`` to ``at`` + PIECE of a text as a number, 0 behind its end."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), at + 1, PIECE)), 2 * PIECE, "0"), 16, 10).cast("double")


def dimensions(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Dimension]]:
    """``df`` with a column for the width of each dimension, and the dimensions."""
    kinds = dict(df.dtypes)
    texts = [c for c in names if kinds[c] == "string"]
    ends = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(texts) for k, f in (("min", F.min), ("max", F.max))], *[F.max(F.octet_length(c)).alias(f"len{i}") for i, c in enumerate(texts)]).first()
    out = []
    for i, c in enumerate(names):
        width = free_name(df, f"__width_{i}")
        filled = lambda column: F.coalesce(column, F.lit(0.0))
        known = lambda c=c, w=width: F.col(w).isNotNull().cast("double")
        if kinds[c] == "string":
            k = texts.index(c)
            least, most = (ends[f"min{k}"] or "").encode(), (ends[f"max{k}"] or "").encode()
            same = next((j for j, (x, y) in enumerate(zip(least, most)) if x != y), min(len(least), len(most)))
            length = ends[f"len{k}"] or 0
            df = df.withColumn(width, _piece(F.col(c), same))
            pieces = [lambda w=width: filled(F.col(w)), *[lambda c=c, j=j: filled(_piece(F.col(c), j)) for j in range(same + PIECE, length, PIECE)]]
            out.append(Dimension(c, width, [known, *pieces, lambda c=c: filled(F.octet_length(c).cast("double"))], [(0.0, 1.0), *[(0.0, 2.0 ** (8 * PIECE))] * len(pieces), (0.0, float(length))]))
        else:
            df = df.withColumn(width, _numeric(kinds[c], F.col(c)))
            out.append(Dimension(c, width, [known, lambda w=width: filled(F.col(w))], [(0.0, 1.0), (-1.7e308, 1.7e308)]))
    return df, out


@dataclass
class Node:
    """A node of the tree: ``leaves`` shards from ``first`` on; rows before ``cut`` (keys and values, the first decides) go left."""

    first: int
    leaves: int
    dim: str | None = None
    cut: list[tuple[Callable[[], Column], float]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def condition(self) -> Column:
        below = F.lit(False)
        for key, value in reversed(self.cut):
            below = (key() < F.lit(value)) | ((key() == F.lit(value)) & below)
        return below

    def assign(self) -> Column:
        """The first shard of the open node or leaf that a row is in."""
        if not self.children:
            return F.lit(self.first)
        left, right = self.children
        return F.when(self.condition(), left.assign()).otherwise(right.assign())

    def open(self) -> list[Node]:
        if self.children:
            return [n for c in self.children for n in c.open()]
        return [self] if self.leaves > 1 else []


class Search:
    """The cut of one node: the weighted quantile left leaves / leaves of its keys, narrowed down pass by pass.

    A pass counts the bytes of BINS ranges between ``lo`` and ``hi`` of the
    current key, of equal width or, where the last pass has left most bytes in
    one range, of equal ratio.  Where one value holds the quantile, the next key
    decides among the rows that have it.  Every pass leaves a smaller range, as
    ``lo`` and ``hi`` are values of rows in different bins.
    """

    def __init__(self, node: Node, keys: list[Callable[[], Column]], bounds: list[tuple[float, float]], weight: float):
        self.node, self.keys, self.bounds, self.weight = node, keys, bounds, weight
        self.goal, self.below, self.done, self.ratio = weight * ((node.leaves + 1) // 2) / node.leaves, 0.0, False, False
        self.fixed: list[float] = []
        self.lo, self.hi = bounds[0]

    def columns(self) -> tuple[Column, Column, Column]:
        """Whether a row is in the range, its key and its bin."""
        key = self.keys[len(self.fixed)]()
        inside = (key >= F.lit(self.lo)) & (key <= F.lit(self.hi))
        for other, value in zip(self.keys, self.fixed):
            inside = (other() == F.lit(value)) & inside
        half = 0.5 if math.isinf(self.hi - self.lo) else 1.0  # their difference may be too large for a double
        span = self.hi * half - self.lo * half
        over = key * half - F.lit(self.lo * half)
        if self.ratio or not span / BINS:
            step = (math.log(span) - _LEAST_LOG) / (BINS - 2) if span else 1.0
            at = F.when(over > 0, F.floor((F.log(over) - F.lit(_LEAST_LOG)) / F.lit(step)) + 1).otherwise(F.lit(0))
        else:
            at = F.floor(over / F.lit(span / BINS))
        return inside, key, F.least(at, F.lit(BINS - 1)).cast("int")

    def narrow(self, bins: list[tuple[int, float, float, float]]) -> None:
        """``bins``: (bin, bytes, least and greatest key) of all rows in the range, in order."""
        inside = sum(b[1] for b in bins)
        for i, (_, weight, lo, hi) in enumerate(bins):
            if self.below + weight >= self.goal or i == len(bins) - 1:
                break
            self.below += weight
        off_low, off_high = self.goal - self.below, self.below + weight - self.goal
        after = bins[i + 1][2] if i + 1 < len(bins) else None
        last = len(self.fixed) == len(self.keys) - 1
        near = min(off_low, off_high) <= CLOSE_ENOUGH * self.weight / self.node.leaves
        if (near or (last and lo == hi)) and (off_low <= off_high or after is not None or last):
            edge = lo if off_low <= off_high or after is None else after
            self.node.cut = list(zip(self.keys, [*self.fixed, edge]))
            self.done = True
        elif lo < hi:
            self.lo, self.hi, self.ratio = lo, hi, not self.ratio and weight > 0.5 * inside
        else:  # one value holds the cut: the next key decides
            self.fixed.append(lo)
            self.lo, self.hi = self.bounds[len(self.fixed)]
            self.ratio = False


def _cuts(rows: DataFrame, node: str, found: list[Search], size: str) -> None:
    """Find the cuts of all open nodes together: a pass over ``rows`` for all of them, at most nodes x BINS rows to the driver."""
    while todo := [s for s in found if not s.done]:
        inside = key = place = F.lit(None)
        for s in todo:
            here = F.col(node) == s.node.first
            made = s.columns()
            inside, key, place = (F.when(here, new).otherwise(old) for new, old in zip(made, (inside, key, place), strict=True))
        binned = rows.select(F.col(node).alias("node"), inside.alias("inside"), key.alias("key"), place.alias("bin"), F.col(size).alias("size")).filter("inside")
        counted = binned.groupBy("node", "bin").agg(F.sum("size").cast("double").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for s in todo:
            s.narrow(sorted((r["bin"], r["w"], r["lo"], r["hi"]) for r in counted if r["node"] == s.node.first))


def kd_shards(df: DataFrame, size: str, dims: list[str], shards: int, ties: list[str]) -> tuple[DataFrame, Node]:
    """``df`` (stored once) plus ``shard``, and the tree.

    Nodes are split breadth first; a node of n shards is cut at the weighted
    quantile ceil(n/2)/n of the dimension that is widest in it (width over the
    dimension's width in the whole table, of texts behind their common
    beginning; the first of equals).  Rows equal in that dimension are split by
    a hash of ``ties`` and, if equal in those too, by one of their place in the
    stored table, so a value, source or group of copies that holds any share of
    the rows is split evenly.  Null and NaN metadata sort first and make no node
    wider, null sizes count as 0, an empty table has no rows in any shard.
    Other columns stay, whatever their names; a column ``shard`` is replaced.
    """
    keyed, found = dimensions(df.withColumn(size, F.coalesce(F.col(size), F.lit(0))), dims)
    tie, node = free_name(keyed, "__tie"), free_name(keyed, "__node")
    unit = lambda h, bits: F.shiftrightunsigned(h, 64 - bits) / F.lit(float(2**bits))
    hashed = unit(F.xxhash64(*[F.col(c).cast("string") for c in ties]), 40) + unit(F.xxhash64(F.monotonically_increasing_id()), 13) / F.lit(float(2**40))
    rows = stored(keyed.withColumn(tie, hashed), "kd")
    for d in found:
        d.keys, d.bounds = [*d.keys, lambda: F.col(tie)], [*d.bounds, (0.0, 1.0)]
    root, spans, depth = Node(0, shards), None, 0
    narrow = [tie, size, *dict.fromkeys([*[d.width for d in found], *[d.name for d in found if len(d.keys) > 3]])]
    base, above = rows.select(*narrow, F.lit(0).alias(node)), [root]
    placed = base
    while open_nodes := root.open():
        nodes = {n.first: n for n in open_nodes}
        if root.children:
            at = F.col(node)
            for n in above:
                at = F.when(F.col(node) == n.first, n.assign()).otherwise(at)
            placed = base.select(*narrow, at.alias(node)).filter(F.col(node).isin(*nodes))
            if depth % STORED_LEVELS == 0:  # the rows' nodes, so that later passes follow the tree from here on only
                placed = base = stored(placed, "level")
                above = open_nodes
        depth += 1
        ends = [f(d.width).alias(f"{k}{i}") for i, d in enumerate(found) for k, f in (("min", F.min), ("max", F.max), ("known", F.count))]
        stats = placed.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("rows"), F.sum(size).cast("double").alias("all"), *ends).collect()  # one row per open node
        extent = lambda r, i: 0.0 if r[f"min{i}"] is None else r[f"max{i}"] / 2 - r[f"min{i}"] / 2
        spans = spans or [extent(stats[0], i) or 1.0 if stats else 1.0 for i in range(len(found))]
        searches = []
        for r in stats:
            n = nodes[r["node"]]
            i = max(range(len(found)), key=lambda i: (extent(r, i) / spans[i], -i))
            n.dim = found[i].name
            search = Search(n, found[i].keys, found[i].bounds, r["all"])
            if r[f"known{i}"] == r["rows"]:  # no nulls: the first key tells nothing, and the ends of the second are known
                search.fixed, search.lo, search.hi = [1.0], r[f"min{i}"], r[f"max{i}"]
            searches.append(search)
        _cuts(placed, node, searches, size)  # a node without rows has no cut: nothing goes left
        for n in open_nodes:
            left = (n.leaves + 1) // 2
            n.children = [Node(n.first, left), Node(n.first + left, n.leaves - left)]
    return rows.withColumn("shard", root.assign().cast("int")).drop(*[d.width for d in found], tie), root


def numbered(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``df`` plus ``slot``: a gapless number from 0 in each shard, by ``order``; shards are spread over many tasks."""
    counts = df.groupBy(shard).agg(F.count("*").alias("n")).collect()  # one row per shard
    starts, total = {}, 0
    for r in sorted(counts, key=lambda r: r[shard]):
        starts[r[shard]], total = total, total + r["n"]
    one, rank = free_name(df, "__one"), free_name(df, "__rank")
    placed = running_sums(df.withColumn(one, F.lit(1).cast("long")), [shard, *order], {rank: one})
    start = F.lit(0).cast("long")
    for k, v in starts.items():
        start = F.when(F.col(shard) == k, F.lit(v)).otherwise(start)
    return placed.withColumn(slot, (F.col(rank) - start).cast("long")).drop(one, rank)


SHARDS, DIMS = 24, ["n_chars", "source", "lang", "doc_id"]


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes (law ``bytes``)."""
    text = F.encode(F.col("text"), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(*dict.fromkeys(["doc_id", *DIMS]), (F.coalesce(F.length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    made, _ = kd_shards(docs, "size", DIMS, SHARDS, ["doc_id", "text_crc32"])
    out = numbered(made.select("doc_id", "size", "text_crc32", "shard"), "shard", ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
