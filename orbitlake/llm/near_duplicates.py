"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles; a shingle weighs its count
times its IDF over all documents (``weighted_sets``).  Two documents agree in
one consistent sample with probability equal to their weighted Jaccard
similarity.  ROWS samples form a band, and documents that share a band a bucket.

Links are looked for in two steps.  In a bucket (dealt out in parts of bounded
size) the first document leads those whose samples agree with its own often
enough, the first of the others leads again, and so on: a link for each member,
verified by the exact weighted Jaccard similarity.  Of buckets that then still
hold several components, every member outside the largest one is compared with
all members of other components, by the exact similarity, in blocks of bounded
size; a block gives at most one link less than it has components.  So every
pair that shares a bucket is either in one component already or compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import free_name, rows_to_rows
from .components import components
from .storage import partitions, scratch, stored
from .weighted_sets import document_id, weighted_sets

#: Similarity from which documents are near duplicates, bands and samples of a band.
SIMILAR, BANDS, ROWS = 0.8, 12, 3
#: Samples that a member must have in common with its leader (at similarity 0.8, 28.8 of 36 agree on average).
AGREE = 22
#: Members of a part of a bucket when leaders are chosen; members and bytes of shingles of one side of a block.
PART, SIDE, SIDE_BYTES = 512, 1024, 8 << 20
#: Shingles of a block that are compared at once, and pairs up to which they are compared one by one.
LAYERS, FEW = 4096, 16
#: A text with more than this part of all rows as its copies is looked up by broadcast (at most as many texts as its inverse).
HOT_COPIES = 0.001


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size_a: float | None = None, size_b: float | None = None) -> float:
    """Weighted Jaccard similarity of two sets of (sorted hashes, weights) and sizes (the sums of weights, where not given); 0 if both are empty."""
    at = np.searchsorted(b[0], a[0])
    inside = at < len(b[0])
    same = np.flatnonzero(inside)[b[0][at[inside]] == a[0][inside]]
    common = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    whole = (float(a[1].sum(dtype=np.float64)) if size_a is None else size_a) + (float(b[1].sum(dtype=np.float64)) if size_b is None else size_b) - common
    return common / whole if whole > 0 else 0.0


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 8
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, "<f4", n, 4 * n)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) with at least the similarity asked for."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("shingles").alias(f"of_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b", "size_a", "size_b")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            sizes = zip(batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist(), strict=True)
            alike = [similarity(_unpack(x.as_py()), _unpack(y.as_py()), *s) >= SIMILAR for x, y, s in zip(batch.column("of_a"), batch.column("of_b"), sizes, strict=True)]
            found = batch.filter(pa.array(alike, pa.bool_()))
            yield {"a": found.column("a"), "b": found.column("b")}

    return rows_to_rows(both, T.StructType([pairs.schema["a"], pairs.schema["b"]]), step)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole groups of a partition sorted by ``keys``: tables and the bounds of the groups in them."""
    held: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(len(table) - 1, 0), bool)
        for k in keys:
            column = table.column(k).to_numpy()
            new |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        cut = bounds(held)
        if len(cut) > 2:  # the last group may go on
            yield held.slice(0, int(cut[-2])), cut[:-1].tolist()
            held = held.slice(int(cut[-2])).combine_chunks()
    if held is not None and len(held):
        yield held, bounds(held).tolist()


def _led(samples: np.ndarray) -> list[tuple[int, int]]:
    """(leader, member) within a group."""
    left, out = np.arange(len(samples)), []
    while len(left) > 1:
        lead, rest = left[0], left[1:]
        like = (samples[rest] == samples[lead]).sum(axis=1) >= AGREE
        out += [(int(lead), int(m)) for m in rest[like]]
        left = rest[~like]
    return out


def common_weight(rows: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of the lesser weights of all sets ``left`` with all sets ``right``.

    A shingle with weights w1 < w2 < ... becomes layers that weigh w1, w2 - w1,
    ..., and a set has all layers up to its own weight; the lesser weight is the
    sum of the layers that both have, so blocks of layers are multiplied as
    matrices.  Layers of a single set have nothing in common with others.
    """
    lengths = [len(x[0]) for x in rows]
    row = np.repeat(np.arange(len(rows)), lengths)
    name, weight = (np.concatenate([x[i] for x in rows]) for i in (0, 1))
    order = np.lexsort((weight, name))
    row, name, weight = row[order], name[order], weight[order].astype(np.float64)
    out = np.zeros((len(left), len(right)))
    if not len(row):
        return out
    new_name = np.append(True, name[1:] != name[:-1])
    new = new_name | np.append(True, weight[1:] != weight[:-1])
    layer = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    adds = np.where(new_name[at], weight[at], weight[at] - np.append(0.0, weight[at][:-1]))
    base = np.maximum.accumulate(np.where(new_name, layer, 0))
    times = layer - base + 1
    flat = np.repeat(np.arange(len(row)), times)
    layer = layer[flat] - (np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times))
    row = row[flat]
    shared = np.bincount(layer, minlength=len(adds)) > 1
    kept = shared[layer]
    row, layer, adds = row[kept], (np.cumsum(shared) - 1)[layer[kept]], adds[shared]
    order = np.argsort(layer, kind="stable")
    row, layer = row[order], layer[order]
    for lo in range(0, len(adds), LAYERS):
        i, j = np.searchsorted(layer, (lo, lo + LAYERS))
        has = np.zeros((len(rows), min(LAYERS, len(adds) - lo)), np.float32)
        has[row[i:j], layer[i:j] - lo] = 1
        out += (has[left] * adds[lo : lo + LAYERS].astype(np.float32)) @ has[right].T
    return out


def links(rows: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, component: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs of a visiting and a resident set of a block, as few as join the same components."""
    left, right = np.flatnonzero(~home), np.flatnonzero(home)
    if len(left) * len(right) <= FEW:
        pairs = [(i, j) for i in left.tolist() for j in right.tolist() if component[i] != component[j] and similarity(rows[i], rows[j], sizes[i], sizes[j]) >= SIMILAR]
    else:
        common = common_weight(rows, left, right)
        alike = common / np.maximum(sizes[left][:, None] + sizes[right][None, :] - common, 1e-300)
        alike[component[left][:, None] == component[right][None, :]] = 0
        x, y = np.nonzero(alike >= SIMILAR - 1e-4)
        near = alike[x, y] < SIMILAR + 1e-4  # the matrices are in single precision
        sure = [not n or similarity(rows[left[i]], rows[right[j]], sizes[left[i]], sizes[right[j]]) >= SIMILAR for i, j, n in zip(x.tolist(), y.tolist(), near.tolist(), strict=True)]
        x, y = left[x[sure]], right[y[sure]]
        _, first = np.unique(component[x] * (int(component.max(initial=0)) + 1) + component[y], return_index=True)
        pairs = list(zip(x[first].tolist(), y[first].tolist(), strict=True))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in pairs:
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _pairs(members: DataFrame, keys: list[str], order: list[str], of) -> DataFrame:
    """Distinct pairs (a, b), a < b, that ``of`` finds in each group of members: pairs of rows of a table from lo to hi."""
    schema = T.StructType([T.StructField("a", members.schema["node"].dataType), T.StructField("b", members.schema["node"].dataType)])
    dealt = members.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys, *order)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for table, cut in groups(batches, keys):
            found = [(lo + i, lo + j) for lo, hi in zip(cut[:-1], cut[1:], strict=True) for i, j in of(table.slice(lo, hi - lo))]
            nodes = table.column("node")
            yield {c: nodes.take(pa.array([p[k] for p in found], pa.int64())).combine_chunks() for k, c in enumerate("ab")}

    made = rows_to_rows(dealt, schema, step)
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def led_pairs(members: DataFrame) -> DataFrame:
    """Every member (band, key, part, node, samples) with the leader whose samples are like its own."""

    def of(group: pa.Table) -> list[tuple[int, int]]:
        return _led(np.frombuffer(b"".join(group.column("samples").to_pylist()), "<u4").reshape(len(group), BANDS * ROWS))

    return _pairs(members, ["band", "key", "part"], ["node"], of)


def crossing_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs between the components of a bucket; ``members`` (band, key, node, c) are all of those buckets with several.

    Members of a bucket's largest component stay at home; every other one also
    visits all parts of the bucket.  Parts and the blocks of visitors to one are
    bounded by SIDE members and about SIDE_BYTES.
    """
    bucket = ["band", "key"]
    weighed = members.join(sets.select("node", F.length("shingles").cast("long").alias("bytes")), "node")
    sizes = weighed.groupBy(*bucket, "c").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    mixed = sizes.groupBy(*bucket).agg(F.max_by(F.struct("c", "m", "bytes"), F.struct("m", "c")).alias("most"), F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("bytes").alias("bytes")).filter("k > 1")
    sides = lambda m, n: F.greatest(F.ceil(m / SIDE), F.ceil(n / SIDE_BYTES), F.lit(1)).cast("int")
    mixed = mixed.select(*bucket, F.col("most.c").alias("most"), sides(F.col("m"), F.col("bytes")).alias("parts"), sides(F.col("m") - F.col("most.m"), F.col("bytes") - F.col("most.bytes")).alias("blocks"))
    placed = members.join(stored(mixed, "mixed"), bucket)
    own = lambda n, seed: F.pmod(F.xxhash64("node", "band", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = placed.select(*bucket, own("parts", 0).alias("part"), every("blocks").alias("block"), F.lit(True).alias("home"), "node", "c")
    away = placed.filter("c <> most").select(*bucket, every("parts").alias("part"), own("blocks", 1).alias("block"), F.lit(False).alias("home"), "node", "c")
    rows = home.unionByName(away).join(sets.select("node", "size", "shingles"), "node")

    def of(group: pa.Table) -> list[tuple[int, int]]:
        sides = group.column("home").to_numpy()
        if sides.all() or not sides.any():
            return []
        component = group.column("c").combine_chunks().dictionary_encode()
        component = (component.combine_chunks() if isinstance(component, pa.ChunkedArray) else component).indices.to_numpy().astype(np.int64)
        return links([_unpack(x) for x in group.column("shingles").to_pylist()], group.column("size").to_numpy(), component, sides)

    return _pairs(rows, [*bucket, "part", "block"], ["home", "node"], of)


def near_duplicate_components(texts: DataFrame, total: int, n_bytes: int) -> DataFrame:
    """(node, c) for every text with a verified link to another; ``texts`` has a row (node, text) for each of ``total`` documents."""
    spark = texts.sparkSession
    with scratch(spark):
        sets = weighted_sets(texts, "node", "text", total, n_bytes, SIMILAR, BANDS * ROWS)
        band = lambda i: F.xxhash64(F.substr("samples", F.lit(i * 4 * ROWS + 1), F.lit(4 * ROWS)), F.lit(i))
        banded = sets.select("node", F.posexplode(F.array(*[band(i) for i in range(BANDS)])).alias("band", "key"))
        many = stored(banded.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        # Parts are drawn anew for each band, so leaders meet other members of a large bucket in each.
        part = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / PART).cast("long")).cast("int")
        members = stored(banded.join(many, ["band", "key"]).select("band", "key", part.alias("part"), "node"), "members")
        found = stored(verified(led_pairs(members.join(sets.select("node", "samples"), "node")), sets), "links")
        linked = components(found, "a", "b").withColumnRenamed("component", "c")
        # A text without a link is a component of its own.
        placed = members.drop("part").join(linked, "node", "left").withColumn("c", F.coalesce("c", "node"))
        crossing = stored(crossing_links(stored(placed, "placed"), sets), "crossing")
        if crossing.isEmpty():
            return stored(linked, "linked", keep=True)
        # The new links join components; texts that had none come in with a name of their own.
        side = lambda x: linked.withColumnsRenamed({"node": x, "c": f"c{x}"})
        joined = crossing.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(joined, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("to"))
        fresh = crossing.select(F.col("a").alias("node")).union(crossing.select("b")).distinct().join(linked, "node", "left_anti").withColumn("c", F.col("node"))
        return stored(linked.unionByName(fresh).join(merged, "c", "left").select("node", F.coalesce("to", "c").alias("c")), "linked", keep=True)


def near_duplicate_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, node, component) for every row of ``df``: documents linked by chains of near duplicates share a component.

    ``class_id`` is the least id in the component, ``node`` the MD5 of the text.
    Equal texts are one component (null counts as empty), also those of fewer
    than five words, which have no shingles and so no other links.  Rows that
    repeat an id are classed by their own texts; null ids are kept (a component
    of null ids only has a null class id).  Extra columns are left out.
    """
    spark = df.sparkSession
    with scratch(spark):
        rows = df.select(F.col(doc_id).alias("doc_id"), document_id(F.col(text)).alias("node"), F.col(text).alias("text"))
        ids = stored(rows.select("doc_id", "node", F.octet_length("text").cast("long").alias("bytes")), "ids", keep=True)
        total, n_bytes = ids.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        parts = near_duplicate_components(rows.select("node", "text"), total, n_bytes)
        nodes = ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(parts, "node", "left").withColumn("component", F.coalesce("c", "node")).drop("c")
        nodes = stored(nodes, "nodes")
        least = nodes.groupBy("component").agg(F.min("least").alias("class_id"))
        nodes = stored(nodes.join(least, "component").select("node", "class_id", "component", "copies"), "classes", keep=True)
    # All copies of one text would meet in one task; the few texts with many are looked up beside their rows.
    hot = nodes.filter(F.col("copies") > F.lit(HOT_COPIES * total)).select("node", F.struct("class_id", "component").alias("often"))
    marked = ids.select("doc_id", "node").join(F.broadcast(hot), "node", "left")  # at most 1 / HOT_COPIES rows
    spread = F.when(F.col("often").isNotNull(), F.unhex(F.md5(F.concat(F.lit("spread "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))).otherwise(F.col("node"))
    rest = nodes.filter(F.col("copies") <= F.lit(HOT_COPIES * total)).select(F.col("node").alias("__node"), F.struct("class_id", "component").alias("found"))
    joined = marked.withColumn("__at", spread).join(rest, F.col("__at") == F.col("__node"), "left").withColumn("found", F.coalesce("often", "found"))
    return joined.select("doc_id", F.col("found.class_id").alias("class_id"), "node", F.col("found.component").alias("component"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class: the one with the least id (of null ids, and of rows that repeat an id, one)."""
    name, key = free_name(df, "__node"), free_name(df, "__id")
    with scratch(df.sparkSession):
        classes = stored(near_duplicate_classes(df, doc_id, text), "classes")
        kept = classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias(key), F.col("k.node").alias(name))
        copies = classes.groupBy(F.col("doc_id").alias("i"), F.col("node").alias("n")).agg(F.count("*").alias("rows")).filter("rows > 1")
        kept = kept.join(copies, F.col(key).eqNullSafe(F.col("i")) & (F.col(name) == F.col("n")), "left").select(key, name, F.coalesce("rows", F.lit(1)).alias("rows"))
        kept = stored(kept, "kept", keep=True)
    rows = df.withColumn(name, document_id(F.col(text))).withColumn(key, F.col(doc_id))
    of = lambda k: rows.alias("x").join(k.alias("k"), F.col(f"x.{key}").eqNullSafe(F.col(f"k.{key}")) & (F.col(f"x.{name}") == F.col(f"k.{name}")), "left_semi")
    repeated = kept.filter("rows > 1")
    if repeated.isEmpty():
        return of(kept).select(*df.columns)
    again = of(repeated).dropDuplicates([key, name])
    return of(kept.filter("rows = 1")).unionByName(again).select(*df.columns)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")
