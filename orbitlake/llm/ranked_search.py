"""Ranked lexical search: an inverted treap per term, all terms of a query traversed together.

The documents stay where they are.  Every task builds, for the documents of a
batch, one treap per asked term: document order is the search order, impact the
heap order.  A traversal holds one node per term for an interval of documents;
as each node is the greatest impact of its term there, their sum bounds every
score of the interval, and an interval that cannot enter the top k is dropped.
Otherwise the document of the greatest node is scored, and the interval is
split there.  What leaves a task is its k best documents of each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import rows_to_rows
from .storage import scratch, stored
from .textscan import TermBlock, blocks

#: Results of an item.
MOST = 50
#: Bytes of item texts that are asked together: what a job sends to its tasks is bounded by it.
ITEM_BYTES = 4 << 20
#: Postings whose treaps are built together, and intervals that are looked at together.
POSTINGS, FRONTIER = 1 << 20, 1 << 14
#: Pairs of an item and a document that a task looks at: the index is small, so its files alone would make few, long tasks.
PAIRS = 4 << 20
#: Parts of an item's candidates that are ranked apart first.
SALTS = 16
#: Stands for a null document id in comparisons: such documents come last among equal scores.
LAST = np.iinfo(np.int64).max

INDEX = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])


@dataclass
class Asked:
    """The items of one job: their ids, hashes of all their terms (sorted), and the terms of each item, padded with -1."""

    ids: list[int | None]
    hashes: np.ndarray
    terms: np.ndarray


def asked(rows: list[tuple[int | None, str | None]]) -> Asked:
    """Items of equal id are one item with the terms of all of them; one without terms finds nothing."""
    found: dict[int | None, set[int]] = {}
    for b in blocks(pa.array([text for _, text in rows], pa.string()), kind=TermBlock):
        for at in range(len(b)):
            found.setdefault(rows[b.lo + at][0], set()).update(b.word_hash[b.word_bounds[at] : b.word_bounds[at + 1]].tolist())
    hashes = np.array(sorted(set().union(*found.values())), np.uint64) if found else np.zeros(0, np.uint64)
    place = {h: i for i, h in enumerate(hashes.tolist())}
    terms = np.full((len(found), max([1, *map(len, found.values())])), -1, np.int32)
    for i, mine in enumerate(found.values()):
        terms[i, : len(mine)] = sorted(place[h] for h in mine)
    return Asked(list(found), hashes, terms)


def term_counts(docs: DataFrame, hashes: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many it has, and the asked ones with their counts.

    ``terms`` are places in ``hashes`` (64-bit hashes of lower-cased terms, sorted).
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            for b in blocks(batch.column(1), kind=TermBlock):
                n = b.n_words
                at = np.minimum(np.searchsorted(hashes, b.word_hash), max(len(hashes) - 1, 0))
                hit = np.flatnonzero(hashes[at] == b.word_hash) if len(hashes) else np.zeros(0, np.int64)
                key, tf = np.unique(b.word_doc[hit] * np.int64(max(len(hashes), 1)) + at[hit], return_counts=True)
                doc = key // max(len(hashes), 1)
                full = np.flatnonzero(n)
                bounds = np.append(np.searchsorted(doc, full), len(doc)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32)))  # noqa: E731, B023
                yield {"doc_id": batch.column(0).slice(b.lo, len(b)).take(pa.array(full)), "n": pa.array(n[full]), "terms": lists(key % max(len(hashes), 1)), "tfs": lists(tf)}

    return rows_to_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), INDEX, step)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores of single postings, in 64-bit integers."""
    m = 50 + (50 * n * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _greater(values: np.ndarray, to: np.ndarray, passes) -> np.ndarray:
    """``to`` moved on from neighbour to neighbour while ``passes(value there, own value)``; -1 is the end.

    All pointers skip smaller values only, at any time, so each may take over
    its target's pointer: the distances double.
    """
    moving = np.flatnonzero(to >= 0)
    while len(moving):
        moving = moving[passes(values[to[moving]], values[moving])]
        to[moving] = to[to[moving]]
        moving = moving[to[moving] >= 0]
    return to


@dataclass
class Treaps:
    """The treaps of all terms over the same documents, as places in postings sorted by term and document."""

    key: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray
    n_docs: int

    @classmethod
    def build(cls, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> Treaps:
        """Postings sorted by term and document; the first of equal impacts is the ancestor of the others."""
        n, at = len(term), np.arange(len(term))
        edge = np.ones(n + 1, bool)
        edge[1:-1] = term[1:] != term[:-1]
        before = _greater(impact, np.where(edge[:-1], -1, at - 1), np.less)
        after = _greater(impact, np.where(edge[1:], -1, at + 1), np.less_equal)
        from_left = (before >= 0) & ((after < 0) | (impact[before] < impact[after]))
        from_right = (after >= 0) & ~from_left
        left, right, root = np.full(n, -1), np.full(n, -1), np.full(n_terms, -1)
        right[before[from_left]] = at[from_left]
        left[after[from_right]] = at[from_right]
        top = ~from_left & ~from_right
        root[term[top]] = at[top]
        return cls(term * np.int64(n_docs) + doc, doc, impact, left, right, root, n_docs)

    def inside(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For every node, the greatest of its treap between documents ``lo`` and ``hi``, or -1."""
        flat, width = node.ravel(), node.shape[1]
        at = np.flatnonzero(flat >= 0)
        while len(at):
            doc, row = self.doc[flat[at]], at // width
            low, high = doc < lo[row], doc > hi[row]
            flat[at] = np.where(low, self.right[flat[at]], np.where(high, self.left[flat[at]], flat[at]))
            at = at[(low | high) & (flat[at] >= 0)]
        return flat.reshape(node.shape)

    def scores(self, terms: np.ndarray, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whole scores of documents, one a row of ``terms``; a term without a node has no posting there."""
        row, slot = np.nonzero(node >= 0)
        key = terms[row, slot] * np.int64(self.n_docs) + doc[row]
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        out = np.zeros(len(doc), np.int64)
        np.add.at(out, row, np.where(self.key[at] == key, self.impact[at], 0))
        return out


class Best:
    """The k best documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least, self.last = k, np.ones(n_items, np.int64), np.full(n_items, LAST)
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_enter(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document with this score and id, or a greater one, can be among the k best."""
        return (score > self.least[item]) | ((score == self.least[item]) & (doc <= self.last[item]))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.append(self.item, item), np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def traverse(treaps: Treaps, terms: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Take the documents of ``treaps`` (their ids: ``ids``, sorted) into ``best``; returns how many intervals were looked at."""
    looked, last = 0, len(ids) - 1
    nodes = np.where(terms >= 0, treaps.root[terms], -1)
    waiting = [(np.arange(len(terms)), np.zeros(len(terms), np.int64), np.full(len(terms), last), nodes)]
    while waiting:
        taken = [waiting.pop()]
        while waiting and sum(len(t[0]) for t in taken) + len(waiting[-1][0]) <= FRONTIER:
            taken.append(waiting.pop())
        item, lo, hi, node = (np.concatenate(x) for x in zip(*taken, strict=True))
        if len(item) > FRONTIER:
            waiting.append((item[FRONTIER:], lo[FRONTIER:], hi[FRONTIER:], node[FRONTIER:]))
            item, lo, hi, node = item[:FRONTIER], lo[:FRONTIER], hi[:FRONTIER], node[:FRONTIER]
        looked += len(item)
        impact = np.where(node >= 0, treaps.impact[node], -1)
        bound = np.maximum(impact, 0).sum(1)
        some = best.may_enter(item, bound, ids[lo])
        item, lo, hi, node, impact = item[some], lo[some], hi[some], node[some], impact[some]
        if not len(item):
            continue
        split = treaps.doc[node[np.arange(len(item)), impact.argmax(1)]]
        score = treaps.scores(terms[item], node, split)
        good = best.may_enter(item, score, ids[split])
        best.add(item[good], score[good], ids[split[good]])
        for low, high in ((lo, split - 1), (split + 1, hi)):
            full = np.flatnonzero(low <= high)
            part = treaps.inside(node[full], low[full], high[full])
            held = (part >= 0).any(1)
            waiting.append((item[full][held], low[full][held], high[full][held], part[held]))
    return looked


def search_batches(batches: Iterator[pa.RecordBatch], terms: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Best:
    """The k best documents of each item among the index rows of a task."""
    best = Best(len(terms), k)
    for batch in batches:
        sizes = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + POSTINGS, side="right")) - 1)
            part = batch.slice(lo, hi - lo)
            lo = hi
            ids = part.column(0).fill_null(LAST).to_numpy()
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), lengths)
            term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            if not len(term):
                continue
            impact = impacts(tf, part.column(1).to_numpy()[row], weights[term], n_docs, n_terms)
            order = np.lexsort((place[row], term))
            treaps = Treaps.build(term[order], place[row][order], impact[order], len(ids), len(weights))
            traverse(treaps, terms, ids[by_id], best)
    return best


def ranked_search(docs: DataFrame, items: DataFrame, k: int = MOST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0, equal scores by ascending id.

    Ids are integers.  Null and empty texts have no terms; such documents count
    nowhere, such items have no rows.  Repeated rows of documents are documents
    of their own; a null document id comes last among equal scores; items of
    equal id (null among them) are one item.  Other columns are not read.  Items
    are asked in blocks of ITEM_BYTES by a hash of their id, so the terms and
    weights that travel to the tasks are bounded, and so is what a task returns
    (k rows an item).
    """
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-size // ITEM_BYTES))
    found = None
    for block in range(n_blocks):
        mine = wanted if n_blocks == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        made = _search_block(docs, asked([(r["item_id"], r["text"]) for r in mine.collect()]), k, doc_id, text)  # at most about ITEM_BYTES
        found = made if found is None else found.unionByName(made)
    return found.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")


def _search_block(docs: DataFrame, block: Asked, k: int, doc_id: str, text: str) -> DataFrame:
    index = stored(term_counts(docs, block.hashes, doc_id, text), "postings", keep=True)
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most one row an asked term
    weights = np.zeros(max(len(block.hashes), 1), np.int64)
    for r in held:
        weights[r["term"]] = weight(n_docs, r["count"])
    ids = pa.array(block.ids, pa.int64())
    terms = block.terms

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        best = search_batches(batches, terms, weights, n_docs, n_terms, k)
        if len(best.item):
            yield {"item_id": ids.take(pa.array(best.item)), "doc_id": pa.array(best.doc, mask=best.doc == LAST), "score": pa.array(best.score)}

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "doc_id", "score")])
    tasks = -(-n_docs * len(block.ids) // PAIRS)
    rows = rows_to_rows(index.repartition(tasks) if tasks > 1 else index, schema, step).withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "__salt").orderBy(*order))).filter(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)
    return rows.drop("__salt")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` ranked for each item of ``benchmark``: its 50 best."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    with scratch(spark):
        return stored(ranked_search(docs, items), "ranked", keep=True)


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), sized AS (SELECT r, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized
), tf AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM sized) GROUP BY r, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, total GROUP BY t, n_docs
), impact AS (
  SELECT s.r, s.doc_id, tf.t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN sized s USING (r) JOIN weights USING (t), total
), item AS (
  SELECT DISTINCT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
), scored AS (
  SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM item JOIN impact USING (t) GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {MOST}
"""
