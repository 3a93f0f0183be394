"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A document's importance weight is the likelihood ratio of its word unigrams and
bigrams, hashed into BUCKETS, under the target model (labelled clean text) and
the raw model (all text): its log is the sum of the log ratios of its n-grams,
divided by a temperature (1: the models' own ratio).  Adding Gumbel noise to
the log weights and keeping the k largest draws k documents without replacement
in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns, free_name, rows_to_rows
from .storage import scratch, stored
from .textscan import Block, blocks, mix

#: Buckets of the hashed n-gram models, pseudo-counts of a bucket, what log ratios are divided by.
BUCKETS, PRIOR, TEMPERATURE = 1 << 18, 2.0, 1.0
#: Share of the held-out clean documents that the cut may lose.
MOST_LOST = 0.01
#: Ranges that one pass over the keys counts.
BINS = 1024
#: Labelled documents used at most (those first by a hash of their id); half train the target model, half set the cut.
MOST_LABELLED = 20_000


def ngrams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word unigram and bigram of a block."""
    pairs, at = b.shingles(2)
    doc = b.word_doc
    hashed = np.concatenate([mix(b.word_hash), pairs])
    return (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate([doc, doc[at]])


def _sample(labels: DataFrame, doc_id: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids, one row each: ``__clean`` (quality 1 and not toxic), ``__low`` (quality 0 or toxic) and ``__fit`` (trains the model, else sets the cut)."""
    rows = labels.select(F.col(doc_id).cast("long").alias("__label_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("__clean"), ((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("__low"))
    rows = rows.filter("__label_id is not null and (__clean is not null)").groupBy("__label_id").agg(F.min("__clean").alias("__clean"), F.max("__low").alias("__low"))
    rows = rows.withColumn("__h", F.xxhash64(F.col("__label_id"), F.lit("labels")))
    return rows.orderBy("__h", "__label_id").limit(most).select("__label_id", "__clean", "__low", (F.col("__h") % 2 == 0).alias("__fit"))


@dataclass
class Model:
    """Log ratio of target to raw probability for every bucket."""

    log_ratio: np.ndarray


def fit(df: DataFrame, sample: DataFrame, doc_id: str, text: str) -> Model:
    """Count the n-grams of all documents (raw) and of the clean labelled ones (target).

    Counts are summed in each task before they are shuffled; what reaches the
    driver is one row per bucket.  The target's pseudo-counts follow the raw
    model, so buckets that tell nothing have ratio 1; without clean labelled
    documents all have.
    """
    target = sample.filter("__fit and __clean").select("__label_id")
    marked = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text")).join(F.broadcast(target), F.col("__id") == F.col("__label_id"), "left")  # at most MOST_LABELLED ids
    marked = marked.select("text", F.col("__label_id").isNotNull().alias("target"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        raw, wanted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags = batch.column("target").to_numpy(zero_copy_only=False)
            for b in blocks(batch.column("text")):
                bucket, doc = ngrams(b)
                raw += np.bincount(bucket, minlength=BUCKETS)
                mine = flags[b.lo : b.hi][doc]
                if mine.any():
                    wanted += np.bincount(bucket[mine], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield {"bucket": some.astype(np.int32), "raw": raw[some], "target": wanted[some]}

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("raw", T.LongType()), T.StructField("target", T.LongType())])
    table = rows_to_rows(marked, schema, step).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most BUCKETS rows
    raw, wanted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = table["bucket"].to_numpy()
    raw[at], wanted[at] = table["raw"].to_numpy(), table["target"].to_numpy()
    expected = raw * (wanted.sum() / max(raw.sum(), 1.0))
    return Model(np.log((wanted + PRIOR) / (expected + PRIOR)).astype(np.float32))


SCORED = T.StructType([T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType())])


def score(df: DataFrame, model: Model, text: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """``df`` plus ``log_weight`` and ``n_grams``; a text without words has weight 0 (log weight null)."""
    shared = df.sparkSession.sparkContext.broadcast(model.log_ratio)  # BUCKETS floats

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        ratio, weights, counts = shared.value, [], []
        for b in blocks(batch.column(text)):
            bucket, doc = ngrams(b)
            n = np.bincount(doc, minlength=len(b))
            total = np.bincount(doc, ratio[bucket], minlength=len(b))
            weights.append(np.where(n > 0, total / temperature, np.nan))
            counts.append(n)
        w, n = (np.concatenate(x) if x else np.zeros(0) for x in (weights, counts))
        return [pa.array(w, mask=np.isnan(w)), pa.array(n.astype(np.int64))]

    return add_columns(df, SCORED, compute)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of seed and id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 12) + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(-F.log(u))


def choose_cut(rows: list[tuple[float, bool]], most_lost: float = MOST_LOST) -> float:
    """The log weight that best parts held-out clean documents (True) from low-quality and toxic ones; of equals the lowest.

    It is the midpoint between neighbouring weights with the largest sum of
    clean documents kept and others rejected (as shares), among those that lose
    at most ``most_lost`` of the clean ones.  Without documents of both kinds
    nothing is rejected.
    """
    rows = sorted(rows)
    clean, low = sum(c for _, c in rows), sum(not c for _, c in rows)
    if not clean or not low:
        return float("-inf")
    best, cut, lost, gone = 1.0, float("-inf"), 0, 0
    for i, (w, c) in enumerate(rows):
        lost, gone = lost + c, gone + (not c)
        if lost > most_lost * clean:
            break
        if i + 1 < len(rows) and rows[i + 1][0] > w:
            merit = 1 - lost / clean + gone / low
            if merit > best:
                best, cut = merit, (w + rows[i + 1][0]) / 2
    return cut


def least_of_largest(df: DataFrame, value: str, k: int) -> float | None:
    """The ``k``-th largest ``value`` (the least one if there are fewer rows, None of none), by counts in ranges that get narrower.

    A pass counts BINS ranges and keeps the one with the row looked for; its
    least and greatest values lie in different ranges of the next pass, so
    passes end, and what reaches the driver is at most BINS rows.
    """
    lo, hi, above = *df.agg(F.min(value), F.max(value)).first(), 0
    if lo is None:
        return None
    while lo < hi:
        step = (hi - lo) / BINS
        if not step:  # neighbouring doubles
            break
        place = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1))
        found = df.filter(F.col(value).between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            lo, hi = r["lo"], r["hi"]
            if above + r["n"] >= k:
                break
            above += r["n"]
    return lo


@dataclass
class Sampler:
    """What decides whether a document stays: its key (log weight plus noise) is at least ``least_key``."""

    model: Model
    seed: int
    cut: float
    k: int
    least_key: float
    temperature: float = TEMPERATURE

    def apply(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``df`` plus ``log_weight``, ``n_grams`` and ``key``, without the documents that were not drawn."""
        own = free_name(df, "__doc")
        made = score(df.withColumn(own, F.col(doc_id)), self.model, text, self.temperature)
        made = made.withColumn("key", F.col("log_weight") + gumbel(F.col(own), self.seed)).drop(own)
        return made.filter(F.col("key") >= F.lit(self.least_key))


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, most_labelled: int = MOST_LABELLED, k: int | None = None, temperature: float = TEMPERATURE) -> Sampler:
    """Fit both models and draw ``k`` documents.

    Without ``k`` it is the number of documents at or above a cut that is set
    on held-out labels, so the corpus itself says how many there are to keep.
    Documents without words are never drawn.  Equal keys (rows that repeat an
    id and a text) stay or go together.
    """
    with scratch(df.sparkSession):
        sample = stored(_sample(labels, doc_id, most_labelled), "labels")
        model = fit(df, sample, doc_id, text)
        narrow = df.select(F.col(doc_id).alias("doc"), F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
        scored = score(narrow, model, "text", temperature).drop("text").withColumn("key", F.col("log_weight") + gumbel(F.col("doc"), seed))
        scored = stored(scored.filter("log_weight is not null"), "scored")
        cut = float("-inf")
        if k is None:
            held = scored.join(F.broadcast(sample.filter("not __fit and (__clean or __low)")), F.col("__id") == F.col("__label_id"))
            held = held.groupBy("__label_id").agg(F.min("log_weight").alias("w"), F.first("__clean").alias("c"))  # repeated ids count once
            cut = choose_cut([(r["w"], r["c"]) for r in held.select("w", "c").collect()])  # at most MOST_LABELLED rows
            k = scored.filter(F.col("log_weight") >= F.lit(cut)).count()
        least = least_of_largest(scored, "key", k) if k else None
    return Sampler(model, seed, cut, k, float("inf") if least is None else least, temperature)


def resample(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """The documents that importance resampling draws, with their columns, ``log_weight``, ``n_grams`` and ``key`` (columns of these names are replaced).

    Null texts and texts without words are rejected; null ids share one noise
    value and carry no label; an empty table stays empty, and without labels of
    both kinds every document with words is kept.
    """
    return train(df, labels, doc_id, text, seed).apply(df, doc_id, text)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept: id, log weight, n-grams, key and ``kept`` (true in every row)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels).select("doc_id", "log_weight", "n_grams", "key", F.lit(True).alias("kept"))
