"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``, with ``n_chars`` as the texts then are;
further columns are dropped, whatever their names.  An empty table stays empty.
Belongs to ``orbitlake.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import near_duplicates, passages, resampling, sentencepiece, source_mixing
from orbitlake.llm.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards labelled clean text; documents that are not drawn go.

    Null texts and texts without words go.  Null ids carry no label and share
    one noise value; repeated rows are judged alike; very long texts are read
    whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resampling.resample(docs, labels).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id.

    Equal texts are one class, so of ties and repeated rows one stays, and a
    null id stays only where its class has no other.
    """
    return near_duplicates.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's are cut out; documents of which nothing is left go.

    Documents that had no words before (null, empty) stay as they are.  Null ids
    and ids that name several texts are no hindrance.
    """
    return passages.cut_passages(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it.

    A null source is a source of its own, null texts have size 0 and are taken
    like others of their source; rows of the same id are taken alike.
    """
    return source_mixing.emit_copies(source_mixing.mix_sources(docs), COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, decoded again to compare; a null text has no ids and decodes to an empty one."""
    return sentencepiece.encode_checked(docs.select("doc_id", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicate),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: Hash-seeded sampling, consistent weighted sampling and chaining are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
