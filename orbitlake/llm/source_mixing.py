"""Mixing sources to target weights: token totals per source, repetition rates, hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import free_name
from .ordered import running_sums
from .storage import stored

#: A word, and how often a source may repeat at most.
WORD, MOST_REPEATS = "[^\\x20\\x09-\\x0D]+", 3
#: Weights of the sources in code-point order, over and over.
WEIGHTS = (1, 2, 3)
#: A table of sources and sizes is broadcast up to this many bytes (of source names plus 64 a row); beyond it the join shuffles, each row to one of SALTS.
BROADCAST_BYTES, SALTS = 8 << 20, 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: ``source_size``, ``target`` and ``rate`` = target / source size.

    Targets share the total of all sizes by weight; none goes over ``most``
    times its source's size, and the excess is shared again by weight until
    none is above.  That fixed point is min(most x size, level x weight) with
    one common level, found exactly from running sums over the sources in order
    of size per weight.  Sources are ordered by code point, a null source last.
    Sources without words have target and rate 0.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    per = per.withColumn("__null", F.col(source).isNull()).withColumn("__one", F.lit(1).cast("long"))
    per = running_sums(per, ["__null", source], {"__rank": "__one"})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * most).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    per = stored(running_sums(per, ["__ratio", "__rank"], {"__cap_before": "__cap", "__weight_before": "weight"}), "sources")
    total = per.agg(F.sum("source_size").alias("__total"), F.sum("weight").alias("__weights"))
    per = per.crossJoin(F.broadcast(total))  # one row
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    capped_sum, rest = whole("__cap_before") + whole("__cap"), whole("__weights") - whole("__weight_before") - whole("weight")
    #: A source is capped if the others, at its own level, do not take up the whole total.
    per = stored(per.withColumn("__capped", capped_sum * whole("weight") + whole("__cap") * rest <= whole("__total") * whole("weight")), "capped")
    level = per.agg(F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__cap"))), F.lit(0)).alias("__taken"), F.coalesce(F.sum(F.when(~F.col("__capped"), F.col("weight"))), F.lit(0)).alias("__open"))
    per = per.crossJoin(F.broadcast(level))  # one row
    target = F.when(F.col("__capped") | (F.col("__open") == 0), F.col("__cap").cast("double")).otherwise((F.col("__total") - F.col("__taken")).cast("double") * F.col("weight") / F.col("__open"))
    return per.select(source, "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from a document's id and the seed (13 hex digits of an MD5)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def size_classes(classes: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """(__source, __size, source_size, target, whole, share): how often documents of a source and size are taken, and the chance of one more.

    ``classes`` is (__source, __size, __n).  A source's documents stand in order
    of their sizes; place r of n has passed floor(r x fraction + offset) extra
    copies, so a class of n documents gets that number behind it less that before
    it.  The offset is a hash of seed and source, so a document's chance is the
    fraction over all seeds, while sizes of any magnitude are taken evenly.
    """
    placed = running_sums(classes, ["__source", "__size"], {"__before": "__n"})
    own = placed.groupBy("__source").agg(F.min("__before").alias("__first"))
    per = rates.join(own.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s").withColumnRenamed("__source", "__s")
    joined = placed.join(per, F.col("__source").eqNullSafe(F.col("__s")))
    named = F.when(F.col("__source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("source:"), F.col("__source").cast("string")))
    fraction, place, offset = F.col("rate") - F.floor("rate"), F.col("__before") - F.col("__first"), draw(named, seed)
    extra = F.floor((place + F.col("__n")) * fraction + offset) - F.floor(place * fraction + offset)
    return joined.select("__source", "__size", "source_size", "target", F.floor("rate").alias("whole"), (extra / F.col("__n")).alias("share"))


def mix_sources(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 2024, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``df`` plus ``size``, ``source_size``, ``target`` and ``copies``: how often the mix holds each document.

    copies = floor(rate) plus one with probability rate - floor(rate), decided
    by a hash of seed and document id, so reruns and repeated rows agree.  The
    draws are stratified: of a source's documents of one size, whose number is
    known, a set number is due (:func:`size_classes`), and that number over
    theirs is each one's chance.  A few very long documents are thus taken as
    evenly as many short ones, and sources come near their targets.  Null texts
    have size 0 (and are copied like any other of their source), null sources
    are a source of their own, an empty table stays empty.  Columns of ``df`` of
    the added names are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    base = df.drop(*[c for c in added if c in df.columns and c not in (doc_id, source, text)]).withColumn("size", words(F.col(text)))
    classes = stored(base.groupBy(F.col(source).alias("__source"), F.col("size").alias("__size")).agg(F.count("*").alias("__n")), "classes")
    rates = stored(source_rates(classes.select("__source", (F.col("__size") * F.col("__n")).alias("size")), "__source", "size", weights, most), "rates")
    shares = stored(size_classes(classes, rates, seed), "shares")
    bound = shares.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + 64), F.lit(0)).alias("b")).first()["b"]
    own = {c: free_name(base, f"__mix_{c}") for c in shares.columns}
    shares, salt = shares.withColumnsRenamed(own), free_name(base, "__salt")
    same = F.col(source).eqNullSafe(F.col(own["__source"])) & (F.col("size") == F.col(own["__size"]))
    if bound <= BROADCAST_BYTES:
        joined = base.join(F.broadcast(shares), same)
    else:  # a class that holds a third of all documents goes to SALTS tasks
        other = free_name(base, "__mix_salt")
        salted = shares.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn(salt, F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(salt) == F.col(other)))
    copies = F.col(own["whole"]) + (draw(F.col(doc_id), seed) < F.col(own["share"])).cast("long")
    return joined.select(*base.columns, F.col(own["source_size"]).alias("source_size"), F.col(own["target"]).alias("target"), copies.alias("copies"))


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document ``copies`` times."""
    copy = free_name(mixed, "__copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; every column is derived from :func:`mix_sources`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::BIGINT AS weight FROM d GROUP BY source
), lined AS (
  SELECT *, sum(3 * source_size) OVER w AS caps, (sum(weight) OVER ()) - (sum(weight) OVER w) AS rest, (sum(source_size) OVER ()) AS total
  FROM per WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), marked AS (
  SELECT *, caps * weight + 3 * source_size * rest <= total * weight AS capped FROM lined
), leveled AS (
  SELECT *, coalesce(sum(3 * source_size) FILTER (WHERE capped) OVER (), 0) AS taken_, coalesce(sum(weight) FILTER (WHERE NOT capped) OVER (), 0) AS open_ FROM marked
), rates AS (
  SELECT source, source_size, CASE WHEN capped OR open_ = 0 THEN (3 * source_size)::DOUBLE ELSE (total - taken_)::DOUBLE * weight::DOUBLE / open_::DOUBLE END AS target FROM leveled
), classes AS (
  SELECT d.source, d.size, count(*) AS n, any_value(r.source_size) AS source_size, any_value(r.target) AS target, any_value(CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END) AS rate
  FROM d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source GROUP BY d.source, d.size
), placed AS (
  SELECT *, rate - floor(rate) AS fraction, sum(n) OVER (PARTITION BY source ORDER BY size)::BIGINT AS upto,
    ('0x' || substr(md5('2024:' || coalesce('source:' || source, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS offset_ FROM classes
), shares AS (
  SELECT *, (floor(upto * fraction + offset_) - floor((upto - n) * fraction + offset_)) / n AS share FROM placed
), joined AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.rate, s.share, ('0x' || substr(md5('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source AND d.size = s.size
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (u < share)::BIGINT))::BIGINT AS taken FROM joined
"""
