"""Spelling variants: words one edit apart, by full neighbourhood generation.

Every word of the vocabulary emits all its distinct deletions, replacements and
insertions over the observed alphabet, and the candidates are hash-joined to the
vocabulary by equality: what is in it is exactly one edit away, so no distance is
ever computed.  A neighbourhood has some thousand strings, nearly all of them no
words.  Their hashes are therefore made first, in arrays, and looked up in a
Bloom filter of the vocabulary; only strings that pass it are written out and
shuffled.  The filter drops no word and the join drops what it passes in error,
so the result is that of the full join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import rows_to_rows
from .storage import scratch, stored

#: A word's form occurs at least so many times as often as the word.
RATIO = 5
#: Bits of the filter for each word, probes of a word, and the most bits there are (32 MB): beyond, more candidates are shuffled.
BITS_PER_WORD, PROBES, MOST_BITS = 32, 3, 1 << 28
#: Hashes that are held at once.
CHUNK = 1 << 21
#: An odd multiplier and its inverse modulo 2**64, and the multipliers of the probes.
_P = 0xD6E8FEB86659FD93
_Q = pow(_P, -1, 1 << 64)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together: their places, and a matrix of their code points."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(rows) and lengths[rows[0]]:
            codes = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), np.uint32)
            yield rows, codes.reshape(len(rows), -1).astype(np.uint64)


def _prefixes(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2, ... code points of every row."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers[: codes.shape[1]], axis=1, out=out[:, 1:])
    return out


def probes(hashes: np.ndarray, log_bits: int, which: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(31))) * _SPREAD[which]) >> np.uint64(64 - log_bits)


def word_probes(words: list[str], log_bits: int) -> np.ndarray:
    """Bits of the filter that the words set."""
    found = [np.zeros(0, np.uint64)]
    for _, codes in by_length(words):
        whole = _prefixes(codes, _powers(_P, codes.shape[1]))[:, -1]
        found += [probes(whole, log_bits, i) for i in range(PROBES)]
    return np.concatenate(found)


class Filter:
    """A Bloom filter as 64-bit words; ``passing`` gives the flat places of the hashes that may be in it."""

    def __init__(self, words: np.ndarray, log_bits: int):
        self.words, self.log_bits = words, log_bits

    def passing(self, hashes: np.ndarray, valid: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(valid)
        hashes = hashes.ravel()[at]
        for i in range(PROBES):
            bit = probes(hashes, self.log_bits, i)
            hit = (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at, hashes = at[hit], hashes[hit]
        return at


def neighbourhood(words: list[str], alphabet: np.ndarray, known: Filter) -> Iterator[tuple[list[int], list[str]]]:
    """All distinct strings one edit away from each word that pass ``known``: places of the words, and the strings.

    One of each is made: of a run of equal characters the last is deleted, a
    character is inserted before another one only, and replaced by others only.
    """
    letters = alphabet.astype(np.uint64)
    for rows, codes in by_length(words):
        n, length = codes.shape
        powers = _powers(_P, length + 1)
        step = max(1, CHUNK // max(1, len(letters) * min(length + 1, CHUNK)))
        for lo in range(0, n, step):
            part, own = codes[lo : lo + step], [words[i] for i in rows[lo : lo + step]]
            pre = _prefixes(part, powers)
            whole = pre[:, -1:]
            fewer = pre[:, :-1] + (whole - pre[:, 1:]) * np.uint64(_Q)
            last = np.ones(part.shape, bool)
            last[:, :-1] = part[:, :-1] != part[:, 1:]
            at = known.passing(fewer, last)
            r, p = at // length, at % length
            yield rows[lo + r].tolist(), [own[i][:j] + own[i][j + 1 :] for i, j in zip(r.tolist(), p.tolist(), strict=True)]
            width = max(1, CHUNK // max(1, len(letters) * len(part)))
            for first in range(0, length + 1, width):
                for keep in (1, 0):  # replacements, insertions
                    here = np.arange(first, min(first + width, length + 1 - keep))
                    if not len(here) or not len(letters):
                        continue
                    now = np.full((len(part), len(here)), np.iinfo(np.uint64).max, np.uint64)
                    inner = here < length
                    now[:, inner] = part[:, here[inner]]
                    base = whole - (now + np.uint64(1)) * powers[here] if keep else pre[:, here] + (whole - pre[:, here]) * np.uint64(_P)
                    hashes = base[:, :, None] + ((letters + np.uint64(1))[None, :] * powers[here][:, None])[None]
                    at = known.passing(hashes, now[:, :, None] != letters)
                    r, rest = at // (len(here) * len(letters)), at % (len(here) * len(letters))
                    p, c = first + rest // len(letters), letters[rest % len(letters)]
                    made = [own[i][:j] + chr(k) + own[i][j + keep :] for i, j, k in zip(r.tolist(), p.tolist(), c.tolist(), strict=True)]
                    yield rows[lo + r].tolist(), made


def vocabulary_filter(vocabulary: DataFrame, n_words: int, word: str = "word") -> Filter:
    """The filter of all words: one row for each 64 bits reaches the driver, MOST_BITS / 64 of them at most."""
    log_bits = max(6, min(max(1, n_words) * BITS_PER_WORD, MOST_BITS).bit_length())
    log_bits = min(log_bits, MOST_BITS.bit_length() - 1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            bit = np.unique(word_probes(batch.column(0).to_pylist(), log_bits))
            at, first = np.unique(bit >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(bit) else bit
            yield {"at": pa.array(at.astype(np.int64)), "bits": pa.array(value.view(np.int64))}

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("bits", T.LongType())])
    rows = rows_to_rows(vocabulary.select(word), schema, step).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (log_bits - 6), np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words, log_bits)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n): how many words of ``vocabulary`` (word, n; words distinct) are one edit away, and the most frequent of them.

    Ties go to the smallest in code-point order; a word without near ones has 0
    and nulls.  Being near is mutual, so candidates are gathered where they are
    words themselves, beside the words that emitted them: one shuffle, on a key
    that at most a neighbourhood's worth of words share.
    """
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()  # code points, so bounded
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint64)
    held = spark.sparkContext.broadcast(vocabulary_filter(vocabulary, vocabulary.count()))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1)
            for places, made in neighbourhood(words, alphabet, held.value):
                if made:
                    at = pa.array(places)
                    yield {"candidate": pa.array(made), "from": batch.column(0).take(at), "from_n": counts.take(at)}

    schema = T.StructType([T.StructField("candidate", T.StringType()), T.StructField("from", T.StringType()), T.StructField("from_n", T.LongType())])
    emitted = rows_to_rows(vocabulary.select("word", "n"), schema, step)
    best = F.min(F.struct((-F.col("from_n")).alias("minus"), F.col("from").alias("word")))
    met = emitted.groupBy("candidate").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.select("word", "n").join(met, F.col("word") == F.col("candidate"), "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.minus")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form) without cycles: the last of each word's forms, by pointer jumping."""
    found = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("__moved"))
        moved = stored(moved, "roots")
        found = moved.drop("__moved")
        if moved.filter("__moved").isEmpty():
            return found


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``vocabulary`` (word, n).

    A word's form is its most frequent near word, if that is at least ``ratio``
    (over 1) times as frequent; ``root`` follows the forms to the last.
    Rows with a null or empty word or a null count are left out, rows of the
    same word are added up; an empty table gives an empty one; further columns
    are not read.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word, or forms could go round in circles")
    counted = vocabulary.select(F.col("word").alias("word"), F.col("n").cast("long").alias("n")).filter("word <> '' AND n IS NOT NULL")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words)
    taken = F.col("near_n") >= F.lit(ratio) * F.col("n")
    formed = stored(near.select("word", "n", "n_near", F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n")), "formed")
    last = roots(formed.filter("form IS NOT NULL"))
    joined = formed.join(last, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the contract's words: fewest code points, fewest occurrences, and which runs lose a code point.
SHORTEST, FEWEST, EVERY = 6, 5, 199


def planted_words(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters, some with a code point left out by a hash of document and run.

    A run that is too short has no word, with or without that code point, so it is not extracted.
    """
    letters = f"[a-z\\u00C0-\\u00FF]{{{SHORTEST},}}+"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(letters), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= FEWEST)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the frequent words of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with scratch(spark):
        return stored(spelling_variants(planted_words(docs)), "variants", keep=True)


#: crc32 by its table, made from the polynomial 0xEDB88320; near words share a string with one place blotted out, or one is the other with one place left out.
OP11_SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS tb FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
  WHERE length(run) >= {SHORTEST} GROUP BY doc_id, run
), coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
    lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255)::INTEGER + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM coded, crc_table
), words AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {FEWEST}
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), blotted AS (SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS k FROM places
), shorter AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS k FROM places
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM blotted a JOIN blotted b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT s.word, s.n, v.word, v.n FROM shorter s JOIN vocabulary v ON s.k = v.word
  UNION ALL SELECT v.word, v.n, s.word, s.n FROM shorter s JOIN vocabulary v ON s.k = v.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, row(-near_n, encode(near))) AS form, max(near_n) AS form_n FROM near GROUP BY word
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= {RATIO} * v.n THEN form END AS form, CASE WHEN form_n >= {RATIO} * v.n THEN form_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)
), followed(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT f.word, d.form FROM followed f JOIN formed d ON f.root = d.word WHERE d.form IS NOT NULL
), last AS (SELECT f.word, f.root FROM followed f JOIN formed d ON f.root = d.word WHERE d.form IS NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN last USING (word)
"""
