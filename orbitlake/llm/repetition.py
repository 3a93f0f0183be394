"""Quality rules on repetition inside a document, from suffix arrays over words.

The documents of a block share one suffix array: the first symbol of a word
includes its document, so suffixes of different documents never share a prefix.
Ranks are refined by prefix doubling on the suffixes that are still tied, and
longest common prefixes of neighbours come from the ranks of every level; of a
text of more than MOST_LEVELLED words, whose levels would fill the memory, from
one walk along the text (Kasai's), which needs the last ranks only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns
from .textscan import Block, blocks, mix, span_hashes

#: Base rules: fewest words, and the percentage of words in repeated windows of BASE_WINDOW words.
FEWEST_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
#: The method's rules: repeated substrings from SHORTEST words on may cover PERCENT of the words, none may be over LONGEST words.
SHORTEST, PERCENT, LONGEST = 4, 50, 40
#: Bytes of a block: suffix arrays of about this much text at once.
BLOCK_BYTES = 1 << 20
#: Words up to which the ranks of all levels are kept (8 bytes a word and level, 20 levels at most).
MOST_LEVELLED = 1 << 20

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_ranks(symbols: np.ndarray, keep: bool = True) -> list[np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4, ... symbols of every suffix; equal prefixes have equal ranks, the last are all distinct.  Without ``keep`` only the last.

    A rank is the place of the group's first suffix in sorted order, so ranks
    that are settled stay as they are and only tied groups are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[order][1:] != symbols[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    sizes = np.bincount(rank, minlength=n)
    levels, step = [rank], 1
    tied = np.flatnonzero(sizes[rank] > 1)
    while len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        at = np.argsort(rank[tied] * (n + 1) + second + 1)
        tied, group, second = tied[at], rank[tied[at]], second[at]
        index = np.arange(len(tied))
        new_group = np.ones(len(tied), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_part = new_group.copy()
        new_part[1:] |= second[1:] != second[:-1]
        part = np.maximum.accumulate(np.where(new_part, index, 0))
        refined = group + part - np.maximum.accumulate(np.where(new_group, index, 0))
        if keep:
            rank = rank.copy()
            levels.append(rank)
        rank[tied] = refined
        tied = tied[np.bincount(part, minlength=len(tied))[part] > 1]
        step *= 2
    return levels


def common_prefixes(symbols: np.ndarray, rank: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For every place in the suffix array, what its suffix has in common with the one before it; one walk along the text.

    The next suffix of the text has at most one symbol less in common with its
    neighbour, so symbols are compared about twice each.
    """
    n, same = len(symbols), 0
    found = np.zeros(n, np.int64)
    text, place, order = memoryview(symbols), memoryview(rank), memoryview(suffixes)
    for i in range(n):
        r = place[i]
        if not r:
            same = 0
            continue
        j = order[r - 1]
        most = n - max(i, j)
        while same < most and text[i + same] == text[j + same]:
            same += 1
        found[r] = same
        same = max(same - 1, 0)
    return found


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For every position, the length of the longest substring from there that starts at another position too.

    That is the larger of the two common prefixes with the suffix array's
    neighbours: the value of the innermost LCP interval that holds the suffix.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    levels = suffix_ranks(symbols, n <= MOST_LEVELLED)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    longest, lcp = np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    if n > MOST_LEVELLED:
        lcp[:-1] = common_prefixes(symbols, levels[-1], suffixes)
        longest[suffixes] = np.maximum(lcp[:-1], lcp[1:])
        return longest
    a, b = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pairs].copy(), b[pairs].copy()
    common = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        inside = (a < n) & (b < n)
        same = inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
        moved = np.where(same, 1 << level, 0)
        a, b, common = a + moved, b + moved, common + moved
    lcp[pairs + 1] = common
    longest[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return longest


def covered(longest: np.ndarray, shortest: int) -> np.ndarray:
    """Words inside the union of all repeated substrings of at least ``shortest`` words."""
    n = len(longest)
    at = np.flatnonzero(longest >= shortest)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.subtract.at(edges, at + longest[at], 1)
    return np.cumsum(edges[:-1]) > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def duplicate_lines(b: Block) -> np.ndarray:
    """Lines (between \\n) that hold a word and equal an earlier line of their document."""
    if not len(b.data):
        return np.zeros(len(b), np.int64)
    breaks = np.flatnonzero(b.data == 10)
    full = np.flatnonzero(np.diff(b.bounds))
    starts = np.unique(np.concatenate([b.bounds[:-1][full], breaks + 1]))
    starts = starts[starts < len(b.data)]
    ends = np.append(starts[1:], len(b.data))
    ends = ends - (b.data[ends - 1] == 10)
    words = np.searchsorted(b.starts, ends) - np.searchsorted(b.starts, starts)
    starts, ends = starts[words > 0], ends[words > 0]
    doc = np.searchsorted(b.bounds, starts, side="right") - 1
    key = mix(span_hashes(b.data, starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=len(b)) - np.bincount(doc[first], minlength=len(b))


def measure(b: Block) -> dict[str, np.ndarray]:
    """Word statistics and repetition of the documents of a block."""
    starts_char = (b.data & 0xC0) != 0x80
    out = {"n_words": b.n_words, "word_chars": b.per_doc(starts_char & b.in_word), "n_symbols": b.per_doc(SYMBOLS[b.data]), "n_dup_lines": duplicate_lines(b)}
    symbols = mix(b.word_hash ^ mix(b.word_doc.astype(np.uint64) + np.uint64(1)))
    longest = longest_repeats(symbols)
    out["n_repeat_words"] = _sums(covered(longest, BASE_WINDOW), b.word_bounds)
    out["covered"] = covered(longest, SHORTEST)
    out["covered_words"] = _sums(out["covered"], b.word_bounds)
    best = np.zeros(len(b), np.int64)
    np.maximum.at(best, b.word_doc, longest)
    out["longest_repeat"] = best
    return out


def spans(flags: np.ndarray, bounds: np.ndarray) -> list[list[dict[str, int]]]:
    """Runs of true flags as (start, end) word positions, document by document."""
    padded = np.concatenate([[False], flags, [False]])
    change = padded[1:] != padded[:-1]
    edge = np.flatnonzero(change)
    pieces: list[list[dict[str, int]]] = [[] for _ in range(len(bounds) - 1)]
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        doc = int(np.searchsorted(bounds, lo, side="right")) - 1
        while lo < hi:
            end = min(hi, bounds[doc + 1])
            if end > lo:
                pieces[doc].append({"start": int(lo - bounds[doc]), "end": int(end - bounds[doc])})
            lo, doc = end, doc + 1
    return pieces


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
SCHEMA = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("repeat_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def repetition_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus counts, ``covered_words``, ``longest_repeat`` (words) and ``repeat_spans``.

    ``repeat_spans`` is the union of the spans of all maximal repeated
    substrings of at least SHORTEST words, as word positions [start, end).
    Null and empty texts have zeros and no spans; copies of a document are
    judged alike, as nothing outside the document counts.  Columns of the
    added names are replaced, all others kept.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        counts: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
        found: list[list[dict[str, int]]] = []
        for b in blocks(batch.column(text), BLOCK_BYTES):
            m = measure(b)
            for c in COUNTS:
                counts[c].append(m[c])
            found += spans(m["covered"], b.word_bounds)
        return [*[pa.array(np.concatenate(counts[c]) if counts[c] else [], pa.int64()) for c in COUNTS], pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    return add_columns(df, SCHEMA, compute)


def repetition_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """:func:`repetition_features` plus ``base_failed`` and the verdict ``kept``."""
    made = repetition_features(df, text)
    base = (F.col("n_words") < FEWEST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_PERCENT)
    repeats = (F.col("covered_words") * 100 > F.col("n_words") * PERCENT) | (F.col("longest_repeat") > LONGEST)
    return made.withColumn("base_failed", base).withColumn("kept", ~base & ~repeats)


def op8_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules over every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"]
    return repetition_rules(docs).select(*columns)


def _window_sql(k: int) -> str:
    """Words inside k-word windows that occur twice or more in their text."""
    return f"""
    SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
      SELECT doc_id, unnest(range(i, i + {k})) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
          SELECT doc_id, i, array_to_string(words[i:i + {k - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {k - 2})) AS i FROM split)))
      WHERE c > 1)
    GROUP BY doc_id"""


#: Takes doc_id as the key of documents, as the contract does.  A repeat over LONGEST words is a window of one more word found twice.
OP8_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM split
), base AS ({_window_sql(BASE_WINDOW)}), wide AS ({_window_sql(SHORTEST)}), longer AS ({_window_sql(LONGEST + 1)}), joined AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(base.n, 0) AS n_repeat_words, coalesce(wide.n, 0) AS covered_words, longer.n IS NOT NULL AS long_repeat
  FROM counted c LEFT JOIN base USING (doc_id) LEFT JOIN wide USING (doc_id) LEFT JOIN longer USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
  n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words) AND NOT (100 * covered_words > {PERCENT} * n_words OR long_repeat) AS kept
FROM joined
"""
