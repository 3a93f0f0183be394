"""Substring deduplication: shared k-mer seeds, collinear chains through a Fenwick tree, alignment of the chains.

Seeds are the minimizers of every WINDOW consecutive k-mers of words: any
K + WINDOW - 1 equal words have a seed in common, wherever they stand.  All
occurrences of a seed are matched with its first one (least document, then
position), so a passage that many documents share gives one match an
occurrence, not one a pair.  Those of a seed that is frequent in one task's
documents are matched with the first one there, so a seed of a third of all
documents sends few rows to the task that matches it.  Parts of a passage may
occur first in different documents, so seeds of LONG words are matched too:
their first occurrence has more of the passage.  The matches of a document with one earlier
document are chained in order, with costs for gaps; a chain is a candidate
passage, and aligning its words decides where it begins and ends and how
similar it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns, free_name, rows_to_rows
from .storage import partitions, scratch, stored
from .textscan import Block, blocks
from .weighted_sets import planes, unplanes

#: Words of a seed, k-mers of a window, least words and similarity of a passage.
K, WINDOW, LEAST_WORDS, SIMILAR = 5, 2, 50, 0.8
#: Cost of a skipped word in a chain, widest gap inside a passage, words beyond a chain that the alignment looks at.
GAP_COST, WIDEST_GAP, MARGIN = 0.1, 64, 40
#: Words of a chain that is aligned: more than a seed or two neighbours, little enough for passages that are full of edits.
LEAST_CHAIN = 16
#: Words of a long seed and of the pieces that choose it: any 2 * LONG - PART - 1 = 41 equal words have a long seed in common.
LONG, PART = 24, 6
#: Words of a piece of text that is fetched for alignments.
PIECE = 64
#: Seeds that a task packs together, occurrences among them from which a seed is matched there and then, matches of a row,
#: seeds of a bucket (sorted in memory).
TOGETHER, FREQUENT, READY_ROWS, BUCKET = 1 << 19, 64, 1 << 16, 1 << 20
#: Unequal words of a run, less than CLOSE equal ones apart, that are aligned anew if there are more than FEW of them.
CLOSE, FEW = 3, 3
BLOCK_BYTES = 1 << 19


# Seeds


def minimizers(hashes: np.ndarray, first: np.ndarray, kmers: np.ndarray) -> np.ndarray:
    """Indices of the minimizers of all windows of WINDOW k-mers; document d has ``kmers[d]`` from index ``first[d]``."""
    n, mask = len(hashes), np.uint64(0xFFFFF)
    value = (hashes & ~mask) | (np.arange(n, dtype=np.uint64) & mask)
    width = 1
    while 2 * width <= WINDOW:
        value = np.minimum(value[: len(value) - width], value[width:])
        width *= 2
    rest = WINDOW - width
    value = np.minimum(value[: len(value) - rest], value[rest:]) if rest else value
    windows = np.maximum(kmers - WINDOW + 1, 0)
    at = np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    place = at + ((value[at] & mask).astype(np.int64) - at & 0xFFFFF)
    return np.unique(place)


def long_seeds(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the windows of LONG words whose least piece of PART words is their first or last one.

    The words of a window alone decide, so all copies of a passage choose the same ones.
    """
    hashes, at = b.shingles(LONG)
    pieces, _ = b.shingles(PART)
    if not len(hashes):
        return hashes, at
    windows, n = np.maximum(b.n_words - LONG + 1, 0), np.maximum(b.n_words - PART + 1, 0)
    first = np.repeat(np.cumsum(n) - n - np.cumsum(windows) + windows, windows) + np.arange(len(hashes))
    last, least = first + LONG - PART, pieces[first]
    for i in range(1, LONG - PART + 1):
        least = np.minimum(least, pieces[first + i])
    chosen = (b.n_words[b.word_doc[at]] >= LEAST_WORDS) & (np.minimum(pieces[first], pieces[last]) == least)
    return hashes[chosen], at[chosen]


def occurrences(seed: np.ndarray, doc: np.ndarray, pos: np.ndarray, least: int, long: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which rows belong to seeds that occur less than ``least`` times, or come first; and (doc, pos, ref, ref_pos) of all others with the first.

    A document's first match of a long seed gives its first and last K words;
    later ones repeat an earlier place of the document itself, which
    ``with_previous`` sees (in periodic texts, on one diagonal).
    """
    order = np.argsort(seed)
    ranked = seed[order]
    often = np.diff(np.append(np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])), len(seed)))
    frequent = np.zeros(len(seed), bool)
    frequent[order] = np.repeat(often >= least, often)
    at = np.flatnonzero(frequent)
    at = at[np.lexsort((pos[at], doc[at], seed[at]))]
    new = np.append(True, seed[at][1:] != seed[at][:-1])[: len(at)]
    first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    again = np.append(False, doc[at][1:] == doc[at][:-1])[: len(at)]
    frequent[at[new]] = False
    at, first, again = at[~new], first[~new], again[~new]
    found = [doc[at], pos[at], doc[first], pos[first]]
    if long:
        ends = np.flatnonzero(~again)
        found = [np.append(x, x[ends] + (LONG - K) * (k % 2)) for k, x in enumerate(found)]
    return ~frequent, tuple(found)


#: Rows on their way to buckets: seeds (of K or of LONG words) with their documents and places, or matches already made.
ROWS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.ByteType()), *[T.StructField(c, T.BinaryType()) for c in ("seed", "doc", "pos", "ref", "ref_pos")]])
MATCHES = T.StructType([T.StructField("doc", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("ref", T.LongType()), T.StructField("ref_pos", T.IntegerType())])
_READY = 2


def _steps(values: np.ndarray) -> bytes:
    """Numbers as differences from the one before, byte by byte: those of neighbouring rows compress well."""
    values = values.astype(np.int64).view(np.uint64)
    return planes(values - np.append(np.zeros(1, np.uint64), values[:-1]))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64).view(np.int64)


def seed_rows(df: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """The seeds of all documents of LEAST_WORDS words or more, packed by bucket of their hash."""

    def of(held: list[list[tuple[np.ndarray, ...]]]) -> dict[str, pa.Array]:
        out: dict[str, list] = {f.name: [] for f in ROWS}
        for kind, rows in enumerate(held):
            seed, doc, pos = (np.concatenate(x) for x in zip(*rows, strict=True))
            keep, ready = occurrences(seed, doc, pos, FREQUENT, kind == 1)
            seed, doc, pos = seed[keep], doc[keep], pos[keep]
            bucket = (((seed >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # in order of documents within a bucket
            bucket = bucket[order]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            parts = [(int(bucket[i]), kind, seed[order[i:j]].astype("<u8").tobytes(), _steps(doc[order[i:j]]), _steps(pos[order[i:j]]), b"", b"") for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True)]
            parts += [(int(ready[0][i] % buckets), _READY, b"", *(_steps(x[i : i + READY_ROWS]) for x in ready)) for i in range(0, len(ready[0]), READY_ROWS)]
            for part in parts:
                for name, x in zip(out, part, strict=True):
                    out[name].append(x)
        return {f.name: pa.array(out[f.name], t) for f, t in zip(ROWS, (pa.int32(), pa.int8(), *[pa.binary()] * 5), strict=True)}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        held: list[list[tuple[np.ndarray, ...]]] = [[], []]
        rows = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1), BLOCK_BYTES):
                hashes, at = b.shingles(K)
                if len(hashes) < WINDOW:
                    continue
                kmers = np.maximum(b.n_words - K + 1, 0)
                first = np.cumsum(kmers) - kmers
                found = minimizers(hashes, first, np.where(b.n_words >= LEAST_WORDS, kmers, 0))
                for kind, (seed, word) in enumerate(((hashes[found], at[found]), long_seeds(b))):
                    doc = b.word_doc[word]
                    held[kind].append((seed, ids[b.lo + doc], word - b.word_bounds[doc]))
                    rows += len(seed)
                if rows >= TOGETHER:
                    yield of(held)
                    held, rows = [[], []], 0
        if held[0]:
            yield of(held)

    return rows_to_rows(df.select(doc_id, text), ROWS, step)


def matches(rows: DataFrame) -> DataFrame:
    """(doc, pos, ref, ref_pos): every occurrence of a repeated seed but the first, with the first one of its bucket or task."""
    tasks = partitions(rows.sparkSession)
    dealt = rows.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "kind")

    def table(found: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
        return {f.name: x.astype(np.int32 if "pos" in f.name else np.int64) for f, x in zip(MATCHES, found, strict=True)}

    def of(held: list[tuple[np.ndarray, ...]], kind: int) -> dict[str, np.ndarray]:
        return table(occurrences(*(np.concatenate(x) for x in zip(*held, strict=True)), 2, kind == 1)[1])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[tuple[np.ndarray, ...]] = []
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, kind, seed, *rest = (batch.column(c)[i].as_py() for c in range(7))
                if kind == _READY:
                    yield table(tuple(_sums(x) for x in rest))
                    continue
                if held and now != (bucket, kind):
                    yield of(held, now[1])
                    held = []
                now = (bucket, kind)
                held.append((np.frombuffer(seed, "<u8"), _sums(rest[0]), _sums(rest[1])))
        if held:
            yield of(held, now[1])

    return rows_to_rows(dealt, MATCHES, step)


# Chains


class Fenwick:
    """Greatest value, and whose it is, over a prefix of places."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, who: int) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place][0]:
                self.best[place] = (value, who)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        """Of the places below ``place``."""
        found = (float("-inf"), -1)
        while place > 0:
            if self.best[place][0] > found[0]:
                found = self.best[place]
            place -= place & -place
        return found


def chain(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Best collinear chains of ``runs`` (pos, ref_pos, length), each run in one chain at most.

    A run may follow another that begins its last seed before it in both
    documents.  A chain scores its runs' lengths less GAP_COST for every word
    between, which splits into a part of either run, so the best predecessor is
    the greatest (score + cost * place) over a prefix.  Chains are taken from
    the best end on; a link over a gap wider than WIDEST_GAP ends a chain.
    """
    order = sorted(range(len(runs)), key=lambda i: (runs[i][1], runs[i][0]))
    lasts = [(p + n - K, r + n - K) for p, r, n in runs]
    places = sorted({p for p, _ in lasts})
    rank = {p: i for i, p in enumerate(places)}
    tree, waiting = Fenwick(len(places)), sorted(range(len(runs)), key=lambda i: lasts[i][1])
    score, before, put = [0.0] * len(runs), [-1] * len(runs), 0
    import bisect

    for i in order:
        pos, ref, length = runs[i]
        while put < len(waiting) and lasts[waiting[put]][1] < ref:
            j = waiting[put]
            tree.put(rank[lasts[j][0]], score[j] + GAP_COST * sum(lasts[j]), j)
            put += 1
        value, j = tree.upto(bisect.bisect_left(places, pos))
        gain = value - GAP_COST * (pos + ref)
        score[i] = length + max(gain, 0.0)
        if gain > 0 and max(pos - lasts[j][0] - K, ref - lasts[j][1] - K) <= WIDEST_GAP:
            before[i] = j
    used, out = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(runs[i])
            i = before[i]
        if links:
            out.append(links[::-1])
    return out


def diagonal_runs(doc: np.ndarray, ref: np.ndarray, pos: np.ndarray, ref_pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches on one diagonal of a pair of documents, not over WIDEST_GAP apart, as runs (doc, ref, pos, ref_pos, length)."""
    order = np.lexsort((pos, pos - ref_pos, ref, doc))
    doc, ref, pos, ref_pos = doc[order], ref[order], pos[order], ref_pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (pos[1:] - ref_pos[1:] != pos[:-1] - ref_pos[:-1]) | (pos[1:] - pos[:-1] > WIDEST_GAP)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(doc)) - 1
    return doc[start], ref[start], pos[start], ref_pos[start], pos[last] + K - pos[start]


def with_previous(doc: np.ndarray, ref: np.ndarray, pos: np.ndarray, ref_pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches with other documents as they are, and every later occurrence of a seed in a document with the one before it.

    Matching with the first occurrence would tear a periodic text into single
    matches; with the previous one they lie on one diagonal.
    """
    order = np.lexsort((pos, ref_pos, ref, doc))
    doc, ref, pos, ref_pos = doc[order], ref[order], pos[order], ref_pos[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (ref[1:] == ref[:-1]) & (ref_pos[1:] == ref_pos[:-1])
    before = np.where(same, np.append(0, pos[:-1]), ref_pos)
    own, other = same | (doc == ref), doc != ref
    return np.append(doc[other], doc[own]), np.append(ref[other], doc[own]), np.append(pos[other], pos[own]), np.append(ref_pos[other], before[own])


CHAINS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc", "ref")], *[T.StructField(c, T.IntegerType()) for c in ("pos", "end", "ref_pos", "ref_end")], T.StructField("runs", T.ArrayType(T.IntegerType()))])


def chains(found: DataFrame) -> DataFrame:
    """Chains of LEAST_CHAIN words or more; ``runs`` lists (pos, ref_pos, length) one after the other.

    All matches of a document come together in one task: as many as it has seeds at most.
    """
    dealt = found.repartition(partitions(found.sparkSession), "doc").sortWithinPartitions("doc")

    def of(*found: np.ndarray) -> dict[str, pa.Array]:
        new = np.unique(np.stack(found), axis=1)  # long and short seeds may give the same match
        runs = diagonal_runs(*with_previous(*new))
        order = np.lexsort((runs[2], runs[1], runs[0]))
        d, r, p, q, n = (x[order] for x in runs)
        edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]))) if len(d) else np.zeros(0, np.int64)
        out = []
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(d)], strict=True):
            if hi == lo + 1:
                if n[lo] >= LEAST_CHAIN:
                    out.append((d[lo], r[lo], [(int(p[lo]), int(q[lo]), int(n[lo]))]))
            else:
                made = chain(list(zip(p[lo:hi].tolist(), q[lo:hi].tolist(), n[lo:hi].tolist(), strict=True)))
                out += [(d[lo], r[lo], c) for c in made if c[-1][0] + c[-1][2] - c[0][0] >= LEAST_CHAIN]
        return {
            "doc": pa.array([x[0] for x in out], pa.int64()),
            "ref": pa.array([x[1] for x in out], pa.int64()),
            "pos": pa.array([x[2][0][0] for x in out], pa.int32()),
            "end": pa.array([x[2][-1][0] + x[2][-1][2] for x in out], pa.int32()),
            "ref_pos": pa.array([x[2][0][1] for x in out], pa.int32()),
            "ref_end": pa.array([x[2][-1][1] + x[2][-1][2] for x in out], pa.int32()),
            "runs": pa.array([[v for run in x[2] for v in run] for x in out], pa.list_(pa.int32())),
        }

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            now = tuple(batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "ref", "pos", "ref_pos"))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last document may go on
            if whole:
                yield of(*(x[:whole] for x in held))
                held = tuple(x[whole:] for x in held)
        if held is not None and len(held[0]):
            yield of(*held)

    return rows_to_rows(dealt, CHAINS, step)


# Alignment


#: Steps of an alignment: a column takes a word of the document (1), of the other (2), or of both (3).
OWN, OTHER, BOTH = 1, 2, 3


def _gap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, equal) of the columns of two short pieces with the fewest edits."""
    if not len(a) or not len(b):
        return np.full(len(a) + len(b), OWN if len(a) else OTHER, np.int8), np.zeros(len(a) + len(b), bool)
    across = np.arange(len(b) + 1)
    rows = [across]
    for x in a:
        best = np.append(rows[-1][0] + 1, np.minimum(rows[-1][1:] + 1, rows[-1][:-1] + (b != x)))
        rows.append(np.minimum.accumulate(best - across) + across)
    i, j, steps, equal = len(a), len(b), [], []
    while i or j:
        same = bool(i and j and a[i - 1] == b[j - 1])
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (not same):
            step = BOTH
        else:
            step = OWN if i and rows[i][j] == rows[i - 1][j] + 1 else OTHER
        steps.append(step)
        equal.append(same and step == BOTH)
        i, j = i - (step & OWN), j - (step >> 1)
    return np.array(steps[::-1], np.int8), np.array(equal[::-1], bool)


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words to go on along the diagonal, and the sum over them: the best one of +1 and -2, given up 6 below it."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    total = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    stop = np.flatnonzero(total < np.maximum.accumulate(np.maximum(total, 0)) - 6)
    until = int(stop[0]) if len(stop) else n
    if not until or total[:until].max() <= 0:
        return 0, 0
    best = int(total[:until].argmax())
    return best + 1, int(total[best])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, equal) of the columns by which an alignment goes on: along the diagonal, and along a near one where that is worth the words left out."""
    steps, equal, i, j = [], [], 0, 0
    while True:
        best = (0, 0, 0, 0)  # gain, words left out of a, of b, words along the diagonal
        for left, right in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2)):
            n, gain = _reach(a[i + left :], b[j + right :])
            best = max(best, (gain - 2 * (left + right), left, right, n))
        gain, left, right, n = best
        if gain <= 0:
            break
        steps += [np.full(left + right, OWN if left else OTHER, np.int8), np.full(n, BOTH, np.int8)]
        equal += [np.zeros(left + right, bool), a[i + left : i + left + n] == b[j + right : j + right + n]]
        i, j = i + left + n, j + right + n
    return (np.concatenate(steps), np.concatenate(equal)) if steps else (np.zeros(0, np.int8), np.zeros(0, bool))


def similar_segments(equal: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [lo, hi) of columns, LEAST_WORDS or more with SIMILAR of them equal: the longest one, then those left and right of it.

    Unequal words at the ends are left off, and so are ends in which equal
    words are so rare that they look like chance, where enough words remain.
    """
    out, todo = [], [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST_WORDS:
            continue
        total = np.append(0.0, np.cumsum(np.where(equal[lo:hi], 1 - SIMILAR, -SIMILAR)))
        high = np.maximum.accumulate(total[::-1])[::-1]
        # For every beginning, the last end from which on the sum is never again as large.
        ends = len(high) - 1 - np.searchsorted(high[::-1], total - 1e-9)
        longest = int(np.argmax(ends - np.arange(len(total))))
        i, j = longest, int(ends[longest])
        if j - i < LEAST_WORDS:
            continue
        where = np.flatnonzero(equal[lo + i : lo + j])
        i, j = lo + i + int(where[0]), lo + i + int(where[-1]) + 1
        drift = np.append(0, np.cumsum(np.where(equal[i:j], 1, -2)))
        end = int(drift.argmax())
        begin = int(len(drift[: end + 1]) - 1 - drift[: end + 1][::-1].argmin())
        if end - begin >= LEAST_WORDS:
            i, j = i + begin, i + end
        todo += [(lo, i), (j, hi)]
        if j - i >= LEAST_WORDS:
            out.append((i, j))
    return sorted(out)


def _along(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, equal) of the columns of two equally long pieces on one diagonal.

    Words that were put in and left out move what is between them to other
    diagonals; unequal words close to each other are aligned with the fewest edits.
    """
    same = a == b
    differ = np.flatnonzero(~same)
    if len(differ) <= FEW:
        return np.full(len(a), BOTH, np.int8), same
    steps, equal, done = [], [], 0
    edge = np.flatnonzero(np.append(True, np.diff(differ) > CLOSE))
    for lo, hi in zip(differ[edge].tolist(), (differ[np.append(edge[1:], len(differ)) - 1] + 1).tolist(), strict=True):
        if hi - lo <= FEW:
            continue
        taken, alike = _gap(a[lo:hi], b[lo:hi])
        steps += [np.full(lo - done, BOTH, np.int8), taken]
        equal += [same[done:lo], alike]
        done = hi
    return np.concatenate([*steps, np.full(len(a) - done, BOTH, np.int8)]), np.concatenate([*equal, same[done:]])


def align(runs: np.ndarray, words: np.ndarray, at: int, ref_words: np.ndarray, ref_at: int) -> list[tuple[int, int, int, int, float]]:
    """(pos, end, ref_pos, ref_end, identity) of the passages of a chain; ``words`` are a document's from word ``at`` on.

    Words on a run's diagonal are compared one by one, gaps (and stretches of
    unequal words) are aligned with the fewest edits, and both ends go on while words agree.  The alignment is
    then cut where too few words are equal: a passage's identity is the share
    of equal words among its columns.
    """
    pos, ref = int(runs[0][0]) - at, int(runs[0][1]) - ref_at
    back, same = (x[::-1] for x in _extend(words[:pos][::-1], ref_words[:ref][::-1]))
    begin, ref_begin = pos - int((back & OWN).sum()), ref - int((back >> 1).sum())
    steps, equal = [back], [same]
    for p, q, n in runs.tolist():
        p, q = p - at, q - ref_at
        cut = max(pos - p, ref - q, 0)  # what an earlier run has taken already
        if cut >= n:
            continue
        p, q, n = p + cut, q + cut, n - cut
        taken, same = _gap(words[pos:p], ref_words[ref:q])
        n = min(n, len(words) - p, len(ref_words) - q)
        along, alike = _along(words[p : p + n], ref_words[q : q + n])
        steps += [taken, along]
        equal += [same, alike]
        pos, ref = p + n, q + n
    on, same = _extend(words[pos:], ref_words[ref:])
    step, same = np.concatenate([*steps, on]), np.concatenate([*equal, same])
    own, other = np.append(0, np.cumsum(step & OWN)) + begin + at, np.append(0, np.cumsum(step >> 1)) + ref_begin + ref_at
    found = [(int(own[i]), int(own[j]), int(other[i]), int(other[j]), float(same[i:j].mean())) for i, j in similar_segments(same)]
    return [x for x in found if x[1] - x[0] >= LEAST_WORDS and x[4] >= SIMILAR]


def _pieces(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """(doc, piece, words): 32-bit hashes of the words of the pieces that are needed; ``needs`` has a list for each document."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            ids, wanted = batch.column("doc").to_pylist(), batch.column("pieces")
            for b in blocks(batch.column("text"), BLOCK_BYTES):
                short = (b.word_hash >> np.uint64(32)).astype("<u4")
                doc, piece, words = [], [], []
                for i in range(len(b)):
                    own = short[b.word_bounds[i] : b.word_bounds[i + 1]]
                    for k in wanted[b.lo + i].as_py():
                        part = own[k * PIECE : (k + 1) * PIECE]
                        if len(part):
                            doc.append(ids[b.lo + i])
                            piece.append(k)
                            words.append(part.tobytes())
                yield {"doc": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "words": pa.array(words, pa.binary())}

    return rows_to_rows(docs.join(needs, "doc").select("doc", "text", "pieces"), schema, step)


PASSAGES = T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc_id", "ref_doc_id")], *[T.StructField(c, T.IntegerType()) for c in ("start", "end", "ref_start", "ref_end")], T.StructField("identity", T.DoubleType())])


def keyed(df: DataFrame, doc_id: str, text: str, key: str) -> DataFrame:
    """``df`` plus ``key``, a number for each document: its id, or from 2**62 on a hash of id and text where the id is null or names several texts."""
    own, digest = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    ids = df.select(own.alias("id"), digest.alias("h")).groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    its, many = free_name(df, f"__{key}_its"), free_name(df, f"__{key}_many")
    several = stored(ids.filter("id is null or lo <> hi").select(F.col("id").alias(its), F.lit(True).alias(many)), "several")
    if several.isEmpty():
        return df.withColumn(key, own)
    marked = df.join(several, own.eqNullSafe(F.col(its)), "left")
    hashed = F.xxhash64(F.coalesce(own, F.lit(0)), F.coalesce(F.col(text), F.lit("")))
    named = F.when(F.col(many), F.shiftrightunsigned(hashed, 2).bitwiseOR(F.lit(1 << 62))).otherwise(own)
    return marked.withColumn(key, named).drop(its, many)


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ref_doc_id, start, end, ref_start, ref_end, identity): passages that repeat an earlier document's, or an earlier place.

    Positions count words; a passage has LEAST_WORDS words or more and an
    identity of SIMILAR or more.  "Earlier" means a smaller id, or the same
    document and an earlier place, so of all copies the first is never listed.
    Null and short texts have no passages; rows that repeat an id with the same
    text are one document.  Where an id is null or names different texts, each
    text is a document, named by that id in the result, that comes after all others.
    """
    docs = keyed(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", "doc")
    found = _passages(docs)
    names = docs.filter("doc_id is null or doc <> doc_id").select(F.col("doc").alias("key"), F.col("doc_id").alias("id")).distinct()
    names = stored(names, "names")
    if names.isEmpty():
        return found
    for c in ("doc_id", "ref_doc_id"):
        found = found.join(names.withColumn("named", F.lit(True)), F.col(c) == F.col("key"), "left").withColumn(c, F.when(F.col("named"), F.col("id")).otherwise(F.col(c))).drop("key", "id", "named")
    return found


def _passages(docs: DataFrame) -> DataFrame:
    """The passages of ``docs`` (doc, text), where ``doc`` names one text."""
    repeated = stored(docs.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "repeated")
    docs = docs.select("doc", "text")
    if not repeated.isEmpty():
        docs = docs.join(repeated, "doc", "left_anti").unionByName(docs.join(repeated, "doc", "left_semi").dropDuplicates(["doc"]))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = partitions(docs.sparkSession)
    buckets = tasks * -(-max(tasks, 128, n_bytes // 8 // BUCKET) // tasks)
    found = stored(chains(matches(seed_rows(docs, "doc", "text", buckets))).withColumn("chain", F.monotonically_increasing_id()), "chains")
    span = lambda lo, hi: F.sequence(F.floor(F.greatest(F.col(lo) - MARGIN, F.lit(0)) / PIECE).cast("int"), F.floor((F.col(hi) + MARGIN) / PIECE).cast("int"))
    own = found.select("chain", F.lit(0).alias("side"), "doc", F.explode(span("pos", "end")).alias("piece"))
    other = found.select("chain", F.lit(1).alias("side"), F.col("ref").alias("doc"), F.explode(span("ref_pos", "ref_end")).alias("piece"))
    uses = own.unionByName(other)
    needs = uses.select("doc", "piece").distinct().groupBy("doc").agg(F.collect_set("piece").alias("pieces"))  # a document's pieces at most
    pieces = stored(_pieces(docs, needs), "pieces")
    gathered = uses.join(pieces, ["doc", "piece"]).groupBy("chain").agg(F.collect_list(F.struct("side", "piece", "words")).alias("pieces"))
    ready = gathered.join(found.select("chain", "doc", "ref", "runs"), "chain").select("doc", "ref", "runs", "pieces")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            out = []
            for d, r, runs, got in zip(batch.column("doc").to_pylist(), batch.column("ref").to_pylist(), batch.column("runs"), batch.column("pieces"), strict=True):
                sides: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
                for x in got.as_py():
                    sides[x["side"]][x["piece"]] = x["words"]
                words = [np.frombuffer(b"".join(s[k] for k in sorted(s)), "<u4") for s in sides]
                first = [min(s) * PIECE for s in sides]
                out += [(d, r, *passage) for passage in align(runs.values.to_numpy().reshape(-1, 3), words[0], first[0], words[1], first[1])]
            yield {f.name: pa.array([x[i] for x in out], k) for i, (f, k) in enumerate(zip(PASSAGES, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True))}

    return outermost(rows_to_rows(ready, PASSAGES, step))


def outermost(found: DataFrame) -> DataFrame:
    """The passages of a pair of documents whose words in the first are not all inside another passage's."""
    w = Window.partitionBy("doc_id", "ref_doc_id").orderBy("start", F.desc("end"), F.desc("identity"), "ref_start", "ref_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = found.withColumn("__reach", F.max("end").over(w))
    return reach.filter("__reach is null or end > __reach").drop("__reach")


def cut_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated passages cut out of its texts; a document of which no word is left is dropped.

    A cut takes the words of the passage and the white space behind them.
    Documents that had no words before stay as they are; an id that is null or
    names different texts is no hindrance.
    """
    key, own, cut = free_name(df, "__cut_key"), free_name(df, "__cut_id"), free_name(df, "__cuts")
    docs = keyed(df, doc_id, text, key)
    with scratch(df.sparkSession):
        spans = _passages(docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start", "end")).alias(cut))
        spans = stored(spans, "cuts", keep=True)
    joined = docs.join(spans, F.col(key) == F.col(own), "left").drop(own, key)
    left = free_name(joined, "__left")
    added = T.StructType([T.StructField(text, T.StringType()), T.StructField(left, T.BooleanType())])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, cuts = batch.column(text).to_pylist(), batch.column(cut)
        some = [i for i, c in enumerate(cuts) if c.as_py()]
        keep = [True] * len(texts)
        for b in blocks(pa.array([texts[i] for i in some], pa.large_string())):
            for k in range(len(b)):
                i = some[b.lo + k]
                lo, hi = int(b.word_bounds[k]), int(b.word_bounds[k + 1])
                gone = np.zeros(hi - lo, bool)
                for c in cuts[i].as_py():
                    gone[c["start"] : c["end"]] = True
                edge = np.append(b.starts[lo:hi], b.bounds[k + 1])
                head = bytes(b.data[b.bounds[k] : edge[0]])
                texts[i] = (head + b"".join(bytes(b.data[edge[w] : edge[w + 1]]) for w in np.flatnonzero(~gone))).decode()
                keep[i] = not gone.all()
        return [pa.array(texts, pa.string()), pa.array(keep)]

    return add_columns(joined, added, compute).filter(left).select(*df.columns)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of ``documents`` that repeat an earlier document's."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
