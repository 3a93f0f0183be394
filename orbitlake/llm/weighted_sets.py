"""Texts as TF-IDF weighted sets of word shingles, with exact document frequencies of every shingle.

No table of all shingles exists in any one place.  Tasks pack the shingles of
some texts (a chunk) as sorted 64-bit numbers, 48 bits of the shingle's hash
and 16 of the text's place in its chunk, and send them to buckets by hash.  A
bucket counts in how many texts each shingle stands and answers every chunk
with the IDF of those that stand in two or more; all others share one IDF.  The
answers meet again by chunk, where weights and samples are made.

A shingle that no other text has can only matter by its weight: to similarity
it adds to the size of the set, and in consistent sampling one private element
with the sum of such weights behaves like all of them.  So neither ever leaves
its chunk, and a text that shares less than the similarity asked for of its own
weight with the rest of the corpus cannot have a partner and is left out.

Shingles that stand in HOT or more texts of a chunk, or several times in one,
go to their bucket as one number with a count, so a shingle of a third of all
texts costs its bucket one number a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import rows_to_rows
from .storage import partitions, replayable, stored
from .textscan import blocks, mix

#: Words of a shingle.
SHINGLE = 5
#: Shingles and texts of a chunk, shingles of a bucket (both are sorted in memory, 8 bytes each), texts of a chunk from which a shingle is counted beforehand.
CHUNK, CHUNK_TEXTS, BUCKET, HOT = 1 << 21, 60_000, 1 << 22, 32
#: Bytes of text handled at once: its arrays stay in a core's cache.
BLOCK_BYTES = 1 << 18
#: Shingles that are sampled at once.
TOGETHER = 1 << 16
_PLACE = np.uint64(0xFFFF)
_BITS = np.uint64(16)


def document_id(text: Column) -> Column:
    """MD5 of a text as 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def idf(total: int, df: np.ndarray | int) -> np.ndarray:
    """ln((N + 1) / (documents with it + 1)) + 1."""
    return np.log((total + 1) / (np.asarray(df, np.float64) + 1)) + 1


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all first bytes first: sorted numbers compress better."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


class Chunk:
    """The shingles of some texts: rows for the buckets, and one of what stays with the chunk."""

    def __init__(self, buckets: int):
        self.buckets, self.names, self.parts, self.totals, self.held = buckets, [], [], [], 0

    def add(self, names: list[bytes], text: np.ndarray, hashes: np.ndarray) -> None:
        self.parts.append((hashes & ~_PLACE) | (text + len(self.names)).astype(np.uint64))
        self.totals.append(np.bincount(text, minlength=len(names)))
        self.names += names
        self.held += len(hashes)

    def rows(self) -> dict[str, pa.Array]:
        v = np.concatenate(self.parts)
        v.sort()
        at = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        often = np.diff(np.append(at, len(v)))
        v = v[at]
        name = v & ~_PLACE
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(v) else np.zeros(0, np.int64)
        texts = np.diff(np.append(first, len(v)))
        special = (texts >= HOT) | (np.maximum.reduceat(often, first) > 1) if len(v) else np.zeros(0, bool)
        mine = np.repeat(special, texts)
        sent = ~mine
        sent[first[special]] = True
        at = np.flatnonzero(sent)
        data, count = np.where(mine, name | _PLACE, v)[at], np.repeat(texts, texts)[at]
        kept = [b"".join(self.names), np.concatenate(self.totals).astype("<u4").tobytes(), name[first[special]].astype("<u8").tobytes(), texts[special].astype("<u4").tobytes(), (v[mine] & _PLACE).astype("<u2").tobytes(), often[mine].astype("<u4").tobytes()]
        head = np.array([len(self.names), int(special.sum()), int(mine.sum())], "<u8").tobytes()
        chunk = int.from_bytes(hashlib.md5(kept[0]).digest()[:8], "little", signed=True)
        bucket = ((data >> np.uint64(40)) * np.uint64(self.buckets)) >> np.uint64(24)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(data) else np.zeros(0, np.int64)
        cuts = [*edges.tolist(), len(data)]
        hot = (data & _PLACE) == _PLACE
        ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
        return {
            "bucket": pa.array([*[int(bucket[i]) for i in cuts[:-1]], chunk % self.buckets], pa.int32()),
            "chunk": pa.array([chunk] * len(cuts), pa.int64()),
            "kept": pa.array([*[False] * len(ranges), True]),
            "data": pa.array([*[planes(data[i:j]) for i, j in ranges], head + b"".join(kept)], pa.large_binary()).cast(pa.binary()),
            "more": pa.array([*[count[i:j][hot[i:j]].astype("<u4").tobytes() for i, j in ranges], b""], pa.binary()),
        }


ROWS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("data", T.BinaryType()), T.StructField("more", T.BinaryType())])


def packed(texts: DataFrame, name: str, text: str, buckets: int) -> DataFrame:
    """The rows of all chunks of ``texts``; a chunk is named by the names of its texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        chunk = Chunk(buckets)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for b in blocks(batch.column(1), BLOCK_BYTES):
                hashes, at = b.shingles(SHINGLE)
                if chunk.names and (len(chunk.names) + len(b) > CHUNK_TEXTS or chunk.held + len(hashes) > CHUNK):
                    yield chunk.rows()
                    chunk = Chunk(buckets)
                chunk.add(names[b.lo : b.hi], b.word_doc[at], hashes)
        if chunk.names:
            yield chunk.rows()

    return rows_to_rows(texts.select(name, text), ROWS, step)


def answered(rows: DataFrame, total: int) -> DataFrame:
    """For every row of a bucket its shingles that stand in two or more documents, with their IDF; other rows as they are."""
    spark = rows.sparkSession
    tasks = partitions(spark)
    dealt = rows.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")

    def of(held: list[tuple[int, int, np.ndarray, bytes]]) -> dict[str, list]:
        v = np.concatenate([x[2] for x in held])
        count = np.ones(len(v), np.int64)
        count[(v & _PLACE) == _PLACE] = np.frombuffer(b"".join(x[3] for x in held), "<u4")
        name = v >> _BITS
        order = np.argsort(name)
        name = name[order]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        df = np.add.reduceat(count[order], first)
        found = np.empty(len(v), np.int64)
        found[order] = np.repeat(df, np.diff(np.append(first, len(v))))
        out = {k: [] for k in ("bucket", "chunk", "kept", "data", "more")}
        lo = 0
        for bucket, chunk, own, _ in held:
            hi = lo + len(own)
            often = np.flatnonzero(found[lo:hi] > 1)
            if len(often):
                for k, x in zip(out, (bucket, chunk, False, planes(own[often]), idf(total, found[lo:hi][often]).astype("<f4").tobytes()), strict=True):
                    out[k].append(x)
            lo = hi
        return out

    def arrays(x: dict[str, list]) -> dict[str, pa.Array]:
        return {f.name: pa.array(x[f.name], k) for f, k in zip(ROWS, (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        held: list[tuple[int, int, np.ndarray, bytes]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, chunk, kept, data, more = (batch.column(c)[i].as_py() for c in range(5))
                if kept:
                    yield arrays({"bucket": [bucket], "chunk": [chunk], "kept": [True], "data": [data], "more": [more]})
                    continue
                if held and held[0][0] != bucket:
                    yield arrays(of(held))
                    held = []
                held.append((bucket, chunk, unplanes(data), more))
        if held:
            yield arrays(of(held))

    return rows_to_rows(dealt, ROWS, step)


def entries(kept: bytes, rows: list[tuple[bytes, bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, totals, text, shingle, IDF, count) of a chunk: shingles shared with other documents in order of text and hash."""
    n, specials, listed = np.frombuffer(kept, "<u8", 3).tolist()
    at = 24
    names = [kept[at + 16 * i : at + 16 * (i + 1)] for i in range(n)]
    at += 16 * n
    parts = []
    for kind, many in (("<u4", n), ("<u8", specials), ("<u4", specials), ("<u2", listed), ("<u4", listed)):
        parts.append(np.frombuffer(kept, kind, many, at))
        at += parts[-1].nbytes
    totals, special, texts, places, often = parts
    v = np.concatenate([np.zeros(0, "<u8"), *[unplanes(d) for d, _ in rows]])
    weight = np.frombuffer(b"".join(m for _, m in rows), "<f4")
    text, shingle = (v & _PLACE).astype(np.int64), v & ~_PLACE
    hot = np.flatnonzero(text == int(_PLACE))
    which = np.searchsorted(special, shingle[hot])
    times = np.ones(len(v), np.int64)
    times[hot] = texts[which]
    flat = np.repeat(np.arange(len(v)), times)
    text, count = text[flat], np.ones(len(flat), np.int64)
    if len(hot):
        begin = np.cumsum(texts, dtype=np.int64) - texts
        into = np.flatnonzero(np.repeat(np.isin(np.arange(len(v)), hot), times))
        source = np.repeat(begin[which] - (np.cumsum(texts[which], dtype=np.int64) - texts[which]), texts[which]) + np.arange(len(into))
        text[into], count[into] = places[source], often[source]
    order = np.argsort(text.astype(np.uint16), kind="stable")
    return names, totals, text[order], shingle[flat][order], weight[flat][order], count[order]


def _gamma_quantiles(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1): the x with 1 - (1 + x) exp(-x) = u, by Newton's method in log x."""
    x = np.sqrt(2 * u) + u - np.log1p(-u) * u
    for _ in range(60):
        value = -np.expm1(-x) - x * np.exp(-x) - u
        x = np.maximum(x - np.clip(value / np.maximum(x * np.exp(-x), 1e-300), -0.5 * x, 2.0), 1e-12)
    return x


class Sampler:
    """The random numbers of all samples: r and c from Gamma(2, 1), beta uniform, each a function of shingle and sample."""

    LEVELS = 1 << 16

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.first = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.second = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        quantiles = _gamma_quantiles((np.arange(self.LEVELS) + 0.5) / self.LEVELS)
        self.r, self.ln_c = quantiles.astype(np.float32), np.log(quantiles).astype(np.float32)

    def sample(self, shingles: np.ndarray, ln_weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, d: int) -> np.ndarray:
        """Sample ``d`` of every document: a hash of the shingle with the least ln a and of its level t."""
        z = shingles * self.first[d]
        z ^= z >> np.uint64(32)
        z *= self.second[d]
        r = self.r[(z >> np.uint64(48)).view(np.int64)]
        beta = ((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        place = ((z >> np.uint64(16)) & np.uint64(0xFFFF)).view(np.int64)
        ln_c = self.ln_c[place]
        low = np.flatnonzero(place < 64)  # the tail, where levels are coarse: c is about sqrt(2 u)
        if len(low):
            u = (place[low] + ((z[low] & np.uint64(0xFFFF)).astype(np.float64) + 0.5) / 65536) / self.LEVELS
            ln_c[low] = 0.5 * np.log(2 * u) + np.sqrt(2 * u) / 3
        t = np.floor(ln_weight / r + beta)
        ln_a = ln_c - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(ln_a, starts)
        at = np.flatnonzero(ln_a == np.repeat(least, sizes))
        first = at[np.searchsorted(at, starts)]
        return mix(shingles[first] ^ (t[first].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def signatures(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """32 bits of every sample (columns) of every document (rows)."""
        out = np.zeros((len(starts), self.samples), "<u4")
        sizes, ln_weight = np.diff(np.append(starts, len(shingles))), np.log(weights).astype(np.float32)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + TOGETHER, side="right")) - 1)
            hi = len(starts) if hi >= len(starts) - 1 else hi
            a, b = int(starts[lo]), int(starts[hi]) if hi < len(starts) else len(shingles)
            for d in range(self.samples):
                out[lo:hi, d] = self.sample(shingles[a:b], ln_weight[a:b], starts[lo:hi] - a, sizes[lo:hi], d) >> np.uint64(32)
            lo = hi
        return out


def gathered(rows: DataFrame, total: int, least_shared: float, samples: int, name: str) -> DataFrame:
    """(name, size, shingles, samples) of every text of which at least ``least_shared`` is shared; copies in a chunk come once."""
    schema = T.StructType([T.StructField(name, T.BinaryType()), T.StructField("size", T.DoubleType()), T.StructField("shingles", T.BinaryType()), T.StructField("samples", T.BinaryType())])
    dealt = rows.repartition(partitions(rows.sparkSession), "chunk").sortWithinPartitions("chunk", F.desc("kept"), "bucket")
    alone = float(idf(total, 1))

    def of(kept: bytes, found: list[tuple[bytes, bytes]], sampler: Sampler) -> dict[str, pa.Array]:
        names, totals, text, shingle, one, count = entries(kept, found)
        weight = (one * count).astype(np.float32)
        shared = np.bincount(text, weight, minlength=len(names))
        own = (totals - np.bincount(text, count, minlength=len(names))) * alone
        size = shared + own
        keep = (totals > 0) & (shared >= least_shared * size * (1 - 1e-6))
        seen: set[bytes] = set()
        for i in np.flatnonzero(keep).tolist():
            keep[i] = names[i] not in seen
            seen.add(names[i])
        chosen = np.flatnonzero(keep)
        inside = keep[text]
        text, shingle, weight = text[inside], shingle[inside], weight[inside]
        cuts = np.searchsorted(text, np.append(chosen, len(names)))
        short = (shingle >> np.uint64(32)).astype("<u4")
        sets = [short[i:j].tobytes() + weight[i:j].astype("<f4").tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        private = chosen[own[chosen] > 0]
        more = mix(np.array([int.from_bytes(names[i][:8], "little") for i in private], np.uint64))
        place = np.append(text, private)
        order = np.argsort(place, kind="stable")
        every, weights, place = np.append(mix(shingle), more)[order], np.append(weight, own[private])[order], place[order]
        made = sampler.signatures(every, weights, np.searchsorted(place, chosen)) if len(chosen) else np.zeros((0, samples), "<u4")
        return {name: pa.array([names[i] for i in chosen], pa.binary()), "size": pa.array(size[chosen]), "shingles": pa.array(sets, pa.binary()), "samples": pa.array([x.tobytes() for x in made], pa.binary())}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        sampler = Sampler(samples)
        now, kept, found, seen = None, b"", [], set()
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, chunk, whole, data, more = (batch.column(c)[i].as_py() for c in range(5))
                if chunk != now:
                    if now is not None:
                        yield of(kept, found, sampler)
                    now, found, seen = chunk, [], set()
                if whole:
                    kept = data
                elif bucket not in seen:  # chunks of the same texts, in the same order, give the same rows
                    seen.add(bucket)
                    found.append((data, more))
        if now is not None:
            yield of(kept, found, sampler)

    return rows_to_rows(dealt, schema, step)


def weighted_sets(texts: DataFrame, name: str, text: str, total: int, n_bytes: int, least_shared: float, samples: int) -> DataFrame:
    """(name, size, shingles, samples) of every distinct text that may have a partner, stored.

    ``texts`` has one row per document, ``name`` its text's 16 bytes; copies
    count as documents.  ``size`` is the weight of all shingles, ``shingles``
    those that other documents have too: the high 32 bits of their hashes in
    order, then their weights.  Texts of fewer than SHINGLE words have none.
    """
    tasks = partitions(texts.sparkSession)
    buckets = tasks * -(-max(tasks, 64, n_bytes // 6 // BUCKET) // tasks)
    rows = packed(replayable(texts.select(name, text)), name, text, buckets)
    answers = stored(answered(rows, total), "answers")
    sets = gathered(answers, total, least_shared, samples, name)
    once = sets.groupBy(name).agg(F.any_value(F.struct("size", "shingles", "samples")).alias("s"))
    return stored(once.select(name, "s.*"), "sets")
