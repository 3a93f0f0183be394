"""Token ids in binary files: patched frame-of-reference blocks with exception lists and an index of block starts.

A file row is one *segment*: whole documents in ascending id order, about
SEGMENT ids.  Layout of a segment (little endian)::

    b"PFR1"  n_docs u32  n_ids u64  n_blocks u32  exceptions_at u64
    doc ids i64 * n_docs, known flags u8 * n_docs, lengths u32 * n_docs
    block index: start of each block's bits u64 * n_blocks
    minima u32 * n_blocks, widths u8 * n_blocks, exception counts u16 * n_blocks
    packed bits of all blocks: BLOCK values of ``width`` bits each
    exceptions: places u8, then values above the minimum u32, block after block

Segments are rows of Parquet tables, so Spark's own commit protocol writes them
to whatever store the cluster shares, and a task that is run again leaves no
half-written file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import rows_to_rows
from .storage import new_path, partitions
from .unit_cache import UnitCache

#: Values of a block, the share of them that fits the packed width, and ids of a segment.
BLOCK, FITS, SEGMENT = 256, 0.92, 1 << 19
END_OF_DOCUMENT = 2
MAGIC, HEADER = b"PFR1", struct.Struct("<4sIQIQ")


# Blocks


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as packed bytes."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), BLOCK * width), axis=1, bitorder="little")


def _values(packed: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros((len(packed), BLOCK, 32), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    return np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(packed), BLOCK)


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment of documents with ``lengths`` ids each."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    values[:n] = ids
    values = values.reshape(blocks, BLOCK)
    minima = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    above = values - minima[:, None]
    if blocks:
        place = min(BLOCK - 1, int(np.ceil(FITS * BLOCK)) - 1)
        fit = np.partition(above, place, axis=1)[:, place]
    else:
        fit = np.zeros(0, np.uint32)
    widths = np.where(fit > 0, np.floor(np.log2(np.maximum(fit, 1).astype(np.float64))) + 1, 0).astype(np.uint8)
    beyond = (above.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    counts = beyond.sum(axis=1).astype(np.uint16)
    place_of = np.nonzero(beyond)[1].astype(np.uint8)
    outliers = above[beyond].astype("<u4")
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    low = np.where(beyond, 0, above)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            packed[starts[rows][:, None] + np.arange(int(sizes[rows[0]]))] = _bits(low[rows], int(width))
    meta = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u4").tobytes(),
        starts.astype("<u8").tobytes(),
        minima.astype("<u4").tobytes(),
        widths.tobytes(),
        counts.astype("<u2").tobytes(),
    ]
    exceptions_at = HEADER.size + sum(map(len, meta)) + len(packed)
    return b"".join([HEADER.pack(MAGIC, len(doc_ids), n, blocks, exceptions_at), *meta, packed.tobytes(), place_of.tobytes(), outliers.tobytes()])


class Segment:
    """A segment's documents; blocks are unpacked for the ids that are asked for."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, blocks, exceptions_at = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, known, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs).astype(np.int64)
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.starts, self.minima, self.widths, counts = take("<u8", blocks).astype(np.int64), take("<u4", blocks), take("u1", blocks), take("<u2", blocks).astype(np.int64)
        self.packed = np.frombuffer(data, np.uint8, exceptions_at - at, at)
        self.first_exception = np.concatenate([[0], np.cumsum(counts)])
        total = int(self.first_exception[-1])
        self.places = np.frombuffer(data, np.uint8, total, exceptions_at)
        self.outliers = np.frombuffer(data, "<u4", total, exceptions_at + total)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``end`` of the segment; the block index leads to the blocks that hold them."""
        end = self.n_ids if end is None else end
        first, last = start // BLOCK, -(-end // BLOCK)
        widths = self.widths[first:last]
        out = np.zeros((last - first, BLOCK), np.uint32)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            if width:
                out[rows] = _values(self.packed[self.starts[first:last][rows][:, None] + np.arange(int(width) * (BLOCK // 8))], int(width))
        a, b = self.first_exception[first], self.first_exception[last]
        out[np.repeat(np.arange(last - first), np.diff(self.first_exception[first : last + 1])), self.places[a:b]] = self.outliers[a:b]
        return (out + self.minima[first:last, None]).reshape(-1)[start - first * BLOCK : end - first * BLOCK]


# Encoding

#: Unicode white space, as the tokenizers' patterns have it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from U+0100."""
    seen = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if seen[b] else chr(256 + sum(not s for s in seen[:b])) for b in range(256)]


@cache
def _tokenizer(path: str) -> UnitCache:
    """A byte-level BPE whose pattern never joins what stands before a blank to the blank and a word after it."""
    import re

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # control strings in a text are ordinary text
    other = _SPACE.replace(" ", "", 1)
    odd = re.compile(f" [{_SPACE}]|[{_SPACE}] \\Z|\n[{other}]|[{other}]\n")
    units = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

    def split(text: str) -> list[str]:
        """Units as they are behind a blank of their own; without one, words that a blank comes before, or a line feed and a word."""
        if odd.search(text):
            return [" " + u for u in units.findall(text)]
        words = text.replace("\n", " \n").split(" ")
        words[0] = " " + words[0]
        return words

    # The pattern takes a run of letters, with the blank before it, and a mark of punctuation behind it as pieces of
    # their own; the library's model alone then gives their ids.  Everything else goes through the whole tokenizer.
    plain = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([,.;:!?]?)").fullmatch
    visible = {b: c for b, c in enumerate(_byte_characters())}
    blank, feed = visible[32], model.encode("\n", add_special_tokens=False).ids
    marks = {c: model.encode(c, add_special_tokens=False).ids for c in ",.;:!?"}
    ends = {c: struct.pack(f"<{len(ids)}I", *ids) for c, ids in marks.items()}
    tokenize, pack = model.model.tokenize, struct.pack

    def encode_many(keys: list[str]) -> list[bytes]:
        out: list[bytes] = []
        others: list[tuple[int, str]] = []
        stems: dict[str, bytes] = {}
        for k in keys:
            if k[-1:] in ends:  # a word that is known without the mark behind it
                stem = cache.known.get(k[:-1]) or stems.get(k[:-1])
                if stem and plain(k):
                    out.append(stem + ends[k[-1]])
                    continue
            found = plain(k)
            if not found:
                others.append((len(out), k[1:] if k.startswith(" ") else k if k.startswith("\n") else " " + k))
                out.append(b"")
                continue
            line, word, mark = found.groups()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(visible)
            ids = [t.id for t in tokenize(word if line else blank + word)]
            if line:
                ids = [*feed, *ids]
            made = pack(f"<{len(ids)}I", *ids)
            stems[k[:-1] if mark else k] = made
            out.append(made + ends[mark] if mark else made)
        for (at, _), e in zip(others, model.encode_batch_fast([t for _, t in others], add_special_tokens=False), strict=True):
            ids = e.ids
            out[at] = pack(f"<{len(ids)}I", *ids)
        return out

    cache = UnitCache(split, encode_many)
    return cache


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SEGMENT_SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("data", T.BinaryType())])


def write_token_files(df: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_OF_DOCUMENT) -> None:
    """Encode every whole text, append ``end_id``, and write segments in ascending id order to ``path``.

    A null or empty text is the end id alone; null ids come first; documents of
    one id are ordered by a hash of their text, equal rows in any order.  An
    empty table writes no segments.  Extra columns are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    docs = docs.repartitionByRange(partitions(df.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        encoder, part = _tokenizer(tokenizer), TaskContext.get().partitionId()
        ids: list[int | None] = []
        held: list[bytes] = []
        size = seq = before = 0

        def flush() -> dict[str, pa.Array]:
            nonlocal ids, held, size, seq, before
            n = size // 4
            data = write_segment(ids, [len(h) // 4 for h in held], np.frombuffer(b"".join(held), "<u4"))
            made = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before]), "n_ids": pa.array([n]), "n_docs": pa.array([len(ids)]), "data": pa.array([data], pa.binary())}
            ids, held, size, seq, before = [], [], 0, seq + 1, before + n
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part_of = batch.slice(at, 256)
                encoded = encoder.encode([t or "" for t in part_of.column("text").to_pylist()])
                for d, e in zip(part_of.column("doc_id").to_pylist(), encoded, strict=True):
                    ids.append(d)
                    held.append(e + end)
                    size += len(e) + 4
                    if size >= 4 * SEGMENT:
                        yield flush()
        if ids:
            yield flush()

    rows_to_rows(docs, SEGMENT_SCHEMA, step).write.parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``base``, the ids in all segments before; one row of totals per part is broadcast."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return segments.join(F.broadcast(bases), "part").select((F.col("first") + F.col("before")).alias("base"), "data")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start (ids of all documents before), ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
                s = Segment(data.as_py())
                ends = np.cumsum(s.lengths)
                yield {"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(base + ends - s.lengths), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(s.ids().astype(np.int32)))}

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows_to_rows(_segments(spark, path), schema, step)


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_token_files`, with ``n_tokens`` and the CRC-32 of the ids (little-endian 32-bit) in their place."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
                s = Segment(data.as_py())
                raw = memoryview(s.ids().astype("<u4").tobytes())
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield {"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(base + starts), "n_tokens": pa.array(s.lengths), "ids_crc32": pa.array(sums, pa.int64())}

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return rows_to_rows(_segments(spark, path), schema, step)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in token files; what is read back from them."""
    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_digests(spark, path)
