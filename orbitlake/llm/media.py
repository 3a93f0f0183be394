"""Media columns: ISO base media files as binary columns, described without decoding their payloads.

``pack_payloads`` stores bytes losslessly as an uncompressed 8-bit grey video
(one 8 x 8 frame per 64 bytes); ``media_columns`` walks the boxes of any ISO
media file and reads codec, duration and the byte ranges of keyframes from the
sample tables; ``sample_bytes`` reads the stored samples back through them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrow import add_columns, free_name

#: The frame: 8 x 8 pixels of 8 bits; frames a second, per chunk, and from one keyframe to the next.
FRAME, RATE, PER_CHUNK, KEY_EVERY = 64, 25, 64, 32
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
DEEPEST = 32


# Writing


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of FRAME."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def pack(payload: bytes) -> bytes:
    """An ISO media file whose only track holds ``payload`` (a multiple of FRAME bytes) as raw grey frames."""
    frames = len(payload) // FRAME
    chunks = -(-frames // PER_CHUNK)
    wide = len(payload) > (1 << 32) - (1 << 24)
    last = frames - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    keys = range(1, frames + 1, KEY_EVERY)
    entry = box(b"raw ", struct.pack(">6xH16xHHIII H32sHh", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"", 40, -1))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")

    def moov(first: int) -> bytes:
        places = [first + i * PER_CHUNK * FRAME for i in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, frames, 1)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
            full(b"co64", 0, 0, struct.pack(f">I{chunks}Q", chunks, *places)) if wide else full(b"stco", 0, 0, struct.pack(f">I{chunks}I", chunks, *places)),
        )
        data = box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1)))
        minf = box(b"minf", full(b"vmhd", 0, 1, bytes(8)), data, table)
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"payload\0"), minf)
        tkhd = full(b"tkhd", 0, 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, frames, 0, 0, 0, 0), MATRIX, struct.pack(">II", 8 << 16, 8 << 16))
        mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, RATE, frames, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mdat = box(b"mdat", payload)
    first = len(ftyp) + len(moov(0)) + len(mdat) - len(payload)
    return ftyp + moov(first) + mdat


# Reading


class Malformed(ValueError):
    pass


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    tables: dict[bytes, bytes] = field(default_factory=dict)
    #: Samples of movie fragments: (offsets, lengths, times, keyframe flags) of each run, and the time after the last one.
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    clock: int | None = None

    def samples(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offset, length, decoding time (in ticks) and keyframe flag of every sample, of the sample tables and then of fragments, checked against the file's size."""
        parts = [self._listed(size), *self.runs]
        for offsets, lengths, _, _ in self.runs:
            if len(offsets) and ((offsets < 0).any() or (offsets + lengths).max() > size):
                raise Malformed("a sample lies outside the file")
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def ticks(self) -> int:
        """The track's duration; of a track made of fragments, the time after its last sample."""
        return max(self.duration, self.clock or 0)

    def _listed(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths, chunks, runs = self._lengths(size), self._chunks(), self._rows(b"stsc", 3)
        n = len(lengths)
        if n and not len(chunks) or n and not len(runs):
            raise Malformed("samples without chunks")
        offsets = np.zeros(n, np.int64)
        if n:
            firsts = np.append(runs[:, 0] - 1, len(chunks))
            if firsts[0] != 0 or (np.diff(firsts) < 0).any() or firsts[-2] > len(chunks):
                raise Malformed("stsc runs out of order")
            per = np.repeat(runs[:, 1], np.diff(firsts))
            ends = np.cumsum(per)
            if ends[-1] < n:
                raise Malformed("fewer samples in chunks than in stsz")
            chunk = np.searchsorted(ends, np.arange(n), side="right")
            before = np.cumsum(lengths) - lengths
            head = np.searchsorted(chunk, chunk)
            offsets = chunks[chunk] + before - before[head]
            if (offsets < 0).any() or (offsets + lengths).max() > size:
                raise Malformed("a sample lies outside the file")
        times = np.zeros(n, np.int64)
        stts = self._rows(b"stts", 2)
        if len(stts) and n:
            run = np.minimum(np.searchsorted(np.cumsum(stts[:, 0]), np.arange(n - 1), side="right"), len(stts) - 1)
            times[1:] = np.cumsum(stts[run, 1])
        key = np.ones(n, bool)
        if b"stss" in self.tables:  # without this table every sample is a keyframe
            key[:] = False
            listed = self._rows(b"stss", 1)[:, 0] - 1
            key[listed[(listed >= 0) & (listed < n)]] = True
        return offsets, lengths, times, key

    def _rows(self, kind: bytes, columns: int) -> np.ndarray:
        body = self.tables.get(kind)
        if body is None:
            return np.zeros((0, columns), np.int64)
        (n,) = _unpack(">I", body, 4)
        if len(body) < 8 + 4 * columns * n:
            raise Malformed(f"{kind.decode('latin-1')} is cut short")
        return np.frombuffer(body, ">u4", n * columns, 8).astype(np.int64).reshape(n, columns)

    def _chunks(self) -> np.ndarray:
        if b"co64" not in self.tables:
            return self._rows(b"stco", 1)[:, 0]
        body = self.tables[b"co64"]
        (n,) = _unpack(">I", body, 4)
        if len(body) < 8 + 8 * n:
            raise Malformed("co64 is cut short")
        return np.frombuffer(body, ">u8", n, 8).astype(np.int64)

    def _lengths(self, size: int) -> np.ndarray:
        if b"stz2" in self.tables:
            body = self.tables[b"stz2"]
            bits, n = body[7] if len(body) > 7 else 0, _unpack(">I", body, 8)[0]
            if bits not in (4, 8, 16) or len(body) < 12 + (n * bits + 7) // 8:
                raise Malformed("stz2 is cut short")
            if bits == 4:
                pairs = np.frombuffer(body, np.uint8, (n + 1) // 2, 12)
                return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n].astype(np.int64)
            return np.frombuffer(body, ">u2" if bits == 16 else np.uint8, n, 12).astype(np.int64)
        body = self.tables.get(b"stsz")
        if body is None:
            return np.zeros(0, np.int64)
        each, n = _unpack(">II", body, 4)
        if each * n > size:
            raise Malformed("samples are larger than the file")
        if each:
            return np.full(n, each, np.int64)
        if len(body) < 12 + 4 * n:
            raise Malformed("stsz is cut short")
        return np.frombuffer(body, ">u4", n, 12).astype(np.int64)


def _unpack(form: str, data: bytes, at: int) -> tuple:
    try:
        return struct.unpack_from(form, data, at)
    except struct.error as error:
        raise Malformed("a box is cut short") from error


def walk(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, type, body start, body end) of all boxes in file order, containers before what they hold."""
    end = len(data) if end is None else end
    if depth > DEEPEST:
        raise Malformed("boxes are nested too deeply")
    while start < end:
        if end - start < 8:
            raise Malformed("bytes left after the last box")
        size, kind = _unpack(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = _unpack(">Q", data, body)
            body += 8
        elif size == 0:  # to the end of what holds it
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or start + size < body:
            raise Malformed(f"box {kind.decode('latin-1')} ends outside what holds it")
        yield depth, kind, body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, depth + 1)
        start += size


def _versioned(data: bytes, at: int) -> tuple[int, int]:
    """The two numbers after the times of a mvhd or mdhd box: timescale and duration."""
    return _unpack(">IQ", data, at + 20) if data[at : at + 1] == b"\x01" else _unpack(">II", data, at + 12)


class Fragment:
    """What the boxes of one movie fragment say about the samples of one track."""

    def __init__(self, data: bytes, at: int, start: int, behind: int | None, tracks: list[Track], defaults: dict[int, tuple[int, ...]]):
        """``at``: body of the tfhd box, ``start``: where the moof box begins, ``behind``: the end of the samples before in it."""
        (word, track_id) = _unpack(">II", data, at)
        flags, at = word & 0xFFFFFF, at + 8
        self.track = next((t for t in tracks if t.track_id == track_id), None)
        if self.track is None:
            raise Malformed("a fragment of a track that is not there")
        base = start if flags & 0x20000 or behind is None else behind
        if flags & 0x1:
            (base,), at = _unpack(">Q", data, at), at + 8
        at += 4 if flags & 0x2 else 0
        self.values = list(defaults.get(track_id, (0, 0, 0)))  # duration, size and flags of a sample that does not say its own
        for k, bit in enumerate((0x8, 0x10, 0x20)):
            if flags & bit:
                (self.values[k],), at = _unpack(">I", data, at), at + 4
        self.base = self.end = base

    def run(self, data: bytes, at: int, size: int) -> None:
        """The samples of a trun box, whose body is at ``at``."""
        word, n = _unpack(">II", data, at)
        flags, at = word & 0xFFFFFF, at + 8
        if flags & 0x1:
            self.end, at = self.base + _unpack(">i", data, at)[0], at + 4
        first = None
        if flags & 0x4:
            (first,), at = _unpack(">I", data, at), at + 4
        fields = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
        width = sum(fields)
        if len(data) < at + 4 * width * n or not width and n * max(self.values[1], 1) > size:
            raise Malformed("trun is cut short")
        table = np.frombuffer(data, ">u4", width * n, at).astype(np.int64).reshape(n, width) if width else np.zeros((n, 0), np.int64)
        own = iter(table.T)
        duration, length, bits = (next(own) if given else np.full(n, value) for given, value in zip(fields, self.values))
        if first is not None and n:
            bits = np.append(first, bits[1:])
        clock = self.track.clock if self.track.clock is not None else self.track.duration
        ends = np.cumsum(duration)
        self.track.runs.append((self.end + np.cumsum(length) - length, length, clock + ends - duration, bits & 0x10000 == 0))
        self.end += int(length.sum())
        self.track.clock = clock + int(ends[-1]) if n else clock


def parse(data: bytes) -> tuple[str, float | None, list[Track]]:
    """Major brand, duration in seconds and the tracks of an ISO media file."""
    brand, duration, tracks, found = "", None, [], False
    defaults: dict[int, tuple[int, ...]] = {}
    start, behind, fragment = 0, None, None
    for _, kind, at, end in walk(data):
        if kind == b"ftyp":
            brand = data[at : at + 4].decode("latin-1")
        elif kind == b"moov":
            found = True
        elif kind == b"mvhd":
            scale, ticks = _versioned(data, at)
            duration = ticks / scale if scale else None
        elif kind == b"trex":
            track_id, _, *values = _unpack(">5I", data, at + 4)
            defaults[track_id] = tuple(values)
        elif kind == b"moof":
            start, behind, fragment = at - (8 if data[at - 4 : at] == b"moof" else 16), None, None
        elif kind == b"traf":
            behind, fragment = (fragment.end if fragment else behind), None
        elif kind == b"tfhd":
            fragment = Fragment(data, at, start, behind, tracks, defaults)
        elif kind == b"tfdt" and fragment:
            (fragment.track.clock,) = _unpack(">Q", data, at + 4) if data[at : at + 1] == b"\x01" else _unpack(">I", data, at + 4)
        elif kind == b"trun":
            if fragment is None:
                raise Malformed("a run of samples without a track")
            fragment.run(data, at, len(data))
        elif kind == b"trak":
            tracks.append(Track())
        elif not tracks:
            continue
        elif kind == b"tkhd":
            tracks[-1].track_id = _unpack(">I", data, at + (20 if data[at : at + 1] == b"\x01" else 12))[0]
        elif kind == b"mdhd":
            tracks[-1].timescale, tracks[-1].duration = _versioned(data, at)
        elif kind == b"hdlr":
            tracks[-1].handler = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd" and _unpack(">I", data, at + 4)[0]:
            tracks[-1].codec = data[at + 12 : at + 16].decode("latin-1")
            if tracks[-1].handler == "vide":
                tracks[-1].width, tracks[-1].height = _unpack(">HH", data, at + 8 + 8 + 24)
        elif kind in (b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64"):
            tracks[-1].tables[kind] = data[at:end]
    if not found:
        raise Malformed("no moov box")
    return brand, duration, tracks


def sample_bytes(data: bytes, track: int = 0) -> bytes:
    """The stored samples of a track, one after the other, read through its sample tables."""
    offsets, lengths, _, _ = parse(data)[2][track].samples(len(data))
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + lengths[:-1]) + 1  # samples side by side are read at once
    firsts, lasts = offsets[np.append(0, breaks)], (offsets + lengths)[np.append(breaks - 1, len(offsets) - 1)]
    return b"".join(data[a:b] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


# Columns

RANGE = T.StructType([T.StructField("sample", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("seconds", T.DoubleType())])
TRACK = T.StructType([T.StructField(n, t) for n, t in (("track_id", T.LongType()), ("handler", T.StringType()), ("codec", T.StringType()), ("seconds", T.DoubleType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("n_samples", T.LongType()), ("sample_bytes", T.LongType()), ("keyframes", T.ArrayType(RANGE)))])
MEDIA = T.StructType([T.StructField("brand", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("tracks", T.ArrayType(TRACK)), T.StructField("error", T.StringType())])


def describe(data: bytes | None) -> dict | None:
    """The value of a media column: null for null, ``error`` for bytes that are not a sound ISO media file."""
    if data is None:
        return None
    try:
        brand, seconds, tracks = parse(data)
        found = []
        for t in tracks:
            offsets, lengths, times, key = t.samples(len(data))
            at = np.flatnonzero(key)
            scale = t.timescale or 1
            keyframes = [{"sample": s, "offset": o, "length": n, "seconds": k / scale} for s, o, n, k in zip(at.tolist(), offsets[at].tolist(), lengths[at].tolist(), times[at].tolist(), strict=True)]
            found.append({"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "seconds": t.ticks() / scale, "width": t.width, "height": t.height, "n_samples": len(offsets), "sample_bytes": int(lengths.sum()), "keyframes": keyframes})
        return {"brand": brand, "seconds": seconds, "tracks": found, "error": None}
    except Malformed as error:
        return {"brand": None, "seconds": None, "tracks": None, "error": str(error)}


def media_columns(df: DataFrame, media: str = "media", out: str = "description") -> DataFrame:
    """``df`` plus ``out``, a struct of brand, duration and tracks with codec and keyframe byte ranges.

    Null media give null; empty, truncated or foreign bytes give a struct with
    ``error`` and nothing else.  Rows are judged one by one, so repeated rows
    agree; other columns stay, one named ``out`` is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(MEDIA)
    return add_columns(df, T.StructType([T.StructField(out, MEDIA)]), lambda batch: [pa.array([describe(x.as_py()) for x in batch.column(media)], kind)])


def pack_payloads(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` plus ``out``: the UTF-8 bytes of ``text`` (null: empty), padded, as an ISO media file."""
    return add_columns(df, T.StructType([T.StructField(out, T.BinaryType())]), lambda batch: [pa.array([pack(padded((x.as_py() or "").encode())) for x in batch.column(text)], pa.binary())])


def feature(d: dict) -> str:
    """What the sample tables say, as one line: codec, size, duration, samples and all keyframe ranges."""
    t = d["tracks"][0]
    ranges = ",".join(f"{k['offset']}+{k['length']}" for k in t["keyframes"])
    return f"{d['brand']}/{t['handler']}/{t['codec']} {t['width']}x{t['height']} {t['seconds']:.2f}s n={t['n_samples']} key={len(t['keyframes'])}:{ranges}"


DIGEST = T.StructType([T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


def media_digests(df: DataFrame, n_bytes: str, media: str) -> DataFrame:
    """Digests of media and of the payload that is read back from them, with the feature line of :func:`describe`."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for n, m in zip(batch.column(n_bytes), batch.column(media), strict=True):
            data = m.as_py()
            payload = sample_bytes(data)
            rows.append((n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature(describe(data))))
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]

    return add_columns(df, DIGEST, compute)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an ISO media file; digests of what is read back."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    length = free_name(docs, "length")
    docs = docs.withColumn(length, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return media_digests(pack_payloads(docs).select("doc_id", length, "media"), length, "media").select("doc_id", *DIGEST.names)
