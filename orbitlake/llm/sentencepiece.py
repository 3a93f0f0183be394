"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, whitespace markers.

Pieces come from a SentencePiece model file.  A unigram model's scores are log
probabilities; a BPE model's are merge ranks, and become log probabilities by
Zipf's law (merges are found in order of frequency).  Nothing is trained.  The
segmentation is the likeliest one, with the largest sum of log scores.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrow import add_columns
from .unit_cache import UnitCache

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: How far below the worst piece a byte (or, without byte pieces, a character) without a piece scores.
UNKNOWN_PENALTY = 10.0
#: Added to ranks: the most frequent piece is not likelier than all of the next ones together.
ZIPF_SHIFT = 2.7
#: A model file's type of merges.
_BPE = 2
#: Distinct words kept by one worker (about 60 MB): workers live on from stage to stage of a pipeline.
MOST_WORDS = 300_000


class DoubleArray:
    """A trie over bytes: the child of state s by byte b is t = base[s] + b + 1 if check[t] == s; value[s] is the piece that ends there, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        n = sum(len(k) for k, _ in keys) + 512
        self._taken = np.zeros(n + 512, bool)
        self._taken[0] = True
        base, check, value = np.zeros(n + 512, np.int64), np.full(n + 512, -1, np.int64), np.full(n + 512, -1, np.int64)
        check[0], top, self._free = -2, 1, 1
        waiting = [(0, 0, len(keys), 0)]
        while waiting:
            state, lo, hi, depth = waiting.pop()
            while lo < hi and len(keys[lo][0]) == depth:
                value[state] = keys[lo][1]
                lo += 1
            children, at = [], lo
            while at < hi:
                byte, end = keys[at][0][depth], at
                while end < hi and keys[end][0][depth] == byte:
                    end += 1
                children.append((byte, at, end))
                at = end
            if not children:
                continue
            place = self._place(np.array([c[0] for c in children]) + 1)
            base[state] = place
            for byte, a, b in children:
                check[place + byte + 1], self._taken[place + byte + 1] = state, True
                top = max(top, place + byte + 2)
                waiting.append((place + byte + 1, a, b, depth + 1))
        del self._taken
        self.base, self.check, self.value = base[:top].tolist(), check[:top].tolist(), value[:top].tolist()

    def _place(self, offsets: np.ndarray) -> int:
        """The first base at which all ``offsets`` are free."""
        while self._taken[self._free]:
            self._free += 1
        at = max(self._free, int(offsets[0]))
        while True:
            free = at + np.flatnonzero(~self._taken[at : at + 4096])
            bases = free - offsets[0]
            inside = bases + offsets[-1] < len(self._taken)
            fits = ~self._taken[bases[inside][:, None] + offsets].any(axis=1)
            if fits.any():
                return int(bases[inside][fits.argmax()])
            at += 4096


def _read_model(path: str) -> list[tuple[str, float, int]]:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    return zipf_scores(pieces) if model.trainer_spec.model_type == _BPE else pieces


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The pieces with scores ln(1 / (rank + ZIPF_SHIFT)) less the ln of their sum: the better the old score, the lower the rank; of equals the first."""
    normal = sorted((i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL), key=lambda i: (-pieces[i][1], i))
    logs = -np.log(np.arange(len(normal)) + ZIPF_SHIFT)
    logs -= np.log(np.exp(logs).sum()) if len(normal) else 0.0
    scores = dict(zip(normal, logs.tolist(), strict=True))
    return [(p, scores.get(i, score), kind) for i, (p, score, kind) in enumerate(pieces)]


class Pieces:
    """Encoder and decoder for one vocabulary: (piece, log score, type) in order of ids."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        usable = [(p.encode(), i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        self.trie = DoubleArray(usable)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.unknown_score = min([s for _, s, kind in pieces if kind == NORMAL], default=0.0) - UNKNOWN_PENALTY
        #: Byte pieces score as unknown bytes do, so the score of a segmentation is the sum over its ids.
        self.scores = [self.unknown_score if kind in (BYTE, UNKNOWN) else s for _, s, kind in pieces]
        inner = [p for p, _, kind in pieces if kind in (NORMAL, USER) and (MARK in p.lstrip(MARK) or "\n" in p)]
        #: Pieces that cross a blank or a line feed forbid cutting a text there.
        self.cuts = not inner
        self.table = [self._bytes_of(p, kind) for p, _, kind in pieces]
        self.words = UnitCache(self._units, self._encode_units, MOST_WORDS)

    def _bytes_of(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best segmentation of ``text`` (blanks already marked); of equal ones, that whose last piece is longest."""
        data = text.encode()
        n = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        worst = float("-inf")
        best, start, piece = [worst] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        size, at = len(check), 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, alone = best[at], 0, False
            for end in range(at, n):
                child = base[state] + data[end] + 1
                if child >= size or check[child] != state:
                    break
                state = child
                found = value[state]
                if found >= 0:
                    if end - at == width - 1:
                        alone = True
                    score = here + scores[found]
                    if score > best[end + 1] or start[end + 1] < 0:
                        best[end + 1], start[end + 1], piece[end + 1] = score, at, found
            if not alone:
                score = here + self.unknown_score * (width if self.byte_ids else 1)
                if score > best[at + width] or start[at + width] < 0:
                    best[at + width], start[at + width], piece[at + width] = score, at, -1
            at += width
        out: list[int] = []
        at = n
        while at > 0:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(data[start[at] : at])]
            else:
                out.append(self.unknown)
            at = start[at]
        return out[::-1]

    def _units(self, text: str) -> list[str]:
        """Marked text behind a blank; without one, words that a mark comes before, or a line feed (which no piece holds) and a word."""
        if not self.cuts or text.startswith(" ") or "  " in text:
            marked = MARK + text.replace(" ", MARK)
            return [" " + u for u in _RUNS.findall(marked)] if self.cuts else [" " + marked]
        return text.replace("\n", " \n").split(" ")

    def _encode_units(self, units: list[str]) -> list[bytes]:
        ids = [self.viterbi(u[1:] if u.startswith(" ") else u if u.startswith("\n") else MARK + u) for u in units]
        return [struct.pack(f"<{len(v)}I", *v) for v in ids]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids; a mark that stands in a text itself goes by its bytes, so that decoding gives it back."""
        out = self.words.encode(["" if MARK in t else t for t in texts])
        mark = b"".join(struct.pack("<I", self.byte_ids.get(b, self.unknown)) for b in MARK.encode())
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif MARK in text:
                runs = [(MARK if k == 0 else "") + part.replace(" ", MARK) for k, part in enumerate(text.split(MARK))]
                out[i] = mark.join(b"".join(self._encode_units([" " + u for u in (_RUNS.findall(r) if self.cuts else [r])])) for r in runs)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are blanks, the first blank is the encoder's own, byte pieces form UTF-8 (else U+FFFD)."""
        data = b"".join(map(self.table.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@cache
def load(path: str) -> Pieces:
    return Pieces(_read_model(path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType())])
DECODED = T.StructType([T.StructField("decoded", T.StringType())])


def _encoded(pieces: Pieces, texts: Iterator[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    raw = pieces.encode([t or "" for t in texts])
    lengths = np.array([len(r) // 4 for r in raw], np.int64)
    ends = np.cumsum(lengths)
    ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
    sums = np.concatenate([[0.0], np.cumsum(np.array(pieces.scores)[ids])])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)), lengths, sums[ends] - sums[ends - lengths]


def encode_pieces(df: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """``df`` plus ``ids``, ``n_tokens`` and ``log_score`` (the sum of the ids' scores).

    Whole texts are encoded; null and empty texts have no ids.  Equal texts get
    equal ids wherever they are.  Columns of the added names are replaced.
    """
    model = model or default_model()

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, lengths, scores = _encoded(load(model), batch.column(text).to_pylist())
        return [ids, pa.array(lengths), pa.array(scores)]

    return add_columns(df, ENCODED, compute)


def decode_pieces(df: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` plus ``decoded``, the text of the column ``ids``; null and empty lists give an empty text."""
    model = model or default_model()

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces = load(model)
        return [pa.array([pieces.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()], pa.string())]

    return add_columns(df, DECODED, compute)


CHECKED = T.StructType([*ENCODED.fields, T.StructField("round_trip", T.BooleanType())])


def encode_checked(df: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """:func:`encode_pieces` plus ``round_trip``: whether decoding the ids gives the text again; the text is dropped."""
    model = model or default_model()

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces = load(model)
        texts = batch.column(text).to_pylist()
        ids, lengths, scores = _encoded(pieces, texts)
        values, ends = ids.values.to_numpy(), np.cumsum(lengths).tolist()
        same = [pieces.decode(values[e - n : e]) == (t or "") for t, e, n in zip(texts, ends, lengths.tolist(), strict=True)]
        return [ids, pa.array(lengths), pa.array(scores), pa.array(same)]

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return add_columns(df, CHECKED, compute).drop(text)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, and decoded again to compare."""
    return encode_checked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
