"""Encoding of whole texts unit by unit: units that a tokenizer treats alone are looked up, new ones encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Distinct units kept by one worker (about 250 MB).  A full cache stays as it is while it serves most units, else starts afresh.
MOST_UNITS = 1_500_000
#: Characters of text whose new units are encoded together; a longer text goes alone.
TOGETHER = 1 << 20


class _Known(dict):
    """Units and their ids; what is missing is noted, and None for now."""

    def __init__(self):
        super().__init__()
        self.missing: dict[str, None] = {}

    def __missing__(self, unit: str) -> None:
        self.missing[unit] = None


class UnitCache:
    """Maps units to the little-endian 32-bit ids that ``encode_many`` gives them.

    ``split(text)`` cuts a text into units whose encodings, joined, are the
    encoding of the text.
    """

    def __init__(self, split: Callable[[str], list[str]], encode_many: Callable[[list[str]], list[bytes]], most: int | None = None):
        self.split, self.encode_many, self.known, self.most = split, encode_many, _Known(), most

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            waiting.append(self.split(text))
            held += len(text)
            if held >= TOGETHER:
                out += self._encode(waiting)
                waiting, held = [], 0
        return out + self._encode(waiting)

    def _encode(self, split: list[list[str]]) -> list[bytes]:
        known = self.known
        found = [list(map(known.__getitem__, units)) for units in split]
        if not known.missing:
            return [b"".join(f) for f in found]
        new, known.missing = list(known.missing), {}
        made = dict(zip(new, self.encode_many(new), strict=True))
        gaps = 0
        for ids, units in zip(found, split, strict=True):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = made[units[at]]
                gaps += 1
        out = [b"".join(ids) for ids in found]
        if len(known) < (self.most or MOST_UNITS):
            known.update(made)
        elif 2 * gaps > sum(map(len, found)):
            known.clear()
        return out
