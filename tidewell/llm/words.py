"""Words of many texts at once: where they stand, and a 64-bit code of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Words:
    """Where the words of consecutive rows of UTF-8 bytes stand, and a 64-bit code of each.

    A code is a polynomial in a fixed odd number over fixed random values of a
    word's bytes, taken from prefix sums over the row, so no word is touched by
    itself. Equal words have equal codes in every task.
    """

    CHUNK = 1 << 20
    SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
    _rng = np.random.default_rng(20_13)
    _value = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    #: What each byte is: 0 parts words, and a word is a run of one other kind.
    KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256)], np.uint8)
    _base = np.uint64(0x9E3779B97F4A7C15)
    _inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    _powers: list[np.ndarray] = []

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not cls._powers or len(cls._powers[0]) <= n:
            size = max(n + 1, 2 * cls.CHUNK)
            cls._powers = [np.cumprod(np.r_[np.uint64(1), np.full(size, x)]) for x in (cls._base, cls._inverse)]
        return cls._powers[0], cls._powers[1]

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.bytes = data.to_pybytes() if data is not None else b""
        whole = np.frombuffer(self.bytes, np.uint8)
        found: list[tuple[np.ndarray, ...]] = []
        row = 0
        while row < len(texts):
            to = max(row + 1, int(np.searchsorted(at, at[row] + self.CHUNK, "right")) - 1)
            found.append(self.split(whole, at[row : to + 1], row))
            row = to
        none = np.zeros(0, np.int64)
        parts = list(zip(*found, strict=True)) if found else [[], [], [], []]
        self.start, self.end, self.row = (np.concatenate([none, *p]) for p in parts[:3])
        self.code = np.concatenate([np.zeros(0, np.uint64), *parts[3]])
        #: How many gaps before each word are not a single byte.
        self.wide = np.cumsum(np.r_[0, self.start[1:] - self.end[:-1] != 1]) if len(self.start) else none

    @classmethod
    def split(cls, whole: np.ndarray, at: np.ndarray, row: int) -> tuple[np.ndarray, ...]:
        data, at0 = whole[at[0] : at[-1]], at - at[0]
        kind = cls.KIND[data]
        letter = kind > 0
        begins, ends = letter.copy(), letter.copy()
        turn = kind[1:] != kind[:-1]
        begins[1:] &= turn
        ends[:-1] &= turn
        edge = at0[:-1][at0[:-1] < len(data)]
        begins[edge] = letter[edge]
        edge = at0[1:][at0[1:] > 0] - 1
        ends[edge] = letter[edge]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = cls.powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(cls._value[data] * up[: len(data)], out=sums[1:])
        code = (sums[end] - sums[start]) * down[start]
        # Mixed, so that the codes of neighbours don't add up along the text.
        code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(29)
        return start + at[0], end + at[0], np.searchsorted(at0, start, "right") - 1 + row, code

    def joined(self, first: int, to: int) -> bytes:
        """Words ``first`` to ``to`` - 1, which lie in one row, parted by single spaces."""
        if to <= first:
            return b""
        text = self.bytes[self.start[first] : self.end[to - 1]]
        return text.translate(self.SPACES) if self.wide[to - 1] == self.wide[first] else b" ".join(text.split())


class Tokens(Words):
    """Runs of letters, digits, underscores and bytes beyond ASCII, and runs of other signs; A-Z count as a-z."""

    KIND = np.array([0 if b <= 32 else 1 if b > 126 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)
    _value = np.array([Words._value[b + 32 if 65 <= b <= 90 else b] for b in range(256)], np.uint64)
