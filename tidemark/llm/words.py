"""Words of many texts at once, as 64-bit hashes, without a Python object a word.

A word is a run of letters and digits in lower case, or one character of a script that sets no blanks. Its hash is a
polynomial of random numbers by character, taken modulo 2 ** 64 from differences of prefix sums and mixed. The larger arrays
cover some ten thousand characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import by_value

by_value(__name__)

LETTER, SINGLE = 1, 2
#: Scripts that set no blanks between words: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
SPAN, BASE = 32_768, 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Splitter:
    """The tables of a task."""

    def __init__(self):
        self.kind = np.array([LETTER if chr(i).isalnum() else 0 for i in range(1 << 16)], np.uint8)
        for a, b in UNSPACED:
            self.kind[a : b + 1] = SINGLE
        rng = np.random.default_rng(7)
        self.of_char = rng.integers(0, 1 << 64, 1 << 16, np.uint64)
        self.power, self.inverse = self.powers(2 * SPAN)

    @staticmethod
    def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the base and of its inverse, modulo 2 ** 64."""
        factors = np.ones((2, n + 1), np.uint64)
        factors[:, 1:] = [[BASE], [pow(BASE, -1, 1 << 64)]]
        return tuple(np.multiply.accumulate(factors, axis=1))

    def kinds(self, code: np.ndarray) -> np.ndarray:
        if not len(code) or code.max() <= 0xFFFF:
            return self.kind[code]
        kind = self.kind[code & np.uint32(0xFFFF)]
        far = np.flatnonzero(code > 0xFFFF)
        if len(far):
            some, at = np.unique(code[far], return_inverse=True)
            low, high = UNSPACED[-1]
            kind[far] = np.array([SINGLE if low <= c <= high else LETTER if chr(c).isalnum() else 0 for c in some.tolist()], np.uint8)[at]
        return kind

    def sums(self, values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of each run of n values from begin on, in its order; runs are ascending and not empty."""
        out = np.empty(len(n), np.uint64)
        ends = begin + n
        start = 0
        while start < len(n):
            low = begin[start]
            stop = max(start + 1, int(np.searchsorted(ends, low + SPAN, "right")))
            v = values[low : ends[stop - 1]]
            if v.dtype != np.uint64:
                far = v >> np.uint32(16)
                v = self.of_char[v & np.uint32(0xFFFF)]
                if far.any():
                    v = v * self.power[far]
            power, inverse = (self.power, self.inverse) if len(v) < len(self.power) else self.powers(len(v))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(v * power[: len(v)])])
            b = begin[start:stop] - low
            out[start:stop] = (sums[ends[start:stop] - low] - sums[b]) * inverse[b]
            start = stop
        return mixed(out + n.astype(np.uint64))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, line, first line of each text): the words of all texts in order, the number of the line each stands in,
        counted over all texts, and the number of each text's first line."""
        joined = "\n".join([t.lower() for t in texts])
        firsts = np.concatenate([[0], np.cumsum([t.count("\n") + 1 for t in texts])])[: len(texts)].astype(np.int64)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds(code)
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        single = np.flatnonzero(kind == SINGLE)
        at = np.unique(np.concatenate([edge, single, single + 1])) if len(single) else edge
        at = np.concatenate([[0], at, [len(code)]])
        begin, end = at[:-1], at[1:]
        word = (begin < end) & (kind[np.minimum(begin, max(len(code) - 1, 0))] > 0) if len(code) else np.zeros(len(begin), bool)
        begin, end = begin[word], end[word]
        return self.sums(code, begin, end - begin), np.searchsorted(np.flatnonzero(code == 10), begin), firsts

    def sequences(self, hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """One int64 hash a run of word hashes."""
        return self.sums(hashes, begin, n).view(np.int64)


def chunked(texts: list[str | None], letters: int = 300_000) -> Iterator[slice]:
    """Slices of texts with some ``letters`` characters together; a longer text is alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t or "") > letters:
            yield slice(start, i)
            start, held = i, 0
        held += len(t or "") + 1
    if start < len(texts):
        yield slice(start, len(texts))


def runs_of(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin in an ascending array, and how long they are."""
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    return begin, np.diff(begin, append=len(line))
