"""Vectorised word scanning of Arrow string columns with numpy.

Texts are read as UTF-8 bytes. Words are runs of bytes outside a set of ASCII
separators, which is the same as runs of characters, since no byte of a longer
UTF-8 sequence is ASCII. Each word gets a 64-bit polynomial hash of its bytes;
prefixes of a word can be hashed as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes that are scanned at a time; a longer text is cut between words.
BLOCK = 1 << 19


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bytes(pattern: str) -> np.ndarray:
    """For each byte, whether it belongs to a word.

    ``space``: all but ASCII white space. ``alnum``: digits, a-z, A-Z and all
    bytes of longer UTF-8 sequences.
    """
    table = np.ones(256, bool)
    if pattern == "space":
        table[[9, 10, 11, 12, 13, 32]] = False
        return table
    table[:128] = False
    for a, b in ("09", "az", "AZ"):
        table[ord(a) : ord(b) + 1] = True
    return table


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows; nulls are empty."""
    import pyarrow as pa

    column = column.fill_null("") if column.null_count else column
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


class WordScanner:
    """Finds and hashes the words of many texts.

    ``prefixes`` lists byte lengths of prefixes to hash as well. Two words have
    the same hash if they are equal after folding A-Z, and otherwise with a
    chance of about 2**-60.
    """

    def __init__(self, pattern: str, prefixes: tuple[int, ...] = ()):
        self.inside = word_bytes(pattern)
        fold = np.arange(256)
        fold[65:91] += 32
        self.code = _byte_codes()[fold]
        self.prefixes = prefixes
        self._power = self._inverse = np.zeros(0, np.uint64)

    def __reduce__(self):
        # found again in the module that is shipped with it; its tables are rebuilt there
        return _scanner, (("space" if self.inside[33] else "alnum"), self.prefixes)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            grown = np.full(n, _BASE, np.uint64)
            grown[0] = 1
            back = np.full(n, _INVERSE, np.uint64)
            back[0] = 1
            self._power, self._inverse = np.cumprod(grown), np.cumprod(back)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Word hashes, a list of prefix hashes, and for each text its first word's index."""
        hashes: list[np.ndarray] = []
        heads: list[list[np.ndarray]] = [[] for _ in self.prefixes]
        first = np.zeros(len(offsets), np.int64)
        seen = 0
        for lo, hi, starts, ends in self._blocks(data, offsets):
            self._powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.code[data[lo:hi]] * self._power[: hi - lo], out=total[1:])
            back = self._inverse[starts]
            hashes.append((total[ends] - total[starts]) * back)
            for k, n in enumerate(self.prefixes):
                heads[k].append((total[np.minimum(starts + n, ends)] - total[starts]) * back)
            # texts that begin in this block
            a, b = np.searchsorted(offsets, (lo, hi))
            first[a:b] = seen + np.searchsorted(starts, offsets[a:b] - lo)
            seen += len(starts)
        first[np.searchsorted(offsets, len(data)) :] = seen
        none = np.zeros(0, np.uint64)
        return (
            np.concatenate(hashes) if hashes else none,
            [np.concatenate(h) if h else none for h in heads],
            first,
        )

    def _blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        lo, n = 0, len(data)
        while lo < n:
            hi = min(n, lo + BLOCK)
            while hi < n:  # end between words: at a separator or at the end of a text
                gap = np.flatnonzero(~self.inside[data[hi : hi + BLOCK]])
                at = offsets[np.searchsorted(offsets, hi)]
                hi = int(min(at, hi + gap[0] if len(gap) else min(n, hi + BLOCK)))
                if hi == at or hi >= n or not self.inside[data[hi]]:
                    break
            inside = np.zeros(hi - lo + 2, bool)
            inside[1:-1] = self.inside[data[lo:hi]]
            edge = inside[1:] != inside[:-1]
            cut = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi)] - lo
            cut = cut[inside[cut] & inside[cut + 1]]  # two words that meet where texts meet
            starts = np.flatnonzero(edge & inside[1:])
            ends = np.flatnonzero(edge & inside[:-1])
            if len(cut):
                cut = np.unique(cut)
                starts, ends = np.union1d(starts, cut), np.union1d(ends, cut)
            yield lo, hi, starts, ends
            lo = hi


def _scanner(pattern: str, prefixes: tuple[int, ...]) -> WordScanner:
    return WordScanner(pattern, prefixes)
