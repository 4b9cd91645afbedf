"""Whole words of many texts as 64-bit numbers, by array operations.

A word ``[^\\W\\d_]+`` is the sum of its letters' numbers, each times a power of
an odd base for its place, modulo 2**64.  Two words of a corpus have one number
with a chance of about 2**-64 for each pair of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: The odd base; characters that are taken at once, about, and of one text at most where it has a place to cut.
BASE, AT_ONCE, LONG = 0x9E3779B97F4A7C15, 65_536, 131_072
_RUNS, _CUT = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Found:
    """Words of several texts in order: their numbers, how many each text has, where they begin and end among ``points``."""

    hashes: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    points: np.ndarray

    def words(self, at: np.ndarray) -> list[str]:
        """The words numbered ``at``."""
        if not len(at):
            return []
        size = self.end[at] - self.begin[at] + 1
        last = np.cumsum(size)
        x = self.points[np.arange(last[-1]) + np.repeat(self.begin[at] - (last - size), size)]
        x[last - 1] = 10  # what follows a word is no letter
        return x.tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]


class Hashes:
    def __init__(self) -> None:
        known = points("".join(_RUNS.findall("".join(map(chr, range(1, 0x110000))))))
        x = known.astype(np.uint64)
        for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27), (0xD6E8FEB86659FD93, 31)):
            x *= np.uint64(by)
            x ^= x >> np.uint64(shift)
        self.letter = np.zeros(0x110000, np.uint64)
        self.letter[known] = x  # of other numbers than 0 never 0, so 0 marks what is no letter
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.inverse = powers(BASE, n), powers(pow(BASE, -1, 2**64), n)

    def of(self, texts: list[str]) -> Found:
        """All words of the texts in lower case."""
        lengths, parts = [], []
        for t in texts:
            t, low = t.lower(), 0
            lengths.append(len(t) + 1)
            while len(t) - low > LONG and (hit := _CUT.search(t, low + LONG)):
                parts.append(t[low : hit.end()])
                low = hit.end()
            parts.append(t[low:] + "\n")
        found, held, size, base = [], [], 0, 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= AT_ONCE:
                found.append(self._of("".join(held), base))
                base += size
                held, size = [], 0
        found.append(self._of("".join(held), base))
        hashes, begin, end, all_points = (np.concatenate(x) for x in zip(*found))
        upto = np.searchsorted(begin, np.cumsum(np.array(lengths, np.int64)))
        return Found(hashes, np.diff(upto, prepend=0), begin, end, all_points)

    def _of(self, text: str, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = points(text)
        self._reach(len(x) + 1)
        m = self.letter[x]
        word = np.zeros(len(x) + 2, bool)
        np.not_equal(m, 0, out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        begin, end = edges[::2], edges[1::2]
        upto = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(np.multiply(m, self.power[: len(x)], out=m), out=upto[1:])
        return (upto[end] - upto[begin]) * self.inverse[begin], begin + base, end + base, x

    def prefixes(self, found: Found, least: int, most: int):
        """(which words, numbers of their first k letters) for k from ``least`` to ``most``, of words that are longer."""
        self._reach(most)
        at, so_far = np.arange(len(found.hashes)), np.zeros(len(found.hashes), np.uint64)
        length = found.end - found.begin
        for k in range(1, most + 1):
            longer = length[at] > k
            at, so_far = at[longer], so_far[longer]
            so_far = so_far + self.letter[found.points[found.begin[at] + k - 1]] * self.power[k - 1]
            if k >= least:
                yield at, so_far

    def of_words(self, words: list[str]) -> np.ndarray:
        """Numbers of words in lower case."""
        return self._of("\n".join(words), 0)[0] if words else np.zeros(0, np.uint64)


class Table:
    """Number of a word -> its value, else ``default``: open addressing over arrays."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, default) -> None:
        bits = max(8, (8 * len(hashes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.tries = np.full(self.mask + 1, len(hashes), np.int32), 0
        self.keys, self.values = np.append(hashes, np.uint64(0)), np.append(values, values.dtype.type(default))
        left, at = np.arange(len(hashes), dtype=np.int32), self._first(hashes)
        while len(left):
            free = self.slots[at] == len(hashes)
            self.slots[at[free]] = left[free]  # of several for one slot the last stays
            lost = self.slots[at] != left
            left, at, self.tries = left[lost], (at[lost] + 1) & self.mask, self.tries + 1

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD1342543DE82EF95) >> self.shift).astype(np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        n, slot = len(self.keys) - 1, self._first(hashes)
        got = self.slots[slot]
        rest = np.flatnonzero((got != n) & (self.keys[got] != hashes))
        for k in range(1, self.tries):
            if not len(rest):
                break
            more = self.slots[(slot[rest] + k) & self.mask]
            got[rest] = more
            rest = rest[(more != n) & (self.keys[more] != hashes[rest])]
        got[rest] = n
        return self.values[got]
