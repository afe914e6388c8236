"""Words, shingle sets and text measures with numpy; runs inside tasks on one text at a time."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Shingler:
    """Hashes words and word shingles of whole texts; one object per task."""

    def __init__(self, size: int = 3):
        self.size = size
        self.bytes = mixed(np.arange(1, 257, dtype=U)) | U(1)
        self.space = np.zeros(256, dtype=bool)
        self.space[list(SPACES)] = True
        self.powers = self.inverse = np.ones(1, dtype=U)

    def _reserve(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, dtype=U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words (stretches without ASCII white space)."""
        a = np.frombuffer(raw, dtype=np.uint8)
        gap = np.concatenate(([True], self.space[a], [True]))
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = turns[0::2], turns[1::2]
        self._reserve(len(a))
        sums = np.zeros(len(a) + 1, dtype=U)
        np.cumsum(self.bytes[a] * self.powers[: len(a)], out=sums[1:])
        return starts, ends, mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))

    def lowered(self, text: str | None) -> np.ndarray:
        """Hashes of the words in their order; A-Z count as a-z."""
        return self.words((text or "").encode("utf-8", "surrogatepass").lower())[2]

    def rolled(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the shingles in their order. Fewer words are one shingle, no words none."""
        if not len(words):
            return np.zeros(0, dtype=U)
        k = min(self.size, len(words))
        hashes = np.full(len(words) - k + 1, k, dtype=U)
        for i in range(k):
            hashes = hashes * U(0x100000001B3) + words[i : len(words) - k + 1 + i]
        return mixed(hashes)

    def shingles(self, text: str | None) -> np.ndarray:
        """The set of hashed shingles, sorted."""
        return np.unique(self.rolled(self.lowered(text)))

    def weighed(self, text: str | None, known: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set of hashed shingles, sorted, and the sum of the weights of each one's words (``known`` ones, sorted)."""
        words = self.lowered(text)
        hashes, first = np.unique(self.rolled(words), return_index=True)
        sums = np.concatenate(([0], np.cumsum(looked_up(words, known, weights))))
        return hashes, sums[np.minimum(first + self.size, len(words))] - sums[first]


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of keys in a sorted table, 0 for others."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(shingles: np.ndarray, load: int) -> np.ndarray:
    """How many shingles fall in each of 2**b equal hash ranges, ``load`` / 2 to ``load`` on average (counts stop at 255).

    The sum of differences of two sketches is never more than the size of the symmetric difference of the sets.
    """
    bits = max(3, int(len(shingles) // load).bit_length())
    return np.minimum(np.bincount((shingles >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)
