"""Words, shingle sets and HyperMinHash registers of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
MANTISSA_BITS = 10


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: A random 64-bit value for each byte, and the powers of an odd number (that leaves 3 over 8) with their inverses.
BYTES = np.random.default_rng(29).integers(0, 2**64, size=256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C13


@lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        table = np.ones(1, dtype=np.uint64)
        for i in range(bits):
            table = np.concatenate([table, table * np.uint64(pow(base, 1 << i, 1 << 64))])
        out.append(table)
    return out[0], out[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts that lie one after another in ``data`` (bytes), and how many each text has.

    A-Z are lowered and words end at ASCII white space (20, 09-0D): bytes do both, whatever the language. The hash is a
    polynomial in random values of the bytes, taken from running sums, so no word is ever looked up.
    """
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    inside = ~SPACES[data]
    begins = np.append(0, ends[:-1])
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[begins] = True
    fresh = fresh[:-1]
    fresh[1:] |= ~inside[:-1]
    starts = np.flatnonzero(inside & fresh)
    counts = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(ends))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    letters = LOWERED[data[inside]]
    # where each word begins among the letters
    firsts = np.flatnonzero(fresh[inside])
    up, down = powers(max(20, len(letters).bit_length()))
    sums = np.append(np.uint64(0), np.cumsum(BYTES[letters] * up[: len(letters)]))
    sizes = np.diff(firsts, append=len(letters))
    return mixed((sums[firsts + sizes] - sums[firsts]) * down[firsts] + sizes.astype(np.uint64) * STEP), counts


class Words:
    """Word hashes of texts."""

    @staticmethod
    def hashes(text: bytes) -> np.ndarray:
        return word_hashes(np.frombuffer(text, dtype=np.uint8), np.array([len(text)]))[0]

    @staticmethod
    def of(texts: list[bytes]) -> list[np.ndarray]:
        """One array per text; all are hashed together."""
        if not texts:
            return []
        hashes, counts = word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]))
        return np.split(hashes, np.cumsum(counts)[:-1])


WORDS = Words()


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of the whole sequence if it is shorter; nothing for no words."""
    n = len(words)
    if n == 0:
        return words
    width_now = min(width, n)
    out = np.full(n - width_now + 1, np.uint64(width_now), dtype=np.uint64)
    for i in range(width_now):
        out = mixed(out * STEP + words[i : n - width_now + 1 + i])
    return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(windows(words, width))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int((b[place] == a).sum())


def digest(values: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class HyperMinHash:
    """Registers of 16 bits: the leading zeros of the least hash (6 bits), and ``MANTISSA_BITS`` bits after its first one.

    Every register has a hash function of its own, so that sets of any size fill all of them.
    """

    def __init__(self, registers: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 2**63, size=registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set (none is empty)."""
        out = np.empty((len(sets), len(self.factors)), dtype="<u2")
        if not sets:
            return out
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        for j, factor in enumerate(self.factors):
            least = np.minimum.reduceat(flat * factor, starts)
            fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
            zeros = np.clip(53 - exponent, 0, 63)
            mantissa = np.clip((fraction * 2 - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1)
            out[:, j] = (zeros.astype(np.int64) << MANTISSA_BITS) | mantissa.astype(np.int64)
        return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of set pairs from their registers, corrected for registers that agree by accident.

    Unlike sets of n and m elements agree in a register with a probability of nearly 2^-bits nm / (n + m)^2 / (2 ln 2).
    """
    accident = 0.5 / np.log(2) * 2.0**-MANTISSA_BITS * n * m / (n + m) ** 2
    return np.clip(((a == b).mean(1) - accident) / (1 - accident), 0, 1)


def grouped(texts: list[bytes], size: int = 2_000_000) -> Iterator[list[bytes]]:
    part, total = [], 0
    for text in texts:
        if part and total + len(text) > size:
            yield part
            part, total = [], 0
        part.append(text)
        total += len(text)
    if part:
        yield part
