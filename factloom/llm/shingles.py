"""Sets of word shingles as sorted 64-bit hashes, and one-permutation sketches of them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes kept by a worker; fixed size, so that memory does not follow the corpus.
MEMO = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hash = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `size` words, lower-cased in A-Z; with fewer words the whole
    sequence is one; without words the set is empty."""
    # Of bytes, lower() changes A-Z alone, and split() parts at space, tab, LF, VT, FF and CR.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, n)
    k = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k) * _P)
        for i in range(k):
            out = mix(out * _P + h[i : n - k + 1 + i])
    return np.unique(out)


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Of each of `bits` classes of hashes, whether the set has an odd number, packed into 64-bit integers."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


class Sketch:
    """One permutation hashing: a set's hash space is cut into `bins` by its top bits, and each bin keeps its least
    value. An empty bin takes the value of a bin chosen by a sequence of universal hashes of its own number, the same for
    all sets, until one is not empty (optimal densification)."""

    def __init__(self, bins: int, bands: int, seed: int = 1, tries: int = 512):
        if bins & (bins - 1) or bins % bands:
            raise ValueError("bins must be a power of two and a multiple of bands")
        self.bins, self.bands, self.shift = bins, bands, np.uint64(64 - (bins.bit_length() - 1))
        i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(tries, dtype=np.uint64), indexing="ij")
        with np.errstate(over="ignore"):
            self.probes = (mix(mix(i + np.uint64(seed) * _P) + t * _P) >> self.shift).astype(np.int64)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted and not empty."""
        bins = (hashes >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[first]], full[bins[first]] = hashes[first], True
        empty = np.flatnonzero(~full)
        if len(empty):
            source = np.full(len(empty), bins[0])
            left, done = np.arange(len(empty)), 0
            while len(left) and done < self.probes.shape[1]:
                probes = self.probes[empty[left], done : done + 16]
                hit = full[probes]
                found = hit.any(axis=1)
                source[left[found]] = probes[found, hit[found].argmax(axis=1)]
                left, done = left[~found], done + 16
            out[empty] = out[source]
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        v = self.values(hashes).reshape(self.bands, -1)
        with np.errstate(over="ignore"):
            key = mix(np.arange(1, self.bands + 1, dtype=np.uint64) * _P)
            for j in range(v.shape[1]):
                key = mix(key * _P + v[:, j])
        return key.view(np.int64)
