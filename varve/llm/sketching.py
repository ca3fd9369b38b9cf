"""Word shingles of whole texts, and the fast similarity sketch of their sets.

The sketch fills ``t`` bins in rounds. In each of the first ``t`` rounds every
shingle is placed in a hashed bin with a hashed value; in round ``t + i`` every
shingle is placed in bin ``i``, so all bins fill. A bin keeps the placement of
the earliest round, and of those the least value. A document is done after the
first round that leaves no bin empty, as later rounds cannot change a bin.
Agreement of two sketches, bin by bin, estimates the Jaccard similarity with
the concentration of sampling without replacement.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a task remembers.
REMEMBERED = 100_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = 0x9E3779B97F4A7C15
MASK = 0xFFFFFFFFFFFFFFFF


class WordHashes(dict):
    """64-bit hashes by word, filled in on first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text.

    A-Z are lowered, and words are runs of anything but ASCII white space. With
    fewer than ``width`` words the whole sequence is one shingle; without words
    the set is empty.
    """

    def __init__(self, width: int) -> None:
        self.width, self.hashes = width, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode(errors="surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        codes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(codes) - width + 1
        value = np.full(n, (width * GOLDEN) & MASK, np.uint64)
        for i in range(width):
            value = mixed(value + codes[i : i + n])
        return np.unique(value)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The fast similarity sketches of non-empty sets, one row of ``t`` values each."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bins = np.full((len(sets), t), EMPTY, np.uint64)
    flat = bins.reshape(-1)
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * t):
        if not len(values):
            break
        placed = mixed(values + np.uint64(((i + 1) * GOLDEN) & MASK))
        value = (placed & low) | np.uint64(i << 48)
        if i < t:
            at = ((placed >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)).astype(np.int64)
            np.minimum.at(flat, owner * t + at, value)
        else:
            np.minimum.at(flat, owner * t + (i - t), value)
        active = (bins == EMPTY).any(axis=1)
        if not active.all():
            keep = active[owner]
            values, owner = values[keep], owner[keep]
    return bins


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` bins; keys of different bands differ."""
    n, t = sketches.shape
    bands = t // rows
    parts = sketches[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN)), (n, bands))
    for i in range(rows):
        key = mixed(key + parts[:, :, i])
    return key.view(np.int64)
