"""Resemblance sketches and compressed sizes of bodies, as Arrow-batched functions.

The rolling hash at a byte is a sum of shifted table values of the last 64
bytes, so a whole body is hashed by six doubling steps of array arithmetic in
wrapping 64-bit integers. The byte table and the multipliers follow from
SHA-256 of their index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = 8
SAMPLE_MASK, LEAST_SAMPLES, LEAST_BYTES = 0x1F, 16, 32 << 10


def word_of(label: str) -> int:
    return int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "little")


GEAR = np.array([word_of(f"gear {b}") for b in range(256)], np.uint64)


def multipliers(n: int) -> np.ndarray:
    return np.array([word_of(f"feature {i}") | 1 for i in range(n)], np.uint64)


def rolling(data: bytes) -> np.ndarray:
    """``h = (h << 1) + G[byte]`` at every byte."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16, 32):
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint64(step)
        h = h + moved
    return h


def features(data: bytes, n: int = FEATURES, least_bytes: int = LEAST_BYTES) -> np.ndarray | None:
    """The greatest permuted sample for each multiplier; None for short bodies and those with few samples."""
    if len(data) < least_bytes:
        return None
    h = rolling(data)
    samples = h[(h & np.uint64(SAMPLE_MASK)) == np.uint64(SAMPLE_MASK)]
    if len(samples) < LEAST_SAMPLES:
        return None
    return (samples[None, :] * multipliers(n)[:, None]).max(axis=1)


def sketch(data: bytes | None, n: int = FEATURES, group: int = 1, width: int = 4, least_bytes: int = LEAST_BYTES) -> list[int] | None:
    """Stored features: ``width`` little-endian bytes of the hash of each group of features."""
    found = features(data or b"", n, least_bytes)
    if found is None:
        return None
    parts = found.reshape(-1, group)
    return [int.from_bytes(hashlib.sha256(p.tobytes()).digest()[:width], "little") for p in parts]


def sketch_column(body: Column, n: int = FEATURES, group: int = 1, width: int = 4, least_bytes: int = LEAST_BYTES) -> Column:
    """``array<bigint>`` for a binary column."""
    if n % group or not 1 <= n <= 32 or not 1 <= width <= 7:
        raise ValueError("features 1 to 32 in whole groups, 1 to 7 bytes each")

    def sketches(bodies: pd.Series) -> pd.Series:
        return pd.Series([sketch(b, n, group, width, least_bytes) for b in bodies], dtype=object)

    return F.pandas_udf(sketches, "array<bigint>")(body)


def compressor(level: int, source: bytes | None = None):
    import zstandard

    if source:
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return zstandard.ZstdCompressor(level=level)


def compressed_length(body: Column, level: int = 3) -> Column:
    """Bytes of one compressed frame of a binary column."""

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = compressor(level)
        for bodies in batches:
            yield pd.Series([None if b is None else len(c.compress(b)) for b in bodies], dtype="Int64")

    lengths.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(lengths, "bigint")(body)


def chunked_length(body: Column, size: int, level: int = 3) -> Column:
    """Bytes of a body compressed in chunks of ``size`` bytes, each a frame of its own, with 4 bytes for each chunk's length."""

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = compressor(level)
        for bodies in batches:
            yield pd.Series([None if b is None else sum(4 + len(c.compress(b[i : i + size])) for i in range(0, len(b), size)) for b in bodies], dtype="Int64")

    lengths.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(lengths, "bigint")(body)


def delta_length(source: Column, body: Column, level: int = 3) -> Column:
    """Bytes of ``body`` compressed with ``source`` as its dictionary."""

    def lengths(sources: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or b is None else len(compressor(level, s).compress(b)) for s, b in zip(sources, bodies, strict=True)], dtype="Int64")

    return F.pandas_udf(lengths, "bigint")(source, body)


def dictionary_length(body: Column, trained: bytes, level: int = 3) -> Column:
    """Bytes of one frame of a binary column under one dictionary (none where it is empty)."""

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else compressor(level)
        for bodies in batches:
            yield pd.Series([None if b is None else len(c.compress(b)) for b in bodies], dtype="Int64")

    lengths.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(lengths, "bigint")(body)


def delta(source: bytes, body: bytes, level: int = 3) -> bytes:
    return compressor(level, source).compress(body)


def apply_delta(source: bytes, blob: bytes) -> bytes:
    """The body that a delta stands for."""
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).decompress(blob)


def worth_storing(delta_bytes: Column, stored_bytes: Column, plain_bytes: Column) -> Column:
    """A delta is kept if it is strictly smaller than the stored form and than the body compressed on its own."""
    return (delta_bytes < stored_bytes) & (delta_bytes < plain_bytes)
