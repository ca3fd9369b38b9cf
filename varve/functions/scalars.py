"""Scalar expressions of the storage model, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Crockford's base-32 digits.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
INLINE = 256
CHUNK = 128 << 10


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def stored_tag(digest: Column) -> Column:
    """The first 16 bytes of a digest, in hex."""
    return F.substring(digest, 1, 32)


def is_canonical(kind: Column) -> Column:
    return kind.like("canonical%")


def is_data(kind: Column) -> Column:
    return kind.isin("data", "canonical_data")


def is_inline(kind: Column) -> Column:
    return kind.isin("inline", "canonical_inline")


def is_delta(kind: Column) -> Column:
    return kind.isin("delta", "canonical_delta")


def has_body(kind: Column) -> Column:
    return is_data(kind) | is_inline(kind)


def owns_hash(kind: Column) -> Column:
    return has_body(kind) | is_delta(kind)


def as_canonical(kind: Column) -> Column:
    """The kind without a claim that carries the same body; others stay."""
    return F.when(kind.isin("data", "inline", "delta"), F.concat(F.lit("canonical_"), kind)).otherwise(kind)


def would_be_inline(length: Column) -> Column:
    return length < INLINE


def pays_fast_codec(compressed: Column, plain: Column) -> Column:
    """At least half as large again before, in whole numbers."""
    return F.floor(compressed * 3 / 2) <= plain


def body_codec(journal: Column, kind: Column, plain: Column, packed: Column) -> Column:
    return F.when(journal, "lz4").when(is_inline(kind), "none").when(plain > CHUNK, "zstd_chunked").when(packed < plain, "zstd").otherwise("none")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def mebibytes(n: Column) -> Column:
    return n / (1 << 20)


def size_text(n: Column) -> Column:
    """Whole units of the largest binary unit that is not above the size."""
    return (
        F.when(n >= 1 << 30, F.concat(F.floor(n / (1 << 30)).cast("string"), F.lit(" GiB")))
        .when(n >= 1 << 20, F.concat(F.floor(n / (1 << 20)).cast("string"), F.lit(" MiB")))
        .when(n >= 1 << 10, F.concat(F.floor(n / (1 << 10)).cast("string"), F.lit(" KiB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def comma_text(n: Column) -> Column:
    return F.format_number(n, 0)


def ulid_of(millis: Column, serial: Column) -> Column:
    """An id of 26 digits that sorts by time and then by serial number."""
    def digits(value: Column, n: int) -> Column:
        return F.concat(*[F.substring(F.lit(BASE32), (F.floor(value / F.lit(32**p)) % 32 + 1).cast("int"), F.lit(1)) for p in range(n - 1, -1, -1)])

    return F.concat(digits(millis, 10), F.lit("0" * 6), digits(serial, 10))


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds of an id's first ten base-32 digits."""
    value = F.lit(0).cast("long")
    for i in range(1, 11):
        value = value * 32 + F.instr(F.lit(BASE32), F.substring(ulid, i, 1)).cast("long") - 1
    return value


def block_aligned(length: Column, block: int = 4096) -> Column:
    return (length > 0) & (length % block == 0)


def retention_over(since: Column, days: int, now: Column) -> Column:
    return since + F.expr(f"interval {days} days") <= now


def anchor_matches(start: Column, run_start: Column, offset: Column) -> Column:
    return run_start - start == offset


def little_endian(n: Column) -> Column:
    """Eight bytes of a number, lowest first, in hex."""
    hexed = F.lpad(F.hex(n), 16, "0")
    return F.concat(*[F.substring(hexed, i, 2) for i in range(15, 0, -2)])


def ownership(owner: Column, me: Column) -> Column:
    return F.when(owner.isNull(), "unclaimed").when(owner == me, "ours").otherwise("foreign")


def rehomed(name: Column, suffix: Column) -> Column:
    return F.concat(name, F.lit("-rehomed-"), suffix)
