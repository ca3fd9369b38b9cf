"""A binary write-log format: framed, checksummed records, with recovery of a torn tail.

A log is a magic, then records of kind, content hash, address, length, data
length, data, and a CRC-32 of all that. Parsing takes content bytes from any
source, ``spark.read.format("binaryFile")`` or a table's binary column, so
inputs may lie in any store that Spark reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"VARVEWL1"
HEAD = struct.Struct("<B32sQIQI")
KINDS = {"data": 1, "ref": 2, "zero": 3}
NAMES = {v: k for k, v in KINDS.items()}
RECORDS = "wal_id long, seq long, kind string, hash string, start_lba long, lba_length long, data_length long, is_truncated boolean"


def encode(records: list[tuple[str, str, int, int, int, bytes]]) -> bytes:
    """Records ``(kind, hash, start, length, seq, data)`` as one log."""
    out = [MAGIC]
    for kind, digest, start, length, seq, data in records:
        body = HEAD.pack(KINDS[kind], bytes.fromhex(digest), start, length, seq, len(data)) + data
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return b"".join(out)


def parse(content: bytes) -> tuple[list[tuple[str, str, int, int, int, bytes]], int, bool]:
    """Whole records, the length of the valid prefix, and whether something was cut off or damaged after it."""
    if not content.startswith(MAGIC):
        return [], 0, bool(content)
    at, out = len(MAGIC), []
    while at + HEAD.size + 4 <= len(content):
        kind, digest, start, length, seq, size = HEAD.unpack_from(content, at)
        stop = at + HEAD.size + size
        if stop + 4 > len(content) or kind not in NAMES or zlib.crc32(content[at:stop]) != struct.unpack_from("<I", content, stop)[0]:
            break
        out.append((NAMES[kind], digest.hex(), start, length, seq, content[at + HEAD.size : stop]))
        at = stop + 4
    return out, at, at < len(content)


def encoded_logs(wal: DataFrame) -> DataFrame:
    """``wal_id, content``: each log's records as bytes; the data is as long as ``data_length`` says."""

    def log(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        fields = (rows.column(c).to_pylist() for c in ("kind", "hash", "start_lba", "lba_length", "seq", "data_length"))
        made = [(kind, digest, start, length, seq, b"\x5a" * size) for kind, digest, start, length, seq, size in zip(*fields, strict=True)]
        return pa.table({"wal_id": rows.column("wal_id")[:1], "content": pa.array([encode(made)], pa.binary())})

    slim = wal.select("wal_id", "seq", "kind", "hash", "start_lba", "lba_length", "data_length")
    return slim.groupBy("wal_id").applyInArrow(log, "wal_id long, content binary")


def parsed_logs(logs: DataFrame) -> DataFrame:
    """Records of ``logs (wal_id, content)``; a torn tail is left out and flagged on the log's rows."""

    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wal_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, _, torn = parse(content.as_py())
                rows = [(wal_id, seq, kind, digest, start, length, len(data), torn) for kind, digest, start, length, seq, data in found]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return logs.select("wal_id", "content").mapInArrow(records, RECORDS)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of all log files under ``path``, named ``<wal_id>.wal``."""
    files = spark.read.format("binaryFile").load(path)
    return parsed_logs(files.select(F.regexp_extract("path", r"(\d+)\.wal$", 1).cast("long").alias("wal_id"), "content"))
