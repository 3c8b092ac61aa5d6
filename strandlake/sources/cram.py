"""Sizes of what CRAM files hold: the blocks of their containers by content and compression method. Records are not decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: compression methods and content types by code.
METHODS = ("raw", "gzip", "bzip2", "lzma", "rans4x8", "rans4x16", "arith", "fqzcomp", "tok3")
KINDS = ("file header", "compression header", "slice header", "reserved", "external data", "core data")


def itf8(data: bytes, at: int) -> tuple[int, int]:
    """(number, place behind it) of a number of one to five bytes: the first byte's leading ones tell how many follow."""
    first = data[at]
    more = 0 if first < 0x80 else 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    if more < 4:
        value = first & (0xFF >> (more + 1))
        for b in data[at + 1 : at + 1 + more]:
            value = value << 8 | b
    else:
        value = (first & 15) << 28 | data[at + 1] << 20 | data[at + 2] << 12 | data[at + 3] << 4 | data[at + 4] & 15
    return value - (1 << 32) if value >= 1 << 31 else value, at + 1 + more


def ltf8(data: bytes, at: int) -> tuple[int, int]:
    """The same for numbers of up to nine bytes."""
    first, more = data[at], 0
    while more < 8 and first & 0x80 >> more:
        more += 1
    value = first & (0x7F >> more) if more < 7 else 0
    for b in data[at + 1 : at + 1 + more]:
        value = value << 8 | b
    return value, at + 1 + more


def block_sizes(data: bytes) -> Iterator[tuple[int, str, int, str, int, int]]:
    """(container, kind, content id, method, packed bytes, unpacked bytes) of every block of a file of version 2 or 3. A cut file or a wrong checksum is an error."""
    if data[:4] != b"CRAM" or len(data) < 26 or data[4] not in (2, 3):
        raise ValueError("not a CRAM file of version 2 or 3")
    three, at, container = data[4] == 3, 26, 0
    while at < len(data):
        begin, length = at, struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(4):  # reference, start, span, records
            _, at = itf8(data, at)
        _, at = ltf8(data, at) if three else itf8(data, at)
        _, at = ltf8(data, at)
        n_blocks, at = itf8(data, at)
        marks, at = itf8(data, at)
        for _ in range(marks):
            _, at = itf8(data, at)
        if three:
            if zlib.crc32(data[begin:at]) != struct.unpack_from("<I", data, at)[0]:
                raise ValueError(f"container {container} has another checksum")
            at += 4
        end = at + length
        if end > len(data):
            raise ValueError(f"container {container} is cut")
        for _ in range(n_blocks):
            first, method, kind = at, data[at], data[at + 1]
            content, at = itf8(data, at + 2)
            packed, at = itf8(data, at)
            unpacked, at = itf8(data, at)
            at += packed
            if three:
                if zlib.crc32(data[first:at]) != struct.unpack_from("<I", data, at)[0]:
                    raise ValueError(f"a block of container {container} has another checksum")
                at += 4
            yield container, KINDS[kind], content, METHODS[method], packed, unpacked
        at, container = end, container + 1


def cram_size(spark: SparkSession, *paths: str) -> DataFrame:
    """kind, content, method, blocks, packed, unpacked: sums over all blocks of the files, a file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                rows = list(block_sizes(x.as_py()))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)], names=["kind", "content", "method", "packed", "unpacked"])

    rows = spark.read.format("binaryFile").load(list(paths)).select("content").mapInArrow(run, "kind string, content long, method string, packed long, unpacked long")
    return rows.groupBy("kind", "content", "method").agg(F.count("*").alias("blocks"), F.sum("packed").alias("packed"), F.sum("unpacked").alias("unpacked"))
