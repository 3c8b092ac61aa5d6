"""Binary alignments (BAM) in BGZF blocks: format sniffing, a reader and a writer of single files.

A file is a row of Spark's binaryFile source, so inputs of up to 2 GB a file are read, one task a file, from any store that Spark
reads. Blocks are unpacked one after another and records are parsed as they come, so a task holds the packed file and one batch of rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources import sam

#: Fixed values of the format: letters of bases and operations by code, struct codes of tag types.
BASE_LETTERS, OP_LETTERS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PAIRS = [a + b for a in BASE_LETTERS for b in BASE_LETTERS]
BATCH = 10_000


def sniff(head: bytes) -> str:
    """The kind of file that begins with these bytes: bam, bgzf, gzip, cram, sam, fastq, fasta, bed or unknown."""
    if head[:4] == b"CRAM":
        return "cram"
    if head[:4] == b"BAM\1":
        return "bam"
    if head[:2] == b"\x1f\x8b":
        if head[3:4] and head[3] & 4 and head[12:14] == b"BC":
            try:
                return "bam" if next(blocks(head, partial=True), b"")[:4] == b"BAM\1" else "bgzf"
            except (zlib.error, ValueError, struct.error):
                return "bgzf"
        return "gzip"
    line = head.split(b"\n", 1)[0]
    if line.startswith((b"@HD\t", b"@SQ\t", b"@RG\t", b"@PG\t", b"@CO\t")) or line.count(b"\t") >= 10:
        return "sam"
    if line[:1] in (b"@", b">"):
        return "fastq" if line[:1] == b"@" else "fasta"
    return "bed" if line.count(b"\t") >= 2 and line.split(b"\t")[1].isdigit() else "unknown"


def blocks(data: bytes, partial: bool = False) -> Iterator[bytes]:
    """The unpacked blocks of a BGZF file. A cut or broken block is an error, unless only the head of a file is given."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b" or len(data) < at + 18:
            raise ValueError(f"no block at byte {at}")
        extra = struct.unpack_from("<H", data, at + 10)[0]
        place, size = at + 12, None
        while place < at + 12 + extra:
            name, n = data[place : place + 2], struct.unpack_from("<H", data, place + 2)[0]
            if name == b"BC":
                size = struct.unpack_from("<H", data, place + 4)[0] + 1
            place += 4 + n
        if size is None or at + size > len(data) and not partial:
            raise ValueError(f"block at byte {at} is cut")
        body = zlib.decompressobj(-15)
        out = body.decompress(data[at + 12 + extra : at + size - 8])
        if at + size <= len(data) and zlib.crc32(out) != struct.unpack_from("<I", data, at + size - 8)[0]:
            raise ValueError(f"block at byte {at} has another checksum")
        yield out
        at += size


def packed(data: bytes, level: int = 6) -> bytes:
    """data as BGZF blocks, without the block that ends a file."""
    out = []
    for at in range(0, len(data), 0xFF00):
        part = data[at : at + 0xFF00]
        body = zlib.compressobj(level, zlib.DEFLATED, -15)
        raw = body.compress(part) + body.flush()
        out.append(struct.pack("<4BI2BHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


class _Stream:
    """Bytes of consecutive blocks, read by number."""

    def __init__(self, data: bytes) -> None:
        self.more, self.held, self.at = blocks(data), b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            part = next(self.more, None)
            if part is None:
                if len(self.held) == self.at and n == 4:
                    return b""
                raise ValueError("the file is cut")
            self.held, self.at = self.held[self.at :] + part, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _head(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(stream.number()).rstrip(b"\0").decode()
    references = []
    for _ in range(stream.number()):
        name = stream.take(stream.number())[:-1].decode()
        references.append((name, stream.number()))
    return text, references


def _tags(data: bytes) -> dict[str, tuple[str, str]]:
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name] = (kind, data[at:end].decode())
            at = end + 1
        elif kind == "A":
            out[name] = ("A", chr(data[at]))
            at += 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{TAG_CODES[sub]}", data, at + 5)
            out[name] = ("B", ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)]))
            at += 5 + n * struct.calcsize(TAG_CODES[sub])
        else:
            value = struct.unpack_from("<" + TAG_CODES[kind], data, at)[0]
            out[name] = ("f", f"{value:g}") if kind == "f" else ("i", str(value))
            at += struct.calcsize(TAG_CODES[kind])
    return out


def _record(data: bytes) -> tuple:
    """The columns of one record behind src and ord. A CIGAR too long for its field is taken from the tag CG."""
    rid, pos, name_size, mapq, _, n_ops, flag, n_bases, mrid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + name_size - 1].decode()
    at += name_size
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    seq = "".join(PAIRS[b] for b in data[at : at + (n_bases + 1) // 2])[:n_bases]
    at += (n_bases + 1) // 2
    quals = data[at : at + n_bases]
    tags = _tags(data[at + n_bases :])
    if len(ops) == 2 and ops[0] == n_bases << 4 | 4 and ops[1] & 15 == 3 and tags.get("CG", ("", ""))[0] == "B":
        ops = [int(x) for x in tags.pop("CG")[1].split(",")[1:]]
    cigar = "".join(f"{x >> 4}{OP_LETTERS[x & 15]}" for x in ops) or "*"
    qual = None if not n_bases or quals[0] == 255 else bytes(q + 33 for q in quals).decode()
    return name, flag, rid, pos, mapq, cigar, mrid, mpos, tlen, seq or None, qual, tags.get("RG", (None, None))[1], [(k, {"t": t, "v": v}) for k, (t, v) in tags.items()]


KINDS = pa.schema(
    [("src", pa.int64()), ("ord", pa.int64()), ("qname", pa.string()), *[(c, pa.int64()) for c in ("flag", "rid", "pos", "mapq")], ("cigar", pa.string()), *[(c, pa.int64()) for c in ("mrid", "mpos", "tlen")]]
    + [("seq", pa.string()), ("qual", pa.string()), ("rg", pa.string()), ("tags", pa.map_(pa.string(), pa.struct([("t", pa.string()), ("v", pa.string())])))]
)


def read_bam(spark: SparkSession, *paths: str) -> tuple[DataFrame, sam.Header]:
    """(alignments, header) of files with one dictionary; src numbers the files, ord the records of each."""
    headers = []
    for path in paths:
        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_header_rows, "text string, names array<string>, lengths array<long>").collect()
        header = sam.Header.parse(rows[0].text.splitlines())
        if not header.of("SQ"):
            header = sam.Header([*header.lines, *(("SQ", [("SN", n), ("LN", str(length))]) for n, length in zip(rows[0].names, rows[0].lengths, strict=True))])
        headers.append(header)
    if any(not h.same_references(headers[0]) for h in headers[1:]):
        raise ValueError("the inputs have different references")
    out = None
    for src, path in enumerate(paths):
        here = spark.read.format("binaryFile").load(path).select(F.lit(src).cast("long").alias("src"), "content").mapInArrow(_rows, sam.SCHEMA)
        out = here if out is None else out.unionByName(here)
    return out, headers[0]


def _header_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [_head(_Stream(x.as_py())) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in heads]), pa.array([[n for n, _ in r] for _, r in heads], pa.list_(pa.string())), pa.array([[n for _, n in r] for _, r in heads], pa.list_(pa.int64()))], names=["text", "names", "lengths"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            stream, src = _Stream(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()
            _head(stream)
            rows: list[tuple] = []
            number = 0
            while size := stream.take(4):
                rows.append((src, number, *_record(stream.take(struct.unpack("<i", size)[0]))))
                number += 1
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


def _bin(begin: int, end: int) -> int:
    for base, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if begin >> shift == (end - 1) >> shift:
            return base + (begin >> shift)
    return 0


def encode(row: dict) -> bytes:
    """One record of the columns of an alignment."""
    import re

    ops = [(int(n), OP_LETTERS.index(o)) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", row["cigar"] or "")]
    name, seq = (row["qname"] or "*").encode() + b"\0", row["seq"] or ""
    codes = [BASE_LETTERS.index(c) if c in BASE_LETTERS else 15 for c in seq.upper()]
    codes += [0] * (len(codes) % 2)
    quals = bytes([255]) * len(seq) if row["qual"] is None else bytes(ord(c) - 33 for c in row["qual"])
    tags = {k: (v["t"], v["v"]) for k, v in dict(row.get("tags") or {}).items() if k != "RG"}
    if row.get("rg") is not None:
        tags["RG"] = ("Z", row["rg"])
    words = [n << 4 | o for n, o in ops]
    span = sum(n for n, o in ops if OP_LETTERS[o] in "MDN=X")
    if len(words) > 65535:  # the place of a long CIGAR is a tag
        tags["CG"] = ("B", ",".join(["I", *map(str, words)]))
        words = [len(seq) << 4 | 4, span << 4 | 3]
    body = b""
    for k, (kind, value) in tags.items():
        body += k.encode()
        if kind in "ZH":
            body += kind.encode() + value.encode() + b"\0"
        elif kind == "A":
            body += b"A" + value.encode()
        elif kind == "f":
            body += b"f" + struct.pack("<f", float(value))
        elif kind == "B":
            sub, *values = value.split(",")
            body += b"B" + sub.encode() + struct.pack("<I", len(values)) + struct.pack(f"<{len(values)}{TAG_CODES[sub]}", *[float(v) if sub == "f" else int(v) for v in values])
        else:
            body += b"i" + struct.pack("<i", int(value)) if -(2**31) <= int(value) < 2**31 else b"I" + struct.pack("<I", int(value))
    pos = row["pos"]
    fixed = struct.pack("<iiBBHHHiiii", row["rid"], pos, len(name), row["mapq"], _bin(pos, pos + max(span, 1)) if pos >= 0 else 4680, len(words), row["flag"], len(seq), row["mrid"], row["mpos"], row["tlen"])
    data = fixed + name + struct.pack(f"<{len(words)}I", *words) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + quals + body
    return struct.pack("<i", len(data)) + data


def head_bytes(header: sam.Header) -> bytes:
    text = "".join(line + "\n" for line in header.text()).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(header.references()))
    for _, name, length in header.references():
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


def bam_parts(reads: DataFrame, header: sam.Header) -> DataFrame:
    """part, content: the packed pieces of a BAM file in order: the header, the rows of each partition of reads as they stand, and the end.

    Put together in the order of part they are one file; Spark has no sink for one binary file, so they are given as rows.
    """
    rows = reads.select("qname", "flag", "rid", "pos", "mapq", "cigar", "mrid", "mpos", "tlen", "seq", "qual", "rg", "tags", F.spark_partition_id().alias("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            if batch.num_rows:
                data = b"".join(encode(r) for r in batch.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([(batch.column(13)[0].as_py() + 1) << 32 | nth], pa.int64()), pa.array([packed(data)], pa.binary())], names=["part", "content"])
                nth += 1

    spark = reads.sparkSession
    ends = spark.createDataFrame([(0, bytearray(packed(head_bytes(header)))), (2**62, bytearray(EOF_BLOCK))], "part long, content binary")
    return ends.unionByName(rows.mapInArrow(run, "part long, content binary"))
