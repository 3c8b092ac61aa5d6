"""Every registered alignment query against its SQL, and the parts that SQL cannot state against plain Python."""

import re
import struct
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.operators import reports, select
from strandlake.plans import queries as Q
from strandlake.sources.derived import reads

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(Q.QUERIES[name](spark, SMALL), con, Q.ORACLE_SQL[name]) is None


def folded(rows, kinds):
    out = {}
    for group, values in rows:
        row = out.setdefault(group, [0] + [1] * len(kinds))
        row[0] += 1
        for i, data in enumerate(values, 1):
            v = (data if isinstance(data, int) else zlib.crc32(data)) & 0x7FFFFFFF
            row[i] = row[i] * (v if v not in (0, 0x7FFFFFFF) else 1) % 0x7FFFFFFF
    return out


def test_checksum_equals_crc32(spark):
    tag = "map('BC', struct('Z' AS t, qname AS v), 'FI', struct('i' AS t, cast(pos - 200 AS string) AS v), 'XX', struct('f' AS t, '1' AS v))"
    r = reads(spark, SMALL).withColumn("tags", F.expr(tag))
    swap = str.maketrans("ACGTN", "TGCAN")
    kinds = ("seq", "name", "qual", "aux", "pos", "cigar", "mate")

    def sums(x):
        seq, qual = (x.seq[::-1].translate(swap), (x.qual or " " * 50)[::-1]) if x.flag & 16 else (x.seq, x.qual or " " * 50)
        head = bytes([x.flag & 0xC1]) + seq.encode()
        n = x.pos - 200
        form = next(f for f, low, high in (("B", 0, 255), ("H", 0, 65535), ("b", -128, -1), ("h", -32768, -1)) if low <= n <= high)
        aux = b"BCZ" + x.qname.encode() + b"\0FI" + {"B": b"C", "H": b"S", "b": b"c", "h": b"s"}[form] + struct.pack("<" + form, n)
        ops = b"".join(struct.pack("<I", int(k) << 4 | "MIDNSHP=X".index(o)) for k, o in re.findall("([0-9]+)([MIDNSHP=X])", x.cigar))
        return [head, x.qname.encode() + b"\0" + head, head + qual.encode(), head + aux, head + struct.pack("<iq", x.rid, x.pos), head + struct.pack("<I", x.mapq) + ops, head + struct.pack("<iqq", x.mrid, x.mpos, x.tlen)]

    rows = r.where("(flag & 2304) = 0").collect()
    want = folded([(g, sums(x)) for x in rows for g in (x.rg or "-", "all")], kinds)
    report = reports.checksum(r, places=True, tags=reports.SUMMED_TAGS)
    assert {x.group: [x["count"], *(x[k] for k in kinds)] for x in report.collect()} == want
    assert {x.group: x.seq for x in reports.checksum(r.repartition(7, "seq")).collect()} == {k: v[1] for k, v in want.items()}
    order = folded([("all", [zlib.crc32(b) ^ zlib.crc32(struct.pack("<q", x.ord)) for b in sums(x)[:3]]) for x in rows], kinds[:3])
    assert [tuple(x) for x in reports.checksum(r, ordered=True).where("group = 'all'").collect()] == [("all", *order["all"])]


def test_read_sums_equal_crc32(spark):
    r = reads(spark, SMALL)
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    want = [0, 0, 0]
    for x in r.collect():
        nibbles = [code[c] for c in x.seq]
        packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
        for i, data in enumerate((x.qname.encode(), packed, bytes(ord(c) - 33 for c in x.qual) if x.qual else b"\xff" * 50)):
            want[i] = (want[i] + zlib.crc32(data)) % 2**32
    assert list(reports.read_sums(r).first()) == want and list(reports.read_sums(r.limit(0)).first()) == [0, 0, 0]


def test_depths_of_overlapping_mates_count_once(spark):
    r = reads(spark, SMALL)
    by_depth = {x.key: x.value for x in reports.stats(r, once=True).where("section = 'COV'").collect()}
    own = reports.depth(r, select.ReadFilter(exclude_any=0x104), once=True).groupBy("rid", "pos").agg(F.sum("depth").alias("d")).where("d > 0")
    assert by_depth == {str(x.d): x["count"] for x in own.groupBy("d").count().collect()}


def test_calls_within_regions(spark):
    calls = spark.createDataFrame([(0, 1, "A"), (0, 5, "C"), (1, 5, "G")], "rid long, pos long, call string")
    regions = spark.createDataFrame([(0, 0, 0, 5), (1, 0, 4, 9), (2, 1, 0, 4)], "line long, rid long, start long, end long")
    assert sorted(map(tuple, reports.within(calls, regions).collect())) == [(0, 0, 1, "A"), (0, 0, 5, "C"), (1, 0, 5, "C")]


def test_split_parts_is_a_cover_and_seeded(spark):
    rows = reads(spark, SMALL).select("ord", select.split_label("parts", 4, seed=9).alias("label")).collect()

    def label(i, seed=9):
        z = (seed + (i + 1) * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return str((z ^ z >> 31) % 4)

    assert all(r.label == label(r.ord) for r in rows) and len(rows) == 6000


def test_flags_and_cigars(spark):
    assert [C.parse_flags(x) for x in ("0x904", "010", "16", "read1,DUP", "")] == [0x904, 8, 16, 0x440, 0]
    with pytest.raises(ValueError):
        C.parse_flags("nonsense")
    df = spark.createDataFrame([("3H2S10M2I5D8M1S4H",), ("*",), ("50M",)], "cigar string")
    c = F.col("cigar")
    rows = df.select(C.ref_span(c), C.query_length(c), C.lead_clip(c), C.trail_clip(c)).collect()
    assert [tuple(r) for r in rows] == [(23, 23, 5, 5), (0, 0, 0, 0), (50, 50, 0, 0)]


def test_natural_names_sort_as_numbers(spark):
    names = ["q10", "q9", "q09x", "q1a2", "q1a10", "b", "q100"]
    df = spark.createDataFrame([(n,) for n in names], "qname string")
    assert [r.qname for r in df.orderBy(C.natural_key(F.col("qname")), "qname").collect()] == ["b", "q1a2", "q1a10", "q9", "q09x", "q10", "q100"]


def test_depth_adds_up(spark):
    r = reads(spark, SMALL)
    total = reports.depth(r).agg(F.sum("depth")).first()[0]
    assert total == reports.pileup(r).count()
    assert reports.depth(r.limit(0)).count() == 0
