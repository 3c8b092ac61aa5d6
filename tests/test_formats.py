"""Text formats, headers, sequences and the operators on them, by small inputs whose results are worked out by hand."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import sql
from strandlake.operators import mates, reference, reports, select
from strandlake.sources import bam, cram, sam, sequences
from strandlake.streaming import events as streams

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:one\tLN:40
@SQ\tSN:two\tLN:12
@RG\tID:g1\tLB:lib1\tSM:s1
@PG\tID:map\tPN:map
@CO\tfree text\twith a tab
a\t99\tone\t3\t60\t4M1D4M\t=\t8\t12\tACGTACGT\tIIIIIIII\tRG:Z:g1\tNM:i:1
b\t0\tone\t5\t20\t2S3M2N3M\t*\t0\t0\tGGACGTTT\t!!IIIIII\tXA:B:c,1,2
a\t147\tone\t8\t60\t7M\t=\t3\t-12\tACGTACG\tIII#III\tRG:Z:g1
c\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
"""


@pytest.fixture
def alignments(spark, tmp_path):
    (tmp_path / "in.sam").write_text(SAM)
    return sam.read_sam(spark, f"file://{tmp_path}/in.sam")


def written(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_sam_comes_back_as_it_was(spark, tmp_path, alignments):
    reads, header = alignments
    assert header.references() == [(0, "one", 40), (1, "two", 12)] and header.groups()["g1"]["SM"] == "s1"
    assert [(r.ord, r.rid, r.pos, r.mrid, r.qual) for r in reads.orderBy("ord").collect()] == [(0, 0, 2, 0, "IIIIIIII"), (1, 0, 4, -1, "!!IIIIII"), (2, 0, 7, 0, "III#III"), (3, -1, -1, -1, None)]
    sam.write_sam(reads, header, f"file://{tmp_path}/out")
    got, want = written(tmp_path / "out").splitlines(), SAM.splitlines()
    columns = lambda line: (line.split("\t")[:11], sorted(line.split("\t")[11:]))
    assert [columns(x) if x[0] != "@" else x for x in got] == [columns(x) if x[0] != "@" else x for x in want]
    again, _ = sam.read_sam(spark, f"file://{tmp_path}/out")
    assert again.count() == 4


def test_records_are_numbered_over_splits(spark, tmp_path):
    lines = [f"q{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII" for i in range(2000)]
    (tmp_path / "in.sam").write_text("@SQ\tSN:one\tLN:9\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        reads, _ = sam.read_sam(spark, f"file://{tmp_path}/in.sam")
        assert reads.rdd.getNumPartitions() > 3
        assert [r.qname for r in reads.orderBy("ord").collect()] == [f"q{i}" for i in range(2000)]
        assert {r.ord for r in reads.select("ord").collect()} == set(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("line", ["x\t0\tone\t1\t0\t4M", "x\tzero\tone\t1\t0\t4M\t*\t0\t0\tACGT\tIIII", "x\t0\tthree\t1\t0\t4M\t*\t0\t0\tACGT\tIIII"])
def test_broken_records_are_errors(spark, tmp_path, line):
    (tmp_path / "in.sam").write_text("@SQ\tSN:one\tLN:9\n" + line + "\n")
    with pytest.raises(Exception):
        sam.read_sam(spark, f"file://{tmp_path}/in.sam")[0].collect()


def test_headers(alignments):
    _, header = alignments
    assert sam.Header.parse(header.text()).text() == header.text() == SAM.splitlines()[:6]
    assert header.with_order("queryname", sub="queryname:natural").text()[0] == "@HD\tVN:1.6\tSO:queryname\tSS:queryname:natural"
    more = header.with_program("map", "2", "map x").with_program("sort", "1", "sort y")
    assert [dict(f) for _, f in more.of("PG")][1:] == [{"ID": "map.1", "PN": "map", "PP": "map", "VN": "2", "CL": "map x"}, {"ID": "sort", "PN": "sort", "PP": "map.1", "VN": "1", "CL": "sort y"}]
    assert [dict(f)["ID"] for _, f in more.without_programs_from("map.1").of("PG")] == ["map"]
    assert list(header.with_group({"ID": "g2"}, only=True).groups()) == ["g2"] and list(header.with_group({"ID": "g2"}).groups()) == ["g1", "g2"]
    for bad in (["@SQ\tSN:a\tLN:1", "@SQ\tSN:a\tLN:2"], ["@XY no tabs"], ["@SQ\tLN:3"]):
        with pytest.raises(ValueError):
            sam.Header.parse(bad)


def test_quickcheck_and_reheader(spark, tmp_path, alignments):
    (tmp_path / "in.sam").write_text(SAM)
    (tmp_path / "cut.sam").write_text(SAM + "d\t0\tone\t1\n")
    got = {r.path[-6:]: r.problem for r in reference.quickcheck(spark, [f"file://{tmp_path}/{x}.sam" for x in ("in", "cut", "no")]).collect()}
    assert got["in.sam"] is None and "eleven" in got["ut.sam"] and "cannot be read" in got["no.sam"]
    reads, header = alignments
    refs = sam.references_frame(spark, header)
    assert reference.reheader(reads, refs, refs.withColumn("name", F.upper("name"))).count() == 4
    with pytest.raises(ValueError):
        reference.reheader(reads, refs, refs.limit(1))


def test_fastq_fasta_bed_and_import(spark, tmp_path):
    (tmp_path / "r1.fq").write_text("@a/1 x y\nACGT\n+\nIIII\n@b/1\nNNAC\n+b/1\n!!II\n")
    (tmp_path / "r2.fq").write_text("@a/2\nTTTT\n+\nHHHH\n@b/2\nGGGG\n+\nFFFF\n")
    at = lambda x: f"file://{tmp_path}/{x}"
    one, two = sequences.read_fastq(spark, at("r1.fq")), sequences.read_fastq(spark, at("r2.fq"))
    assert [tuple(r) for r in one.orderBy("ord").collect()] == [(0, 0, "a/1", "x y", "ACGT", "IIII"), (0, 1, "b/1", None, "NNAC", "!!II")]
    got = [(r.qname, r.flag, r.seq) for r in sequences.import_reads(one, two).orderBy("ord").collect()]
    assert got == [("a", 77, "ACGT"), ("a", 141, "TTTT"), ("b", 77, "NNAC"), ("b", 141, "GGGG")]
    (tmp_path / "r3.fq").write_text("@a/2\nTTTT\n+\nHHHH\n")
    with pytest.raises(Exception):
        sequences.import_reads(one, sequences.read_fastq(spark, at("r3.fq"))).collect()
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception):
        sequences.read_fastq(spark, at("bad.fq")).collect()
    (tmp_path / "g.fa").write_text(">one first\nACG\nTAC\n>two\n>three\nGG\n")
    assert [tuple(r) for r in sequences.read_fasta(spark, at("g.fa")).orderBy("rid").collect()] == [(0, "one", "ACGTAC"), (1, "two", ""), (2, "three", "GG")]
    (tmp_path / "x.bed").write_text("#chrom\ntrack x\none\t1\t5\tn\t7\t-\none\t0\t90\tm\t0\t+\t0\t0\t0\t2\t10,5,\t0,80,\nnine\t1\t2\n")
    refs = spark.createDataFrame([(0, "one", 100)], "rid long, name string, length long")
    bed = sequences.read_bed(spark, at("x.bed"), refs).orderBy("line").collect()
    assert [(r.start, r.end, r.name, r.strand, [tuple(b) for b in r.blocks]) for r in bed] == [(1, 5, "n", "-", [(1, 5)]), (0, 90, "m", "+", [(0, 10), (80, 85)])]
    (tmp_path / "list").write_text("a.sam\n\nb.sam\n")
    assert sequences.read_list(spark, at("list")) == ["a.sam", "b.sam"]


GENOME = "NNACGTTACGTACGTACGTACGTACGTACGTACGTACGTA"


def test_mismatch_tags_there_and_back(spark, alignments):
    reads, _ = alignments
    for size in (reference.CHUNK, 8):
        reference.CHUNK, kept = size, (reference.CHUNK, reference.HALO)
        reference.HALO = min(kept[1], size // 2)
        try:
            chunked = reference.chunks(spark.createDataFrame([(0, GENOME), (1, "ACGTACGTACGT")], "rid long, seq string"))
            rows = reference.calmd(reads, chunked)
            got = {r.ord: (r.md, r.nm) for r in rows.collect()}
        finally:
            reference.CHUNK, reference.HALO = kept
        # a: ACGT over ACGT, T deleted, ACGT over ACGT; b: ACG over GTT, TTT over TAC two further; its mate: ACGTACG over ACGTACG.
        assert {i: got[i] for i in (0, 2, 3)} == {0: ("4^T4", 1), 2: ("7", 0), 3: (None, None)}
        assert got[1][1] == sum(a != b for a, b in zip("ACG", GENOME[4:7], strict=True)) + sum(a != b for a, b in zip("TTT", GENOME[9:12], strict=True))
    told = {r.pos: r.base for r in reference.bases_from_md(rows.where("ord in (0, 2)")).collect()}
    assert told == {i: GENOME[i] for i in range(2, 14)}
    lines = reference.fasta_lines(reference.bases_from_md(rows.where("ord in (0, 2)")), spark.createDataFrame([(0, "one", 40)], "rid long, name string, length long"), width=25)
    assert [r.text for r in lines.orderBy("line").collect()] == ["NN" + GENOME[2:14] + "N" * 11, "N" * 15]
    shown = reference.calmd(reads.where("ord = 2"), reference.chunks(spark.createDataFrame([(0, GENOME)], "rid long, seq string")), equals=True).first()
    assert shown.seq == "=" * 7
    with pytest.raises(Exception):
        reference.bases_from_md(rows.where("ord in (0, 2)").withColumn("seq", F.when(F.col("ord") == 0, "TTTTTTTT").otherwise(F.col("seq")))).collect()


def test_pads_are_taken_out(spark):
    padded = spark.createDataFrame([(0, "AC*GT**ACGT")], "rid long, seq string")
    reads = spark.createDataFrame([(0, 0, 0, 1, "5M", 0, 7), (0, 1, 0, 3, "2M2D2M", -1, -1), (0, 2, 0, 0, "1S2M1P3M1H", -1, -1), (0, 3, -1, -1, "*", -1, -1)], "src long, ord long, rid long, pos long, cigar string, mrid long, mpos long")
    got = {r.ord: (r.pos, r.cigar, r.mpos) for r in reference.depad(reads, padded).collect()}
    assert got == {0: (1, "1M1I2M1I", 4), 1: (2, "4M", -1), 2: (0, "1S2M1I2M1H", -1), 3: (-1, "*", -1)}


def test_primer_clips(spark):
    primers = spark.createDataFrame([(0, 0, 10, 20, "+"), (1, 0, 90, 100, "-")], "line long, rid long, start long, end long, strand string")
    rows = [(0, 0, "f", 0, 0, 12, "30M"), (0, 1, "d", 0, 0, 12, "6M2D4I20M"), (0, 2, "r", 16, 0, 70, "5H28M"), (0, 3, "n", 0, 0, 30, "30M"), (0, 4, "h", 0, 0, 8, "3S30M"), (0, 5, "all", 0, 0, 12, "5M")]
    reads = spark.createDataFrame(rows, "src long, ord long, qname string, flag long, rid long, pos long, cigar string").withColumns({"seq": F.lit("ACGTACGTACGTACGTACGTACGTACGTAC"), "qual": F.lit(None).cast("string")})
    soft = {r.qname: (r.pos, r.cigar) for r in mates.clip_reads(reads, primers).collect()}
    assert soft == {"f": (20, "8S22M"), "d": (20, "10S20M"), "r": (70, "5H20M8S"), "n": (30, "30M"), "h": (20, "15S18M"), "all": (17, "5S")}
    hard = {r.qname: (r.pos, r.cigar, r.seq) for r in mates.clip_reads(reads, primers, hard=True).collect()}
    assert hard["f"] == (20, "8H22M", "ACGTACGTACGTACGTACGTAC") and hard["r"][1] == "5H20M8H" and len(hard["h"][2]) == 15
    assert {r.qname for r in mates.clip_reads(reads, primers, filter_length=20).collect()} == {"f", "n"}
    assert {r.qname for r in mates.clip_reads(reads, primers, fail_length=20).where("flag & 512 <> 0").collect()} == {"d", "r", "h", "all"}


def test_scalar_functions(spark):
    assert C.parse_region("one") == ("one", 0, None) and C.parse_region("one:1,001-2,000") == ("one", 1000, 2000) and C.parse_region("a:b:5") == ("a:b", 4, None)
    with pytest.raises(ValueError):
        C.parse_region("one:9-3")
    assert [C.parse_size(x) for x in ("12", "2K", "768m", "1G")] == [12, 2048, 768 << 20, 1 << 30]
    values = [0.0, 1.0, 0.5, 123456.0, 1234567.0, 0.0001, 0.00001234567, -2.25, 99999.96, 1e20]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(C.general(F.col("v"))).collect()] == [f"{v:g}" for v in values]
    df = spark.createDataFrame([("a b/c",), ("ok-1._",), ("é",)], "s string")
    assert [r[0] for r in df.select(C.percent_encoded(F.col("s"))).collect()] == ["a%20b%2Fc", "ok-1._", "%C3%A9"]
    df = spark.createDataFrame([("10A0^AC5T3",)], "m string")
    assert [tuple(x) for x in df.select(C.md_runs(F.col("m"))).first()[0]] == [("=", "10"), ("X", "A"), ("=", "0"), ("D", "AC"), ("=", "5"), ("X", "T"), ("=", "3")]
    long = "".join(f"{1 + i % 3}M1I2D" for i in range(300))
    got = spark.createDataFrame([(long,)], "c string").select(C.walk(F.col("c"))).first()[0]
    ref = query = 0
    for o in got:
        assert (o.roff, o.qoff) == (ref, query)
        ref += o.n if o.op in "MD" else 0
        query += o.n if o.op in "MI" else 0
    assert len(got) == 900
    assert spark.createDataFrame([("2M3M0D1I",)], "c string").select(C.render_cigar(C.cigar_ops(F.col("c")))).first()[0] == "5M1I"


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT revcomp('ACGN') a, flag_names(99) b, unclipped_5p(16, 10, '3S5M2D2S1H') c, region_overlap(1, 9, 4, 20) d, natural_key('q10') > natural_key('q9') e").first()
    assert tuple(row) == ("NCGT", "PAIRED,PROPER_PAIR,MREVERSE,READ1", 20, 5, True)
    assert [tuple(r) for r in spark.sql("SELECT * FROM cigar_blocks('3M2D4M', 10) ORDER BY start").collect()] == [("M", 10, 3), ("D", 13, 2), ("M", 15, 4)]
    assert [r.kind for r in spark.sql("SELECT * FROM md_columns('3A^CC2') ORDER BY at").collect()] == ["=", "X", "D", "="]


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    for name, run, keys in (("windows", streams.windowed_counts, None), ("sessions", streams.sessions, None), ("firsts", lambda e: streams.first_of_each(e, ["user_id", "event_type"], "9999 hours").select("user_id", "event_type"), None)):
        mode = "append" if name == "firsts" else "complete"
        query = run(stream).writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert rows(spark.table(f"s_{name}")) == rows(run(events))


def test_reports(spark):
    rows = [(0, i, f"q{i}", f, 0, 0, 60, "4M", -1, -1, 0, "*", "ACGT", q, rg) for i, (f, q, rg) in enumerate([(0, "IIII", "a"), (512, "IIII", None), (16, None, "a"), (1024, "####", "b")])]
    reads = spark.createDataFrame(rows, "src long, ord long, qname string, flag long, rid long, pos long, mapq long, cigar string, mrid long, mpos long, tlen long, mcigar string, seq string, qual string, rg string")
    assert sorted((r.category, r.total) for r in reports.flagstat(reads.where("flag = 0")).collect()) == [("fail", 0), ("pass", 1)]
    text = [r.text for r in reports.flagstat_text(reports.flagstat(reads)).orderBy("line").collect()]
    assert text[0] == "3 + 1 in total (QC-passed reads + QC-failed reads)" and "3 + 1 mapped (100.00% : 100.00%)" in text and "0 + 0 properly paired (N/A : N/A)" in text
    both = reports.checksum(reads, passed=True, places=True)
    counts = {(r.group, r.qc): r["count"] for r in both.collect()}
    assert counts[("all", "all")] == 4 and counts[("all", "fail")] == 1 and counts[("-", "all")] == 1 and counts[("a", "pass")] == 2
    halves = reports.merge_checksums(reports.checksum(reads.where("ord < 2"), passed=True), reports.checksum(reads.where("ord >= 2"), passed=True))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, reports.checksum(reads, passed=True).select(halves.columns).collect()))
    assert all(0 < r.combined < reports.MODULUS for r in reports.combined_checksum(both).collect())
    fan, reports.FAN_IN = reports.FAN_IN, 2
    try:
        assert sorted(map(tuple, reports.checksum(reads).collect())) == sorted(map(tuple, (lambda x: x.collect())(_with_fan(reports, fan, reads))))
    finally:
        reports.FAN_IN = fan
    votes = spark.createDataFrame([(0, i, "q", 0, 0, 0, 60, "1M", s, "I") for i, s in enumerate("AAAGGR")], "src long, ord long, qname string, flag long, rid long, pos long, mapq long, cigar string, seq string, qual string")
    one = reports.consensus(votes, call_percent=60, ambiguous=True).first()
    assert (one.depth, one.call, one.qual) == (6, "R", 100)
    lines = reports.consensus_text(reports.consensus(votes, call_percent=50), spark.createDataFrame([(0, "one", 5)], "rid long, name string, length long"), width=3)
    assert [r.text for r in lines.orderBy("line").collect()] == ["ANN", "NN"]
    assert select.check_order(reads.withColumn("pos", 9 - F.col("ord"))).count() == 3


def _with_fan(module, fan, reads):
    now, module.FAN_IN = module.FAN_IN, fan
    try:
        return module.checksum(reads).cache()
    finally:
        module.FAN_IN = now


def test_bam_there_and_back(spark, tmp_path, alignments):
    reads, header = alignments
    parts = bam.bam_parts(reads.orderBy("ord").coalesce(1), header).orderBy("part").collect()
    data = b"".join(bytes(r.content) for r in parts)
    (tmp_path / "x.bam").write_bytes(data)
    again, head = bam.read_bam(spark, f"file://{tmp_path}/x.bam")
    assert head.text() == header.text()
    rows = lambda df: [(r.ord, r.qname, r.flag, r.rid, r.pos, r.mapq, r.cigar, r.mrid, r.mpos, r.tlen, r.seq, r.qual, r.rg, {k: tuple(v) for k, v in r.tags.items()}) for r in df.orderBy("ord").collect()]
    assert rows(again) == rows(reads)
    assert [bam.sniff(x) for x in (data, SAM.encode(), b"@r1\nAC\n", b">one\n", b"CRAM\3", b"one\t1\t5\n", b"\x1f\x8b\x08\0rest", b"")] == ["bam", "sam", "fastq", "fasta", "cram", "bed", "gzip", "unknown"]
    (tmp_path / "cut.bam").write_bytes(data[:-40])
    with pytest.raises(Exception):
        bam.read_bam(spark, f"file://{tmp_path}/cut.bam")[0].collect()
    long = dict(again.where("ord = 0").first().asDict(recursive=True), cigar="1M1I" * 40_000, seq="AC" * 40_000, qual=None)
    back = bam._record(bam.encode(long)[4:])
    assert back[5] == long["cigar"] and back[9] == long["seq"] and b"".join(bam.blocks(bam.packed(b"x" * 200_000))) == b"x" * 200_000


def test_mates_of_larger_templates(spark):
    """Three primary rows, supplementary rows of both ends, an unmapped mate, an orphan, two that do not face each other."""
    rows = [
        ("m", 67, 0, 100, 40, "10M"), ("m", 131, 0, 200, 41, "10M"), ("m", 145, 0, 300, 42, "10M"), ("m", 2113, 0, 510, 30, "5M5S"), ("m", 2177, 1, 7, 31, "10M"),
        ("u", 73, 0, 400, 60, "10M"), ("u", 133, -1, -1, 0, "*"), ("o", 99, 0, 500, 60, "10M"), ("s", 99, 0, 600, 60, "8M2S"), ("s", 147, 0, 700, 50, "2S8M"), ("s", 355, 0, 610, 1, "10M"),
    ]
    reads = spark.createDataFrame([(0, i, q, f, r, p, m, c, 9, 9, 0, "A" * 10, chr(33 + 20 + i) * 10) for i, (q, f, r, p, m, c) in enumerate(rows)], "src long, ord long, qname string, flag long, rid long, pos long, mapq long, cigar string, mrid long, mpos long, tlen long, seq string, qual string")
    got = {r.ord: (r.flag, r.rid, r.pos, r.mrid, r.mpos, r.tlen, r.mq, r.mc, r.ms) for r in mates.fixmate(reads).collect()}
    # The first of three keeps what the last gives it; the pair with the second, on one strand, has taken its proper bit.
    assert got[0] == (65 | 32, 0, 100, 0, 300, 210, 42, "10M", 220)
    assert got[1] == (129, 0, 200, 0, 100, -100, 40, "10M", 200) and got[2] == (145, 0, 300, 0, 100, -210, 40, "10M", 200)
    assert got[3][3:] == (0, 300, 0, 42, "10M", None) and got[3][0] == 2113 | 32 and got[4][3:] == (0, 100, 0, 40, "10M", None)
    assert got[5] == (73, 0, 400, 0, 400, 0, None, "*", 260) and got[6] == (133, 0, 400, 0, 400, 0, 60, "10M", 250)
    assert got[7] == (65, 0, 500, -1, -1, 0, None, None, None) and got[10][:5] == (355, 0, 610, 9, 9)
    assert got[8] == (99, 0, 600, 0, 700, 108, 50, "2S8M", 290) and got[9] == (147, 0, 700, 0, 600, -108, 60, "8M2S", 280)
    left = {r.ord: r.flag for r in mates.fixmate(reads, remove=True).collect()}
    assert set(left) == {0, 1, 2, 3, 4, 5, 7, 8, 9} and left[5] == 73


def test_sizes_of_blocks(spark, tmp_path):
    def number(n):
        n &= 0xFFFFFFFF
        return bytes([n]) if n < 0x80 else bytes([0x80 | n >> 8, n & 255]) if n < 0x4000 else bytes([0xF0 | n >> 28, n >> 20 & 255, n >> 12 & 255, n >> 4 & 255, n & 15])

    for n in (0, 127, 128, 16383, 2**31 - 1, -1):
        assert cram.itf8(number(n), 0) == (n, len(number(n)))
    assert cram.ltf8(b"\xff" + (2**60).to_bytes(8, "big"), 0) == (2**60, 9) and cram.ltf8(b"\x81\x02", 0) == (258, 2)

    def sealed(x):
        return x + struct.pack("<I", zlib.crc32(x))

    def block(method, kind, content, packed, unpacked):
        return sealed(bytes([method, kind]) + number(content) + number(len(packed)) + number(unpacked) + packed)

    def container(*inner):
        body = b"".join(inner)
        head = struct.pack("<i", len(body)) + number(-1) + number(1) + number(200) + number(3) + b"\0" + b"\0" + number(len(inner)) + number(1) + number(0)
        return sealed(head) + body

    data = b"CRAM\3\0" + b"n" * 20 + container(block(0, 0, 0, b"head", 4)) + container(block(1, 1, 0, b"x" * 300, 900), block(4, 4, 11, b"y" * 20, 100)) + container(block(4, 4, 11, b"z" * 5, 50))
    (tmp_path / "x.cram").write_bytes(data)
    got = sorted(map(tuple, cram.cram_size(spark, f"file://{tmp_path}/x.cram").collect()))
    assert got == [("compression header", 0, "gzip", 1, 300, 900), ("external data", 11, "rans4x8", 2, 25, 150), ("file header", 0, "raw", 1, 4, 4)]
    for bad in (data[:-3], data[:40] + b"?" + data[41:], b"CRAM\x09" + data[5:]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            list(cram.block_sizes(bad))


def test_samples_and_dictionaries(spark, alignments):
    reads, header = alignments
    groups = spark.createDataFrame([("g1", "s1")], "rg string, sample string")
    assert {r.sample for r in reports.samples(reads, groups).collect()} == {"s1", "."}
    refs = sam.references_frame(spark, header)
    known = refs.withColumn("label", F.lit("a.fa")).unionByName(refs.withColumn("label", F.lit("b.fa"))).unionByName(refs.limit(1).withColumn("label", F.lit("c.fa")))
    assert [r.label for r in reports.matching_dictionary(refs, known).collect()] == ["b.fa", "a.fa"]
    assert '"fail":{"total":0' in reports.flagstat_json(reports.flagstat(reads)).first().json
    assert select.view(reads, select.ReadFilter(exact_length=7)).count() == 1 and select.of_sample(reads, groups, "s1").count() == 2
