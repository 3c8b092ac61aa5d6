"""Phasing, the text viewer and amplicons, on inputs made so that the answer is known."""

import random

from pyspark.sql import functions as F

from strandlake.operators import amplicons, genotypes, viewer

SCHEMA = "src long, ord long, qname string, flag long, rid long, pos long, mapq long, cigar string, mrid long, mpos long, tlen long, seq string, qual string"


def haplotype_reads(spark, sites, length=400, n=160, gap=None):
    rng = random.Random(4)
    base = [rng.choice("ACGT") for _ in range(length)]
    other = list(base)
    for p in sites:
        other[p] = "ACGT"["ACGT".index(base[p]) ^ 1]
    rows = []
    for i in range(n):
        a = rng.randrange(length - 60)
        if gap and a < gap < a + 60:
            continue
        which = i % 2
        rows.append((0, i, f"r{i}", 0, 0, a, 60, "60M", -1, -1, 0, "".join((base, other)[which][a : a + 60]), "I" * 60))
    return spark.createDataFrame(rows, SCHEMA), base, other


def test_phase_finds_the_haplotypes(spark):
    sites = [30, 70, 100, 150, 260, 300, 330]
    reads, base, other = haplotype_reads(spark, sites, gap=210)
    found, fragments = genotypes.phase(reads)
    rows = found.orderBy("pos").collect()
    assert [r.pos for r in rows] == sites
    blocks = {}
    for r in rows:
        # On the first haplotype of a block lies first, or second where flipped.
        letter = r.second if r.flip else r.first
        blocks.setdefault(r.block, set()).add(letter == base[r.pos])
        assert {r.first, r.second} == {base[r.pos], other[r.pos]}
    assert all(len(x) == 1 for x in blocks.values()) and len(blocks) == 2
    assert [r.block for r in rows] == [rows[0].block] * 4 + [rows[-1].block] * 3
    side = {(r.qname, r.block): r.haplotype for r in fragments.collect()}
    for block, same in blocks.items():
        got = {int(q[1:]) % 2 == (h if same == {True} else 1 - h) for (q, b), h in side.items() if b == block}
        assert got == {True}
    labels = genotypes.by_haplotype(reads, fragments)
    assert labels.count() == reads.count() and {r.label for r in labels.select("label").distinct().collect()} <= {"0", "1", "chimera"}
    again = genotypes.by_haplotype(reads.repartition(5), fragments)
    assert sorted((r.ord, r.label) for r in again.collect()) == sorted((r.ord, r.label) for r in labels.collect())


def test_no_sites_no_phase(spark):
    reads, *_ = haplotype_reads(spark, [])
    found, fragments = genotypes.phase(reads)
    assert found.count() == fragments.count() == 0 and genotypes.by_haplotype(reads, fragments).count() == reads.count()


def test_diploid_calls(spark):
    rows = [(0, i, f"q{i}", 0, 0, 0, 60, "4M" if i < 8 else "1M1D2M", -1, -1, 0, ("ACGT" if i % 2 else "ATGT") if i < 8 else "AGT", "IIII" if i < 8 else "III") for i in range(12)]
    calls = {r.pos: (r.depth, r.call) for r in genotypes.consensus_diploid(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert calls[1] == (12, "A") and calls[3] == (12, "G") and calls[4] == (12, "T") and calls[2][0] == 12
    assert genotypes.consensus_diploid(spark.createDataFrame(rows[:8], SCHEMA)).where("pos = 2").first().call == "Y"
    assert genotypes.consensus_diploid(spark.createDataFrame(rows[8:], SCHEMA)).where("pos = 2").first().call == "*"
    assert genotypes.consensus_diploid(spark.createDataFrame(rows[:1], SCHEMA), min_depth=2).where("call <> 'N'").count() == 0


def test_rows_of_the_viewer(spark):
    assert viewer.pack_rows([0, 2, 5, 6, 11], [5, 8, 6, 9, 12]) == [0, 1, 2, 0, 0]
    rows = [(0, 0, "a", 0, 0, 2, 60, "4M2D2M", -1, -1, 0, "ACGTAC", None), (0, 1, "b", 16, 0, 4, 60, "3M", -1, -1, 0, "GTA", "III"), (0, 2, "c", 0, 0, 9, 60, "2M3N1M", -1, -1, 0, "CCC", "III"), (0, 3, "d", 0, 1, 3, 60, "3M", -1, -1, 0, "GTA", "III")]
    genome = spark.createDataFrame([(0, "TTACGTTTACGTAC")], "rid long, seq string")
    lines = viewer.grid(spark.createDataFrame(rows, SCHEMA), 0, 0, 14, genome)
    got = [r.text for r in lines.orderBy("line").collect()]
    assert got[0] == "1         11  " and got[1] == "TTACGTTTACGTAC" and got[2][:8] == "  ACGT  " or got[2].startswith("  ACGT")
    assert got[3].startswith("  ....**..") and got[4] == "    ,,a  .C>>>" and len(got) == 5
    assert "<pre>" in viewer.to_html(lines).first().html
    assert [r.line for r in viewer.grid(spark.createDataFrame(rows, SCHEMA), 0, 500, 10).collect()] == [0, 1, 2]


def test_amplicons_are_runs_of_left_and_right_primers(spark):
    rows = [(0, 0, 50, 70, "+"), (1, 0, 48, 66, "+"), (2, 0, 150, 170, "-"), (3, 0, 200, 220, "+"), (4, 0, 300, 320, "-"), (5, 0, 310, 331, "-"), (6, 1, 5, 9, "+")]
    amps = amplicons.amplicons(spark.createDataFrame(rows, "line long, rid long, start long, end long, strand string"))
    got = [(r.rid, r.amp, r.lefts, r.rights, r.max_left, r.min_right) for r in amps.orderBy("rid", "amp").collect()]
    assert got == [(0, 1, [48, 50], [170], 70, 150), (0, 2, [200], [320, 331], 220, 300)]
    reads = spark.createDataFrame([(0, i, f"q{i}", f, 0, p, 60, "100M", 0, 0, t, "A" * 100, None) for i, (f, p, t) in enumerate([(99, 55, 118), (147, 73, -118), (0, 210, 0), (99, 120, 10), (4, 60, 0)])], SCHEMA)
    told = {r.ord: (r.amp, r.other, r.status) for r in amplicons.assigned(reads, amps).collect()}
    assert told == {0: (1, 1, 0), 1: (1, 1, 0), 2: (2, 2, 0), 3: (None, None, 2)}
    stats = {(r.section, r.amp, r.key): r.value for r in amplicons.ampliconstats(reads, amplicons_rows(spark, rows)).collect()}
    assert stats[("SS", 0, "sequences")] == 5 and stats[("SS", 0, "filtered")] == 1 and stats[("READS", 1, "n")] == 2 and stats[("LENGTH", 2, "n")] == 80
    share = {r.amp: (r.percent, r.covered) for r in amplicons.shares(amplicons.ampliconstats(reads, amplicons_rows(spark, rows))).collect()}
    assert share[1] == (66.667, 100.0) and share[2] == (33.333, 100.0)


def amplicons_rows(spark, rows):
    return spark.createDataFrame(rows, "line long, rid long, start long, end long, strand string").where(F.col("rid") == 0)
