"""Steps whose work must not grow faster than their input, on small inputs that show it in plans, limits or results."""

from pyspark.sql import functions as F

from strandlake.operators import reference, reports
from strandlake.plans import queries as Q
from strandlake.sources.derived import derive, genome, reads

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def placed(spark, rows):
    """rows of (pos, cigar, seq, qual), all forward, passing and on reference 0."""
    return spark.createDataFrame([(0, i, f"r{i}", 0, 0, pos, 60, cigar, -1, -1, 0, "*", None, seq, qual) for i, (pos, cigar, seq, qual) in enumerate(rows)], "src long, ord long, qname string, flag long, rid long, pos long, mapq long, cigar string, mrid long, mpos long, tlen long, mcigar string, rg string, seq string, qual string")


def test_derived_relation_shuffles_once(spark):
    assert derive(spark, SMALL)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pileup_of_any_depth_is_whole(spark):
    deep = placed(spark, [(126, "2M2I2M1D1M", "ACGTACG", "IIIIIII")]).crossJoin(spark.range(9000).select(F.col("id").alias("k"))).withColumn("ord", F.col("k"))
    rows = {r.pos: r for r in reports.mpileup(deep, max_depth=None).collect()}
    assert sorted(rows) == list(range(127, 133)) and {r.depth for r in rows.values()} == {9000}
    assert rows[127].bases == "^]A" * 9000 and rows[128].bases == "C+2GT" * 9000 and rows[130].bases == "C-1N" * 9000 and rows[131].bases == "*" * 9000 and rows[132].bases == "G$" * 9000
    assert {r.depth for r in reports.mpileup(deep).collect()} == {8000} and reports.mpileup(deep, max_depth=3).where("pos = 128").first().bases == "C+2GT" * 3


def test_pileup_keeps_places_of_poor_bases(spark):
    rows = reports.mpileup(placed(spark, [(0, "3M", "ACG", "I!I"), (500, "2M", "AC", "!!")])).collect()
    assert sorted((r.pos, r.depth, r.bases) for r in rows) == [(1, 1, "^]A"), (2, 0, "*"), (3, 1, "G$"), (501, 0, "*"), (502, 0, "*")]


def test_pileup_shuffles_no_bases(spark):
    for name in ("mpileup", "mpileup_reference"):
        assert "collect_list" not in plan(Q.QUERIES[name](spark, SMALL))


def test_large_genomes_are_met_by_key(spark, monkeypatch):
    r, g = reads(spark, SMALL).where("ord % 3 = 0"), reference.chunks(genome(spark))
    told = lambda: sorted(map(tuple, reference.calmd(r, g).select("src", "ord", "md", "nm").collect()), key=str)
    piled = lambda: sorted(map(tuple, reports.mpileup(r, genome=g).collect()))
    small = told(), piled()
    monkeypatch.setattr(reference, "WHOLE", 0)
    assert (told(), piled()) == small


def test_tags_are_told_batch_by_batch(spark):
    assert "ArrowEvalPython" in plan(Q.QUERIES["calmd"](spark, SMALL)) and "MapInArrow" in plan(Q.QUERIES["reference_from_md"](spark, SMALL))


def test_genes_meet_reads_by_bin(spark):
    assert "Generate" not in plan(Q.QUERIES["split_genes"](spark, SMALL)).split("Join", 1)[0] and plan(Q.QUERIES["split_genes"](spark, SMALL)).count("Join") == 1
    exons = spark.createDataFrame([(0, 0, 100, 200), (1, 0, 1000, 3000), (2, 0, 100, 100)], "line long, rid long, start long, end long").crossJoin(spark.range(50)).drop("id")
    from strandlake.operators import select

    labels = select.in_genes(placed(spark, [(p, "1M", "A", "I") for p in (99, 100, 199, 200, 999, 1000, 1024, 2048, 2999, 3000)]), exons).orderBy("ord")
    assert [r.label for r in labels.collect()] == [1, 0, 0, 1, 1, 0, 0, 0, 0, 1]


def test_deep_places_of_regions_are_summed_not_joined(spark):
    assert "r_start" not in plan(Q.QUERIES["bedcov_at_least"](spark, SMALL))


def test_rows_are_packed_as_by_search():
    import random

    from strandlake.operators.viewer import pack_rows

    rng = random.Random(1)
    starts = sorted(rng.randrange(200) for _ in range(800))
    ends = [a + rng.randrange(1, 60) for a in starts]
    free, want = [], []
    for a, b in zip(starts, ends, strict=True):
        row = next((i for i, until in enumerate(free) if until <= a), len(free))
        free[row : row + 1] = [b + 1]
        want.append(row)
    assert pack_rows(starts, ends) == want
    n = 200_000  # quadratic work would not end
    assert max(pack_rows([0] * n, [50] * n)) == n - 1


def test_phasing_shuffles_no_bases(spark):
    assert plan(Q.QUERIES["phase_sites"](spark, SMALL)).count("MapInArrow") == 2


def test_summaries_count_reads_once(spark):
    for name, scans in (("stats_summary", 1), ("insert_sizes", 1), ("stats_targets", 1)):
        assert plan(Q.QUERIES[name](spark, SMALL)).count("l_orderkey") and plan(Q.QUERIES[name](spark, SMALL)).count("RepartitionByExpression") == scans
    whole = {(r.section, r.key): r.value for r in reports.stats(reads(spark, SMALL)).collect()}
    for sections in (reports.SUMMED, ("COV",), ("IS",), ("RL", "MAPQ", "GCF", "LBC", "ID")):
        part = {(r.section, r.key): r.value for r in reports.stats(reads(spark, SMALL), sections=sections).collect()}
        assert part and part == {k: v for k, v in whole.items() if k[0] in sections}


def test_places_are_numbered_part_by_part(spark):
    rows = spark.range(1000, numPartitions=7).selectExpr("id % 3 as src", "id * 10 as ord")
    got = {(r.src, r.ord): r.place for r in Q._ranked(rows, "src").collect()}
    assert got == {(i % 3, i * 10): i // 3 + 1 for i in range(1000)}
    windows = [w for w in plan(Q.QUERIES["sort_template"](spark, SMALL)).splitlines() if "row_number() windowspecdefinition" in w and "_at" in w]
    assert windows and all("_part" in w.split("_at")[0] for w in windows)


def test_duplicates_need_few_passes(spark):
    assert plan(Q.QUERIES["markdup"](spark, SMALL)).count("RepartitionByExpression") == 2


def test_amplicons_are_looked_up(spark):
    told = plan(Q.QUERIES["ampliconstats"](spark, SMALL))
    assert told.count("RepartitionByExpression") == 3 and "r_start" not in told


def test_scores_are_summed_batch_by_batch(spark):
    import pyarrow as pa

    from strandlake.operators import kernels

    texts = ["I5?+#:9", None, "", "000/", "~é", "!"]
    want = [None if t is None else sum(ord(c) - 33 for c in t if ord(c) - 33 >= 15) for t in texts]
    assert kernels.quality_sums(15)(pa.array(texts)).to_pylist() == want and kernels.quality_sums(15)(pa.array(texts).slice(1, 3)).to_pylist() == want[1:4]
    for name in ("fixmate", "markdup"):
        assert "ArrowEvalPython" in plan(Q.QUERIES[name](spark, SMALL))


def test_depth_walks_reads_once(spark):
    assert plan(Q.QUERIES["depth_once"](spark, SMALL)).count("RepartitionByExpression") == 1


def test_regions_meet_reads_without_vain_pairs(spark, monkeypatch):
    import random

    from strandlake.operators import select

    told = plan(Q.QUERIES["view_regions"](spark, SMALL))
    assert "r_start" not in told and all("<" not in line for line in told.splitlines() if "Join" in line)
    rng = random.Random(6)
    spans = [(rng.choice((-1, 0, 1)), rng.randrange(6000), rng.choice((0, 1, 2, 50, 1023, 1024, 1025, 5000))) for _ in range(300)] + [(0, p, n) for p in (0, 1023, 1024, 2048) for n in (1, 1024, 4096)]
    made = [(rng.choice((0, 1, 2)), a := rng.randrange(-10, 9000), a + rng.choice((-1, 0, 1, 2, 40, 1024, 3000))) for _ in range(150)] + [(0, 1024, 2048), (1, 0, 9000)] * 20
    regions = [(i // 2, *x) for i, x in enumerate(made)]
    reads = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "ord long, rid long, pos long, n long").selectExpr("ord", "rid", "pos", "if(n = 0, '*', concat(n, 'M')) as cigar")
    table = spark.createDataFrame(regions, "line long, rid long, start long, end long")
    want = sorted((line, i) for i, (rid, p, n) in enumerate(spans) for line, r, a, b in regions if rid >= 0 and rid == r and a < b and p < b and a < p + max(n, 1))
    for held, listed, dealt in ((1 << 23, 1 << 20, 1024), (0, 3, 1)):
        for name, value in (("HELD_NUMBERS", held), ("LISTED", listed), ("DEALT", dealt)):
            monkeypatch.setattr(select, name, value)
        assert sorted((r.line, r.ord) for r in select.view_regions(reads, table).select("line", "ord").collect()) == want
    assert select.view_regions(reads, table.limit(0)).count() == 0
