"""Registered queries over the derived alignments, each with DuckDB SQL that computes the same rows another way where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import sql
from strandlake.operators import amplicons, genotypes, mates, reference, reports, select, viewer
from strandlake.operators.select import ReadFilter
from strandlake.sources.derived import ORACLE, genome, reads, references, regions
from strandlake.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
COLUMNS = "src, ord, qname, flag, rid, pos, mapq, cigar, rg"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ORACLE + sql
        return f

    return add


def short(df: DataFrame) -> DataFrame:
    return df.selectExpr(*COLUMNS.split(", "))


OK = "(flag & 1796) = 0 AND rid >= 0"


@query(f"SELECT {COLUMNS} FROM (SELECT * REPLACE ((flag | 1024) & 65527 AS flag), flag f FROM r) r WHERE (f & 1) = 1 AND (f & 512) = 0 AND (f & 48) <> 0 AND (f & 192) <> 192 AND (CASE WHEN mapq = 255 AND (f & 4) > 0 THEN 0 ELSE mapq END) >= 20 AND cigar <> '*' AND (rg IS NULL OR rg IN ('rg0', 'rg2'))")
def view_filter(spark: SparkSession, d: str) -> DataFrame:
    rule = ReadFilter(require_all=1, exclude_any=512, include_any=48, exclude_all=192, min_mapq=20, min_query_length=50, missing_mapq=True)
    return short(select.view(reads(spark, d), rule, ["rg0", "rg2"], add_flags=1024, remove_flags=8))


@query("SELECT line, src, ord FROM r JOIN cg USING (cigar) JOIN reg g ON r.rid = g.rid AND r.pos < g.\"end\" AND g.start < r.pos + greatest(span, 1) AND g.start < g.\"end\" WHERE r.rid >= 0")
def view_regions(spark: SparkSession, d: str) -> DataFrame:
    return select.view_regions(reads(spark, d), regions(spark, d)).select("line", "src", "ord")


@query("SELECT src, ord, qname FROM r WHERE qname IN (SELECT qname FROM r WHERE (flag & 1024) > 0)")
def view_names(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    return select.by_names(r, r.where(C.has(F.col("flag"), C.DUP))).select("src", "ord", "qname")


@query("SELECT src, ord, qname FROM r WHERE qname NOT IN (SELECT qname FROM r WHERE (flag & 1024) > 0)")
def view_names_except(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    return select.by_names(r, r.where(C.has(F.col("flag"), C.DUP)), negate=True).select("src", "ord", "qname")


_NAMES = ", ".join(f"CASE WHEN (flag & {1 << i}) > 0 THEN '{n}' END" for i, n in enumerate(C.FLAG_NAMES))


@query(f"SELECT flag, '0x' || lower(printf('%x', flag)) || chr(9) || CAST(flag AS VARCHAR) || chr(9) || concat_ws(',', {_NAMES}) AS text, count(*) AS n FROM r GROUP BY flag")
def flags(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).groupBy("flag").agg(F.count("*").alias("n")).select("flag", C.describe_flags(F.col("flag")).alias("text"), "n")


_P = "(flag & 2304) = 0"
_PP = f"{_P} AND (flag & 1) > 0"
_BOTH = f"{_PP} AND (flag & 12) = 0"
_FS = {
    "total": "true", "secondary": "(flag & 256) > 0", "supplementary": "(flag & 256) = 0 AND (flag & 2048) > 0", "primary_reads": _P, "mapped": "(flag & 4) = 0", "primary_mapped": f"{_P} AND (flag & 4) = 0",
    "duplicates": "(flag & 1024) > 0", "primary_duplicates": f"{_P} AND (flag & 1024) > 0", "paired": _PP, "read1": f"{_PP} AND (flag & 64) > 0", "read2": f"{_PP} AND (flag & 128) > 0",
    "proper": f"{_PP} AND (flag & 2) > 0 AND (flag & 4) = 0", "both_mapped": _BOTH, "singletons": f"{_PP} AND (flag & 12) = 8", "far": f"{_BOTH} AND rid <> mrid", "far_mapq5": f"{_BOTH} AND rid <> mrid AND mapq >= 5 AND mapq < 255",
}


@query("SELECT category, " + ", ".join(f"count(flag) FILTER ({c}) AS {k}" for k, c in _FS.items()) + " FROM (VALUES ('pass', 0), ('fail', 512)) c(category, bit) LEFT JOIN r ON (flag & 512) = bit GROUP BY 1")
def flagstat(spark: SparkSession, d: str) -> DataFrame:
    return reports.flagstat(reads(spark, d))


@query("SELECT name, length, count(r.rid) FILTER ((flag & 4) = 0) AS mapped, count(r.rid) FILTER ((flag & 4) > 0) AS unmapped FROM ref LEFT JOIN r USING (rid) GROUP BY ALL UNION ALL SELECT '*', 0, 0, count(*) FROM r WHERE rid < 0")
def idxstats(spark: SparkSession, d: str) -> DataFrame:
    return reports.idxstats(reads(spark, d), references(spark))


@query(
    f"""SELECT name AS rname, CAST(1 AS BIGINT) AS startpos, length AS endpos, coalesce(n, 0) AS numreads, coalesce(cb, 0) AS covbases, round(coalesce(cb, 0) * 100.0::DOUBLE / length, 4) AS coverage,
    round(coalesce(b, 0)::DOUBLE / length, 4) AS meandepth, round(coalesce(q::DOUBLE / b, 0), 4) AS meanbaseq, round(coalesce(m::DOUBLE / n, 0), 4) AS meanmapq
    FROM ref LEFT JOIN (SELECT rid, count(*) AS n, sum(mapq) AS m FROM r WHERE {OK} GROUP BY 1) USING (rid)
    LEFT JOIN (SELECT rid, count(*) AS cb, CAST(sum(d) AS BIGINT) AS b, sum(q) AS q FROM (SELECT rid, p, count(*) AS d, sum(bq) AS q FROM bases WHERE {OK} AND bq >= 10 GROUP BY ALL) GROUP BY 1) USING (rid)"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage(reads(spark, d), references(spark), min_baseq=10)


_SPANS = f"SELECT src, rid, p + i.i AS pos FROM (SELECT src, rid, pos AS p, span FROM r JOIN cg USING (cigar) WHERE {OK}) JOIN range(60) i(i) ON i.i < span"


@query(
    f"""SELECT s.rid, s.pos, coalesce(CAST(sum(n) FILTER (src = 0) AS BIGINT), 0) AS depth_0, coalesce(CAST(sum(n) FILTER (src = 1) AS BIGINT), 0) AS depth_1 FROM (SELECT DISTINCT rid, pos FROM ({_SPANS})) s
    LEFT JOIN (SELECT src, rid, p AS pos, count(*) AS n FROM bases WHERE {OK} GROUP BY ALL) USING (rid, pos) GROUP BY ALL"""
)
def depth(spark: SparkSession, d: str) -> DataFrame:
    return reports.depth_table(reads(spark, d), [0, 1])


_OVER = "greatest(0, least(e, g.\"end\") - greatest(s, g.start))"


@query(
    f"""SELECT line, g.rid, g.start, g."end", CAST(coalesce(sum({_OVER}), 0) AS BIGINT) AS cov, count(*) FILTER ({_OVER} > 0) AS reads
    FROM reg g LEFT JOIN (SELECT rid, pos AS s, pos + span AS e FROM r JOIN cg USING (cigar) WHERE {OK}) a ON a.rid = g.rid GROUP BY ALL"""
)
def bedcov(spark: SparkSession, d: str) -> DataFrame:
    return reports.bedcov(reads(spark, d), regions(spark, d))


@query(
    f"""SELECT line, g.rid, g.start, g."end", CAST(coalesce((SELECT sum({_OVER}) FROM (SELECT rid, pos + roff AS s, pos + roff + len AS e FROM r JOIN blk USING (cigar) WHERE {OK}) a WHERE a.rid = g.rid), 0) AS BIGINT) AS cov,
    (SELECT count(*) FROM (SELECT rid, pos AS s, pos + span AS e FROM r JOIN cg USING (cigar) WHERE {OK}) a WHERE a.rid = g.rid AND {_OVER} > 0) AS reads FROM reg g"""
)
def bedcov_no_gaps(spark: SparkSession, d: str) -> DataFrame:
    return reports.bedcov(reads(spark, d), regions(spark, d), skip_gaps=True)


@query("SELECT DISTINCT src, coalesce(rg, '.') AS sample FROM r")
def samples(spark: SparkSession, d: str) -> DataFrame:
    return reports.samples(reads(spark, d))


def _ranked(rows: DataFrame, group: str) -> DataFrame:
    """The order of rows made visible: their ids increase from row to row and from part to part, so each row's place in its group is where it stands.

    Rows are numbered in each part and group apart and moved by what stands in the parts before, so no task holds a group. The sorted rows, three numbers
    each, are kept on disk: both steps must see the same parts, and a sort that is done again may cut them elsewhere.
    """
    from pyspark import StorageLevel
    from pyspark.sql.window import Window

    stands = rows.withColumn("_at", F.monotonically_increasing_id()).select("src", "ord", F.col(group).alias("_group"), "_at", F.shiftright("_at", 33).alias("_part")).persist(StorageLevel.DISK_ONLY)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stands.groupBy("_group", "_part").agg(F.count("*").alias("_n"))  # a row for each part and group
    base = sizes.select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = stands.withColumn("_k", F.row_number().over(Window.partitionBy("_part", "_group").orderBy("_at")))
    return here.join(F.broadcast(base), ["_group", "_part"]).select("src", "ord", (F.col("_k") + F.col("_base")).cast("long").alias("place"))


@query("SELECT src, ord, row_number() OVER (PARTITION BY rid ORDER BY pos, (flag & 16) > 0, src, ord) AS place FROM r")
def sort_coordinate(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(select.sort(reads(spark, d)), "rid")


_RANK = "((flag & 192) << 8) + ((flag & 256) << 3) + ((flag & 2048) >> 3)"


@query(f"SELECT src, ord, row_number() OVER (PARTITION BY rid ORDER BY CAST(split_part(substr(qname, 2), '_', 1) AS BIGINT), CAST(split_part(qname, '_', 2) AS BIGINT), {_RANK}, src, ord) AS place FROM r")
def sort_natural(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(select.sort(reads(spark, d), "natural"), "rid")


@query(f"SELECT src, ord, row_number() OVER (PARTITION BY rid ORDER BY qname, {_RANK}, src, ord) AS place FROM r")
def sort_bytewise(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(select.sort(reads(spark, d), "bytewise"), "rid")


@query("SELECT qname, count(*) AS n, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY " + _RANK + ", src, ord) AS ords FROM r GROUP BY qname")
def collate(spark: SparkSession, d: str) -> DataFrame:
    rows = select.collate(reads(spark, d)).groupBy("qname").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(C.flag_rank(F.col("flag")).alias("k"), "src", "ord"))).alias("x"))
    return rows.select("qname", "n", F.array_join(F.transform("x", lambda x: x["ord"].cast("string")), ",").alias("ords"))


@query(f"SELECT {COLUMNS} FROM r WHERE src = 0 UNION ALL SELECT {COLUMNS} FROM r WHERE src = 1")
def cat(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    return short(r.where("src = 0").unionByName(r.where("src = 1")))


@query("SELECT src, ord, CASE WHEN src = 1 AND rid >= 0 THEN 4 - rid ELSE rid END AS rid, CASE WHEN src = 1 AND mrid >= 0 THEN 4 - mrid ELSE mrid END AS mrid, rg || CASE WHEN src = 1 THEN '.1' ELSE '' END AS rg FROM r")
def merge(spark: SparkSession, d: str) -> DataFrame:
    """The second input numbers its references from the other end."""
    r, refs = reads(spark, d), references(spark)
    merged, _ = select.merge([(r.where("src = 0"), refs), (r.where("src = 1"), refs.withColumn("rid", 4 - F.col("rid")))])
    return merged.select("src", "ord", "rid", "mrid", "rg")


@query(f"SELECT {COLUMNS} FROM r ORDER BY src, ord LIMIT 100")
def head(spark: SparkSession, d: str) -> DataFrame:
    return short(select.head(reads(spark, d), 100))


_RC = "translate(reverse(seq), 'ACGTN', 'TGCAN')"
_ENDS = f"""SELECT *, CASE WHEN (flag & 192) = 64 THEN '/1' WHEN (flag & 192) = 128 THEN '/2' ELSE '' END AS sfx, CASE WHEN (flag & 16) > 0 THEN {_RC} ELSE seq END AS s2, CASE WHEN (flag & 16) > 0 THEN reverse(qual) ELSE qual END AS q2,
 row_number() OVER (PARTITION BY src, qname, flag & 192 ORDER BY qual IS NULL, ord) AS k FROM r WHERE (flag & 2304) = 0"""


@query(f"SELECT src, '>' || qname || sfx || chr(10) || s2 || chr(10) AS record FROM ({_ENDS}) WHERE k = 1")
def fasta(spark: SparkSession, d: str) -> DataFrame:
    return select.fasta(reads(spark, d))


@query(f"SELECT src, '@' || qname || sfx || chr(10) || s2 || chr(10) || '+' || chr(10) || coalesce(q2, repeat(chr(34), 50)) || chr(10) AS record FROM ({_ENDS}) WHERE k = 1")
def fastq(spark: SparkSession, d: str) -> DataFrame:
    return select.fastq(reads(spark, d))


@query(
    f"""SELECT src, ord, qname, (flag & (65535 - 1024 - 16 - 32 - 2)) | 4 | (CASE WHEN (flag & 1) > 0 THEN 8 ELSE 0 END) AS flag, CAST(-1 AS BIGINT) AS rid, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS mapq, '*' AS cigar,
    CASE WHEN (flag & 16) > 0 THEN {_RC} ELSE seq END AS seq, CASE WHEN (flag & 16) > 0 THEN reverse(qual) ELSE qual END AS qual, rg FROM r WHERE (flag & 2304) = 0"""
)
def reset(spark: SparkSession, d: str) -> DataFrame:
    return select.reset(reads(spark, d))


@query("SELECT src, ord, CASE WHEN rg = 'rg1' OR rg IS NULL THEN 'new' ELSE rg END AS rg FROM r")
def addreplacerg_orphans(spark: SparkSession, d: str) -> DataFrame:
    orphans = reads(spark, d).withColumn("rg", F.when(F.col("rg") != "rg1", F.col("rg")))
    return select.set_read_group(orphans, "new", "orphan_only").select("src", "ord", "rg")


@query("SELECT src, ord, 'all' AS rg FROM r")
def addreplacerg_all(spark: SparkSession, d: str) -> DataFrame:
    return select.set_read_group(reads(spark, d), "all").select("src", "ord", "rg")


_BED = "qname || CASE WHEN (flag & 64) > 0 THEN '/1' WHEN (flag & 128) > 0 THEN '/2' ELSE '' END AS name, mapq AS score, CASE WHEN (flag & 16) > 0 THEN '-' ELSE '+' END AS strand"


@query(f"SELECT ref.name AS chrom, pos AS start, pos + span AS \"end\", b.name, b.score, b.strand FROM (SELECT *, {_BED} FROM r JOIN cg USING (cigar) WHERE (flag & 4) = 0) b JOIN ref USING (rid)")
def to_bed(spark: SparkSession, d: str) -> DataFrame:
    return mates.bed6(reads(spark, d), references(spark))


@query(
    f"""SELECT ref.name AS chrom, pos + a AS start, pos + z AS "end", b.name, b.score, b.strand FROM (SELECT *, {_BED} FROM (SELECT *, CAST(0 AS BIGINT) AS a, CAST(CASE WHEN cigar = '20M10N30M' THEN 20 ELSE span END AS BIGINT) AS z FROM r JOIN cg USING (cigar) WHERE (flag & 4) = 0
    UNION ALL SELECT *, 30, 60 FROM r JOIN cg USING (cigar) WHERE cigar = '20M10N30M' AND (flag & 4) = 0)) b JOIN ref USING (rid)"""
)
def to_bed_split(spark: SparkSession, d: str) -> DataFrame:
    return mates.bed6(reads(spark, d), references(spark), split=True)


@query(
    """SELECT CASE WHEN sw THEN c2 ELSE c1 END AS chrom1, CASE WHEN sw THEN s2 ELSE s1 END AS start1, CASE WHEN sw THEN e2 ELSE e1 END AS end1, CASE WHEN sw THEN c1 ELSE c2 END AS chrom2, CASE WHEN sw THEN s1 ELSE s2 END AS start2,
    CASE WHEN sw THEN e1 ELSE e2 END AS end2, qname AS name, score, CASE WHEN sw THEN t2 ELSE t1 END AS strand1, CASE WHEN sw THEN t1 ELSE t2 END AS strand2
    FROM (SELECT *, c1 = '.' OR (c2 <> '.' AND (c1 > c2 OR (c1 = c2 AND s1 > s2))) AS sw FROM (
      SELECT a.qname, coalesce(ra.name, '.') AS c1, CASE WHEN a.off THEN -1 ELSE a.pos END AS s1, CASE WHEN a.off THEN -1 ELSE a.pos + ga.span END AS e1, CASE WHEN a.off THEN '.' WHEN (a.flag & 16) > 0 THEN '-' ELSE '+' END AS t1,
        coalesce(rb.name, '.') AS c2, CASE WHEN b.off THEN -1 ELSE b.pos END AS s2, CASE WHEN b.off THEN -1 ELSE b.pos + gb.span END AS e2, CASE WHEN b.off THEN '.' WHEN (b.flag & 16) > 0 THEN '-' ELSE '+' END AS t2, least(a.mapq, b.mapq) AS score
      FROM (SELECT *, (flag & 4) > 0 AS off FROM r) a JOIN (SELECT *, (flag & 4) > 0 AS off FROM r) b ON a.src = b.src AND a.qname = b.qname AND (a.flag & 64) > 0 AND (b.flag & 128) > 0 AND ((a.flag | b.flag) & 2304) = 0 JOIN cg ga ON ga.cigar = a.cigar JOIN cg gb ON gb.cigar = b.cigar
      LEFT JOIN ref ra ON ra.rid = a.rid AND NOT a.off LEFT JOIN ref rb ON rb.rid = b.rid AND NOT b.off)) WHERE c1 <> '.' OR c2 <> '.'"""
)
def to_bedpe(spark: SparkSession, d: str) -> DataFrame:
    return mates.bedpe(reads(spark, d), references(spark))


@query("SELECT coalesce(rg, 'unaccounted') AS label, count(*) AS n, min(ord) AS first, CAST(sum(ord) AS BIGINT) AS total FROM r GROUP BY 1")
def split_read_group(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).groupBy(select.split_label("read_group").alias("label")).agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.sum("ord").alias("total"))


@query("SELECT src, ord, CASE WHEN (flag & 4) > 0 THEN 'unmap' WHEN (flag & 192) = 128 THEN 'R2' ELSE 'R1' END AS label FROM r")
def split_mates(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("src", "ord", select.split_label("mates").alias("label"))


_M64 = "% 18446744073709551616::HUGEINT"


def _mixed(x: str) -> str:
    """The counter's output as DuckDB writes it, with products from 32-bit halves that fit 128 bits."""
    times = lambda v, m: f"(({v} % 4294967296) * {m}::HUGEINT + (((({v}) // 4294967296) * {m & 0xFFFFFFFF}::HUGEINT) % 4294967296) * 4294967296) {_M64}".replace(f"* {m}::HUGEINT", f"* {m & 0xFFFFFFFF}::HUGEINT + ((({v} % 4294967296) * {m >> 32}::HUGEINT) % 4294967296) * 4294967296")
    step = f"SELECT src, ord, CAST({x} AS HUGEINT) AS z FROM i"
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        step = f"SELECT src, ord, {times('z', m)} AS z FROM (SELECT src, ord, xor(z, z // {1 << shift}) AS z FROM ({step}))"
    return f"SELECT src, ord, xor(z, z // {1 << 31}) AS z FROM ({step})"


@query(f", i AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY ord) - 1 AS ord FROM r) SELECT src, ord, CAST(CAST(z % 4 AS BIGINT) AS VARCHAR) AS label FROM ({_mixed('(CAST(ord + 1 AS HUGEINT) * 11400714819323198485::HUGEINT) ' + _M64)})")
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    return select.input_index(reads(spark, d)).select("src", "ord", select.split_label("parts", 4).alias("label"))


@query(
    """SELECT src, ord, CASE WHEN (flag & 4) > 0 THEN 2 WHEN EXISTS (SELECT 1 FROM reg g WHERE g.rid = x.rid AND g.start <= x.a AND x.a < g."end") THEN 0 ELSE 1 END AS label
    FROM (SELECT *, CASE WHEN mrid = rid AND mpos >= 0 THEN least(pos, mpos) ELSE pos END AS a FROM r) x"""
)
def split_genes(spark: SparkSession, d: str) -> DataFrame:
    return select.in_genes(reads(spark, d), regions(spark, d)).select("src", "ord", "label")


@query(
    """SELECT rid, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY rid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM reg WHERE start < "end")) GROUP BY rid, k"""
)
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return select.coalesced(regions(spark, d)).select("rid", "start", "end")


_FOLD = "CAST(list_reduce(list_prepend(CAST(1 AS BIGINT), list({0})), lambda a, x: a * x % 2147483647) AS BIGINT)"


@query(
    "SELECT coalesce(rg, '-') AS \"group\", count(*) AS count, {f} AS seq, {f} AS name, {f} AS qual FROM v GROUP BY rg UNION ALL SELECT 'all', count(*), {f}, {f}, {f} FROM v".format(f=_FOLD.format("x")).replace(
        "FROM v", "FROM (SELECT rg, CASE WHEN v IN (0, 2147483647) THEN 1 ELSE v END AS x FROM (SELECT rg, (ord * 48271 + pos * 69621 + flag) & 2147483647 AS v FROM r WHERE (flag & 2304) = 0))"
    )
)
def checksum_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold over a surrogate value, since DuckDB has no CRC-32."""
    return reports.checksum(reads(spark, d), F.expr("ord * 48271 + pos * 69621 + flag"))


@query()
def checksum(spark: SparkSession, d: str) -> DataFrame:
    return reports.checksum(reads(spark, d))


_O = "(flag & 2304) = 0"
_F1, _L1 = "((flag & 1) = 0 OR (flag & 192) = 64)", "((flag & 1) = 1 AND (flag & 192) = 128)"
_BOTH_ON = "(flag & 13) = 1"
_SN = {
    "sequences": _O, "1st fragments": f"{_O} AND {_F1}", "last fragments": f"{_O} AND {_L1}", "reads mapped": f"{_O} AND (flag & 4) = 0", "reads mapped and paired": f"{_O} AND {_BOTH_ON}", "reads unmapped": f"{_O} AND (flag & 4) > 0",
    "reads properly paired": f"{_O} AND {_BOTH_ON} AND (flag & 2) > 0", "reads paired": f"{_O} AND (flag & 1) > 0", "reads duplicated": "(flag & 1280) = 1024", "reads MQ0": f"{_O} AND (flag & 4) = 0 AND mapq = 0",
    "reads QC failed": f"{_O} AND (flag & 512) > 0", "non-primary alignments": "(flag & 256) > 0", "supplementary alignments": "(flag & 2304) = 2048", "pairs on different chromosomes": f"{_O} AND {_BOTH_ON} AND rid <> mrid",
}
_SL = {
    "total length": (_O, "50"), "total first fragment length": (f"{_O} AND {_F1}", "50"), "total last fragment length": (f"{_O} AND {_L1}", "50"), "bases mapped": (f"{_O} AND (flag & 4) = 0", "50"),
    "bases mapped (cigar)": ("(flag & 260) = 0", "CASE WHEN cigar = '20M5I25M' OR cigar = '10M2I10M3D28M' THEN 50 ELSE aligned END"), "bases duplicated": ("(flag & 1280) = 1024", "50"),
}
_LEN = "CASE WHEN cigar = '3H50M' THEN '53' ELSE '50' END"
_GC = "CAST(length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS VARCHAR) || ':50'"
_ST = "CASE WHEN (flag & 64) > 0 THEN 1 ELSE -1 END"
_DIR = "CASE WHEN (flag & 16) > 0 THEN -1 ELSE 1 END"
_KIND = f"CASE WHEN ((flag & 16) > 0) = ((flag & 32) > 0) THEN 'other' WHEN {_ST} * (mpos - pos) > 0 THEN CASE WHEN {_ST} * {_DIR} > 0 THEN 'in' ELSE 'out' END WHEN {_ST} * (mpos - pos) < 0 THEN CASE WHEN {_ST} * {_DIR} > 0 THEN 'out' ELSE 'in' END ELSE 'in' END"
_TURNED = f"""SELECT CASE WHEN {_L1} THEN 'L' ELSE 'F' END AS e, i + 1 AS c, coalesce(ascii(substr(CASE WHEN (flag & 16) > 0 THEN reverse(qual) ELSE qual END, CAST(i + 1 AS INT), 1)) - 33, 255) AS q,
  substr(CASE WHEN (flag & 16) > 0 THEN translate(reverse(seq), 'ACGTN', 'TGCAN') ELSE seq END, CAST(i + 1 AS INT), 1) AS b FROM r, range(50) t(i) WHERE {_O} AND ({_F1} OR {_L1})"""
_PLACED = "(flag & 260) = 0 AND rid >= 0"
_INDELS = f"""SELECT CASE WHEN (flag & 16) > 0 THEN 50 - q - CASE WHEN op = 'I' THEN n ELSE 0 END ELSE q END + CASE WHEN op = 'I' THEN 1 ELSE 0 END AS c, op, n FROM r
  JOIN (VALUES ('20M5D30M', 'D', 5, 20), ('20M5I25M', 'I', 5, 20), ('10M2I10M3D28M', 'I', 2, 10), ('10M2I10M3D28M', 'D', 3, 22)) g(cigar, op, n, q) USING (cigar) WHERE {_PLACED}"""


@query(
    " UNION ALL ".join(
        [f"SELECT 'SN' AS section, '{k}' AS key, count(*) FILTER ({c}) AS value FROM r" for k, c in _SN.items()]
        + [f"SELECT 'SN', '{k}', CAST(coalesce(sum({n}) FILTER ({c}), 0) AS BIGINT) FROM r JOIN cg USING (cigar)" for k, (c, n) in _SL.items()]
        + [
            "SELECT 'SN', 'maximum length', CAST(50 AS BIGINT)",
            f"SELECT 'RL', {_LEN}, count(*) FROM r WHERE {_O} GROUP BY 2",
            f"SELECT 'FRL', {_LEN}, count(*) FROM r WHERE {_O} AND {_F1} GROUP BY 2",
            f"SELECT 'LRL', {_LEN}, count(*) FROM r WHERE {_O} AND {_L1} GROUP BY 2",
            "SELECT 'MAPQ', CAST(mapq AS VARCHAR), count(*) FROM r WHERE (flag & 3844) = 0 GROUP BY 2",
            f"SELECT 'GCF', {_GC}, count(*) FROM r WHERE {_O} AND {_F1} GROUP BY 2",
            f"SELECT 'GCL', {_GC}, count(*) FROM r WHERE {_O} AND {_L1} GROUP BY 2",
            f"SELECT 'IS', CAST(least(abs(tlen), 8000) AS VARCHAR) || ':' || {_KIND}, count(*) // 2 FROM r WHERE {_O} AND {_BOTH_ON} AND NOT (tlen = 0 AND rid <> mrid) GROUP BY 2",
            f"SELECT e || 'FQ', CAST(c AS VARCHAR) || ':' || CAST(q AS VARCHAR), count(*) FROM ({_TURNED}) GROUP BY 1, 2",
            f"SELECT e || 'BC', CAST(c AS VARCHAR) || ':' || b, count(*) FROM ({_TURNED}) GROUP BY 1, 2",
            f"SELECT 'ID', op || ':' || CAST(n AS VARCHAR), count(*) FROM ({_INDELS}) GROUP BY 2",
            f"SELECT 'IC', CAST(c AS VARCHAR) || ':' || op, count(*) FROM ({_INDELS}) GROUP BY 2",
            f"SELECT 'COV', CAST(d AS VARCHAR), count(*) FROM (SELECT rid, p, count(*) AS d FROM bases WHERE {_PLACED} GROUP BY ALL) GROUP BY 2",
        ]
    )
)
def stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.stats(reads(spark, d))


_PROPER = f"{OK} AND ((flag & 1) = 0 OR (flag & 2) > 0)"
_CASE = "CASE WHEN (flag & 16) > 0 THEN lower({0}) ELSE {0} END"


def _mpileup_sql(base: str, gone: str, ref: str, join: str = "") -> str:
    """The pileup's rows: base, how an aligned base is shown; gone, the letters of a deletion of {n} bases behind {p}; ref, the column ref."""
    d3, d5 = gone.format(n=3, p="b.p"), gone.format(n=5, p="b.p")
    return f"""SELECT rid, pos + 1 AS pos, {ref} AS ref, count(*) FILTER (bq >= 13) AS depth, coalesce(string_agg(t, '' ORDER BY src, ord) FILTER (bq >= 13), '*') AS bases, coalesce(string_agg(chr(CAST(least(bq, 93) + 33 AS INT)), '' ORDER BY src, ord) FILTER (bq >= 13), '*') AS quals FROM (
    SELECT b.rid, b.p AS pos, src, ord, bq, CASE WHEN b.p = b.pos THEN '^' || chr(CAST(least(mapq, 93) + 33 AS INT)) ELSE '' END || {base}
      || CASE WHEN cigar = '20M5I25M' AND q = 19 THEN '+5' || {_CASE.format('substr(seq, 21, 5)')} WHEN cigar = '10M2I10M3D28M' AND q = 9 THEN '+2' || {_CASE.format('substr(seq, 11, 2)')}
         WHEN cigar = '10M2I10M3D28M' AND q = 21 THEN '-3' || {_CASE.format(d3)} WHEN cigar = '20M5D30M' AND q = 19 THEN '-5' || {_CASE.format(d5)} ELSE '' END
      || CASE WHEN b.p = b.pos + span - 1 THEN '$' ELSE '' END AS t FROM bases b JOIN cg USING (cigar) {join} WHERE {_PROPER}
    UNION ALL SELECT rid, pos + roff + i, src, ord, coalesce(ascii(substr(qual, CAST(qoff + 1 AS INT), 1)) - 33, 255), CASE WHEN kind = 'D' THEN '*' WHEN (flag & 16) > 0 THEN '<' ELSE '>' END FROM r JOIN dels USING (cigar) JOIN range(10) t(i) ON i < len WHERE {_PROPER}
    ) x"""


@query(_mpileup_sql(_CASE.format("base"), "repeat('N', {n})", "'N'") + " GROUP BY rid, pos")
def mpileup(spark: SparkSession, d: str) -> DataFrame:
    return reports.mpileup(reads(spark, d), max_depth=None)


_DOT = "CASE WHEN base = gb.g THEN CASE WHEN (flag & 16) > 0 THEN ',' ELSE '.' END ELSE " + _CASE.format("base") + " END"
_GONE = "(SELECT string_agg(g, '' ORDER BY p) FROM gen y WHERE y.rid = b.rid AND y.p > {p} AND y.p <= {p} + {n})"


@query(
    f"""SELECT gen.rid, gen.p + 1 AS pos, gen.g AS ref, coalesce(depth, 0) AS depth, coalesce(bases, '*') AS bases, coalesce(quals, '*') AS quals FROM gen LEFT JOIN ({_mpileup_sql(_DOT, _GONE, "'x'", "JOIN (SELECT rid AS grid, p AS gp, g FROM gen) gb ON gb.grid = b.rid AND gb.gp = b.p")}
    GROUP BY rid, pos) m ON m.rid = gen.rid AND m.pos = gen.p + 1"""
)
def mpileup_reference(spark: SparkSession, d: str) -> DataFrame:
    return reports.mpileup(reads(spark, d), genome=reference.chunks(genome(spark)), everywhere=True, references=references(spark), max_depth=None)


_V = {0: "A", 1: "C", 2: "G", 3: "T"}
_VOTES = ", ".join(f"CAST(sum(CASE WHEN base = '{b}' THEN 8 WHEN base = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS v{i}" for i, b in _V.items())
_TOP = "greatest(v0, v1, v2, v3, v4)"


@query(
    f"""SELECT rid, p + 1 AS pos, depth, CASE WHEN sure OR best = 4 THEN substr('ACGT*', best + 1, 1) ELSE 'N' END AS call, CASE WHEN sure OR best = 4 THEN least(100, top * 100 // total) ELSE 0 END AS qual FROM (
    SELECT *, {_TOP} AS top, v0 + v1 + v2 + v3 + v4 AS total, {_TOP} * 100 >= 60 * (v0 + v1 + v2 + v3 + v4) AS sure, CASE {_TOP} WHEN v0 THEN 0 WHEN v1 THEN 1 WHEN v2 THEN 2 WHEN v3 THEN 3 ELSE 4 END AS best FROM (
    SELECT rid, p, count(*) AS depth, {_VOTES}, CAST(sum(CASE WHEN base = '*' THEN 8 ELSE 0 END) AS BIGINT) AS v4 FROM (
      SELECT rid, p, base FROM bases WHERE {OK} UNION ALL SELECT rid, pos + roff + i, '*' FROM r JOIN dels USING (cigar) JOIN range(10) t(i) ON i < len WHERE kind = 'D' AND {OK}) GROUP BY ALL))"""
)
def consensus_simple(spark: SparkSession, d: str) -> DataFrame:
    return reports.consensus(reads(spark, d), call_percent=60)


_BIN = " ".join(f"WHEN pos // {1 << s} = e // {1 << s} THEN {b} + pos // {1 << s}" for b, s in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)))


@query(f"SELECT rid, CAST(CASE {_BIN} ELSE 0 END AS BIGINT) AS bin, count(*) AS n, min(pos) AS first, max(pos) AS last FROM (SELECT *, pos + greatest(span, 1) - 1 AS e FROM r JOIN cg USING (cigar)) WHERE rid >= 0 GROUP BY 1, 2")
def index_bins(spark: SparkSession, d: str) -> DataFrame:
    return reports.index_bins(reads(spark, d))


_QS = "coalesce(list_sum(list_transform(string_split(qual, ''), lambda c: CASE WHEN ascii(c) >= 48 THEN ascii(c) - 33 ELSE 0 END)), 255 * length(seq))"


@query(
    f"""SELECT src, ord, qname, CASE WHEN k THEN (((flag | 1) & (65535 - 32)) | (CASE WHEN (mf & 16) > 0 THEN 32 ELSE 0 END) | (CASE WHEN mo THEN 8 ELSE 0 END)) & (CASE WHEN same AND (flag & 16) <> (mf & 16) AND lo < hi THEN 65535 ELSE 65533 END)
      WHEN alone THEN flag & (65535 - 34) ELSE flag END AS flag,
    CASE WHEN k AND o AND NOT mo THEN mr ELSE rid END AS rid, CASE WHEN k AND o AND NOT mo THEN mp ELSE pos END AS pos, CASE WHEN k THEN CASE WHEN mo AND NOT o THEN rid ELSE mr END WHEN alone THEN -1 ELSE mrid END AS mrid,
    CASE WHEN k THEN CASE WHEN mo AND NOT o THEN pos ELSE mp END WHEN alone THEN -1 ELSE mpos END AS mpos, CAST(CASE WHEN same THEN m5 - s5 ELSE 0 END AS BIGINT) AS tlen, CASE WHEN k AND NOT mo THEN mq END AS mq,
    CASE WHEN k AND (NOT o OR NOT mo) THEN mc END AS mc, CAST(CASE WHEN k THEN mq15 END AS BIGINT) AS ms
    FROM (SELECT *, CASE WHEN (flag & 16) > 0 THEN m5 ELSE pos END AS lo, CASE WHEN (flag & 16) > 0 THEN pos + span ELSE m5 END AS hi, CASE WHEN (flag & 16) > 0 THEN pos + span ELSE pos END AS s5, k AND NOT o AND NOT mo AND rid = mr AS same FROM (
      SELECT x.*, y.ord IS NOT NULL AS k, x.pr AND x.np = 1 AS alone, (x.flag & 4) > 0 AS o, (y.flag & 4) > 0 AS mo, y.flag AS mf, y.rid AS mr, y.pos AS mp, y.mapq AS mq, y.cigar AS mc, y.q15 AS mq15, CASE WHEN (y.flag & 16) > 0 THEN y.pos + y.span ELSE y.pos END AS m5
      FROM (SELECT *, (flag & 2304) = 0 AS pr, count(*) FILTER ((flag & 2304) = 0) OVER (PARTITION BY src, qname) AS np, {_QS} AS q15 FROM r JOIN cg USING (cigar)) x
      LEFT JOIN (SELECT *, {_QS} AS q15, count(*) OVER (PARTITION BY src, qname) AS np FROM r JOIN cg USING (cigar) WHERE (flag & 2304) = 0) y ON y.src = x.src AND y.qname = x.qname AND y.ord <> x.ord AND x.pr AND x.np = 2 AND y.np = 2))"""
)
def fixmate(spark: SparkSession, d: str) -> DataFrame:
    return mates.fixmate(reads(spark, d))


_FIVE = "CASE WHEN {f} THEN {p} + greatest({g}.span, 1) + {g}.trail ELSE {p} - {g}.lead + 1 END"


@query(
    f"""SELECT src, ord, flag | (CASE WHEN m AND pk > 1 THEN 1024 WHEN x AND NOT m AND (pairs > 0 OR sk > 1) THEN 1024 ELSE 0 END) AS flag FROM (
    SELECT *, row_number() OVER (PARTITION BY m, rid, f5, rev, mrid, m5, mrev ORDER BY tot DESC, qname, src, ord) AS pk, row_number() OVER (PARTITION BY x, rid, f5, rev ORDER BY m, q15 DESC, src, ord) AS sk,
      count(*) FILTER (m) OVER (PARTITION BY x, rid, f5, rev) AS pairs FROM (SELECT *, sum(q15) OVER (PARTITION BY src, qname, m) AS tot FROM (
        SELECT r.*, (flag & 16) > 0 AS rev, (flag & 32) > 0 AS mrev, (flag & 2820) = 0 AS x, (flag & 2820) = 0 AND (flag & 9) = 1 AND mpos >= 0 AND mcigar <> '*' AS m, {_QS} AS q15,
          {_FIVE.format(f='(flag & 16) > 0', p='pos', g='a')} AS f5, {_FIVE.format(f='(flag & 32) > 0', p='mpos', g='b')} AS m5 FROM r JOIN cg a ON a.cigar = r.cigar JOIN cg b ON b.cigar = r.mcigar)))"""
)
def markdup(spark: SparkSession, d: str) -> DataFrame:
    return mates.markdup(reads(spark, d)).select("src", "ord", "flag")


def _primers(spark: SparkSession) -> DataFrame:
    """A panel of 50 pairs: each 480 bases apart, forward primers of 20 and reverse ones of 22 bases."""
    one = spark.range(100).select(F.col("id").alias("line"), (F.floor(F.col("id") / 2) % 5).alias("rid"), (F.floor(F.col("id") / 10) * 500).alias("a"), (F.col("id") % 2).alias("back"))
    return one.select("line", "rid", (F.col("a") + F.col("back") * 480).alias("start"), (F.col("a") + F.when(F.col("back") == 1, 502).otherwise(20)).alias("end"), F.when(F.col("back") == 1, "-").otherwise("+").alias("strand"))


@query(
    """SELECT src, ord, clip, primer, CASE WHEN rev THEN pos ELSE pos + clip END AS pos FROM (SELECT *, row_number() OVER (PARTITION BY src, ord ORDER BY clip DESC, primer) AS k FROM (
    SELECT src, ord, r.pos, (flag & 16) > 0 AS rev, line AS primer, CASE WHEN (flag & 16) > 0 THEN pos + span - a ELSE b - pos END AS clip FROM r JOIN cg USING (cigar) JOIN (
      SELECT i AS line, i // 2 % 5 AS rid, i // 10 * 500 + i % 2 * 480 AS a, i // 10 * 500 + CASE WHEN i % 2 = 1 THEN 502 ELSE 20 END AS b, i % 2 = 1 AS back FROM range(100) t(i)) p
    ON p.rid = r.rid AND (flag & 4) = 0 AND CASE WHEN (flag & 16) > 0 THEN back AND pos + span <= b + 5 AND pos + span > a ELSE NOT back AND pos >= a - 5 AND pos < b END)) WHERE k = 1"""
)
def ampliconclip(spark: SparkSession, d: str) -> DataFrame:
    return mates.clip_primers(reads(spark, d), _primers(spark))


@query(
    f"""SELECT rid, pos, depth, 0 AS x FROM (SELECT src, rid, p AS pos, count(*) AS depth FROM bases WHERE false GROUP BY ALL) WHERE false UNION ALL
    SELECT s.rid, s.pos, coalesce(n, 0), 0 FROM (SELECT DISTINCT rid, pos FROM ({_SPANS}) WHERE src = 0) s LEFT JOIN (SELECT rid, p AS pos, count(*) AS n FROM (
      SELECT rid, p FROM bases WHERE {OK} AND src = 0 AND bq >= 20 UNION ALL SELECT rid, pos + roff + i FROM r JOIN dels USING (cigar) JOIN range(10) t(i) ON i < len WHERE kind = 'D' AND {OK} AND src = 0
        AND coalesce(ascii(substr(qual, CAST(qoff + 1 AS INT), 1)) - 33, 255) >= 20) GROUP BY ALL) USING (rid, pos)
    WHERE EXISTS (SELECT 1 FROM reg g WHERE g.rid = s.rid AND g.start <= s.pos AND s.pos < g."end")"""
)
def depth_options(spark: SparkSession, d: str) -> DataFrame:
    """Least base quality, deletions counted, positions of regions only."""
    return reports.depth(reads(spark, d).where("src = 0"), min_baseq=20, deletions=True, regions=regions(spark, d)).select("rid", "pos", "depth", F.lit(0).alias("x"))


@query(
    f"""SELECT gen.rid, gen.p AS pos, coalesce(n, 0) AS depth FROM gen LEFT JOIN (SELECT rid, p, count(*) AS n FROM (
      SELECT b.rid, b.p FROM bases b LEFT JOIN (SELECT DISTINCT ON (x.src, x.ord) x.src, x.ord, y.pos + g.span AS z FROM r x JOIN r y ON x.src = y.src AND x.qname = y.qname AND y.ord < x.ord AND ((x.flag | y.flag) & 1800) = 0 AND (x.flag & y.flag & 1) = 1 AND ((x.flag | y.flag) & 4) = 0
          AND x.rid = y.rid AND y.mrid = y.rid JOIN cg g ON g.cigar = y.cigar WHERE y.mpos <= y.pos + g.span ORDER BY x.src, x.ord, y.ord) m ON m.src = b.src AND m.ord = b.ord
      WHERE {OK} AND (m.z IS NULL OR b.p >= m.z)) GROUP BY ALL) c ON c.rid = gen.rid AND c.p = gen.p"""
)
def depth_once(spark: SparkSession, d: str) -> DataFrame:
    """Bases under both mates counted once, at all positions of all references."""
    rows = reports.depth(reads(spark, d), once=True, references=references(spark), everywhere="all")
    return rows.groupBy("rid", "pos").agg(F.sum("depth").alias("depth"))


@query(
    f"""SELECT line, g.rid, g.start, g."end", CAST(coalesce((SELECT sum({_OVER}) FROM (SELECT rid, pos + roff AS s, pos + roff + len AS e FROM r JOIN blk USING (cigar) WHERE {OK}) a WHERE a.rid = g.rid), 0) AS BIGINT) AS cov,
    (SELECT count(*) FROM (SELECT rid, pos AS s, pos + span AS e FROM r JOIN cg USING (cigar) WHERE {OK}) a WHERE a.rid = g.rid AND {_OVER} > 0) AS reads,
    (SELECT count(*) FROM (SELECT rid, p, count(*) AS n FROM bases WHERE {OK} GROUP BY ALL) b WHERE b.rid = g.rid AND b.n >= 3 AND b.p >= g.start AND b.p < g."end") AS bases FROM reg g"""
)
def bedcov_at_least(spark: SparkSession, d: str) -> DataFrame:
    return reports.bedcov(reads(spark, d), regions(spark, d), at_least=3)


_EVENTS = f"""SELECT b.src, b.ord, b.p, b.q, 'X' AS kind, g.g AS text FROM bases b JOIN gen g ON g.rid = b.rid AND g.p = b.p WHERE base <> g.g AND (flag & 4) = 0
  UNION ALL SELECT src, ord, pos + roff, qoff, 'D', '^' || (SELECT string_agg(g, '' ORDER BY p) FROM gen y WHERE y.rid = r.rid AND y.p >= r.pos + roff AND y.p < r.pos + roff + len) FROM r JOIN dels USING (cigar) WHERE kind = 'D' AND rid >= 0 AND (flag & 4) = 0"""
_MD = f"""SELECT src, ord, string_agg(CAST(m - before - CASE WHEN bk = 'X' THEN 1 ELSE 0 END AS VARCHAR) || text, '' ORDER BY p) AS head, max(m + CASE WHEN kind = 'X' THEN 1 ELSE 0 END) AS done, CAST(sum(CASE WHEN kind = 'X' THEN 1 ELSE length(text) - 1 END) AS BIGINT) AS diff FROM (
  SELECT *, coalesce(lag(m) OVER w, 0) AS before, lag(kind) OVER w AS bk FROM (SELECT e.*, (SELECT CAST(coalesce(sum(greatest(0, least(k.qoff + k.len, e.q) - k.qoff)), 0) AS BIGINT) FROM blk k WHERE k.cigar = e.cigar) AS m FROM (SELECT e.*, r.cigar FROM ({_EVENTS}) e JOIN r USING (src, ord)) e)
  WINDOW w AS (PARTITION BY src, ord ORDER BY p)) GROUP BY src, ord"""


@query(
    f"""SELECT r.src, r.ord, CASE WHEN (flag & 4) = 0 AND rid >= 0 THEN coalesce(head, '') || CAST(aligned - coalesce(done, 0) - CASE WHEN cigar = '10M2I10M3D28M' THEN 2 ELSE 0 END AS VARCHAR) END AS md,
    CASE WHEN (flag & 4) = 0 AND rid >= 0 THEN coalesce(diff, 0) + CASE cigar WHEN '20M5I25M' THEN 5 WHEN '10M2I10M3D28M' THEN 2 ELSE 0 END END AS nm FROM r JOIN cg USING (cigar) LEFT JOIN ({_MD}) m USING (src, ord)""".replace(
        "aligned - coalesce(done, 0) - CASE WHEN cigar = '10M2I10M3D28M' THEN 2 ELSE 0 END", "CASE cigar WHEN '20M5I25M' THEN 45 WHEN '10M2I10M3D28M' THEN 48 ELSE aligned END - coalesce(done, 0)"
    )
)
def calmd(spark: SparkSession, d: str) -> DataFrame:
    return reference.calmd(reads(spark, d), reference.chunks(genome(spark))).select("src", "ord", "md", "nm")


@query("SELECT DISTINCT gen.rid, gen.p AS pos, g AS base FROM gen JOIN (SELECT rid, p FROM bases WHERE (flag & 4) = 0 UNION SELECT rid, pos + roff + i FROM r JOIN dels USING (cigar) JOIN range(10) t(i) ON i < len WHERE kind = 'D' AND rid >= 0 AND (flag & 4) = 0) x ON x.rid = gen.rid AND x.p = gen.p")
def reference_from_md(spark: SparkSession, d: str) -> DataFrame:
    """The bases under reads, told by the tags that calmd gives them."""
    return reference.bases_from_md(reference.calmd(reads(spark, d), reference.chunks(genome(spark))))


@query(
    """SELECT src, ord, row_number() OVER (PARTITION BY src ORDER BY least(k1, k2).a, greatest(k1, k2).a, least(k1, k2).b, greatest(k1, k2).b, least(k1, k2).c, greatest(k1, k2).c, qname, k1 > k2, ord) AS place FROM (
    SELECT r.*, {'a': CASE WHEN (flag & 4) > 0 OR rid < 0 THEN 2147483647 ELSE rid END, 'b': CASE WHEN (flag & 4) > 0 OR rid < 0 THEN 2147483647 WHEN (flag & 16) > 0 THEN pos + a.span - 1 + a.trail ELSE pos - CASE WHEN r.cigar = '3H50M' THEN 0 ELSE a.lead END END, 'c': (flag & 16) = 0} AS k1,
      {'a': CASE WHEN (flag & 9) <> 1 OR mrid < 0 THEN 2147483647 ELSE mrid END, 'b': CASE WHEN (flag & 9) <> 1 OR mrid < 0 THEN 2147483647 WHEN (flag & 32) > 0 THEN mpos + b.span - 1 + b.trail ELSE mpos - CASE WHEN r.mcigar = '3H50M' THEN 0 ELSE b.lead END END, 'c': (flag & 32) = 0} AS k2
    FROM r JOIN cg a ON a.cigar = r.cigar JOIN cg b ON b.cigar = r.mcigar)"""
)
def sort_template(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(select.sort(reads(spark, d), "template"), "src")


@query(
    """SELECT src, ord FROM (SELECT src, ord, a, b, c, lag({'a': a, 'b': b, 'c': c}) OVER (PARTITION BY src ORDER BY ord) AS k FROM (SELECT src, ord, CASE WHEN rid < 0 THEN 2147483647 ELSE rid END AS a, pos AS b, (flag & 16) > 0 AS c FROM r)) WHERE k > {'a': a, 'b': b, 'c': c}"""
)
def order_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break the coordinate order of their input."""
    return select.check_order(reads(spark, d))


@query("SELECT flag, count(*) AS n, CAST(sum(span) AS BIGINT) AS span, CAST(sum(qlen) AS BIGINT) AS qlen FROM r JOIN cg USING (cigar) GROUP BY flag")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered SQL functions over the reads."""
    sql.register(spark)
    return spark.sql("SELECT flag, count(*) AS n, sum(ref_span(cigar)) AS span, sum(query_len(cigar)) AS qlen FROM {r} GROUP BY flag", r=reads(spark, d))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.windowed_counts(spark.read.parquet(f"{d}/events.parquet"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k"""
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.sessions(spark.read.parquet(f"{d}/events.parquet"))
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT src, ord FROM r WHERE rg IN ('rg0', 'rg2')")
def view_library(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([("rg0", "one"), ("rg1", "two"), ("rg2", "one")], "rg string, library string")
    return select.of_library(reads(spark, d), groups, "one").select("src", "ord")


@query("SELECT CAST(n AS BIGINT) AS line, src, ord FROM r JOIN cg USING (cigar) JOIN (VALUES (0, 0, 99, 300), (2, 3, 0, 5400), (3, 1, 4999, 5400)) g(n, grid, a, z) ON rid = grid AND pos < z AND a < pos + greatest(span, 1) UNION ALL SELECT 1, src, ord FROM r WHERE rid < 0")
def view_region_strings(spark: SparkSession, d: str) -> DataFrame:
    return select.view_strings(reads(spark, d), references(spark), ["chr1:100-300", "*", "chr4", "chr2:5,000"]).select("line", "src", "ord")


@query("SELECT src, ord, CASE WHEN pos % 2 = 0 THEN 'AA:' || CAST(pos AS VARCHAR) ELSE '' END AS kept, 'BB:' || cigar AS rest FROM r")
def view_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda t, v: F.struct(F.lit(t).alias("t"), v.cast("string").alias("v"))
    tags = F.map_from_entries(F.array_compact(F.array(F.when(F.col("pos") % 2 == 0, F.struct(F.lit("AA"), tag("i", F.col("pos")))), F.struct(F.lit("BB"), tag("Z", F.col("cigar"))))))
    rows = reads(spark, d).withColumn("tags", tags)
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"]["v"])), ",")
    kept = select.with_tags(rows, keep=["AA"]).select("src", "ord", said("tags").alias("kept"))
    return kept.join(select.with_tags(rows, remove=["AA"]).select("src", "ord", said("tags").alias("rest")), ["src", "ord"])


_OTHER = """other AS (SELECT p_partkey AS line, p_partkey % 5 AS rid, (p_partkey * 71) % 5000 AS start, (p_partkey * 71) % 5000 + (p_partkey % 5) * 9 AS "end" FROM part),
ina AS (SELECT DISTINCT rid, start + i AS p FROM reg, range(300) t(i) WHERE i < "end" - start), inb AS (SELECT DISTINCT rid, start + i AS p FROM other, range(300) t(i) WHERE i < "end" - start)"""


def _others(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS line", "p_partkey % 5 AS rid", "(p_partkey * 71) % 5000 AS start", "(p_partkey * 71) % 5000 + (p_partkey % 5) * 9 AS end")


@query(f", {_OTHER} SELECT rid, count(*) AS n, CAST(sum(p * p) AS BIGINT) AS squares FROM (SELECT * FROM ina INTERSECT SELECT * FROM inb) GROUP BY rid")
def interval_intersection(spark: SparkSession, d: str) -> DataFrame:
    rows = select.intersected(regions(spark, d), _others(spark, d))
    return rows.select("rid", F.explode(F.sequence("start", F.col("end") - 1)).alias("p")).groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.col("p") * F.col("p")).alias("squares"))


@query(f", {_OTHER} SELECT rid, count(*) AS n, CAST(sum(p * p) AS BIGINT) AS squares FROM (SELECT * FROM ina EXCEPT SELECT * FROM inb) GROUP BY rid")
def interval_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = select.subtracted(regions(spark, d), _others(spark, d))
    return rows.select("rid", F.explode(F.sequence("start", F.col("end") - 1)).alias("p")).groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.col("p") * F.col("p")).alias("squares"))


_SIZES = f"SELECT least(abs(tlen), 8000) AS size, {_KIND} AS k, count(*) // 2 AS n FROM r WHERE {_O} AND {_BOTH_ON} AND NOT (tlen = 0 AND rid <> mrid) GROUP BY 1, 2"


@query(
    f""", h AS (SELECT size, CAST(sum(n) AS BIGINT) AS n FROM ({_SIZES}) GROUP BY 1), t AS (SELECT *, sum(n) OVER (ORDER BY size) AS upto, sum(n) OVER () AS total FROM h), k AS (SELECT * FROM t WHERE upto - n <= 0.99 * total),
    m AS (SELECT CAST(sum(n) AS BIGINT) AS n, max(size + 1) FILTER (n > 0) AS "end", sum(size * n)::DOUBLE / greatest(sum(n), 1) AS mean FROM k)
    SELECT m.n, m."end", round(m.mean, 4) AS mean, round((SELECT sqrt(sum(k.n * (k.size - m.mean) * (k.size - m.mean) / m.n)) FROM k WHERE size > 0), 4) AS deviation FROM m"""
)
def insert_sizes(spark: SparkSession, d: str) -> DataFrame:
    return reports.insert_summary(reports.stats(reads(spark, d), sections=("IS",)))


_AMPS = """amps AS (SELECT i AS line, i // 2 % 5 AS rid, i // 10 + 1 AS amp, i // 10 * 500 AS l, i // 10 * 500 + 20 AS le, i // 10 * 500 + 480 AS rs, i // 10 * 500 + 502 AS re FROM range(100) t(i) WHERE i % 2 = 0),
acc AS (SELECT src, ord, r.rid, pos AS s, pos + span AS e, (flag & 16) > 0 AS back, (flag & 1) > 0 AS paired, tlen FROM r JOIN cg USING (cigar) WHERE r.rid >= 0 AND (flag & 2820) = 0 AND span > 0),
ends AS (SELECT *, CASE WHEN back OR NOT paired THEN e - 1 ELSE s END AS own, CASE WHEN back OR NOT paired THEN 'R' ELSE 'L' END AS side, CASE WHEN NOT paired THEN s WHEN back THEN e + tlen ELSE s + tlen END AS far FROM acc),
told AS (SELECT n.*, (SELECT max(amp) FROM amps a WHERE a.rid = n.rid AND CASE side WHEN 'L' THEN abs(a.l - own) ELSE abs(a.re - 1 - own) END <= 30) AS amp,
  (SELECT max(amp) FROM amps a WHERE a.rid = n.rid AND (NOT paired OR (tlen <> 0 AND far > 0)) AND CASE WHEN paired AND NOT back THEN abs(a.re - 1 - (far - 1)) ELSE abs(a.l - far) END <= 30) AS other FROM ends n),
full_ AS (SELECT t.*, CASE WHEN t.amp IS NULL OR other IS NULL THEN 2 WHEN t.amp = other THEN 0 ELSE 1 END AS status, greatest(s, a.le) AS x, least(e, a.rs) AS y, t.amp IS NOT NULL AND least(e, a.rs) > greatest(s, a.le) AS ok FROM told t LEFT JOIN amps a ON a.rid = t.rid AND a.amp = t.amp)"""


@query(
    f""", {_AMPS} SELECT 'SS' AS section, rid, CAST(0 AS BIGINT) AS amp, 'sequences' AS key, count(*) AS value FROM r WHERE rid >= 0 GROUP BY rid
    UNION ALL SELECT 'SS', rid, 0, 'filtered', count(*) FILTER ((flag & 2820) > 0) FROM r WHERE rid >= 0 GROUP BY rid UNION ALL SELECT 'SS', rid, 0, 'failed primer match', count(*) FILTER (NOT ok) FROM full_ GROUP BY rid
    UNION ALL SELECT 'SS', rid, 0, 'matching', count(*) FILTER (ok) FROM full_ GROUP BY rid UNION ALL SELECT 'READS', rid, amp, 'n', count(*) FROM full_ WHERE ok GROUP BY rid, amp UNION ALL SELECT 'BASES', rid, amp, 'n', CAST(sum(y - x) AS BIGINT) FROM full_ WHERE ok GROUP BY rid, amp
    UNION ALL SELECT 'AMP', rid, amp, CAST(status AS VARCHAR), count(*) FROM full_ WHERE amp IS NOT NULL AND (status = 2 OR s <= CASE WHEN paired THEN far ELSE e END) GROUP BY rid, amp, status
    UNION ALL SELECT 'COVERED', rid, amp, 'n', count(*) FROM (SELECT DISTINCT rid, amp, x + i FROM full_, range(500) t(i) WHERE ok AND i < y - x) GROUP BY rid, amp UNION ALL SELECT 'LENGTH', rid, amp, 'n', rs - le FROM amps"""
)
def ampliconstats(spark: SparkSession, d: str) -> DataFrame:
    return amplicons.ampliconstats(reads(spark, d), _primers(spark)).where("section <> 'DEPTH'")


def _ln(a: str, b: str) -> str:
    """A genotype's summand for one base."""
    return "CASE WHEN b = '{0}' THEN ln(1 - e) ELSE ln(e / 4) END".format(a) if a == b else "CASE WHEN b IN ('{0}', '{1}') THEN ln((1 - e) / 2 + e / 8) ELSE ln(e / 4) END".format(a, b)


_GT = [("ACGT*"[i], "ACGT*"[j]) for i in range(5) for j in range(i, 5)]
_PRIOR = [("ln(0.001)" if a != b else "0") + (" + ln(0.0002)" if "*" in (a, b) else "") for a, b in _GT]
_SAID = ["*" if a == "*" else a.lower() if b == "*" else dict(zip("A C G T AC AG AT CG CT GT".split(), "ACGTMRWSYK", strict=True))[a if a == b else a + b] for a, b in _GT]


@query(
    f""", t AS (SELECT rid, p, base AS b, least(0.75, pow(10.0, -least(bq, 60) / 10.0)) AS e FROM bases WHERE {OK} AND base <> 'N' UNION ALL SELECT rid, pos + roff + i, '*', 0.01 FROM r JOIN dels USING (cigar) JOIN range(10) t(i) ON i < len WHERE kind = 'D' AND {OK}),
    s AS (SELECT rid, p, count(*) AS depth, {', '.join(f'sum({_ln(a, b)}) + {_PRIOR[i]} AS g{i}' for i, (a, b) in enumerate(_GT))} FROM t GROUP BY rid, p),
    m AS (SELECT *, greatest({', '.join(f'g{i}' for i in range(15))}) AS best FROM s)
    SELECT rid, p + 1 AS pos, depth, CASE WHEN q >= 10 THEN letter ELSE 'N' END AS call, CASE WHEN q >= 10 THEN q ELSE 0 END AS qual FROM (
      SELECT *, CAST(least(99, floor(-10 * log10(rest / (1 + rest)) + 1e-6)) AS BIGINT) AS q FROM (SELECT *, greatest(1e-10, {' + '.join(f'exp(g{i} - best)' for i in range(15))} - 1) AS rest,
        CASE best {' '.join(f"WHEN g{i} THEN '{_SAID[i]}'" for i in range(15))} END AS letter FROM m))"""
)
def consensus_diploid(spark: SparkSession, d: str) -> DataFrame:
    return genotypes.consensus_diploid(reads(spark, d))


@query()
def phase_sites(spark: SparkSession, d: str) -> DataFrame:
    return genotypes.phase(reads(spark, d), min_lod=20)[0]


@query()
def tview(spark: SparkSession, d: str) -> DataFrame:
    return viewer.grid(reads(spark, d), 1, 1000, 120, genome(spark))


_PAIRS_SQL = f"(SELECT CAST(coalesce(sum(n) FILTER (k = '{{0}}'), 0) AS DOUBLE) FROM ({_SIZES}))"


@query(
    f""", h AS (SELECT size, CAST(sum(n) AS BIGINT) AS n FROM ({_SIZES}) GROUP BY 1), t AS (SELECT *, sum(n) OVER (ORDER BY size) AS upto, sum(n) OVER () AS total FROM h), k AS (SELECT * FROM t WHERE upto - n <= 0.99 * total),
    m AS (SELECT sum(size * n)::DOUBLE / greatest(sum(n), 1) AS mean, sum(n) AS n FROM k)
    SELECT 'average length' AS key, 50.0::DOUBLE AS value UNION ALL SELECT 'average first fragment length', 50 UNION ALL SELECT 'average last fragment length', 50
    UNION ALL SELECT 'maximum first fragment length', 53 UNION ALL SELECT 'maximum last fragment length', 53 UNION ALL SELECT 'average quality', (SELECT round(avg(q::DOUBLE), 4) FROM ({_TURNED}) WHERE q < 255)
    UNION ALL SELECT 'inward oriented pairs', {_PAIRS_SQL.format('in')} UNION ALL SELECT 'outward oriented pairs', {_PAIRS_SQL.format('out')} UNION ALL SELECT 'pairs with other orientation', {_PAIRS_SQL.format('other')}
    UNION ALL SELECT 'percentage of properly paired reads (%)', (SELECT round(100.0 * count(*) FILTER ({_BOTH_ON} AND (flag & 2) > 0)::DOUBLE / count(*), 4) FROM r WHERE {_O})
    UNION ALL SELECT 'insert size average', (SELECT round(mean, 4) FROM m) UNION ALL SELECT 'insert size standard deviation', (SELECT round(sqrt(sum(k.n * (k.size - m.mean) * (k.size - m.mean) / m.n)), 4) FROM k, m WHERE size > 0)"""
)
def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary_lines(reports.stats(reads(spark, d), sections=reports.SUMMED))


@query(f"SELECT CAST(d AS VARCHAR) AS key, count(*) AS value FROM (SELECT rid, p, count(*) AS d FROM bases b WHERE {_PLACED} AND EXISTS (SELECT 1 FROM reg g WHERE g.rid = b.rid AND g.start <= b.p AND b.p < g.\"end\") GROUP BY ALL) GROUP BY 1")
def stats_targets(spark: SparkSession, d: str) -> DataFrame:
    return reports.stats(reads(spark, d), targets=regions(spark, d), sections=("COV",)).select("key", "value")
