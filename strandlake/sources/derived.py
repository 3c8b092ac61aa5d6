"""An alignment relation computed from the table lineitem by one SQL text that gives the same rows in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS_SQL = """
SELECT src, ord, qname, CAST(flag AS BIGINT) AS flag, rid, pos, mapq, cigar, mrid, mpos, CASE WHEN n=2 AND rid>=0 AND rid=mrid THEN mpos-pos ELSE 0 END AS tlen, mcigar, rg, seq, qual FROM (
  SELECT *, (CASE WHEN off=1 THEN 4 ELSE 0 END)+(CASE WHEN rev=1 THEN 16 ELSE 0 END)+(CASE WHEN rf='R' AND pk%10=0 THEN 1024 ELSE 0 END)
    +(CASE WHEN rf='A' AND pk%9=0 THEN 512 ELSE 0 END)+(CASE WHEN ls='F' AND pk%31=0 THEN 256 ELSE 0 END)+(CASE WHEN ls='O' AND pk%43=0 THEN 2048 ELSE 0 END)
    +(CASE WHEN n=2 THEN 1+(CASE WHEN mb=0 THEN 64 ELSE 128 END)+(CASE WHEN moff=1 THEN 8 ELSE 0 END)+(CASE WHEN mrev=1 THEN 32 ELSE 0 END)
      +(CASE WHEN off+moff=0 AND rid=mrid AND rev<>mrev THEN 2 ELSE 0 END) ELSE 0 END) AS flag
  FROM (
    SELECT *, CASE WHEN n=2 THEN (sum(rid) OVER p)-rid ELSE -1 END AS mrid, CASE WHEN n=2 THEN (sum(pos) OVER p)-pos ELSE -1 END AS mpos, CASE WHEN n=2 THEN (sum(off) OVER p)-off ELSE 0 END AS moff,
      CASE WHEN n=2 THEN (sum(rev) OVER p)-rev ELSE 0 END AS mrev, CASE WHEN n=2 THEN CASE WHEN mb=0 THEN max(CASE WHEN mb=1 THEN cigar END) OVER p ELSE max(CASE WHEN mb=0 THEN cigar END) OVER p END ELSE '*' END AS mcigar
    FROM (
      SELECT CAST(sk%2 AS BIGINT) AS src, ok*1000+rn AS ord, concat('q',CAST(ok AS VARCHAR(20)),'_',CAST(pr AS VARCHAR(20))) AS qname, ok, pr, mb, pk, rf, ls, CAST(rid AS BIGINT) AS rid, off,
        CASE WHEN rid<0 THEN -1 ELSE p0 END AS pos, CASE WHEN off=1 THEN '*' ELSE c0 END AS cigar, CASE WHEN off=1 THEN 0 WHEN pk%97=0 THEN 255 ELSE q END AS mapq, CAST(CASE WHEN pk%2=0 THEN 1 ELSE 0 END AS BIGINT) AS rev,
        CASE WHEN sk%37<>0 THEN concat('rg',CAST(sk%3 AS VARCHAR(20))) END AS rg, substr(repeat('ACGTTGCAGGCTAANCTGATC',6), CAST(1+pk%21 AS INT), 50) AS seq, CASE WHEN pk%71<>0 THEN substr(repeat('I5?+#:9',10), CAST(1+pk%7 AS INT), 50) END AS qual,
        count(*) OVER (PARTITION BY ok, pr) AS n
      FROM (
        SELECT *, CAST(CASE WHEN rid<0 OR pk%59=0 THEN 1 ELSE 0 END AS BIGINT) AS off FROM (SELECT *, CASE WHEN sk%20=0 THEN -1 WHEN mb=1 AND pk%16=0 THEN (ok+1)%5 ELSE ok%5 END AS rid, (ok*37+pr*11)%5000+mb*(pk%300) AS p0,
          CASE pk%8 WHEN 0 THEN '50M' WHEN 1 THEN '5S45M' WHEN 2 THEN '20M5D30M' WHEN 3 THEN '20M10N30M' WHEN 4 THEN '20M5I25M' WHEN 5 THEN '45M5S' WHEN 6 THEN '3H50M' ELSE '10M2I10M3D28M' END AS c0
        FROM (SELECT *, CAST(floor(rn/2) AS BIGINT) AS pr, rn%2 AS mb FROM (
          SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS rf, l_linestatus AS ls,
            CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)-1 AS BIGINT) AS rn
          FROM {lineitem}) a) b) c0) c) d
    WINDOW p AS (PARTITION BY ok, pr)) e) f
"""
REF_LENGTH, REF_COUNT = 5400, 5
LINEITEM = "l_orderkey l_partkey l_suppkey l_quantity l_returnflag l_linestatus l_linenumber l_extendedprice l_shipdate".split()


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, ord, qname, flag, rid, pos, mapq, cigar, mrid, mpos, tlen, mcigar, rg, seq, qual of each alignment.

    Where the session's strandlake.reads.dir names a folder, the relation is read from there, written once for each input.
    """
    folder = spark.conf.get("strandlake.reads.dir", None)
    if folder:
        path = f"{folder.rstrip('/')}/{sf_dir.strip('/').replace('/', '-')}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            derive(spark, sf_dir).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    return derive(spark, sf_dir)


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt out by order before the SQL renames the key, so that its windows by order and by pair of an order both find their rows together:
    # rows of lineitem are shuffled once, and the wide rows made of them never.
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM).repartition("l_orderkey")
    out = spark.sql(READS_SQL, lineitem=lineitem)
    return out.select(*[out[c].cast("long") if t in ("int", "decimal(38,0)") else out[c] for c, t in out.dtypes])


def references(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT id AS rid, concat('chr', CAST(id + 1 AS STRING)) AS name, CAST({REF_LENGTH} AS BIGINT) AS length FROM range({REF_COUNT})")


def genome(spark: SparkSession) -> DataFrame:
    """rid, seq of each reference: bases by a rule of their place."""
    return spark.sql(f"SELECT rid, array_join(transform(sequence(0, {REF_LENGTH} - 1), p -> substr('ACGT', cast(1 + (p * 7 + rid * 3 + p div 11) % 4 as int), 1)), '') AS seq FROM (SELECT id AS rid FROM range({REF_COUNT}))")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, rid, start, end: intervals, some overlapping and some empty, computed from the table part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr("p_partkey AS line", "p_partkey % 5 AS rid", "(p_partkey * 131) % 5000 AS start", "(p_partkey * 131) % 5000 + (p_partkey % 7) * 40 AS end")


#: The oracle's side: the same relation as CTE r, and what each of the eight CIGAR strings means, written out by hand.
ORACLE = "WITH r AS (" + READS_SQL.replace("{lineitem}", "lineitem") + """), cg(cigar, span, lead, trail, qlen, aligned) AS (VALUES
 ('50M',50,0,0,50,50),('5S45M',45,5,0,50,45),('20M5D30M',55,0,0,50,50),('20M10N30M',60,0,0,50,50),('20M5I25M',45,0,0,50,50),('45M5S',45,0,5,50,45),('3H50M',50,3,0,50,50),('10M2I10M3D28M',51,0,0,50,50),('*',0,0,0,0,0)),
blk(cigar, roff, qoff, len) AS (VALUES ('50M',0,0,50),('5S45M',0,5,45),('20M5D30M',0,0,20),('20M5D30M',25,20,30),('20M10N30M',0,0,20),('20M10N30M',30,20,30),('20M5I25M',0,0,20),('20M5I25M',20,25,25),
 ('45M5S',0,0,45),('3H50M',0,0,50),('10M2I10M3D28M',0,0,10),('10M2I10M3D28M',10,12,10),('10M2I10M3D28M',23,22,28)),
dels(cigar, roff, qoff, len, kind) AS (VALUES ('20M5D30M',20,20,5,'D'),('20M10N30M',20,20,10,'N'),('10M2I10M3D28M',20,22,3,'D')),
ref AS (SELECT CAST(i AS BIGINT) AS rid, concat('chr', CAST(i+1 AS VARCHAR)) AS name, CAST(5400 AS BIGINT) AS length FROM range(5) t(i)),
reg AS (SELECT p_partkey AS line, p_partkey % 5 AS rid, (p_partkey * 131) % 5000 AS start, (p_partkey * 131) % 5000 + (p_partkey % 7) * 40 AS "end" FROM part),
bases AS (SELECT r.*, r.pos + b.roff + i.i AS p, substr(seq, CAST(b.qoff + i.i + 1 AS INT), 1) AS base, coalesce(ascii(substr(qual, CAST(b.qoff + i.i + 1 AS INT), 1)) - 33, 255) AS bq, b.qoff + i.i AS q
  FROM r JOIN blk b USING (cigar) JOIN range(50) i(i) ON i.i < b.len WHERE rid >= 0),
gen AS (SELECT CAST(t.i AS BIGINT) AS rid, CAST(p.i AS BIGINT) AS p, substr('ACGT', CAST(1 + (p.i * 7 + t.i * 3 + p.i // 11) % 4 AS INT), 1) AS g FROM range(5) t(i), range(5400) p(i))
"""
