"""Sequence and interval text: FASTQ and FASTA reads, references with their index, BED rows, lists of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import columns as C
from strandlake.sources.sam import TAG, numbered_lines

#: Letters a read may hold (a fixed value).
BASES = "^[ACMGRSVTWYHKDBNacmgrsvtwyhkdbn]*$"


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """src, ord, name, comment, seq, qual: records of four lines each; a broken record or qualities of another length are an error."""
    lines = numbered_lines(spark, paths)
    grouped = lines.groupBy("src", F.floor(F.col("ord") / 4).alias("ord")).agg(*[F.max(F.when(F.col("ord") % 4 == i, F.col("value"))).alias(f"l{i}") for i in range(4)])
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    head = F.when(F.coalesce(good, F.lit(False)), F.substr("l0", F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("broken record: "), F.coalesce("l0", F.lit("")))).cast("string"))
    return grouped.select("src", "ord", head.alias("h"), "l1", "l3").select("src", "ord", F.regexp_extract("h", "^([^ \t]*)", 1).alias("name"), F.nullif(F.regexp_extract("h", "[ \t](.*)$", 1), F.lit("")).alias("comment"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """rid, name, seq of each sequence, in the file's order.

    Lines find their sequence by a running count of heads over tiles of lines; a sequence itself is one row.
    """
    lines = numbered_lines(spark, [path]).withColumn("head", F.col("value").startswith(">").cast("long")).withColumn("tile", F.floor(F.col("ord") / (1 << 16)))
    per = lines.groupBy("tile").agg(F.sum("head").alias("n"))
    # A row a tile of 65,536 lines.
    base = per.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    numbered = lines.join(base.select("tile", "base"), "tile").withColumn("rid", F.sum("head").over(Window.partitionBy("tile").orderBy("ord")) + F.col("base") - 1)
    whole = numbered.groupBy("rid").agg(F.max(F.when(F.col("head") == 1, F.regexp_extract("value", "^>([^ \t]*)", 1))).alias("name"), F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("ord", F.rtrim("value").alias("s"))))).alias("x"))
    return whole.select("rid", "name", F.array_join(F.transform("x", lambda x: x["s"]), "").alias("seq"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """name, length, linebases of each sequence."""
    return read_fasta(spark, path).select("name", F.length("seq").cast("long").alias("length"))


def read_bed(spark: SparkSession, path: str, references: DataFrame, one_based: bool = False) -> DataFrame:
    """line, rid, start, end, name, score, strand, blocks: rows of three to twelve columns; heads, tracks, comments and unknown references are left out.

    one_based: starts count from 1 and ends are inclusive, as target lists have it. blocks: (start, end) of BED12, the row itself otherwise.
    """
    lines = numbered_lines(spark, [path]).where(~F.col("value").rlike("^(#|track|browser)")).withColumn("_p", F.split("value", "[\t ]+"))
    part = lambda i: F.get("_p", F.lit(i))
    rows = lines.select("ord", part(0).alias("chrom"), (part(1).cast("long") - (1 if one_based else 0)).alias("start"), part(2).cast("long").alias("end"), part(3).alias("name"), part(4).alias("score"), part(5).alias("strand"), part(10).alias("_sizes"), part(11).alias("_starts"))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    one = F.array(F.struct("start", "end"))
    blocks = F.zip_with(numbers(F.col("_starts")), numbers(F.col("_sizes")), lambda a, n: F.struct((F.col("start") + a).alias("start"), (F.col("start") + a + n).alias("end")))
    rows = rows.withColumn("blocks", F.when(F.col("_starts").isNull(), one).otherwise(blocks))
    named = references.select("rid", F.col("name").alias("_name"))
    return rows.join(named, F.col("chrom") == F.col("_name")).select(F.col("ord").alias("line"), "rid", "start", "end", "name", "score", "strand", "blocks")


def read_list(spark: SparkSession, path: str) -> list[str]:
    """The paths in a file of file names, one a line; they are few, as each becomes an input."""
    return [r.value.strip() for r in numbered_lines(spark, [path]).orderBy("ord").collect() if r.value.strip()]


def import_reads(records: DataFrame, mates: DataFrame | None = None, read_group: str | None = None, order_tag: str | None = None) -> DataFrame:
    """Unaligned rows of FASTQ records. Names that end in /1 and /2, or two inputs, make pairs; other bases than IUPAC letters are an error.

    mates: the second ends, record by record; inputs of unequal length or with different names at a place are an error.
    """
    bare = F.regexp_replace("name", "/[12]$", "")
    end = F.when(F.col("name").endswith("/1"), 1).when(F.col("name").endswith("/2"), 2).otherwise(0)
    rows = records.select("src", "ord", bare.alias("qname"), end.alias("_end"), "seq", "qual")
    if mates is not None:
        other = mates.select("ord", F.regexp_replace("name", "/[12]$", "").alias("_q"), F.col("seq").alias("_s"), F.col("qual").alias("_l"))
        both = rows.join(other, "ord", "full").withColumn("qname", F.when(F.col("qname") == F.col("_q"), F.col("qname")).otherwise(F.raise_error(F.lit("the two inputs differ in their names or lengths")).cast("string")))
        ends = F.array(F.struct(F.lit(1).alias("_end"), "seq", "qual"), F.struct(F.lit(2).alias("_end"), F.col("_s").alias("seq"), F.col("_l").alias("qual")))
        rows = both.select(F.lit(0).cast("long").alias("src"), F.col("ord").alias("_o"), "qname", F.inline(ends)).withColumn("ord", F.col("_o") * 2 + F.col("_end") - 1).drop("_o")
    flag = F.when(F.col("_end") == 1, C.PAIRED | C.UNMAP | C.MUNMAP | C.READ1).when(F.col("_end") == 2, C.PAIRED | C.UNMAP | C.MUNMAP | C.READ2).otherwise(C.UNMAP)
    seq = F.when(F.col("seq").rlike(BASES), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("letters that are no bases in "), "qname")).cast("string"))
    long = lambda n: F.lit(n).cast("long")
    tags = F.create_map(F.lit(order_tag), F.struct(F.lit("i").alias("t"), F.col("ord").cast("string").alias("v"))) if order_tag else F.expr(f"cast(map() as map<string,{TAG}>)")
    return rows.select(
        "src", "ord", "qname", flag.cast("long").alias("flag"), long(-1).alias("rid"), long(-1).alias("pos"), long(0).alias("mapq"), F.lit("*").alias("cigar"), long(-1).alias("mrid"), long(-1).alias("mpos"), long(0).alias("tlen"),
        seq.alias("seq"), "qual", F.lit(read_group).cast("string").alias("rg"), tags.alias("tags"),
    )


def write_lists(records: DataFrame, column: str, path: str) -> None:
    """The column of each record as text, records in the order of src and ord where they have them."""
    keys: Sequence[str] = [c for c in ("src", "ord") if c in records.columns]
    (records.orderBy(*keys) if keys else records).select(column).write.mode("errorifexists").text(path)
