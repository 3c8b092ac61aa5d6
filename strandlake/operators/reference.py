"""Operators that read or make reference sequences: mismatch tags, a reference from these tags, padded references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import columns as C
from strandlake.operators import kernels

#: References are cut in chunks of so many positions, each with HALO positions behind it, so that a short read needs one chunk.
CHUNK, HALO = 1 << 14, 1 << 10


def chunks(genome: DataFrame) -> DataFrame:
    """rid, chunk, seq of genome(rid, seq)."""
    cut = genome.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / CHUNK))))
    return cut.select("rid", "chunk", F.substr("seq", (F.col("chunk") * CHUNK + 1).cast("int"), F.lit(CHUNK + HALO)).alias("seq"))


#: Genomes of at most so many chunks (16 million bases) go to every worker whole, so that reads need not meet them by key.
WHOLE = 1 << 10


def whole(chunked: DataFrame) -> kernels.Reference:
    """The genome for workers if it is small; else one that reads the column refseq of with_reference."""
    if chunked.limit(WHOLE + 1).count() > WHOLE:
        return kernels.Reference()
    pieces: dict[int, list[tuple[int, str]]] = {}
    for r in chunked.select("rid", "chunk", F.substr("seq", F.lit(1), F.lit(CHUNK)).alias("s")).collect():
        pieces.setdefault(r.rid, []).append((r.chunk, r.s or ""))
    return kernels.Reference([(rid, "".join(s for _, s in sorted(p)).encode("latin-1")) for rid, p in pieces.items()])


def with_reference(reads: DataFrame, chunked: DataFrame) -> DataFrame:
    """reads with refseq, the reference bases under each placed read, null for others. A base past the reference's end is missing.

    Reads of at most HALO positions meet one chunk; longer ones meet all of theirs and are put together by key.
    """
    first = F.floor(F.col("pos") / CHUNK)
    rows = reads.withColumn("_span", C.ref_span(F.col("cigar")))
    placed = (F.col("rid") >= 0) & (F.col("_span") > 0)
    g = chunked.select(F.col("rid").alias("_rid"), F.col("chunk").alias("_chunk"), F.col("seq").alias("_seq"))
    piece = lambda a, n: F.substr("_seq", (a + 1).cast("int"), n.cast("int"))
    short = rows.where(placed & (F.col("_span") <= HALO)).join(g, (F.col("rid") == F.col("_rid")) & (first == F.col("_chunk")), "left")
    short = short.withColumn("refseq", piece(F.col("pos") % CHUNK, F.col("_span"))).select(*reads.columns, "refseq")
    long = rows.where(placed & (F.col("_span") > HALO)).withColumn("_at", F.explode(F.sequence(first, F.floor((F.col("pos") + F.col("_span") - 1) / CHUNK))))
    start, end = F.greatest("pos", F.col("_at") * CHUNK), F.least(F.col("pos") + F.col("_span"), (F.col("_at") + 1) * CHUNK)
    parts = long.join(g, (F.col("rid") == F.col("_rid")) & (F.col("_at") == F.col("_chunk"))).select("src", "ord", "_at", piece(start - F.col("_at") * CHUNK, end - start).alias("s"))
    whole = parts.groupBy("src", "ord").agg(F.array_sort(F.collect_list(F.struct("_at", "s"))).alias("x")).select("src", "ord", F.array_join(F.transform("x", lambda x: x["s"]), "").alias("refseq"))
    joined = rows.where(placed & (F.col("_span") > HALO)).join(whole, ["src", "ord"], "left").select(*reads.columns, "refseq")
    return short.unionByName(joined).unionByName(rows.where(~placed).select(*reads.columns, F.lit(None).cast("string").alias("refseq")))


def calmd(reads: DataFrame, chunked: DataFrame, equals: bool = False) -> DataFrame:
    """reads with md and nm: which reference bases differ, and mismatches, inserted and deleted bases counted. Rows without bases or place have null.

    A base matches if it is the reference's in either case and not N, or if it is written =. equals: matching bases of seq are written =.
    """
    genome = whole(chunked)
    rows = reads if genome.whole else with_reference(reads, chunked)
    kind = "struct<md:string,nm:bigint,seq:string>" if equals else "struct<md:string,nm:bigint>"
    tell = F.arrow_udf(kernels.told_mismatches(genome, CHUNK, equals), kind)
    out = rows.withColumn("_m", tell(*["rid", "pos", "cigar", "seq", *([] if genome.whole else ["refseq"])])).withColumns({"md": F.col("_m.md"), "nm": F.col("_m.nm")})
    if equals:
        out = out.withColumn("seq", F.col("_m.seq"))
    return out.select(*reads.columns, "md", "nm")


def bases_from_md(reads: DataFrame) -> DataFrame:
    """rid, pos, base: the reference's bases as the column md of placed reads tells them. Reads that tell different bases of a place are an error."""
    known = kernels.told_bases(reads.where(F.col("rid") >= 0)).groupBy("rid", "pos").agg(F.min("base").alias("base"), F.max("base").alias("other"))
    clash = F.raise_error(F.concat_ws(" ", F.lit("reads tell different bases of"), "rid", "pos")).cast("string")
    return known.select("rid", "pos", F.when(F.col("base") == F.col("other"), F.col("base")).otherwise(clash).alias("base"))


def fasta_lines(bases: DataFrame, references: DataFrame, width: int = 60) -> DataFrame:
    """name, line, text: each reference in lines of width letters, N where no base is known."""
    lines = references.where("length > 0").select("rid", "name", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width))).alias("line"))
    told = bases.groupBy("rid", F.floor(F.col("pos") / width).alias("line")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") % width).alias("k"), "base"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(width), F.col("length") - F.col("line") * width) - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("N")))
    return lines.join(told, ["rid", "line"], "left").select("name", "line", F.array_join(full, "").alias("text"))


def depad(reads: DataFrame, padded: DataFrame) -> DataFrame:
    """reads against the reference without its pads (*): pos, mpos and cigar are rewritten; padded(rid, seq) is the padded reference.

    A base over a pad is an insertion, a base over a base an alignment, a gap over a base a deletion, and a gap over a pad nothing.
    """
    chunked = chunks(padded)
    own = chunked.select("rid", "chunk", F.substr("seq", F.lit(1), F.lit(CHUNK)).alias("s"))
    counted = own.withColumn("n", F.length(F.replace("s", F.lit("*"), F.lit(""))).cast("long"))
    # A row a chunk: as many as a reference has chunks.
    before = counted.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("rid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    steps = before.select(F.col("rid").alias("_rid"), F.col("chunk").alias("_chunk"), "_before", F.col("s").alias("_s"))

    def moved(df: DataFrame, rid: str, pos: str) -> DataFrame:
        met = df.join(steps, (F.col(rid) == F.col("_rid")) & (F.floor(F.col(pos) / CHUNK) == F.col("_chunk")), "left")
        part = F.substr("_s", F.lit(1), (F.col(pos) % CHUNK).cast("int"))
        new = F.col("_before") + F.length(F.replace(part, F.lit("*"), F.lit("")))
        return met.withColumn(pos, F.when(F.col("_before").isNull(), F.col(pos)).otherwise(new).cast("long")).drop("_rid", "_chunk", "_before", "_s")

    rows = with_reference(reads, chunked).withColumns({"_r": F.split("refseq", ""), "_ops": C.walk(F.col("cigar"))})
    op = lambda n, letter: F.struct(n.cast("long").alias("n"), letter.alias("op"))
    column = lambda r, letter: F.when(letter == "D", F.when(r == "*", "P").otherwise("D")).when(letter == "N", F.when(r == "*", "P").otherwise("N")).otherwise(F.when(r == "*", "I").otherwise("M"))
    each = F.flatten(
        F.transform("_ops", lambda o: F.when(o["op"].isin("M", "=", "X", "D", "N"), F.transform(F.slice("_r", (o["roff"] + 1).cast("int"), o["n"].cast("int")), lambda r: op(F.lit(1), column(r, o["op"])))).otherwise(F.array(op(o["n"], o["op"]))))
    )
    kept = F.filter(each, lambda o: o["op"] != "P")
    rows = rows.withColumn("cigar", F.when(F.col("refseq").isNull(), F.col("cigar")).otherwise(C.render_cigar(kept))).select(*reads.columns)
    rows = moved(rows, "rid", "pos")
    return (moved(rows, "mrid", "mpos") if "mrid" in reads.columns else rows).select(*reads.columns)


def reheader(reads: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """new, as the references of reads: it has to have as many rows as old, whatever their names; ids stay."""
    if old.count() != new.count():
        raise ValueError("the new header has another number of references")
    return reads


def quickcheck(spark, paths: list[str]) -> DataFrame:
    """path, problem: what makes each alignment text unfit to be read; null where nothing does. The header and the last line are looked at."""
    from strandlake.sources import sam

    out = []
    for path in paths:
        try:
            header = sam.read_header(spark, path)
            lines = spark.read.text(path)
            body = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
            bad = body.where(F.size(F.split("value", "\t")) < 11).limit(1).count()
            problem = "no references in the header" if not header.references() and not body.isEmpty() and not header.lines else "a line has fewer than eleven columns" if bad else None
        except Exception as error:  # any failure to read is what is reported
            problem = f"cannot be read: {type(error).__name__}"
        out.append((path, problem))
    return spark.createDataFrame(out, "path string, problem string")
