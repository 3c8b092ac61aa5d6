"""Operators that look at both ends of a template: mate repair, duplicate marking, pairs as BED rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import columns as C
from strandlake.operators import kernels
from strandlake.operators.select import range_join


def quality_score(least: int = 15) -> Column:
    """Sum of a read's qualities that reach least; where there are none, 255 for each base. Worked out batch by batch."""
    told = F.arrow_udf(lambda qual: kernels.quality_sums(least)(qual), "long")
    return F.when(F.col("qual").isNull(), F.length("seq").cast("long") * 255).otherwise(told("qual"))


def fixmate(reads: DataFrame, add_score: bool = True, check_proper: bool = True, remove: bool = False) -> DataFrame:
    """Primary rows of a template get each other's place, strand, MQ, MC, template length and, with add_score, ms; a single primary row loses its mate.

    Of more than two primary rows the first is paired with each other one in turn, so it keeps what the last gives it, and what any of
    them marks or takes from its flags. Supplementary rows get their mate's place and tags from the last primary row of the other end. check_proper: pairs that do not face each
    other on one reference are not proper; remove: secondary and unmapped rows are left out, with the bits that tell of them.
    """
    flag = F.col("flag")
    rows = reads.withColumns({"_primary": ~C.has(flag, C.SECONDARY | C.SUPPLEMENTARY), "_score": quality_score(), "_end": F.col("pos") + C.ref_span(F.col("cigar")), "_off": C.has(flag, C.UNMAP)})
    # One window a template: primary rows are numbered in input order, and the first, the last and the last of each end are looked up.
    whole = Window.partitionBy("src", "qname")
    rows = rows.withColumn("_k", F.when(F.col("_primary"), F.sum(F.col("_primary").cast("long")).over(whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    one = F.struct(F.col("_k").alias("k"), "rid", "pos", "flag", "mapq", "cigar", F.col("_score").alias("score"), F.col("_end").alias("end"), F.col("_off").alias("off"))
    among = lambda cond: F.max(F.when(F.col("_primary") & cond, one)).over(whole)
    rows = rows.withColumns({"_n": F.max("_k").over(whole), "_first": among(F.col("_k") == 1), "_last": among(F.lit(True)), "_one": among(~C.has(flag, C.READ2)), "_two": among(C.has(flag, C.READ2))})
    extra = C.has(flag, C.SUPPLEMENTARY) & C.has(flag, C.PAIRED) & (F.col("_n") >= 2)
    second = C.has(flag, C.READ2)
    source = F.when(F.col("_k") == 1, F.col("_last")).when(F.col("_k") > 1, F.col("_first")).when(extra & second, F.col("_one")).when(extra, F.col("_two"))
    rows = rows.withColumns({"_m": source, "_own": F.when(second, F.col("_two")).otherwise(F.col("_one")), "_pair": F.col("_primary") & (F.col("_n") >= 2)}).withColumn("_told", F.col("_pair") | extra & F.col("_m").isNotNull())
    pair, told, off, moff = F.col("_pair"), F.col("_told"), F.col("_off"), F.col("_m.off")
    five = lambda f, start, end: F.when(C.has(f, C.REVERSE), end).otherwise(start)
    mine, theirs = five(flag, F.col("pos"), F.col("_end")), five(F.col("_m.flag"), F.col("_m.pos"), F.col("_m.end"))
    same = pair & ~off & ~moff & (F.col("rid") == F.col("_m.rid"))
    back, mback = C.has(flag, C.REVERSE), C.has(F.col("_m.flag"), C.REVERSE)
    left, right = F.when(back, theirs).otherwise(F.col("pos")), F.when(back, F.col("_end")).otherwise(theirs)
    rows = rows.withColumn("_face", same & (back != mback) & (left < right))
    others = lambda what: F.max(F.when(F.col("_k") > 1, what.cast("int"))).over(whole) == 1
    rows = rows.withColumns({"_away": F.when(F.col("_k") == 1, others(~F.col("_face"))).otherwise(~F.col("_face")), "_gone": F.when(F.col("_k") == 1, others(off)).otherwise(moff)})
    # An unmapped row stands where its mapped mate stands; a supplementary row's unmapped mate stands with the row's own end.
    taken = pair & off & ~moff
    mrid = F.when(pair & moff & ~off, F.col("rid")).when(extra & moff & ~F.col("_own.off"), F.col("_own.rid")).otherwise(F.col("_m.rid"))
    mpos = F.when(pair & moff & ~off, F.col("pos")).when(extra & moff & ~F.col("_own.off"), F.col("_own.pos")).otherwise(F.col("_m.pos"))
    alone = F.col("_primary") & (F.col("_n") == 1)
    new = flag.bitwiseAND(F.lit(0xFFFF & ~C.MREVERSE)).bitwiseOR(F.when(mback, C.MREVERSE).otherwise(0)).bitwiseOR(F.when(F.col("_gone"), C.MUNMAP).otherwise(0))
    new = new.bitwiseOR(F.when(pair, C.PAIRED).otherwise(0)).bitwiseAND(F.when(pair & F.lit(check_proper) & F.col("_away"), 0xFFFF & ~C.PROPER).otherwise(0xFFFF))
    if remove:
        new = new.bitwiseAND(F.when(pair & F.col("_gone"), 0xFFFF & ~(C.MREVERSE | C.PROPER)).otherwise(0xFFFF))
    new = F.when(told, new).when(alone, flag.bitwiseAND(F.lit(0xFFFF & ~(C.MREVERSE | C.PROPER)))).otherwise(flag)
    out = rows if not remove else rows.where(~C.has(flag, C.SECONDARY | C.UNMAP))
    keep = lambda c: F.col(c) if c in reads.columns else F.lit(None)
    return out.select(
        "src", "ord", "qname", new.cast("long").alias("flag"), F.when(taken, F.col("_m.rid")).otherwise(F.col("rid")).alias("rid"), F.when(taken, F.col("_m.pos")).otherwise(F.col("pos")).alias("pos"),
        F.when(told, mrid).when(alone, -1).otherwise(F.col("mrid")).cast("long").alias("mrid"), F.when(told, mpos).when(alone, -1).otherwise(F.col("mpos")).cast("long").alias("mpos"),
        F.when(pair, F.when(same, theirs - mine).otherwise(0)).when(extra, F.coalesce(keep("tlen").cast("long"), F.lit(0))).otherwise(0).cast("long").alias("tlen"), F.when(told & ~moff, F.col("_m.mapq")).cast("long").alias("mq"),
        F.when(told & (~off | ~moff), F.col("_m.cigar")).alias("mc"), (F.when(pair, F.col("_m.score")) if add_score else F.lit(None)).cast("long").alias("ms"),
    )


def unclipped_five(flag, pos, cigar):
    """1-based place of a read's 5' end as if nothing were clipped."""
    return F.when(C.has(flag, C.REVERSE), pos + F.greatest(C.ref_span(cigar), F.lit(1)) + C.trail_clip(cigar)).otherwise(pos - C.lead_clip(cigar) + 1)


def markdup(reads: DataFrame, include_fails: bool = False, clear: bool = False, remove: bool = False) -> DataFrame:
    """reads with the bit for duplicates, set-based: pairs compete by both 5' ends and strands, single reads by their own.

    Rows that are secondary, supplementary or unmapped, and failed ones unless include_fails, pass unexamined. Of equal templates
    a passing one stays before a failed one, then the one with the higher sum of qualities, then the smaller name; a single read loses
    to any paired read of its place. clear: bits from before are taken off first; remove: duplicates are left out.
    Only narrow rows of examined reads are shuffled to find the losers, once by template and once by place, which then meet the reads.
    """
    flag = F.col("flag")
    if clear:
        reads = reads.withColumn("flag", flag.bitwiseAND(F.lit(0xFFFF & ~C.DUP)))
    skipped = C.SECONDARY | C.SUPPLEMENTARY | C.UNMAP | (0 if include_fails else C.QCFAIL)
    mated = C.has(flag, C.PAIRED) & ~C.has(flag, C.MUNMAP) & (F.col("mpos") >= 0) & (F.col("mcigar") != "*")
    rev, mrev = C.has(flag, C.REVERSE), C.has(flag, C.MREVERSE)
    mflag = F.when(mrev, C.REVERSE).otherwise(0).cast("long")
    paired = lambda c: F.when(mated, c)
    rows = reads.where(~C.has(flag, skipped)).select(
        "src", "ord", "qname", "rid", unclipped_five(flag, F.col("pos"), F.col("cigar")).alias("five"), rev.alias("rev"), mated.alias("mated"), paired(F.col("mrid")).alias("mrid"),
        paired(unclipped_five(mflag, F.col("mpos"), F.col("mcigar"))).alias("mfive"), paired(mrev).alias("mrev"), quality_score().alias("score"), C.has(flag, C.QCFAIL).alias("fail"),
    )
    total = F.sum(F.when(F.col("mated"), F.col("score"))).over(Window.partitionBy("src", "qname"))
    rows = rows.select("src", "ord", F.when(F.col("mated"), F.col("qname")).alias("name"), *["rid", "five", "rev", "mated", "mrid", "mfive", "mrev", "fail"], F.when(F.col("mated"), total).otherwise(F.col("score")).alias("score"))
    # A place is one task's rows. Single reads there lose to any pair, else they compete as pairs do.
    place = ["rid", "five", "rev"]
    rows = rows.withColumn("met", F.max("mated").over(Window.partitionBy(*place)))
    best = Window.partitionBy(*place, "mated", "mrid", "mfive", "mrev").orderBy("fail", F.desc("score"), "name", "src", "ord")
    lost = rows.withColumn("k", F.row_number().over(best)).where("k > 1 or met and not mated").select("src", "ord")
    out = reads.join(lost.withColumn("_lost", F.lit(C.DUP)), ["src", "ord"], "left")
    if remove:
        return out.where(F.col("_lost").isNull() & ~C.has(flag, C.DUP)).select(*reads.columns)
    return out.withColumn("flag", flag.bitwiseOR(F.coalesce("_lost", F.lit(0)))).select(*reads.columns)


def bed6(reads: DataFrame, names: DataFrame, split: bool = False) -> DataFrame:
    """chrom, start, end, name, score, strand of each mapped row, or of each of its blocks between skips (N)."""
    flag = F.col("flag")
    suffix = F.when(C.has(flag, C.READ1), "/1").when(C.has(flag, C.READ2), "/2").otherwise("")
    rows = reads.where((F.col("rid") >= 0) & ~C.has(flag, C.UNMAP)).join(names.select("rid", F.col("name").alias("chrom")), "rid")
    if split:
        ops = C.walk(F.col("cigar"))
        cuts = F.filter(ops, lambda o: o["op"] == "N")
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda o: o["roff"] + o["n"]))
        ends = F.concat(F.transform(cuts, lambda o: o["roff"]), F.array(C.ref_span(F.col("cigar"))))
        rows = rows.withColumn("_b", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b")))).withColumn("_s", F.col("pos") + F.col("_b.a")).withColumn("_e", F.col("pos") + F.col("_b.b"))
    else:
        rows = rows.withColumn("_s", F.col("pos")).withColumn("_e", F.col("pos") + C.ref_span(F.col("cigar")))
    return rows.select("chrom", F.col("_s").alias("start"), F.col("_e").alias("end"), F.concat("qname", suffix).alias("name"), F.col("mapq").alias("score"), F.when(C.has(flag, C.REVERSE), "-").otherwise("+").alias("strand"))


def bedpe(reads: DataFrame, names: DataFrame) -> DataFrame:
    """Both ends of each pair of primary rows in one row, the end that comes first by chromosome and start first; score is the lower MAPQ."""
    flag = F.col("flag")
    rows = reads.where(C.has(flag, C.PAIRED) & ~C.has(flag, C.SECONDARY | C.SUPPLEMENTARY)).join(names.select("rid", F.col("name").alias("chrom")), "rid", "left")
    off = C.has(flag, C.UNMAP) | (F.col("rid") < 0)
    end = F.struct(
        F.when(off, ".").otherwise(F.coalesce("chrom", F.lit("."))).alias("chrom"), F.when(off, -1).otherwise(F.col("pos")).cast("long").alias("start"), F.when(off, -1).otherwise(F.col("pos") + C.ref_span(F.col("cigar"))).cast("long").alias("end"),
        F.when(off, ".").when(C.has(flag, C.REVERSE), "-").otherwise("+").alias("strand"), "mapq",
    )
    both = rows.groupBy("src", "qname").agg(F.max(F.when(C.has(flag, C.READ1), end)).alias("a"), F.max(F.when(C.has(flag, C.READ2), end)).alias("b")).where("a is not null and b is not null")
    later = (F.col("a.chrom") == ".") | (F.col("b.chrom") != ".") & (F.struct("a.chrom", "a.start") > F.struct("b.chrom", "b.start"))
    both = both.where("a.chrom <> '.' or b.chrom <> '.'").select("src", "qname", F.when(later, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("y"))
    one = lambda s, k: [F.col(f"{s}.{c}").alias(f"{c}{k}") for c in ("chrom", "start", "end")]
    return both.select(*one("x", 1), *one("y", 2), F.col("qname").alias("name"), F.least("x.mapq", "y.mapq").alias("score"), F.col("x.strand").alias("strand1"), F.col("y.strand").alias("strand2"))


def clip_primers(reads: DataFrame, primers: DataFrame, tolerance: int = 5) -> DataFrame:
    """src, ord, clip, primer, pos: how many reference bases the primer (rid, start, end, strand, line) at a read's 5' end takes; the largest clip wins, then the first primer.

    The 5' end meets primers by bins of places, widened by the tolerance; a read is no more than one place here, so rows grow with matches only.
    """
    flag = F.col("flag")
    mapped = reads.where(~C.has(flag, C.UNMAP) & (F.col("rid") >= 0)).select("src", "ord", "rid", F.col("pos").alias("_first"), (F.col("pos") + C.ref_span(F.col("cigar"))).alias("_end"), C.has(flag, C.REVERSE).alias("_rev"))
    placed = mapped.withColumn("pos", F.when(F.col("_rev"), F.col("_end") - 1).otherwise(F.col("_first"))).withColumn("end", F.col("pos") + 1)
    back = F.col("strand") == "-"
    wide = primers.select("line", "rid", F.when(back, F.col("start")).otherwise(F.greatest(F.lit(0), F.col("start") - tolerance)).alias("start"), F.when(back, F.col("end") + tolerance).otherwise(F.col("end")).alias("end"))
    met = range_join(placed, wide).join(primers.select("line", F.col("start").alias("_a"), F.col("end").alias("_b"), back.alias("_back")), "line").where("_rev = _back")
    size = F.when(F.col("_rev"), F.col("_end") - F.col("_a")).otherwise(F.col("_b") - F.col("_first"))
    best = met.groupBy("src", "ord").agg(F.max(F.struct(size.alias("clip"), (-F.col("line")).alias("_l"), "_rev", F.col("_first").alias("pos"))).alias("m"))
    return best.select("src", "ord", F.col("m.clip").alias("clip"), (-F.col("m._l")).alias("primer"), F.when(F.col("m._rev"), F.col("m.pos")).otherwise(F.col("m.pos") + F.col("m.clip")).alias("pos"))


def clip_reads(reads: DataFrame, primers: DataFrame, tolerance: int = 5, hard: bool = False, fail_length: int | None = None, filter_length: int | None = None) -> DataFrame:
    """reads whose primer bases are clipped: CIGAR, place, and with hard clips SEQ and QUAL are rewritten, as long as a base is left on the reference.

    The clip covers clip reference bases from the 5' end; operations in it become one clip of their query bases, and insertions,
    deletions and skips that the cut would leave at the edge go with it. fail_length: reads of at most so many aligned and inserted
    bases are marked failed; filter_length: they are left out.
    """
    found = clip_primers(reads, primers, tolerance).select("src", "ord", "clip")
    rows = reads.join(found, ["src", "ord"], "left").withColumn("_clip", F.coalesce("clip", F.lit(0).cast("long"))).withColumn("_back", C.has(F.col("flag"), C.REVERSE))
    ops = C.cigar_ops(F.col("cigar"))
    rows = rows.withColumn("_ops", F.when(F.col("_back"), F.reverse(ops)).otherwise(ops)).withColumn("_span", C.total(F.col("_ops"), "MDN=X"))
    rows = rows.withColumn("_clip", F.when((F.col("_clip") > 0) & (F.col("_span") > 0), F.least("_clip", "_span")).otherwise(0).cast("long"))
    state = F.expr("struct(0L as cut, 0L as hard, 0L as soft, 0L as moved, false as done, cast(array() as array<struct<n:bigint,op:string>>) as kept)")

    def step(a: Column, o: Column) -> Column:
        refs, query = F.lit("MDN=X").contains(o["op"]), F.lit("MIS=X").contains(o["op"])
        left = F.col("_clip") - a["cut"]
        taken = F.when(refs, F.least(o["n"], left)).otherwise(0)  # reference bases of this operation that are cut
        both = refs & query
        whole = ~a["done"] & (F.lit("HS").contains(o["op"]) & (F.size(a["kept"]) == 0) | (left > 0) & ~refs | refs & (taken == o["n"]) | ~both & (left <= 0))
        part = ~a["done"] & ~whole & both
        rest = F.when(part, o["n"] - taken).otherwise(o["n"])
        return F.struct(
            (a["cut"] + F.when(whole | part, taken).otherwise(0)).alias("cut"),
            (a["hard"] + F.when(whole & (o["op"] == "H"), o["n"]).otherwise(0)).alias("hard"),
            (a["soft"] + F.when(whole & query, o["n"]).when(part, taken).otherwise(0)).alias("soft"),
            (a["moved"] + F.when(whole & refs, o["n"]).when(part, taken).otherwise(0)).alias("moved"),
            (a["done"] | ~whole).alias("done"),
            F.when(whole, a["kept"]).otherwise(F.concat(a["kept"], F.array(F.struct(rest.alias("n"), o["op"].alias("op"))))).alias("kept"),
        )

    rows = rows.withColumn("_c", F.aggregate("_ops", state, step))
    cut = F.col("_clip") > 0
    op = lambda n, letter: F.struct(n.alias("n"), F.lit(letter).alias("op"))
    ends = F.array(op(F.col("_c.hard") + F.col("_c.soft"), "H")) if hard else F.array(op(F.col("_c.hard"), "H"), op(F.col("_c.soft"), "S"))
    new = F.concat(ends, F.col("_c.kept"))
    new = F.when(F.col("_back"), F.reverse(new)).otherwise(new)
    # A read that is primer to its end keeps its clips only, without a place on the reference.
    rows = rows.withColumns({"cigar": F.when(cut, C.render_cigar(new)).otherwise(F.col("cigar")), "pos": F.when(cut & ~F.col("_back"), F.col("pos") + F.col("_c.moved")).otherwise(F.col("pos"))})
    if hard:
        n = F.col("_c.soft").cast("int")
        trim = lambda c: F.when(cut, F.when(F.col("_back"), F.substr(c, F.lit(1), F.length(c) - n)).otherwise(F.substr(c, n + 1))).otherwise(F.col(c))
        rows = rows.withColumns({"seq": trim("seq"), "qual": trim("qual")})
    length = C.total(C.cigar_ops(F.col("cigar")), "MI=X")
    if fail_length is not None:
        rows = rows.withColumn("flag", F.when(length <= fail_length, F.col("flag").bitwiseOR(F.lit(C.QCFAIL))).otherwise(F.col("flag")))
    if filter_length is not None:
        rows = rows.where(length > filter_length)
    return rows.select(*reads.columns)
