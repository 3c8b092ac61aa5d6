"""Statistics of amplicons: primers in pairs of left and right sites, reads told apart by the sites their ends lie on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import columns as C
from strandlake.operators.reports import _swept, depth
from strandlake.operators.select import HELD, ReadFilter

DEFAULT = ReadFilter(exclude_any=0xB04)


def amplicons(primers: DataFrame) -> DataFrame:
    """amp, rid, lefts, rights, min_left, max_left, min_right, max_right of primers(line, rid, start, end, strand) in their order.

    Left primers (+) and the right ones (-) that follow make an amplicon; the next left one begins another. Places are 0-based, ends exclusive;
    a site is where a read that holds its primer starts (lefts) or ends (rights). A primer panel is small by nature: a reference's rows are ordered in one task.
    """
    w = Window.partitionBy("rid").orderBy("line")
    rows = primers.withColumn("_new", ((F.col("strand") == "+") & (F.coalesce(F.lag("strand").over(w), F.lit("-")) == "-")).cast("long")).withColumn("_n", F.sum("_new").over(w))
    left, right = F.col("strand") == "+", F.col("strand") == "-"
    one = rows.groupBy("rid", "_n").agg(
        F.array_sort(F.collect_list(F.when(left, F.col("start")))).alias("lefts"), F.array_sort(F.collect_list(F.when(right, F.col("end")))).alias("rights"), F.min(F.when(left, F.col("start"))).alias("min_left"),
        F.max(F.when(left, F.col("end"))).alias("max_left"), F.min(F.when(right, F.col("start"))).alias("min_right"), F.max(F.when(right, F.col("end"))).alias("max_right"),
    )
    whole = one.where("size(lefts) > 0 and size(rights) > 0")
    return whole.withColumn("amp", F.row_number().over(Window.partitionBy("rid").orderBy("_n")).cast("long")).drop("_n")


def assigned(reads: DataFrame, amps: DataFrame, rule: ReadFilter = DEFAULT, margin: int = 30) -> DataFrame:
    """src, ord, rid, start, end, amp, other, status of each accepted read.

    amp: the last amplicon with a site within margin of the read's own end of the template (the end of reverse and unpaired reads, the start of others), null if there is none; other: the same for
    the template's other end; status: 0 both from one amplicon, 1 from two, 2 otherwise.
    """
    flag = F.col("flag")
    back, paired = C.has(flag, C.REVERSE), C.has(flag, C.PAIRED)
    rows = reads.where(rule.condition() & (F.col("rid") >= 0)).select("src", "ord", "rid", F.col("pos").alias("start"), (F.col("pos") + C.ref_span(F.col("cigar"))).alias("end"), back.alias("back"), paired.alias("paired"), "tlen").where("start < end")
    far = F.when(~F.col("paired"), F.col("start")).otherwise(F.when(F.col("back"), F.col("end")).otherwise(F.col("start")) + F.col("tlen"))
    rows = rows.withColumn("far", far)
    # An end is the base before it. Places that sites reach are few, and a read looks its two ends up there; of several amplicons the last stands at a place.
    by_end = F.col("back") | ~F.col("paired")
    far_end = F.col("paired") & ~F.col("back")
    known = ~F.col("paired") | (F.col("tlen") != 0) & (F.col("far") > 0)
    rows = rows.withColumns({"_right": by_end, "_at": F.when(by_end, F.col("end") - 1).otherwise(F.col("start")), "_oright": far_end, "_oat": F.when(known, F.when(far_end, F.col("far") - 1).otherwise(F.col("far")))})
    sites = amps.select("amp", "rid", F.inline(F.concat(F.transform("lefts", lambda p: F.struct(p.alias("p"), F.lit(False).alias("side"))), F.transform("rights", lambda p: F.struct((p - 1).alias("p"), F.lit(True).alias("side"))))))
    near = sites.select("amp", "rid", "side", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - margin), F.col("p") + margin)).alias("at")).groupBy("rid", "side", "at").agg(F.max("amp").alias("amp"))
    if near.limit(HELD + 1).count() <= HELD:
        near = F.broadcast(near)

    def look_up(rows: DataFrame, name: str, right: str, at: str) -> DataFrame:
        table = near.select(F.col("rid").alias("_rid"), F.col("side").alias("_side"), F.col("at").alias("_place"), F.col("amp").alias(name))
        return rows.join(table, (F.col("rid") == F.col("_rid")) & (F.col(right) == F.col("_side")) & (F.col(at) == F.col("_place")), "left").drop("_rid", "_side", "_place")

    out = look_up(look_up(rows, "amp", "_right", "_at"), "other", "_oright", "_oat")
    status = F.when(F.col("amp").isNull() | F.col("other").isNull(), 2).when(F.col("amp") == F.col("other"), 0).otherwise(1)
    return out.select("src", "ord", "rid", "start", "end", "far", "paired", "amp", "other", status.alias("status"))


def ampliconstats(reads: DataFrame, primers: DataFrame, rule: ReadFilter = DEFAULT, margin: int = 30, least: int = 1) -> DataFrame:
    """section, rid, amp, key, value: counts of one or several inputs together.

    SS: sequences, filtered, failed primer match, matching; READS: reads of each amplicon that reach between its primers; BASES: their bases there;
    AMP: reads by status; COVERED: bases between the primers with depth least or more from the amplicon's own reads, out of
    LENGTH; DEPTH: how many bases of the reference have each depth, bases under both mates once.
    """
    amps = amplicons(primers)
    told = assigned(reads, amps, rule, margin).join(amps.select("amp", "rid", "max_left", "min_right"), ["rid", "amp"], "left")
    a, b = F.greatest("start", "max_left"), F.least("end", "min_right")
    told = told.withColumns({"a": a, "b": b, "inside": F.col("amp").isNotNull() & (b > a)})
    counts = F.col("amp").isNotNull() & ((F.col("status") == 2) | (F.col("start") <= F.when(F.col("paired"), F.col("far")).otherwise(F.col("end"))))
    # Reads that count alike are one row from here on.
    alike = told.groupBy("rid", "amp", "status", "inside", counts.alias("counts"), F.when(F.col("inside"), F.col("a")).alias("a"), F.when(F.col("inside"), F.col("b")).alias("b")).agg(F.count("*").alias("n"))
    row = lambda section, key, value, amp=None: F.struct(F.lit(section).alias("section"), (F.lit(0) if amp is None else amp).cast("long").alias("amp"), key.cast("string").alias("key"), value.cast("long").alias("value"))
    n, amp, zero, inside = F.col("n"), F.col("amp"), F.lit(0), F.col("inside")
    ss = {k: F.lit(k) for k in ("sequences", "filtered", "failed primer match", "matching")}
    totals = reads.where("rid >= 0").groupBy("rid").agg(F.count("*").alias("all"), F.count_if(~rule.condition()).alias("out"))
    named = [row("SS", ss["sequences"], F.col("all")), row("SS", ss["filtered"], F.col("out")), row("SS", ss["failed primer match"], zero), row("SS", ss["matching"], zero)]
    told_rows = [
        row("SS", F.when(inside, ss["matching"]).otherwise(ss["failed primer match"]), n), F.when(inside, row("READS", F.lit("n"), n, amp)), F.when(inside, row("BASES", F.lit("n"), n * (F.col("b") - F.col("a")), amp)),
        F.when(F.col("counts"), row("AMP", F.col("status"), n, amp)),
    ]
    long = alike.select("rid", F.inline_outer(F.array_compact(F.array(*told_rows)))).unionByName(totals.select("rid", F.inline(F.array(*named))))
    out = long.groupBy("rid", "amp", "section", "key").agg(F.sum("value").alias("value")).select("rid", "amp", "section", "key", "value")
    marks = alike.where("inside").select("rid", "amp", F.col("a").alias("start"), F.col("b").alias("end"), n.alias("d"), F.lit(0).cast("long").alias("s"))
    deep = _swept(marks, ["rid", "amp"]).where((F.col("depth") >= least) & F.col("q").isNotNull()).groupBy("rid", "amp").agg(F.sum(F.col("q") - F.col("p")).alias("value"))
    out = out.unionByName(deep.select("rid", "amp", F.lit("COVERED").alias("section"), F.lit("n").alias("key"), "value"))
    out = out.unionByName(amps.select("rid", "amp", F.lit("LENGTH").alias("section"), F.lit("n").alias("key"), (F.col("min_right") - F.col("max_left")).alias("value")))
    depths = depth(reads, rule, once=True).groupBy("rid", "pos").agg(F.sum("depth").alias("d")).where("d > 0").groupBy("rid", "d").agg(F.count("*").alias("value"))
    return out.unionByName(depths.select("rid", F.lit(0).cast("long").alias("amp"), F.lit("DEPTH").alias("section"), F.col("d").cast("string").alias("key"), "value")).select("section", "rid", "amp", "key", "value")


def shares(stats: DataFrame) -> DataFrame:
    """rid, amp, percent, depth, covered: each amplicon's share of all matching reads, its mean depth and the part of it that is covered."""
    value: Column = F.sum("value")
    wide = stats.where("amp > 0").groupBy("rid", "amp").pivot("section", ["READS", "BASES", "COVERED", "LENGTH"]).agg(value).na.fill(0)
    total = stats.where("section = 'READS'").agg(F.sum("value").alias("total"))
    both = wide.join(F.broadcast(total), F.lit(True))  # one row
    return both.select("rid", "amp", F.round(F.try_divide(F.col("READS") * 100.0, F.col("total")), 3).alias("percent"), F.round(F.col("BASES") / F.greatest("LENGTH", F.lit(1)), 3).alias("depth"), F.round(F.col("COVERED") * 100.0 / F.greatest("LENGTH", F.lit(1)), 3).alias("covered"))
