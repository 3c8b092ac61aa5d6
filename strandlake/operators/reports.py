"""Counts and per-position reports: grouped aggregates, sweeps over CIGAR runs, and pileups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import columns as C
from strandlake.operators import kernels
from strandlake.operators.select import DEFAULT, ReadFilter, coalesced, range_join


def flagstat(reads: DataFrame) -> DataFrame:
    """A row for passing and for failing reads (category), a column a counter."""
    flag = F.col("flag")
    on = lambda bits: C.has(flag, bits)
    primary = ~on(C.SECONDARY) & ~on(C.SUPPLEMENTARY)
    paired = primary & on(C.PAIRED)
    both = paired & ~on(C.UNMAP) & ~on(C.MUNMAP)
    far = both & (F.col("rid") != F.col("mrid"))
    counters = {
        "total": F.lit(True), "secondary": on(C.SECONDARY), "supplementary": ~on(C.SECONDARY) & on(C.SUPPLEMENTARY), "primary_reads": primary, "mapped": ~on(C.UNMAP), "primary_mapped": primary & ~on(C.UNMAP),
        "duplicates": on(C.DUP), "primary_duplicates": primary & on(C.DUP), "paired": paired, "read1": paired & on(C.READ1), "read2": paired & on(C.READ2), "proper": paired & on(C.PROPER) & ~on(C.UNMAP),
        "both_mapped": both, "singletons": paired & ~on(C.UNMAP) & on(C.MUNMAP), "far": far, "far_mapq5": far & (F.col("mapq") >= 5) & (F.col("mapq") != 255),
    }
    fail = on(C.QCFAIL)
    both_rows = reads.agg(*[F.count_if(c & which).alias(f"{name}_{k}") for name, which in (("pass", ~fail), ("fail", fail)) for k, c in counters.items()])
    rows = [F.struct(F.lit(name).alias("category"), *[F.col(f"{name}_{k}").alias(k) for k in counters]) for name in ("pass", "fail")]
    return both_rows.select(F.inline(F.array(*rows)))


def flagstat_text(counts: DataFrame) -> DataFrame:
    """line, text: the lines of the printed report, passed and failed reads side by side, shares as per cent or N/A."""
    one = counts.agg(*[F.max(F.when(F.col("category") == name, F.col(k))).alias(f"{name}_{k}") for name in ("pass", "fail") for k in counts.columns if k != "category"])
    share = lambda name, a, b: F.when(F.col(f"{name}_{b}") == 0, "N/A").otherwise(F.format_string("%.2f%%", F.col(f"{name}_{a}") * 100.0 / F.col(f"{name}_{b}")))
    plain = {"total": "in total (QC-passed reads + QC-failed reads)", "primary_reads": "primary", "secondary": "secondary", "supplementary": "supplementary", "duplicates": "duplicates", "primary_duplicates": "primary duplicates"}
    lines = [(k, t, None) for k, t in plain.items()] + [("mapped", "mapped", "total"), ("primary_mapped", "primary mapped", "primary_reads"), ("paired", "paired in sequencing", None), ("read1", "read1", None), ("read2", "read2", None)]
    lines += [("proper", "properly paired", "paired"), ("both_mapped", "with itself and mate mapped", None), ("singletons", "singletons", "paired"), ("far", "with mate mapped to a different chr", None), ("far_mapq5", "with mate mapped to a different chr (mapQ>=5)", None)]
    text = [F.concat_ws(" ", F.concat_ws(" + ", F.col(f"pass_{k}").cast("string"), F.col(f"fail_{k}").cast("string")), F.lit(t), *([F.concat(F.lit("("), share("pass", k, of), F.lit(" : "), share("fail", k, of), F.lit(")"))] if of else [])) for k, t, of in lines]
    return one.select(F.posexplode(F.array(*text)).alias("line", "text"))


def idxstats(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """name, length, mapped, unmapped of each reference, and * for rows without a place."""
    off = C.has(F.col("flag"), C.UNMAP)
    counts = reads.groupBy("rid").agg(F.count_if(~off).alias("mapped"), F.count_if(off).alias("unmapped"))
    placed = refs.join(counts, "rid", "left").select("name", "length", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("mapped", "unmapped")])
    loose = reads.where("rid < 0").agg(F.count("*").alias("unmapped")).select(F.lit("*").alias("name"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("mapped"), "unmapped")
    return placed.unionByName(loose)


def aligned_runs(reads: DataFrame, kinds: str = "M=X") -> DataFrame:
    """A row for each CIGAR run whose letter is in kinds: op, start, end on the reference, qoff, n."""
    # The outer form, since Spark tests the input of the inner one for rows first and so computes it more than once.
    runs = reads.withColumn("_w", F.explode_outer(F.filter(C.walk(F.col("cigar")), lambda o: F.lit(kinds).contains(o["op"])))).where("_w is not null")
    return runs.select("*", F.col("_w.op").alias("op"), (F.col("pos") + F.col("_w.roff")).alias("start"), (F.col("pos") + F.col("_w.roff") + F.col("_w.n")).alias("end"), F.col("_w.qoff").alias("qoff"), F.col("_w.n").alias("n")).drop("_w")


def collapsed(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, cigar, times: reads that stand alike once, with how many they are, so that depth is worked out by places and not by reads."""
    return reads.groupBy(*keys, "pos", "cigar").agg(F.count("*").alias("times"))


#: Positions are swept in tiles, so that a reference is no single task's work.
TILE = 1 << 14


def _swept(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, q, depth, spans of marks(keys, start, end, d, s): what d and s sum to between one change and the next.

    Marks are cut at tiles; in each, starts and ends are summed and swept, so rows are made for changes, never for bases.
    """
    # Equal marks are added up first, where they lie.
    marks = marks.where("start < end").groupBy(*keys, "start", "end").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    tiles = marks.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / TILE), F.floor((F.col("end") - 1) / TILE))))
    cut = tiles.select(*keys, "tile", F.greatest("start", F.col("tile") * TILE).alias("a"), F.least("end", (F.col("tile") + 1) * TILE).alias("b"), "d", "s")
    events = cut.select(*keys, "tile", F.explode(F.array(F.struct(F.col("a").alias("p"), "d", "s"), F.struct(F.col("b").alias("p"), (-F.col("d")).alias("d"), (-F.col("s")).alias("s")))).alias("e"))
    steps = events.groupBy(*keys, "tile", F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"), F.sum("e.s").alias("s"))
    w = Window.partitionBy(*keys, "tile").orderBy("p")
    return steps.select(*keys, "p", F.sum("d").over(w).alias("depth"), F.sum("s").over(w).alias("spans"), F.lead("p").over(w).alias("q"))


def _after_mate(rows: DataFrame) -> DataFrame:
    """rows with _from, the place from which a read counts if bases under both mates count once: behind the end of the mate that came before it."""
    end = F.col("pos") + C.ref_span(F.col("cigar"))
    able = C.has(F.col("flag"), C.PAIRED) & ~C.has(F.col("flag"), C.MUNMAP)
    w = Window.partitionBy("src", "qname").orderBy("ord")
    rows = rows.withColumn("_able", able).withColumn("_k", F.when(able, F.sum(able.cast("int")).over(w)).otherwise(0))
    kept = F.when(F.col("_able") & ((F.col("mpos") < 0) | (F.col("mrid") == F.col("rid")) & (F.col("mpos") <= end)), end)
    before = F.max(F.when(F.col("_k") == 1, F.struct("rid", kept.alias("end")))).over(w)
    return rows.withColumn("_from", F.when((F.col("_k") == 2) & (before["rid"] == F.col("rid")), before["end"])).drop("_able", "_k")


def depth(
    reads: DataFrame, rule: ReadFilter = DEFAULT, min_baseq: int = 0, min_aligned: int = 0, deletions: bool = False, once: bool = False, references: DataFrame | None = None, everywhere: str | None = None, regions: DataFrame | None = None
) -> DataFrame:
    """src, rid, pos, depth at every position inside the span of an accepted read, deletions and skips counting nothing.

    min_baseq: bases below it do not count, bases without a quality do; min_aligned: least number of bases on the reference;
    deletions: deleted positions count, by the quality of the next base; once: bases under both mates count once; everywhere:
    "covered" for all positions of the references with data, "all" for those of all references; regions: only their positions.
    """
    mapped = reads.where(rule.condition() & (F.col("rid") >= 0) & ~C.has(F.col("flag"), C.UNMAP))
    if min_aligned:
        mapped = mapped.where(C.total(C.cigar_ops(F.col("cigar")), "MI=X") >= min_aligned)
    first = F.col("start")
    if once:
        mapped = _after_mate(mapped)
        first = F.greatest("start", F.coalesce("_from", "start"))
    one = lambda d, s: (F.lit(d).cast("long").alias("d"), F.lit(s).cast("long").alias("s"))
    alike = mapped.groupBy("src", "rid", "pos", "cigar", *(["_from"] if once else [])).agg(F.count("*").alias("times"))
    kinds = "M=XD" if deletions else "M=X"
    times, none = F.col("times").cast("long"), F.lit(0).cast("long")
    # Runs and spans are made of the same rows at once.
    mark = lambda start, end, d, s: F.struct(start.alias("start"), end.alias("end"), d.alias("d"), s.alias("s"))
    pos, since = F.col("pos"), F.coalesce("_from", "pos") if once else F.col("pos")
    runs = F.transform(F.filter(C.walk(F.col("cigar")), lambda o: F.lit(kinds).contains(o["op"])), lambda o: mark(F.greatest(pos + o["roff"], since), pos + o["roff"] + o["n"], times, none))
    marks = alike.select("src", "rid", F.inline_outer(F.concat(runs, F.array(mark(pos, pos + C.ref_span(F.col("cigar")), none, times)))))
    if min_baseq:
        counted = aligned_runs(mapped, kinds)
        low = lambda at: F.coalesce(F.ascii(F.substr("qual", (at + 1).cast("int"), F.lit(1))) - 33, F.lit(255)) < min_baseq
        bases = counted.where("op <> 'D'").withColumn("_i", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: low(F.col("qoff") + i))))
        lost = bases.withColumn("start", F.col("start") + F.col("_i")).withColumn("end", F.col("start") + 1).where(first == F.col("start")).select("src", "rid", "start", "end", *one(-1, 0))
        marks = marks.unionByName(lost)
        if deletions:
            marks = marks.unionByName(counted.where(F.col("op") == "D").where(low(F.col("qoff"))).select("src", "rid", first.alias("start"), "end", *one(-1, 0)))
    if everywhere:
        whole = references.select("rid", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), *one(0, 1))
        with_data = mapped.select("src", "rid").distinct()
        marks = marks.unionByName(whole.join(with_data, "rid") if everywhere == "covered" else whole.withColumn("src", F.lit(0).cast("long")))
    swept = _swept(marks, ["src", "rid"]).where("spans > 0")
    if regions is not None:
        inside = coalesced(regions).withColumn("line", F.monotonically_increasing_id())
        swept = range_join(swept.withColumnsRenamed({"p": "pos", "q": "end"}), inside).select("src", "rid", F.greatest("pos", "r_start").alias("p"), F.least("end", "r_end").alias("q"), "depth")
    return swept.select("src", "rid", F.explode(F.sequence(F.col("p"), F.col("q") - 1)).alias("pos"), "depth")


def depth_table(reads: DataFrame, inputs: list[int], rule: ReadFilter = DEFAULT) -> DataFrame:
    """rid, pos and a column depth_<src> of each input, 0 where only other inputs have a span."""
    columns = [F.coalesce(F.sum(F.when(F.col("src") == i, F.col("depth"))), F.lit(0)).cast("long").alias(f"depth_{i}") for i in inputs]
    return depth(reads, rule).groupBy("rid", "pos").agg(*columns)


#: Bases are made in tiles of so many positions: runs are dealt out by tile, so bases are grouped where they are made and never shuffled.
PILE = 1 << 10


def _tiled(runs: DataFrame) -> DataFrame:
    """runs(rid, start, end, ...) cut at tiles and dealt out by (rid, tile): cut_a, cut_b is the part in the tile."""
    tiles = runs.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / PILE), F.floor((F.col("end") - 1) / PILE))))
    cut = tiles.withColumn("cut_a", F.greatest("start", F.col("tile") * PILE)).withColumn("cut_b", F.least("end", (F.col("tile") + 1) * PILE))
    return cut.repartition("rid", "tile")


def pileup(reads: DataFrame, rule: ReadFilter = DEFAULT, kinds: str = "M=X") -> DataFrame:
    """A row for each aligned base (M, = or X): src, ord, rid, tile, p, base, bq, qpos, flag, mapq. An absent quality is 255; a deleted base (kinds with D) is *, a skipped one (with N) >."""
    runs = aligned_runs(reads.where(rule.condition() & (F.col("rid") >= 0)), kinds).where("n > 0")
    text = lambda c: F.substr(c, (F.col("qoff") + 1).cast("int"), F.col("n").cast("int"))
    narrow = runs.select("src", "ord", "rid", "start", "end", "qoff", "op", F.when(F.col("op") != "D", text("seq")).alias("bases"), F.when(F.col("op") != "D", text("qual")).alias("quals"), "flag", "mapq")
    rows = _tiled(narrow).withColumn("p", F.explode(F.sequence(F.col("cut_a"), F.col("cut_b") - 1)))
    at = (F.col("p") - F.col("start") + 1).cast("int")
    bq = F.coalesce((F.ascii(F.substr("quals", at, F.lit(1))) - 33).cast("long"), F.lit(255).cast("long"))
    return rows.select("src", "ord", "rid", "tile", "p", F.when(F.col("op") == "D", "*").when(F.col("op") == "N", ">").otherwise(F.substr("bases", at, F.lit(1))).alias("base"), bq.alias("bq"), (F.col("qoff") + F.col("p") - F.col("start")).alias("qpos"), "flag", "mapq")


def coverage(reads: DataFrame, refs: DataFrame, rule: ReadFilter = DEFAULT, min_baseq: int = 0, min_depth: int = 1) -> DataFrame:
    """Nine columns a reference; empty ones are reported too."""
    accepted = reads.where(rule.condition() & (F.col("rid") >= 0))
    by_read = accepted.groupBy("rid").agg(F.count("*").alias("numreads"), F.sum("mapq").alias("mapqs"))
    at = kernels.base_counts(accepted, base=False).where(F.col("bq") >= min_baseq).groupBy("rid", "p").agg(F.sum("n").alias("d"), F.sum(F.col("bq") * F.col("n")).alias("q")).where(F.col("d") >= min_depth)
    by_place = at.groupBy("rid").agg(F.count("*").alias("covbases"), F.sum("d").alias("bases"), F.sum("q").alias("quals"))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    mean = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0)).cast("double"), 4)
    out = refs.join(by_read, "rid", "left").join(by_place, "rid", "left")
    return out.select(
        F.col("name").alias("rname"), F.lit(1).cast("long").alias("startpos"), F.col("length").alias("endpos"), some(F.col("numreads")).alias("numreads"), some(F.col("covbases")).alias("covbases"),
        F.round(F.coalesce(F.col("covbases") * 100.0 / F.col("length"), F.lit(0.0)), 4).alias("coverage"), mean("bases", "length").alias("meandepth"), mean("quals", "bases").alias("meanbaseq"), mean("mapqs", "numreads").alias("meanmapq"),
    )


def bedcov(reads: DataFrame, regions: DataFrame, rule: ReadFilter = DEFAULT, skip_gaps: bool = False, at_least: int | None = None) -> DataFrame:
    """line, rid, start, end, cov, reads: depth summed over each region, and reads that overlap it; no base is exploded and no read meets a region.

    The sum of depths below a place x is x times the pieces open there, less the starts and plus the ends of pieces up to x. Running sums
    of these over starts and ends, by tile and then within a tile, are read at both ends of a region. Reads that overlap it
    are those that start before its end less those that end up to its start.
    at_least: a further column bases, how many positions of the region have that depth; gaps are left out then.
    """
    accepted = collapsed(reads.where(rule.condition() & (F.col("rid") >= 0)), ["rid"])
    kinds = "M=X" if skip_gaps or at_least is not None else "MDN=X"
    zero, times = F.lit(0).cast("long"), F.col("times").cast("long")
    pieces = aligned_runs(accepted, kinds).where("start < end")
    spans = accepted.select("rid", F.col("pos").alias("start"), (F.col("pos") + C.ref_span(F.col("cigar"))).alias("end"), "times").where("start < end")
    marks = pieces.select("rid", "start", "end", times.alias("d"), zero.alias("s"), zero.alias("b")).unionByName(spans.select("rid", "start", "end", zero.alias("d"), times.alias("s"), zero.alias("b")))
    if at_least is not None:
        runs = aligned_runs(accepted, "M=X").select("rid", "start", "end", times.alias("d"), zero.alias("s"))
        deep = _swept(runs, ["rid"]).where((F.col("depth") >= at_least) & F.col("q").isNotNull())
        marks = marks.unionByName(deep.select("rid", F.col("p").alias("start"), F.col("q").alias("end"), zero.alias("d"), zero.alias("s"), F.lit(1).cast("long").alias("b")))
    # d and b: what is open behind a place, of pieces and of deep places; s and e: reads that started and ended up to it; dp and bp: d and b times the place.
    sums = ("d", "s", "e", "b", "dp", "bp")
    mark = lambda p, rank, sign: F.struct(F.col(p).alias("p"), F.lit(rank).alias("rank"), (F.col("d") * sign).alias("d"), (F.col("s") if sign > 0 else zero).alias("s"), (F.col("s") if sign < 0 else zero).alias("e"), (F.col("b") * sign).alias("b"))
    tile = F.floor(F.col("p") / TILE)
    events = marks.select("rid", F.explode(F.array(mark("start", 2, 1), mark("end", 0, -1))).alias("m")).select("rid", "m.*").groupBy("rid", tile.alias("tile"), "p", "rank").agg(*[F.sum(c).alias(c) for c in "dseb"], F.sum(F.col("d") * F.col("p")).alias("dp"), F.sum(F.col("b") * F.col("p")).alias("bp"))
    # What stands up to a place is worked out once, however many regions begin or end there.
    ends = regions.where("start < end").select("line", "rid", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(-1).alias("sign")), F.struct(F.col("end").alias("p"), F.lit(1).alias("sign")))).alias("x")).select("line", "rid", "x.*")
    asked = ends.select("rid", "p").distinct()
    # Ends come before what is asked at a place, starts behind it.
    both = events.unionByName(asked.withColumns({"tile": tile, "rank": F.lit(1), **{c: zero for c in sums}}))
    inside = Window.partitionBy("rid", "tile").orderBy("p", "rank").rowsBetween(Window.unboundedPreceding, 0)
    local = both.select("rid", "tile", "rank", "p", *[F.sum(c).over(inside).alias(c) for c in sums]).where("rank = 1")
    # A row a tile: as many as a reference has tiles.
    whole = events.groupBy("rid", "tile").agg(*[F.sum(c).alias(f"{c}_t") for c in sums])
    wanted = whole.join(asked.select("rid", tile.alias("tile")).distinct(), ["rid", "tile"], "full").na.fill(0)
    before = Window.partitionBy("rid").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.select("rid", "tile", *[F.coalesce(F.sum(f"{c}_t").over(before), zero).alias(f"{c}_b") for c in sums])
    full = local.join(carried, ["rid", "tile"]).withColumns({c: F.col(c) + F.col(f"{c}_b") for c in sums})
    upto = full.select("rid", "p", "s", "e", (F.col("d") * F.col("p") - F.col("dp")).alias("under"), (F.col("b") * F.col("p") - F.col("bp")).alias("deep"))
    met = ends.join(upto, ["rid", "p"])
    sign = F.col("sign")
    out = met.groupBy("line").agg(F.sum(sign * F.col("under")).alias("cov"), F.sum(F.when(sign > 0, F.col("s")).otherwise(-F.col("e"))).alias("reads"), F.sum(sign * F.col("deep")).alias("bases"))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return regions.join(out, "line", "left").select("line", "rid", "start", "end", some("cov"), some("reads"), *([] if at_least is None else [some("bases")]))


def samples(reads: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """src, sample: distinct read groups in each input, or with groups(rg, sample) their samples; . where there is none."""
    if groups is None:
        return reads.select("src", F.coalesce("rg", F.lit(".")).alias("sample")).distinct()
    used = reads.select("src", "rg").distinct()
    return used.join(groups.select("rg", "sample"), "rg", "left").select("src", F.coalesce("sample", F.lit(".")).alias("sample")).distinct()


def matching_dictionary(references: DataFrame, known: DataFrame) -> DataFrame:
    """name of each of known(label, name, length, rid) whose whole dictionary is that of references, the last label first."""
    own = references.agg(F.array_sort(F.collect_list(F.struct("rid", "name", "length"))).alias("d"))  # a header: as many entries as there are references
    theirs = known.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rid", "name", "length"))).alias("d"))
    return theirs.join(own, "d").select("label").orderBy(F.desc("label"))


def flagstat_json(counts: DataFrame) -> DataFrame:
    """json: the counters of passed and failed reads as one object."""
    return counts.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct(*[c for c in counts.columns if c != "category"])))))).alias("json"))


MODULUS = 2**31 - 1
#: Rows folded into one at a time.
FAN_IN = 4096


def product_fold(values: Column) -> Column:
    """The product modulo 2^31 - 1 of values, those equal to 0 modulo it counting as 1; it does not depend on their order."""
    v = values.bitwiseAND(F.lit(MODULUS))
    return F.aggregate(F.collect_list(F.when((v == 0) | (v == MODULUS), 1).otherwise(v).cast("long")), F.lit(1).cast("long"), lambda a, x: a * x % MODULUS)


#: Tags summed by default and letters of CIGAR operations by code (fixed values).
SUMMED_TAGS, OP_CODES = ("BC", "FI", "QT", "RT", "TC"), "MIDNSHP=X"


def tag_bytes(tags: Column, names: tuple[str, ...]) -> Column:
    """The named tags a row has, in the order of names: name, type, value, whole numbers in the shortest type that holds them. Texts and whole numbers only."""

    def one(name: str) -> Column:
        tag = F.try_element_at(tags, F.lit(name))
        kind, text = tag["t"], tag["v"]
        n = text.try_cast("long")
        ranges = (("C", 1, n.between(0, 255)), ("S", 2, n.between(0, 65535)), ("I", 4, n >= 0), ("c", 1, n >= -128), ("s", 2, n >= -32768))
        short = F.concat(F.encode(F.lit("i"), "UTF-8"), C.little_endian(n, 4))
        for letter, size, fits in reversed(ranges):
            short = F.when(fits, F.concat(F.encode(F.lit(letter), "UTF-8"), C.little_endian(n, size))).otherwise(short)
        end = F.when(kind.isin("Z", "H"), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
        value = F.when(kind.isin("c", "C", "s", "S", "i", "I"), short).when(kind.isin("Z", "H", "A"), F.concat(F.encode(kind, "UTF-8"), F.encode(text, "UTF-8"), end)).otherwise(F.raise_error(F.lit("only texts and whole numbers are summed")).cast("binary"))
        return F.when(tag.isNull(), F.unhex(F.lit(""))).otherwise(F.concat(F.encode(F.lit(name), "UTF-8"), value))

    return F.concat(*[one(n) for n in names])


def checksum(
    reads: DataFrame, value: Column | None = None, rule: ReadFilter = ReadFilter(exclude_any=0x900), mask: int = 0xC1, places: bool = False, passed: bool = False, tags: tuple[str, ...] | None = None, ordered: bool = False
) -> DataFrame:
    """group, count, seq, name, qual: CRC-32 of each row on its own strand, folded by products, for all rows and each read group.

    places: columns pos, cigar (with the mapping quality) and mate too; tags: a column aux over the named tags of the column tags; passed: rows for passed (qc) and failed
    reads; ordered: each sum is joined with the row's index ord in its input, so that another order gives another result. An absent quality is a blank for each base.
    value replaces the CRCs, for engines that have none. Products are folded in levels of about FAN_IN rows, as many as the input needs, so no list grows with it.
    """
    strand = C.has(F.col("flag"), C.REVERSE)
    seq = F.when(strand, C.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    blank = F.repeat(F.lit(" "), F.coalesce(F.length("seq"), F.lit(0)))
    qual = F.coalesce(F.when(strand, F.reverse("qual")).otherwise(F.col("qual")), blank)
    head = F.unhex(F.lpad(F.hex(F.col("flag").bitwiseAND(F.lit(mask))), 2, "0"))
    text = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8")
    number = C.little_endian
    kinds = {"seq": F.concat(head, text(seq)), "name": F.concat(text(F.col("qname")), F.unhex(F.lit("00")), head, text(seq)), "qual": F.concat(head, text(seq), text(qual))}
    if tags is not None:
        kinds["aux"] = F.concat(kinds["seq"], tag_bytes(F.col("tags"), tags))
    if places:
        kinds["pos"] = F.concat(kinds["seq"], number(F.col("rid"), 4), number(F.col("pos"), 8))
        words = F.transform(C.cigar_ops(F.col("cigar")), lambda o: F.hex(number(o["n"] * 16 + F.instr(F.lit(OP_CODES), o["op"]) - 1, 4)))
        kinds["cigar"] = F.concat(kinds["seq"], number(F.col("mapq"), 4), F.unhex(F.array_join(words, "")))
        kinds["mate"] = F.concat(kinds["seq"], number(F.col("mrid"), 4), number(F.col("mpos"), 8), number(F.col("tlen"), 8))
    accepted = reads.where(rule.condition())
    mixed = lambda v: v.bitwiseXOR(F.crc32(number(F.col("ord"), 8))) if ordered else v
    columns = [mixed(F.crc32(b) if value is None else value).alias(k) for k, b in kinds.items()]
    parts = max(1, -(-accepted.count() // FAN_IN))
    which = F.when(C.has(F.col("flag"), C.QCFAIL), "fail").otherwise("pass")
    rows = accepted.select("rg", *([which.alias("qc")] if passed else []), F.pmod(F.xxhash64("src", "ord"), F.lit(parts)).alias("part"), F.lit(1).cast("long").alias("count"), *columns)
    keys = ["rg", "qc"] if passed else ["rg"]
    fold = lambda df, by: df.groupBy(*by).agg(F.sum("count").alias("count"), *[product_fold(F.col(k)).alias(k) for k in kinds])
    folded = fold(rows, [*keys, "part"])
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        folded = fold(folded.withColumn("part", F.pmod("part", F.lit(parts))), [*keys, "part"])
    groups = fold(folded, keys).withColumn("group", F.coalesce("rg", F.lit("-")))
    if not passed:
        everything = groups.agg(F.sum("count").alias("count"), *[product_fold(F.col(k)).alias(k) for k in kinds]).select(F.lit("all").alias("group"), F.coalesce("count", F.lit(0)).alias("count"), *kinds)
        return groups.select("group", "count", *kinds).unionByName(everything)
    # A row for passed reads, for failed ones and for both, of each group and of all.
    out = groups.select("group", "qc", "count", *kinds)
    out = out.unionByName(out.withColumn("qc", F.lit("all")))
    out = out.unionByName(out.withColumn("group", F.lit("all")))
    return fold(out, ["group", "qc"])


def merge_checksums(*reports: DataFrame) -> DataFrame:
    """One report of several inputs' reports with the same columns: counts are added and products multiplied group by group."""
    kinds = [c for c in reports[0].columns if c not in ("group", "qc", "count")]
    if any(set(r.columns) != set(reports[0].columns) for r in reports):
        raise ValueError("the reports have different columns")
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    keys = [c for c in ("group", "qc") if c in out.columns]
    return out.groupBy(*keys).agg(F.sum("count").alias("count"), *[product_fold(F.col(k)).alias(k) for k in kinds])


def combined_checksum(report: DataFrame) -> DataFrame:
    """The report with a column combined: the product of the count's halves and the columns, in which seq counts twice and qual not at all."""
    kinds = [c for c in report.columns if c not in ("group", "qc", "count", "qual", "name")]
    parts = [F.shiftright("count", 32), F.col("count").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("seq"), F.col("name"), *[F.col(k) for k in kinds]]
    one = lambda v: F.when((v.bitwiseAND(F.lit(MODULUS)) == 0) | (v.bitwiseAND(F.lit(MODULUS)) == MODULUS), 1).otherwise(v.bitwiseAND(F.lit(MODULUS))).cast("long")
    return report.withColumn("combined", F.aggregate(F.array(*[one(p) for p in parts]), F.lit(1).cast("long"), lambda a, x: a * x % MODULUS))


#: Sections of the statistics report.
SECTIONS = ("SN", "RL", "FRL", "LRL", "MAPQ", "GCF", "GCL", "IS", "FFQ", "LFQ", "FBC", "LBC", "ID", "IC", "COV")


def stats(reads: DataFrame, max_insert: int = 8000, once: bool = False, targets: DataFrame | None = None, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """section, key, value of the statistics report, in counts.

    sections: only these are worked out, each as in the whole report; once: bases under both mates count once in COV; targets: COV counts positions in these regions only.

    SN: summary numbers; FFQ, LFQ: qualities by cycle of first and last fragments (cycle:quality, 255 where there is none); GCF, GCL:
    how many of each end have each GC content (bases of length); FBC, LBC: bases by cycle (cycle:base); IS: insert sizes by orientation (size:in, out
    or other), each pair once; RL, FRL, LRL: lengths with hard clips; MAPQ; ID: indel lengths (I or D:length); IC: indels by cycle (cycle:I or D); COV: how many
    positions have each depth. Secondary rows count in their own line only, supplementary ones in theirs and in ID, IC and COV.
    """
    flag = F.col("flag")
    on = lambda bits: C.has(flag, bits)
    size_of = F.length("seq").cast("long")
    outs = []

    # One pass over the reads: what sums and lengths need of a read is one text (read), of which there are few different ones, and histograms have a text each.
    seen = lambda c: F.coalesce(c.cast("long"), F.lit(-1).cast("long"))
    scalars = {"flag": flag, "far": F.col("rid") != F.col("mrid"), "length": size_of, "mapq": F.col("mapq") if "MAPQ" in sections else F.col("mapq") != 0, "aligned": C.op_length(F.col("cigar"), "MI=X"), "hard": C.op_length(F.col("cigar"), "H")}
    original, paired = ~on(C.SECONDARY | C.SUPPLEMENTARY) & (size_of > 0), on(C.PAIRED)
    first = ~paired | on(C.READ1) & ~on(C.READ2)
    last = paired & on(C.READ2) & ~on(C.READ1)
    mapped, both = ~on(C.UNMAP), ~on(C.UNMAP) & paired & ~on(C.MUNMAP)
    gc = F.length("seq") - F.length(F.translate("seq", "GCgc", ""))
    size = F.least(F.abs(F.col("tlen")), F.lit(max_insert))
    step, far = F.when(on(C.READ1), 1).otherwise(-1), F.signum(F.col("mpos") - F.col("pos")).cast("int")
    inward = F.when(on(C.REVERSE), -step).otherwise(step) > 0
    kind = F.when(on(C.REVERSE) == on(C.MREVERSE), "other").when(step * far > 0, F.when(inward, "in").otherwise("out")).when(step * far < 0, F.when(inward, "out").otherwise("in")).otherwise("in")
    insert = both & original & ~((size == 0) & (F.col("rid") != F.col("mrid")))
    texts = {"GCF": (original & first, F.concat_ws(":", gc, size_of)), "GCL": (original & last, F.concat_ws(":", gc, size_of)), "IS": (insert, F.concat_ws(":", size, kind))}
    told = {k: F.when(cond, text) for k, (cond, text) in texts.items() if k in sections}
    if {"SN", "RL", "FRL", "LRL", "MAPQ"} & set(sections):
        told["read"] = F.when(flag.isNotNull(), F.concat_ws(":", *[seen(c) for c in scalars.values()]))
    quals, bases = {"FFQ", "LFQ"} & set(sections), {"FBC", "LBC"} & set(sections)
    if quals or bases:
        end = F.when(original & (first | last), F.when(last, "L").otherwise("F"))
        turned = reads.select(
            end.alias("end"), F.when(on(C.REVERSE), F.reverse("qual")).otherwise(F.col("qual")).alias("q"), F.length("seq").alias("size"), *[c.alias(k) for k, c in told.items()],
            *([F.when(on(C.REVERSE), C.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("b")] if bases else []),
        )
        counted = kernels.cycle_counts(turned, tuple(told)).where(F.col("section").isin(*told, *quals, *bases))
    elif told:
        entries = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("section"), c.alias("key"))) for k, c in told.items()]))
        counted = reads.select(F.inline_outer(entries)).where("section is not null").withColumn("n", F.lit(1).cast("long"))
    if told or quals or bases:
        counts = counted.groupBy("section", "key").agg(F.sum("n").alias("n"))
        got = F.split("key", ":")
        n, (flag, away, length, mapq, aligned, hard) = F.col("n"), (F.get(got, F.lit(i)).try_cast("long") for i in range(len(scalars)))
        is_read = lambda c: (F.col("section") == "read") & c
        on = lambda bits: C.has(flag, bits)
        original, paired = ~on(C.SECONDARY | C.SUPPLEMENTARY) & (length > 0), on(C.PAIRED)
        first = ~paired | on(C.READ1) & ~on(C.READ2)
        last = paired & on(C.READ2) & ~on(C.READ1)
        mapped, both = ~on(C.UNMAP), ~on(C.UNMAP) & paired & ~on(C.MUNMAP)
        sums = {
            "sequences": original, "1st fragments": original & first, "last fragments": original & last, "reads mapped": original & mapped, "reads mapped and paired": original & both, "reads unmapped": original & ~mapped,
            "reads properly paired": original & both & on(C.PROPER), "reads paired": original & paired, "reads duplicated": ~on(C.SECONDARY) & on(C.DUP), "reads MQ0": original & mapped & (mapq == 0), "reads QC failed": original & on(C.QCFAIL),
            "non-primary alignments": on(C.SECONDARY), "supplementary alignments": on(C.SUPPLEMENTARY) & ~on(C.SECONDARY), "pairs on different chromosomes": original & both & (away == 1),
        }
        lengths = {
            "total length": (original, length), "total first fragment length": (original & first, length), "total last fragment length": (original & last, length), "bases mapped": (original & mapped, length),
            "bases mapped (cigar)": (~on(C.SECONDARY) & mapped, aligned), "bases duplicated": (~on(C.SECONDARY) & on(C.DUP), length),
        }
        summed = {**{k: (c, n) for k, c in sums.items()}, **{k: (c, n * F.greatest(x, F.lit(0))) for k, (c, x) in lengths.items()}, "maximum length": (original, length)}
        full = F.when(hard >= 0, length + hard)
        row = lambda section, key, value: F.struct(section.alias("section"), key.cast("string").alias("key"), value.cast("long").alias("value"))
        rows = [F.when(is_read(c), row(F.lit("SN"), F.lit(k), value)) for k, (c, value) in summed.items()] if "SN" in sections else []
        named = {"RL": (original, full), "FRL": (original & first, full), "LRL": (original & last, full), "MAPQ": (~on(C.UNMAP | C.SECONDARY | C.SUPPLEMENTARY | C.QCFAIL | C.DUP), F.when(mapq >= 0, mapq))}
        rows += [F.when(is_read(c), row(F.lit(k), key, n)) for k, (c, key) in named.items() if k in sections]
        rows.append(F.when(F.col("section") != "read", row(F.col("section"), F.col("key"), n)))
        long = counts.select(F.inline_outer(F.array_compact(F.array(*rows)))).where("section is not null")
        if "SN" in sections:  # these lines are there without reads, too
            long = long.unionByName(reads.sparkSession.range(1).select(F.inline(F.array(*[row(F.lit("SN"), F.lit(k), F.lit(0)) for k in summed]))))
        every = long.groupBy("section", "key").agg(F.sum("value").alias("value"), F.max("value").alias("most"))
        value = F.when(F.col("section") == "IS", F.floor(F.col("value") / 2)).when((F.col("section") == "SN") & (F.col("key") == "maximum length"), F.col("most")).otherwise(F.col("value"))
        outs.append(every.select("section", "key", value.alias("value")))

    flag = F.col("flag")
    on = lambda bits: C.has(flag, bits)
    mapped = ~on(C.UNMAP)
    placed = reads.where(~on(C.SECONDARY) & mapped & (F.col("rid") >= 0))
    if {"ID", "IC"} & set(sections):
        gaps = aligned_runs(placed.where(F.col("cigar").rlike("[ID]")).groupBy("cigar", on(C.REVERSE).alias("back")).agg(F.count("*").alias("times")).withColumn("pos", F.lit(0).cast("long")), "ID")
        cycle = F.when(F.col("back"), C.query_length(F.col("cigar")) - F.col("qoff") - F.when(F.col("op") == "I", F.col("n")).otherwise(0)).otherwise(F.col("qoff")) + F.when(F.col("op") == "I", 1).otherwise(0)
        indels = gaps.select("times", F.inline(F.array(F.struct(F.lit("ID").alias("section"), F.concat_ws(":", "op", "n").alias("key")), F.struct(F.lit("IC").alias("section"), F.concat_ws(":", cycle, "op").alias("key")))))
        outs.append(indels.where(F.col("section").isin(*sections)).groupBy("section", "key").agg(F.sum("times").alias("value")))
    if "COV" in sections:
        alike = collapsed(_after_mate(placed), ["rid", "_from"]) if once else collapsed(placed, ["rid"])
        runs = aligned_runs(alike).withColumn("start", F.greatest("start", F.coalesce("_from", "start"))) if once else aligned_runs(alike)
        marks = runs.select("rid", "start", "end", F.col("times").cast("long").alias("d"), F.lit(0).cast("long").alias("s"))
        swept = _swept(marks, ["rid"]).where("depth > 0 and q is not null")
        if targets is not None:
            inside = coalesced(targets).withColumn("line", F.monotonically_increasing_id())
            swept = range_join(swept.withColumnsRenamed({"p": "pos", "q": "end"}), inside).select("rid", F.greatest("pos", "r_start").alias("p"), F.least("end", "r_end").alias("q"), "depth")
        outs.append(swept.groupBy(F.col("depth").cast("string").alias("key")).agg(F.sum(F.col("q") - F.col("p")).alias("value")).select(F.lit("COV").alias("section"), "key", "value"))
    out = outs[0]
    for more in outs[1:]:
        out = out.unionByName(more)
    return out


def read_sums(reads: DataFrame) -> DataFrame:
    """names, sequences, qualities: CRC-32 of each row's name, its bases in four bits each and its qualities (255 for each base where there are none), added up modulo 2^32."""
    codes = F.translate(F.upper("seq"), "=ACMGRSVTWYHKDBN", "0123456789abcdef")
    packed = F.unhex(F.concat(codes, F.when(F.length("seq") % 2 == 1, "0").otherwise("")))
    # Qualities as bytes: their letters moved down by 33.
    moved = F.encode(F.translate("qual", "".join(map(chr, range(33, 127))), "".join(map(chr, range(94)))), "UTF-8")
    absent = F.unhex(F.repeat(F.lit("ff"), F.coalesce(F.length("seq"), F.lit(0))))
    empty = F.unhex(F.lit(""))
    total = lambda b: F.pmod(F.coalesce(F.sum(F.crc32(b)), F.lit(0)), F.lit(2**32)).cast("long")
    return reads.agg(total(F.encode("qname", "UTF-8")).alias("names"), total(F.coalesce(packed, empty)).alias("sequences"), total(F.coalesce(moved, absent)).alias("qualities"))


#: Sections that the numbers of summary_lines are made of.
SUMMED = ("SN", "FRL", "LRL", "IS", "FFQ", "LFQ")


def _insert_runs(sizes: DataFrame, keys: list[str], bulk: float) -> DataFrame:
    """sizes(*keys, size, n) with taken, whether a size is taken for the bulk of all pairs, and _all and _mean, how many pairs are taken and their mean size.

    The histogram has a row for each size up to the greatest one reported, so one task orders it.
    """
    w = Window.partitionBy(*keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = sizes.withColumns({"upto": F.sum("n").over(w.orderBy("size")), "total": F.sum("n").over(whole)})
    run = run.withColumn("taken", F.coalesce(F.col("upto") - F.col("n") <= bulk * F.col("total"), F.lit(True)))
    of = lambda c: F.sum(F.when(F.col("taken"), c)).over(whole)
    run = run.withColumns({"_all": of(F.col("n")), "_mean": of(F.col("size") * F.col("n"))})
    return run.withColumn("_mean", F.col("_mean") / F.greatest("_all", F.lit(1)))


def _insert_numbers(taken: Column) -> tuple[Column, Column, Column, Column]:
    """n, end, mean, deviation over rows of _insert_runs."""
    n, size, mean = F.col("n"), F.col("size"), F.col("_mean")
    return (
        F.sum(F.when(taken, n)), F.max(F.when(taken & (n > 0), size + 1)), F.max(F.when(taken, mean)),
        F.sqrt(F.sum(F.when(taken & (size > 0), n * F.pow(size - mean, 2) / F.greatest("_all", F.lit(1))))),
    )


def summary_lines(report: DataFrame, bulk: float = 0.99) -> DataFrame:
    """key, value: the numbers that a statistics report's counts give: means, orientations, shares and the insert sizes' mean and deviation.

    The report, whose every use would count all reads anew, is read once: its rows are added up to one a number and one an insert size.
    """
    part = F.split("key", ":")
    section, second = F.col("section"), F.get(part, F.lit(1))
    quality = F.when(section.isin("FFQ", "LFQ") & (second != "255"), second.try_cast("long"))
    facing = lambda kind: F.coalesce(F.sum(F.when((section == "IS") & (second == kind), F.col("value"))), F.lit(0)).cast("long").alias(kind)
    what = F.when(section == "SN", F.concat_ws(" ", "section", "key")).when(section.isin("FFQ", "LFQ"), "FQ").otherwise(section)
    rows = report.where(section.isin(*SUMMED)).groupBy(what.alias("what"), F.when(section == "IS", F.get(part, F.lit(0)).cast("long")).alias("size")).agg(
        F.sum("value").alias("n"), F.sum(F.when(quality.isNotNull(), F.col("value"))).alias("known"), F.sum(quality * F.col("value")).alias("qualities"), F.max(F.when(section.isin("FRL", "LRL"), F.col("key").try_cast("long"))).alias("longest"), *[facing(k) for k in ("in", "out", "other")]
    )
    run = _insert_runs(rows, ["what"], bulk)
    of = lambda name, c: F.sum(F.when(F.col("what") == name, F.col(c)))
    sn = lambda key: of(f"SN {key}", "n")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    some = lambda c: F.coalesce(c, F.lit(0))
    _, _, mean, deviation = _insert_numbers((F.col("what") == "IS") & F.col("taken"))
    named = {
        "average length": ratio(sn("total length"), sn("sequences")), "average first fragment length": ratio(sn("total first fragment length"), sn("1st fragments")), "average last fragment length": ratio(sn("total last fragment length"), sn("last fragments")),
        "maximum first fragment length": some(of("FRL", "longest")), "maximum last fragment length": some(of("LRL", "longest")), "average quality": ratio(of("FQ", "qualities"), of("FQ", "known")),
        "inward oriented pairs": some(of("IS", "in")), "outward oriented pairs": some(of("IS", "out")), "pairs with other orientation": some(of("IS", "other")), "percentage of properly paired reads (%)": ratio(sn("reads properly paired") * 100, sn("sequences")),
        "insert size average": some(mean), "insert size standard deviation": some(deviation),
    }
    one = run.agg(*[F.round(c.cast("double"), 4).alias(k) for k, c in named.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in named])))


def insert_summary(stats: DataFrame, bulk: float = 0.99) -> DataFrame:
    """n, end, mean, deviation of the insert sizes in a statistics report: sizes are taken in order until more than the bulk of all pairs is reached. The report is read once."""
    sizes = stats.where("section = 'IS'").groupBy(F.split("key", ":")[0].cast("long").alias("size")).agg(F.sum("value").alias("n"))
    n, end, mean, deviation = _insert_numbers(F.col("taken"))
    one = _insert_runs(sizes, [], bulk).agg(n.alias("n"), end.alias("end"), mean.alias("mean"), deviation.alias("deviation"))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), "end", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


def mpileup(
    reads: DataFrame, rule: ReadFilter = DEFAULT, min_baseq: int = 13, anomalous: bool = False, max_depth: int | None = 8000, genome: DataFrame | None = None, everywhere: bool = False, references: DataFrame | None = None
) -> DataFrame:
    """rid, pos, ref, depth, bases, quals: the text pileup. Entries keep input order.

    anomalous: pairs that are not proper count too; max_depth: of a position's entries the first so many; genome: (rid, chunk, seq) as
    reference.chunks makes it, so that equal bases are . and , and deleted bases are named; everywhere: positions without reads, too.
    Each read writes its entries for a tile into one row; rows are dealt out by tile and read in input order, so that neither bases nor finished texts are shuffled.
    max_depth None: all of them.
    """
    flag = F.col("flag")
    proper = F.lit(True) if anomalous else ~(C.has(flag, C.PAIRED) & ~C.has(flag, C.PROPER))
    kept = reads.where(rule.condition() & proper & (F.col("rid") >= 0))
    from strandlake.operators.reference import CHUNK, whole, with_reference

    known = None if genome is None else whole(genome)
    entries = kernels.pile_entries(with_reference(kept, genome) if known and not known.whole else kept, known, CHUNK, min_baseq)
    none = F.lit("").cast("binary")
    row = lambda src, order, text: ["rid", "tile", F.lit(src).cast("long").alias("src"), order.cast("long").alias("ord"), text.alias("text"), none.alias("sizes"), none.alias("places"), none.alias("quals")]
    if genome is not None:
        own = genome.withColumn("seq", F.substr("seq", F.lit(1), F.lit(CHUNK))).where("length(seq) > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / kernels.TEXTS).cast("int"))))
        own = own.withColumn("tile", F.col("chunk") * (CHUNK // kernels.TEXTS) + F.col("_i"))
        entries = entries.unionByName(own.select(*row(-1, F.lit(0), F.substr("seq", F.col("_i") * kernels.TEXTS + 1, F.lit(kernels.TEXTS)).cast("binary"))))
    if everywhere:
        every = references.where("length > 0").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / kernels.TEXTS))))
        entries = entries.unionByName(every.select(*row(-2, F.col("length"), none)))
    return kernels.piled(entries, max_depth, everywhere)


#: IUPAC letters by the bits of A, C, G and T in them (fixed values), and with a base and a gap.
IUPAC, GAPPED = "NACMGRSVTWYHKDB", {1: "a", 2: "c", 4: "g", 8: "t"}


def within(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """line and the columns of calls(rid, pos, ...), 1-based places, for every region that holds the place."""
    rows = calls.withColumn("_pos", F.col("pos")).withColumn("pos", F.col("pos") - 1).withColumn("end", F.col("_pos"))
    return range_join(rows, regions).withColumn("pos", F.col("_pos")).select("line", *calls.columns)


def consensus(reads: DataFrame, rule: ReadFilter = DEFAULT, min_depth: int = 1, call_percent: int = 75, min_baseq: int = 0, use_quality: bool = False, ambiguous: bool = False, het_percent: int = 50) -> DataFrame:
    """rid, pos, depth, call, qual of the simple vote over A, C, G, T and the gap.

    A plain base votes 8 for itself, a letter for several bases shares its vote among them, a deleted base votes 8 for the gap, each times its quality with
    use_quality. The best is called, with ambiguous also the second if it reaches het_percent of the best, where the called votes are
    call_percent of all; else N, or * where the gap is best. Ties fall to the earlier one. qual is the called share of all votes.
    """
    seen = kernels.base_counts(reads.where(rule.condition() & (F.col("rid") >= 0)), "M=XD", quality=use_quality or min_baseq > 0).where(F.col("bq") >= min_baseq)
    bits = F.lit(0)
    for i, letter in enumerate(IUPAC[1:], 1):
        bits = F.when(F.upper("base") == letter, i).otherwise(bits)
    seen = seen.withColumn("_bits", F.when(F.col("base") == "*", 16).when(F.upper("base") == "N", 15).otherwise(bits))
    of = F.bit_count(F.col("_bits"))
    weight = F.when(of == 1, 8).when(of == 2, 4).when(of == 3, 2).otherwise(1) * (F.col("bq") if use_quality else F.lit(1))
    vote = lambda i: F.coalesce(F.sum(F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0, weight * F.col("n"))), F.lit(0)).cast("long").alias(f"v{i}")
    votes = seen.groupBy("rid", "p").agg(F.sum("n").alias("depth"), *[vote(i) for i in range(5)])
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"v{i}")).alias("v"), F.lit(1 << i).alias("bit")) for i in range(5)]), lambda x: x["v"] < 0))
    votes = votes.withColumns({"_total": sum((F.col(f"v{i}") for i in range(1, 5)), F.col("v0")), "_1": F.get(ranked, F.lit(0)), "_2": F.get(ranked, F.lit(1))})
    two = F.lit(ambiguous) & F.col("_2").isNotNull() & (F.col("_2.v") * 100 <= F.col("_1.v") * het_percent)
    votes = votes.withColumns({"_bit": F.col("_1.bit") + F.when(two, F.col("_2.bit")).otherwise(0), "_got": -(F.col("_1.v") + F.when(two, F.col("_2.v")).otherwise(0))})
    sure = (F.col("depth") >= min_depth) & (F.col("_got") * 100 >= F.col("_total") * call_percent)
    called = F.when(sure, F.col("_bit")).when(F.col("_1.bit") == 16, 16).otherwise(0)
    letter = F.when(called == 16, "*").when(called > 16, F.try_element_at(F.create_map(*[x for k, v in GAPPED.items() for x in (F.lit(16 + k), F.lit(v))]), called)).otherwise(F.substr(F.lit(IUPAC), called + 1, F.lit(1)))
    called = F.coalesce(called, F.lit(0))
    quality = F.when((called == 0) | (F.col("_total") == 0), 0).otherwise(F.least(F.lit(100), F.floor(F.col("_got") * 100 / F.col("_total"))))
    return votes.select("rid", (F.col("p") + 1).alias("pos"), "depth", F.coalesce(letter, F.lit("N")).alias("call"), quality.cast("long").alias("qual"))


def consensus_text(calls: DataFrame, references: DataFrame, show_gaps: bool = False, width: int = 70) -> DataFrame:
    """name, line, text: the lines of each reference's called sequence, N where no read is, gaps left out unless shown.

    Lines are made of letters numbered by running sums, tile by tile, so that no task holds a reference.
    """
    every = references.select("rid", "name", F.explode(F.sequence(F.lit(1).cast("long"), "length")).alias("pos"))
    letters = every.join(calls.select("rid", "pos", "call"), ["rid", "pos"], "left").withColumn("call", F.coalesce("call", F.lit("N")))
    if not show_gaps:
        letters = letters.where("call <> '*'")
    tiled = letters.withColumn("tile", F.floor(F.col("pos") / TILE))
    before = tiled.groupBy("rid", "tile").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("rid").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = tiled.withColumn("k", F.row_number().over(Window.partitionBy("rid", "tile").orderBy("pos"))).join(before.select("rid", "tile", "base"), ["rid", "tile"])
    at = F.col("k") + F.col("base") - 1
    lines = numbered.groupBy("name", F.floor(at / width).alias("line")).agg(F.array_sort(F.collect_list(F.struct("pos", "call"))).alias("x"))
    return lines.select("name", "line", F.array_join(F.transform("x", lambda x: x["call"]), "").alias("text"))


def index_bins(reads: DataFrame) -> DataFrame:
    """rid, bin, n, first, last: the R-tree bins of 16 kbp and up that alignments fall in, of the published BAI scheme."""
    end = F.col("pos") + F.greatest(C.ref_span(F.col("cigar")), F.lit(1)) - 1
    level = lambda shift: F.floor(F.col("pos") / (1 << shift)) == F.floor(end / (1 << shift))
    out = None
    for base, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        here = F.lit(base) + F.floor(F.col("pos") / (1 << shift))
        out = F.when(level(shift), here) if out is None else out.when(level(shift), here)
    return reads.where("rid >= 0").groupBy("rid", out.otherwise(0).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
