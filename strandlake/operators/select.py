"""Filters, projections, orders, unions and partitions of alignments."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import columns as C


@dataclass(frozen=True)
class ReadFilter:
    """Flag and quality predicates; commands differ in their defaults, so every field is explicit."""

    require_all: int = 0
    exclude_any: int = 0
    include_any: int = 0
    exclude_all: int = 0
    min_mapq: int = 0
    min_query_length: int = 0
    #: Only reads of just so many bases, where given.
    exact_length: int | None = None
    #: Whether the value 255 counts as missing: 255 for mapped rows and 0 for unmapped ones.
    missing_mapq: bool = False

    def condition(self) -> Column:
        flag = F.col("flag")
        out = F.lit(True)
        if self.require_all:
            out &= C.has_all(flag, self.require_all)
        if self.exclude_any:
            out &= ~C.has(flag, self.exclude_any)
        if self.include_any:
            out &= C.has(flag, self.include_any)
        if self.exclude_all:
            out &= ~C.has_all(flag, self.exclude_all)
        if self.min_mapq:
            mapq = F.when((F.col("mapq") == 255) & C.has(flag, C.UNMAP), 0).otherwise(F.col("mapq")) if self.missing_mapq else F.col("mapq")
            out &= mapq >= self.min_mapq
        if self.exact_length is not None:
            out &= F.length("seq") == self.exact_length
        if self.min_query_length:
            out &= C.query_length(F.col("cigar")) >= self.min_query_length
        return out


DEFAULT = ReadFilter(exclude_any=0x704)


def view(reads: DataFrame, rule: ReadFilter, read_groups: list[str] | None = None, add_flags: int = 0, remove_flags: int = 0) -> DataFrame:
    """Rows that pass; rows without a read group pass any list of groups. Flags are edited after filtering."""
    out = reads.where(rule.condition())
    if read_groups is not None:
        out = out.where(F.col("rg").isNull() | F.col("rg").isin(read_groups))
    return out.withColumn("flag", F.col("flag").bitwiseOR(F.lit(add_flags)).bitwiseAND(F.lit(~remove_flags & 0xFFFF)))


def of_library(reads: DataFrame, groups: DataFrame, library: str) -> DataFrame:
    """Rows whose read group, by groups(rg, library), is of the library; rows without one are not."""
    return reads.join(groups.where(F.col("library") == library).select("rg").distinct(), "rg", "left_semi").select(*reads.columns)


def with_tags(reads: DataFrame, keep: list[str] | None = None, remove: list[str] | None = None) -> DataFrame:
    """reads with only the tags to keep, or without those to remove; both at once is an error."""
    if keep is not None and remove is not None:
        raise ValueError("tags can be kept or removed, not both")
    names = keep if keep is not None else remove or []
    inside = lambda k: k.isin(names) if names else F.lit(False)
    return reads.withColumn("tags", F.map_filter("tags", lambda k, v: inside(k) if keep is not None else ~inside(k)))


def of_sample(reads: DataFrame, groups: DataFrame, value: str) -> DataFrame:
    """Rows whose read group's id or sample, by groups(rg, sample), is the value."""
    return reads.join(groups.where((F.col("rg") == value) | (F.col("sample") == value)).select("rg").distinct(), "rg", "left_semi").select(*reads.columns)


def view_strings(reads: DataFrame, references: DataFrame, regions: list[str]) -> DataFrame:
    """Rows that overlap each region string, in its order (line); * stands for rows without a place."""
    spark = reads.sparkSession
    parsed = [(i, *C.parse_region(r)) for i, r in enumerate(regions) if r != "*"]
    table = spark.createDataFrame(parsed, "line long, name string, start long, end long").join(references.select("rid", "name", "length"), "name", "left")
    checked = table.select("line", F.coalesce("rid", F.raise_error(F.concat(F.lit("unknown reference "), "name")).cast("long")).alias("rid"), "start", F.coalesce(F.least("end", "length"), "length").alias("end"))
    out = view_regions(reads, checked).select(*reads.columns, "line")
    for i, r in enumerate(regions):
        if r == "*":
            out = out.unionByName(reads.where("rid < 0").withColumn("line", F.lit(i).cast("long")))
    return out


def view_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows that overlap each region (line), once for each region: repeated and overlapping regions repeat rows.

    The result may hold a row for nearly every read and region, so no pair is made in vain. A region overlaps a read either because it
    covers the read's first position or because it begins at a later one; both are looked up in a tree of places (_nodes), where each
    pair meets in exactly one node. Regions that begin and end alike meet as one, and their lines are listed last. A task holds the
    rows of one read at a time.
    """
    real = regions.where("start < end").select("rid", "start", "end", "line")
    alike = real.groupBy("rid", "start", "end").agg(F.count("*").alias("n"))
    # The number of an interval is a hash that no two of them share: another seed is taken until that is so.
    for seed in itertools.count():
        kind = F.xxhash64(F.lit(seed), "rid", "start", "end").alias("_kind")
        nodes = F.sum(3 * LEVELS + F.floor((F.col("end") - F.col("start")) / BIN))
        told = alike.select("*", kind).agg(F.count("*").alias("kinds"), F.count_distinct("_kind").alias("hashes"), F.sum("n").alias("lines"), F.max("n").alias("most"), nodes.alias("nodes")).first()
        if told.kinds == told.hashes:
            break
    lines = told.lines or 0
    held = F.broadcast if max(lines, told.nodes or 0) <= HELD_NUMBERS else lambda df: df
    part = F.pmod(F.xxhash64("line"), F.lit(1 + (told.most or 0) // LISTED))
    listed = real.groupBy(kind.alias("_of"), part.alias("_part")).agg(F.collect_list("line").alias("_lines")).drop("_part")
    at = _nodes(alike.select("rid", "start", "end", kind), "start", "end", 0, "start").groupBy(F.col("rid").alias("_rid"), F.col("_node").alias("_at")).agg(F.collect_list("_kind").alias("_kinds"))

    placed = reads.where("rid >= 0")
    if lines > DEALT * reads.sparkSession.sparkContext.defaultParallelism:  # what is made of a read grows with the regions, so the tasks are made smaller
        placed = placed.repartition(lines // DEALT)
    placed = placed.withColumn("_end", F.col("pos") + F.greatest(C.ref_span(F.col("cigar")), F.lit(1)))
    met = _nodes(placed, "pos + 1", "_end", 1, "pos").join(held(at), (F.col("rid") == F.col("_rid")) & (F.col("_node") == F.col("_at")))
    met = met.select(*reads.columns, F.explode("_kinds").alias("_kind")).join(held(listed), F.col("_kind") == F.col("_of"))
    return met.select(*reads.columns, F.explode("_lines").alias("line"))


BIN = 1024
#: Levels of the tree of places: nodes of 1, 2, 4 and so on up to BIN positions.
LEVELS = 11
#: Numbers in the lists of regions' lines, or in those of nodes, that are broadcast at most.
HELD_NUMBERS = 1 << 23
#: Lines in a list, about; regions for each task that reads are dealt to.
LISTED, DEALT = 1 << 20, 1024
#: Bins of disjoint intervals that are broadcast at most.
HELD = 1 << 14


def _nodes(rows: DataFrame, start: str, end: str, kind: int, point: str) -> DataFrame:
    """rows, once for each _node: those of the kind that make up the places from start to end, disjoint and as large as they can be, and those of the other kind (0 or 1) that hold the point."""
    code = lambda place, of: f"({place}) * {2 * LEVELS} + 2 * _level + {of}"
    low, high, held = code("_low", kind), code("_high - 1", kind), code(f"shiftright({point}, _level)", 1 - kind)
    ends = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumns({"_low": F.expr(f"shiftright({start} + shiftleft(1L, _level) - 1, _level)"), "_high": F.expr(f"shiftright({end}, _level)")})
    edges = f"array({held}, IF(_low < _high AND _low % 2 <> 0, {low}, NULL), IF(_low < _high AND _high % 2 <> 0, {high}, NULL))"
    nodes = f"IF(_level = {LEVELS - 1} AND _low < _high, concat(array({held}), sequence({low}, {high}, {2 * LEVELS}L)), {edges})"
    return ends.withColumn("_node", F.explode(F.expr(nodes))).where("_node IS NOT NULL").drop("_level", "_low", "_high")


def range_join(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """spans(rid, pos, end) with the line, start and end (r_start, r_end) of every region they overlap."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor((b - 1) / BIN)))
    left = spans.withColumn("_bin", bins(F.col("pos"), F.col("end")))
    right = regions.where("start < end").select("line", F.col("rid").alias("_rid"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), bins(F.col("start"), F.col("end")).alias("_rbin"))
    met = (F.col("rid") == F.col("_rid")) & (F.col("_bin") == F.col("_rbin")) & (F.col("pos") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    once = F.floor(F.greatest("pos", "r_start") / BIN) == F.col("_bin")
    return left.join(right, met & once).drop("_bin", "_rbin", "_rid")


def by_names(reads: DataFrame, names: DataFrame, negate: bool = False) -> DataFrame:
    return reads.join(names.select("qname").distinct(), "qname", "left_anti" if negate else "left_semi")


def sort_keys(order: str) -> list[Column]:
    """Sort columns of an order: coordinate (no position last), natural or bytewise names, or template coordinate."""
    flag = F.col("flag")
    if order == "coordinate":
        return [F.when(F.col("rid") < 0, 2**31 - 1).otherwise(F.col("rid")), F.col("pos"), C.has(flag, C.REVERSE), F.col("src"), F.col("ord")]
    if order == "natural":
        return [C.natural_key(F.col("qname")), F.col("qname"), C.flag_rank(flag), F.col("src"), F.col("ord")]
    if order == "bytewise":
        return [F.col("qname"), C.flag_rank(flag), F.col("src"), F.col("ord")]
    if order == "template":
        return [*template_keys(), F.col("src"), F.col("ord")]
    raise ValueError(f"unknown order {order!r}")


def template_keys() -> list[Column]:
    """Both 5' ends of a template, soft clips counted as aligned, the earlier end first; then strands, cell and molecule tags, the name, and whether the row is the later end.

    Needs the columns mrid, mpos, mcigar (the mate's CIGAR) and takes the tags CB, MI and the library where there are any.
    """
    flag = F.col("flag")

    def end(rid: Column, pos: Column, cigar: Column, reverse: Column, off: Column) -> Column:
        five = F.when(reverse, pos + C.ref_span(cigar) - 1 + C.soft_trail(cigar)).otherwise(pos - C.soft_lead(cigar))
        last = F.lit(2**31 - 1).cast("long")
        return F.struct(F.when(off | (rid < 0), last).otherwise(rid).alias("rid"), F.when(off | (rid < 0), last).otherwise(five).alias("five"), (~reverse).alias("strand"))

    mine = end(F.col("rid"), F.col("pos"), F.col("cigar"), C.has(flag, C.REVERSE), C.has(flag, C.UNMAP))
    none = ~C.has(flag, C.PAIRED) | C.has(flag, C.MUNMAP)
    other = end(F.col("mrid"), F.col("mpos"), F.col("mcigar"), C.has(flag, C.MREVERSE), none)
    low, high = F.least(mine, other), F.greatest(mine, other)
    return [low["rid"], high["rid"], low["five"], high["five"], low["strand"], high["strand"], F.col("qname"), mine > other]


def sort(reads: DataFrame, order: str = "coordinate") -> DataFrame:
    """reads in order. Keys are computed once a row, before rows are sampled and sorted."""
    keys = [k.alias(f"_key{i}") for i, k in enumerate(sort_keys(order))]
    return reads.select("*", *keys).orderBy(*[f"_key{i}" for i in range(len(keys))]).select(*reads.columns)


def collate(reads: DataFrame) -> DataFrame:
    """Rows of a name together, in no order between names."""
    return reads.repartition("qname").sortWithinPartitions(F.xxhash64("qname"), "qname", C.flag_rank(F.col("flag")), "src", "ord")


#: Rows of a dictionary or of read groups up to which it is broadcast.
SMALL_HEADER = 100_000


def merge(parts: list[tuple[DataFrame, DataFrame]], order: str = "coordinate") -> tuple[DataFrame, DataFrame]:
    """(reads, references) of inputs with their own dictionaries: references are joined by name, ids of reads and mates translated.

    A name with two lengths is an error. Read groups of one id in two inputs stay apart: from the second input on, a taken id gets the input's number.
    """
    dictionaries, taken = None, None
    for i, (reads, refs) in enumerate(parts):
        here = refs.select("name", "length", F.lit(i).alias("_input"), F.col("rid").alias("_rid"))
        dictionaries = here if dictionaries is None else dictionaries.unionByName(here)
        groups = reads.where("rg is not null").select("rg", F.lit(i).alias("_input")).distinct()
        taken = groups if taken is None else taken.unionByName(groups)
    first = dictionaries.groupBy("name").agg(F.min(F.struct("_input", "_rid", "length")).alias("m"), F.max("length").alias("longest"), F.min("length").alias("shortest"))
    checked = F.when(F.col("longest") == F.col("shortest"), F.col("m.length")).otherwise(F.raise_error(F.concat(F.lit("two lengths of "), "name")).cast("long"))
    # The dictionary is a header: as many rows as there are references.
    merged = first.select("name", "m._input", "m._rid", checked.alias("length")).withColumn("rid", F.row_number().over(Window.orderBy("_input", "_rid")).cast("long") - 1)
    owner = taken.groupBy("rg").agg(F.min("_input").alias("_owner"))
    # Headers are sent to every task where they are known to be small, and dealt out by key where they are not.
    near = F.broadcast if dictionaries.count() <= SMALL_HEADER and owner.count() <= SMALL_HEADER else lambda df: df
    out = None
    for i, (reads, refs) in enumerate(parts):
        to = refs.join(merged.select("name", F.col("rid").alias("_to")), "name").select(F.col("rid").alias("_from"), "_to")
        here = reads
        for c in ("rid", "mrid"):
            if c in reads.columns:
                here = here.join(near(to), F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", F.lit(-1).cast("long"))).drop("_from", "_to")
        here = here.join(near(owner.withColumnRenamed("rg", "_rg")), F.col("rg") == F.col("_rg"), "left").withColumn("rg", F.when(F.col("_owner") < i, F.concat("rg", F.lit(f".{i}"))).otherwise(F.col("rg"))).select(*reads.columns)
        out = here if out is None else out.unionByName(here)
    return sort(out, order), merged.select("rid", "name", "length")


def check_order(reads: DataFrame, order: str = "coordinate") -> DataFrame:
    """src, ord of each row that stands behind one that should follow it in its input. Rows are compared with the one before in tiles of ord."""
    keys = F.struct(*sort_keys(order)[:-2])
    tile = F.floor(F.col("ord") / (1 << 16))
    rows = reads.select("src", "ord", keys.alias("k"), tile.alias("tile"))
    # The last row of a tile is also the first of the next.
    edges = rows.groupBy("src", "tile").agg(F.max(F.struct("ord", "k")).alias("m")).select("src", "m.ord", "m.k", (F.col("tile") + 1).alias("tile"))
    w = Window.partitionBy("src", "tile").orderBy("ord")
    return rows.unionByName(edges).withColumn("before", F.lag("k").over(w)).where("before > k").select("src", "ord")


def head(reads: DataFrame, n: int) -> DataFrame:
    return reads.orderBy("src", "ord").limit(n)


def _part_sql(index: str, parts: int, seed: int) -> str:
    """SplitMix64 of Steele, Lea and Flood modulo parts, in 64-bit arithmetic of halves, since products of longs must not overflow.

    Its state is the seed plus a multiple of the golden gamma, so a part depends on the row's index alone.
    """

    def times(x: str, m: int) -> str:
        # x * m modulo 2^64 from 32-bit halves: high * m_low + low * m_high matter in their low 32 bits only.
        low, high = m & 0xFFFFFFFF, m >> 32
        a, b = f"({x} & 4294967295L)", f"shiftrightunsigned({x}, 32)"
        wide = lambda p, q: f"(cast({p} as decimal(20,0)) * {q}BD)"
        whole = f"({wide(a, low)} + (({wide(a, high)} + {wide(b, low)}) % 4294967296BD) * 4294967296BD) % 18446744073709551616BD"
        return _signed(whole)

    def _signed(d: str) -> str:
        return f"transform(array({d}), d -> cast(if(d >= 9223372036854775808BD, d - 18446744073709551616BD, d) as bigint))[0]"

    def bind(value: str, body: str) -> str:
        return f"transform(array({value}), x -> {body})[0]"

    start = _signed(f"(cast({seed % 2**64} as decimal(20,0)) + (cast({index} as decimal(20,0)) + 1BD) * 11400714819323198485BD) % 18446744073709551616BD")
    out = bind(start, times("(x ^ shiftrightunsigned(x, 30))", 0xBF58476D1CE4E5B9))
    out = bind(out, times("(x ^ shiftrightunsigned(x, 27))", 0x94D049BB133111EB))
    out = bind(out, "(x ^ shiftrightunsigned(x, 31))")
    return bind(out, f"cast(if(x < 0, cast(x as decimal(20,0)) + 18446744073709551616BD, cast(x as decimal(20,0))) % {parts}BD as bigint)")


def input_index(reads: DataFrame) -> DataFrame:
    """reads with ord as the number of the row in its input, by tiles of ord: rows are counted a tile at a time, so no task holds an input."""
    tile = F.floor(F.col("ord") / (1 << 20))
    rows = reads.withColumn("_tile", tile)
    base = rows.groupBy("src", "_tile").agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    placed = rows.join(base.select("src", "_tile", "_base"), ["src", "_tile"])
    return placed.withColumn("ord", F.row_number().over(Window.partitionBy("src", "_tile").orderBy("ord")) + F.col("_base") - 1).select(*reads.columns)


def split_label(mode: str, parts: int = 2, seed: int = 0) -> Column:
    """The output that a row goes to: its read group, its mate number, or one of parts by a counter-based generator over ord."""
    if mode == "read_group":
        return F.coalesce("rg", F.lit("unaccounted"))
    if mode == "mates":
        flag = F.col("flag")
        return F.when(C.has(flag, C.UNMAP), "unmap").when(C.has(flag, C.READ1), "R1").when(C.has(flag, C.READ2), "R2").otherwise("R1")
    if mode == "parts":
        return F.expr(_part_sql("ord", parts, seed)).cast("string")
    raise ValueError(f"unknown mode {mode!r}")


def in_genes(reads: DataFrame, exons: DataFrame) -> DataFrame:
    """reads with label 0 (the leftmost start of read or mate lies in an exon), 1 (it does not), 2 (unmapped).

    Exons are joined to disjoint ones and gathered by bin, at most BIN / 2 in each, so that a read meets one row and looks its place up there.
    """
    at = F.when((F.col("mrid") == F.col("rid")) & (F.col("mpos") >= 0), F.least("pos", "mpos")).otherwise(F.col("pos"))
    cut = coalesced(exons).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))))
    inside = cut.groupBy(F.col("rid").alias("_rid"), "_bin").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_in"))
    if inside.limit(HELD + 1).count() <= HELD:
        inside = F.broadcast(inside)
    placed = reads.withColumn("_at", at)
    met = placed.join(inside, (F.col("rid") == F.col("_rid")) & (F.floor(F.col("_at") / BIN) == F.col("_bin")), "left")
    hit = (F.col("rid") >= 0) & F.coalesce(F.exists("_in", lambda x: (x["start"] <= F.col("_at")) & (F.col("_at") < x["end"])), F.lit(False))
    return met.withColumn("label", F.when(C.has(F.col("flag"), C.UNMAP), 2).when(hit, 0).otherwise(1)).select(*reads.columns, "label")


def coalesced(regions: DataFrame, gap: int = 0) -> DataFrame:
    """rid, start, end: the union of intervals; touching ones merge."""
    # Of intervals that start together the longest tells all, so that a reference's rows are no more than its places.
    regions = regions.where("start < end").groupBy("rid", "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy("rid").orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = regions.withColumn("_new", F.when(F.col("start") <= top + gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy("rid", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def intersected(a: DataFrame, b: DataFrame) -> DataFrame:
    """rid, start, end: the places in both of two sets of intervals, as disjoint intervals."""
    left = coalesced(a).select("rid", F.col("start").alias("pos"), "end")
    met = range_join(left, coalesced(b).withColumn("line", F.monotonically_increasing_id()))
    return met.select("rid", F.greatest("pos", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    """rid, start, end: the places of the first set of intervals that are not in the second.

    Each interval of the first is cut at those of the second that it meets; an interval that meets none stays whole.
    """
    left = coalesced(a).withColumn("_id", F.monotonically_increasing_id())
    met = range_join(left.select("rid", F.col("start").alias("pos"), "end", "_id"), coalesced(b).withColumn("line", F.monotonically_increasing_id()))
    w = Window.partitionBy("_id").orderBy("r_start")
    gaps = met.select("_id", "rid", "pos", "end", "r_start", "r_end", F.coalesce(F.lag("r_end").over(w), "pos").alias("from"), F.lead("r_start").over(w).alias("next"))
    # Before each cut, and behind the last one.
    pieces = gaps.select("rid", F.inline(F.array(F.struct(F.col("from").alias("start"), F.col("r_start").alias("end")), F.when(F.col("next").isNull(), F.struct(F.col("r_end").alias("start"), F.col("end").alias("end")))))).where("start < end")
    return pieces.unionByName(left.join(met.select("_id").distinct(), "_id", "left_anti").select("rid", "start", "end"))


def reset(reads: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Back to unaligned reads: primary rows, on their own strand, without places."""
    flag = F.col("flag")
    strand = C.has(flag, C.REVERSE)
    clear = C.PROPER | C.MREVERSE | C.REVERSE | (0 if keep_duplicates else C.DUP)
    new = flag.bitwiseAND(F.lit(~clear & 0xFFFF)).bitwiseOR(F.lit(C.UNMAP)).bitwiseOR(F.when(C.has(flag, C.PAIRED), C.MUNMAP).otherwise(0))
    return reads.where(~C.has(flag, C.SECONDARY | C.SUPPLEMENTARY)).select(
        "src", "ord", "qname", new.alias("flag"), F.lit(-1).cast("long").alias("rid"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("mapq"), F.lit("*").alias("cigar"),
        F.when(strand, C.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(strand, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), "rg",
    )


def set_read_group(reads: DataFrame, group: str, mode: str = "overwrite_all") -> DataFrame:
    if mode not in ("overwrite_all", "orphan_only"):
        raise ValueError(f"unknown mode {mode!r}")
    return reads.withColumn("rg", F.lit(group) if mode == "overwrite_all" else F.coalesce("rg", F.lit(group)))


def sequences(reads: DataFrame, rule: ReadFilter = ReadFilter(exclude_any=0x900)) -> DataFrame:
    """name, seq, qual: one row of each name and end (0, 1, 2), the first with qualities or else the first, on its own strand."""
    flag = F.col("flag")
    end = F.when(C.has(flag, C.READ1) & ~C.has(flag, C.READ2), 1).when(C.has(flag, C.READ2) & ~C.has(flag, C.READ1), 2).otherwise(0)
    strand = C.has(flag, C.REVERSE)
    best = Window.partitionBy("src", "qname", "_end").orderBy(F.col("qual").isNull(), "ord")
    one = reads.where(rule.condition()).withColumn("_end", end).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return one.select(
        "src", F.concat("qname", F.when(F.col("_end") > 0, F.concat(F.lit("/"), F.col("_end").cast("string"))).otherwise("")).alias("name"),
        F.when(strand, C.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(strand, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )


def fasta(reads: DataFrame) -> DataFrame:
    return sequences(reads).select("src", F.concat(F.lit(">"), "name", F.lit("\n"), "seq", F.lit("\n")).alias("record"))


def fastq(reads: DataFrame) -> DataFrame:
    quality = F.coalesce("qual", F.expr("repeat('\"', length(seq))"))
    return sequences(reads).select("src", F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), quality, F.lit("\n")).alias("record"))
