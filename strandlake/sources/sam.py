"""Alignment text (SAM): header model, reader and writer.

Rows keep their place in the input: src, the number of the file, and ord, the number of the record in it. Both come from
where a split begins and the order of lines in it, so no task reads more than its split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import columns as C

TAG = "struct<t:string,v:string>"
SCHEMA = (
    "src long, ord long, qname string, flag long, rid long, pos long, mapq long, cigar string, mrid long, mpos long, tlen long, seq string, qual string, rg string,"
    f" tags map<string,{TAG}>"
)


@dataclass
class Header:
    """The lines of a header in order, as (kind, fields); comments have one field without a key."""

    lines: list[tuple[str, list[tuple[str, str]]]] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: Sequence[str]) -> Header:
        out = cls()
        for line in lines:
            kind, *rest = line.split("\t")
            if kind == "@CO":
                out.lines.append(("CO", [("", "\t".join(rest))]))
            elif len(kind) == 3 and kind[0] == "@" and all(len(x) > 2 and x[2] == ":" for x in rest):
                out.lines.append((kind[1:], [(x[:2], x[3:]) for x in rest]))
            else:
                raise ValueError(f"bad header line {line!r}")
        names = [dict(f).get("SN") for _, f in out.of("SQ")]
        if None in names or len(set(names)) < len(names):
            raise ValueError("a reference without a name, or two of one name")
        return out

    def of(self, kind: str) -> list[tuple[str, list[tuple[str, str]]]]:
        return [x for x in self.lines if x[0] == kind]

    def text(self) -> list[str]:
        return ["@CO\t" + f[0][1] if kind == "CO" else "\t".join(["@" + kind, *(f"{k}:{v}" for k, v in f)]) for kind, f in self.lines]

    def references(self) -> list[tuple[int, str, int]]:
        """(rid, name, length) in dictionary order."""
        return [(i, dict(f)["SN"], int(dict(f)["LN"])) for i, (_, f) in enumerate(self.of("SQ"))]

    def groups(self) -> dict[str, dict[str, str]]:
        """Read groups by id."""
        return {dict(f)["ID"]: dict(f) for _, f in self.of("RG")}

    def same_references(self, other: Header) -> bool:
        return self.references() == other.references()

    def with_order(self, order: str, group: str | None = None, sub: str | None = None) -> Header:
        """The header of rows in another order: SO, GO and SS of its first line are set or taken out."""
        first = dict(self.of("HD")[0][1]) if self.of("HD") else {"VN": "1.6"}
        fields = [(k, v) for k, v in first.items() if k not in ("SO", "GO", "SS")] + [("SO", order)] + [("GO", group)] * bool(group) + [("SS", sub)] * bool(sub)
        return Header([("HD", fields), *(x for x in self.lines if x[0] != "HD")])

    def with_program(self, name: str, version: str, command: str) -> Header:
        """One more program line, chained to the last of each chain; an id that is taken gets a number."""
        ids = [dict(f)["ID"] for _, f in self.of("PG")]
        before = {dict(f).get("PP") for _, f in self.of("PG")}
        tips = [i for i in ids if i not in before] or [None]
        lines = list(self.lines)
        for tip in tips:
            new, k = name, 0
            while new in ids:
                k += 1
                new = f"{name}.{k}"
            ids.append(new)
            lines.append(("PG", [("ID", new), ("PN", name), *([("PP", tip)] if tip else []), ("VN", version), ("CL", command)]))
        return Header(lines)

    def without_programs_from(self, program: str) -> Header:
        """Without a program line and those that follow it in its chain."""
        gone = {program}
        for _, f in self.of("PG"):
            if dict(f).get("PP") in gone:
                gone.add(dict(f)["ID"])
        return Header([x for x in self.lines if x[0] != "PG" or dict(x[1])["ID"] not in gone])

    def with_group(self, fields: dict[str, str], only: bool = False) -> Header:
        """With a read group, in the place of one of its id; only: all others are taken out."""
        kept = [x for x in self.lines if x[0] != "RG" or not only and dict(x[1])["ID"] != fields["ID"]]
        at = max((i for i, x in enumerate(kept) if x[0] in ("HD", "SQ", "RG")), default=-1) + 1
        return Header([*kept[:at], ("RG", list(fields.items())), *kept[at:]])


def references_frame(spark: SparkSession, header: Header) -> DataFrame:
    return spark.createDataFrame(header.references(), "rid long, name string, length long")


def numbered_lines(spark: SparkSession, paths: Sequence[str], skip: str | None = None) -> DataFrame:
    """src, ord, value of each line that does not begin with skip, in the order of each file.

    A first pass counts the lines of each split; only a row a split comes to the driver.
    """
    out = None
    for src, path in enumerate(paths):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
        lines = lines.where(F.col("value") != "") if skip is None else lines.where((F.col("value") != "") & ~F.col("value").startswith(skip))
        lines = lines.withColumn("_i", F.monotonically_increasing_id())
        splits = sorted(lines.groupBy("_f", "_b").agg(F.min("_i").alias("low"), F.count("*").alias("n")).collect(), key=lambda r: (r._f, r._b))
        base, rows = 0, []
        for r in splits:
            rows.append((r._f, r._b, base - r.low))
            base += r.n
        shifts = spark.createDataFrame(rows, "_f string, _b long, _shift long")
        here = lines.join(F.broadcast(shifts), ["_f", "_b"]).select(F.lit(src).cast("long").alias("src"), (F.col("_i") + F.col("_shift")).alias("ord"), "value")
        out = here if out is None else out.unionByName(here)
    return out


def read_header(spark: SparkSession, path: str) -> Header:
    rows = numbered_lines(spark, [path]).where(F.col("value").startswith("@")).orderBy("ord").select("value").collect()
    return Header.parse([r.value for r in rows])


def parse_rows(lines: DataFrame, references: DataFrame) -> DataFrame:
    """Alignments of lines(src, ord, value). A line with fewer than eleven columns, a flag or place that is no number, or a reference that is not in the dictionary is an error.

    Spark may test a line before it is known not to be of the header, so header lines raise nothing here.
    """
    part = lambda i: F.get(F.col("_p"), F.lit(i))
    number = lambda i: F.when(~F.col("value").startswith("@"), part(i)).cast("long")
    rows = lines.withColumn("_p", F.split("value", "\t"))
    rows = rows.withColumn("_p", F.when((F.size("_p") >= 11) | F.col("value").startswith("@"), F.col("_p")).otherwise(F.raise_error(F.concat(F.lit("fewer than eleven columns: "), "value")).cast("array<string>")))
    pairs = F.transform(F.slice("_p", F.lit(12), F.greatest(F.size("_p") - 11, F.lit(0))), lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)), F.struct(F.substr(x, F.lit(4), F.lit(1)).alias("t"), F.substr(x, F.lit(6)).alias("v"))))
    names = references.select("name", F.col("rid").alias("_id"))
    to = lambda c, at: (F.col(c) == F.col(at))
    rows = rows.select(
        "src", "ord", part(0).alias("qname"), number(1).alias("flag"), part(2).alias("_rname"), (number(3) - 1).alias("pos"), number(4).alias("mapq"), part(5).alias("cigar"),
        F.when(part(6) == "=", part(2)).otherwise(part(6)).alias("_mname"), (number(7) - 1).alias("mpos"), number(8).alias("tlen"), F.nullif(part(9), F.lit("*")).alias("seq"), F.nullif(part(10), F.lit("*")).alias("qual"),
        F.map_from_entries(pairs).alias("tags"),
    )
    rows = rows.join(names.select(F.col("name").alias("_n1"), F.col("_id").alias("_r1")), to("_rname", "_n1"), "left").join(names.select(F.col("name").alias("_n2"), F.col("_id").alias("_r2")), to("_mname", "_n2"), "left")
    known = lambda c, r: F.when(F.col(c) == "*", F.lit(-1)).otherwise(F.coalesce(F.col(r), F.raise_error(F.concat(F.lit("unknown reference "), F.col(c))).cast("long"))).cast("long")
    return rows.select(
        "src", "ord", "qname", "flag", known("_rname", "_r1").alias("rid"), "pos", "mapq", "cigar", known("_mname", "_r2").alias("mrid"), "mpos", "tlen", "seq", "qual", C.tag_text(F.col("tags"), "RG").alias("rg"), "tags"
    )


def read_sam(spark: SparkSession, *paths: str) -> tuple[DataFrame, Header]:
    """(alignments, header) of files with one dictionary; src numbers the files."""
    headers = [read_header(spark, p) for p in paths]
    if any(not h.same_references(headers[0]) for h in headers[1:]):
        raise ValueError("the inputs have different references")
    return parse_rows(numbered_lines(spark, paths, "@"), references_frame(spark, headers[0])), headers[0]


def sam_lines(reads: DataFrame, references: DataFrame) -> DataFrame:
    """reads with a column value, the line of each row. The tag RG follows the column rg."""
    names = references.select("rid", F.col("name"))
    rows = reads.join(names.select(F.col("rid").alias("_r1"), F.col("name").alias("_n1")), F.col("rid") == F.col("_r1"), "left").join(names.select(F.col("rid").alias("_r2"), F.col("name").alias("_n2")), F.col("mrid") == F.col("_r2"), "left")
    name = F.coalesce("_n1", F.lit("*"))
    mate = F.when(F.col("mrid") < 0, "*").when(F.col("mrid") == F.col("rid"), "=").otherwise(F.col("_n2"))
    tags = F.coalesce("tags", F.expr(f"cast(map() as map<string,{TAG}>)")) if "tags" in reads.columns else F.expr(f"cast(map() as map<string,{TAG}>)")
    group = F.struct(F.lit("Z").alias("t"), F.col("rg").alias("v"))
    said = F.transform(F.map_entries(F.map_filter(tags, lambda k, v: k != "RG")), lambda e: F.concat_ws(":", e["key"], e["value"]["t"], e["value"]["v"]))
    said = F.concat(said, F.when(F.col("rg").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat_ws(":", F.lit("RG"), group["t"], group["v"]))))
    text = lambda c: F.col(c).cast("string")
    star = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("*"))
    fixed = [text("qname"), text("flag"), name, (F.col("pos") + 1).cast("string"), text("mapq"), star("cigar"), mate, (F.col("mpos") + 1).cast("string"), F.coalesce(text("tlen"), F.lit("0")) if "tlen" in reads.columns else F.lit("0"), star("seq"), star("qual")]
    return rows.withColumn("value", F.array_join(F.concat(F.array(*fixed), said), "\t")).select(*reads.columns, "value")


def write_sam(reads: DataFrame, header: Header, path: str, order: Sequence[Column | str] = ("src", "ord")) -> None:
    """A folder of text parts that, put together in the order of their names, are one file: the header, then the rows in the given order.

    Spark's committer makes the folder appear whole: a failed job leaves no marker of success.
    """
    spark = reads.sparkSession
    lines = sam_lines(reads, references_frame(spark, header))
    keys = [F.expr(k) if isinstance(k, str) else k for k in order]
    body = lines.select(F.lit(1).alias("_kind"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("_key"), F.lit(0).cast("long").alias("_i"), "value")
    none = F.lit(None).cast(body.schema["_key"].dataType)
    head = spark.createDataFrame(list(enumerate(header.text())), "_i long, value string").select(F.lit(0).alias("_kind"), none.alias("_key"), "_i", "value")
    head.unionByName(body).orderBy("_kind", "_key", "_i").select("value").write.mode("errorifexists").text(path)
