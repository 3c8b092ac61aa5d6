"""Column expressions over alignments: flags, CIGAR strings, sequences, qualities and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag names in bit order (fixed values).
FLAG_NAMES = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")
PAIRED, PROPER, UNMAP, MUNMAP, REVERSE, MREVERSE, READ1, READ2, SECONDARY, QCFAIL, DUP, SUPPLEMENTARY = (1 << i for i in range(12))


def has(flag: Column, bits: int) -> Column:
    """Any of the bits."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def has_all(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def parse_flags(text: str) -> int:
    """A flag word from decimal, 0x, leading-zero octal, or names divided by commas."""
    text = text.strip()
    if text[:1].isdigit():
        value = int(text, 16) if text.lower().startswith("0x") else int(text, 8) if len(text) > 1 and text[0] == "0" else int(text)
    else:
        names = {n: 1 << i for i, n in enumerate(FLAG_NAMES)}
        value = 0
        for name in filter(None, text.split(",")):
            if name.strip().upper() not in names:
                raise ValueError(f"unknown flag {name!r}")
            value |= names[name.strip().upper()]
    if not 0 <= value < 65536:
        raise ValueError(f"flag {text!r} out of range")
    return value


def describe_flags(flag: Column) -> Column:
    """0x.. TAB decimal TAB names."""
    names = F.concat_ws(",", *[F.when(has(flag, 1 << i), n) for i, n in enumerate(FLAG_NAMES)])
    return F.concat(F.lit("0x"), F.lower(F.hex(flag)), F.lit("\t"), flag.cast("string"), F.lit("\t"), names)


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op); empty for *."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def render_cigar(ops: Column) -> Column:
    """The text of an array of (n, op): runs of one letter are joined first, empty ones left out, * if nothing is left."""
    empty = F.expr("cast(array() as array<struct<n:bigint,op:string>>)")
    last = lambda a: F.element_at(a, -1)
    join = lambda a, o: F.when(o["n"] == 0, a).when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["op"] == o["op"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct((last(a)["n"] + o["n"]).alias("n"), o["op"].alias("op"))))).otherwise(F.concat(a, F.array(F.struct(o["n"].alias("n"), o["op"].alias("op")))))
    text = F.array_join(F.transform(F.aggregate(ops, empty, join), lambda o: F.concat(o["n"].cast("string"), o["op"])), "")
    return F.when(text == "", "*").otherwise(text)


def total(ops: Column, kinds: str) -> Column:
    """Summed lengths of the operations whose letter is in kinds."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda a, o: a + F.when(F.lit(kinds).contains(o["op"]), o["n"]).otherwise(0))


def op_length(cigar: Column, kinds: str) -> Column:
    """total of a CIGAR's text, without making its operations."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{kinds}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))


def ref_span(cigar: Column) -> Column:
    return op_length(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    return op_length(cigar, "MIS=X")


def _number(text: Column, pattern: str, letter: str) -> Column:
    """The number a pattern finds before a letter; texts without the letter are not searched."""
    return F.when(text.contains(letter), F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def lead_clip(cigar: Column) -> Column:
    return _number(cigar, "^([0-9]+)H", "H") + _number(cigar, "^(?:[0-9]+H)?([0-9]+)S", "S")


def trail_clip(cigar: Column) -> Column:
    return _number(cigar, "([0-9]+)H$", "H") + _number(cigar, "([0-9]+)S(?:[0-9]+H)?$", "S")


def soft_lead(cigar: Column) -> Column:
    return _number(cigar, "^(?:[0-9]+H)?([0-9]+)S", "S")


def soft_trail(cigar: Column) -> Column:
    return _number(cigar, "([0-9]+)S(?:[0-9]+H)?$", "S")


#: Operations walked at a time: appending to an array copies it, so a long CIGAR is walked in runs and these are joined.
RUN = 64


def walk(cigar: Column) -> Column:
    """Array of (op, n, roff, qoff): where each operation begins on the reference and on the query."""
    start = F.expr("struct(0L as r, 0L as q, cast(array() as array<struct<op:string,n:bigint,roff:bigint,qoff:bigint>>) as out)")

    def step(a: Column, o: Column) -> Column:
        return F.struct(
            (a["r"] + F.when(F.lit("MDN=X").contains(o["op"]), o["n"]).otherwise(0)).alias("r"),
            (a["q"] + F.when(F.lit("MIS=X").contains(o["op"]), o["n"]).otherwise(0)).alias("q"),
            F.concat(a["out"], F.array(F.struct(o["op"].alias("op"), o["n"].alias("n"), a["r"].alias("roff"), a["q"].alias("qoff")))).alias("out"),
        )

    ops = cigar_ops(cigar)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ops) - 1) / RUN)), lambda i: F.aggregate(F.slice(ops, (i * RUN + 1).cast("int"), F.lit(RUN)), start, step))
    base = F.expr("struct(0L as r, 0L as q, cast(array() as array<struct<r:bigint,q:bigint,out:array<struct<op:string,n:bigint,roff:bigint,qoff:bigint>>>>) as out)")
    placed = F.aggregate(
        runs, base, lambda a, b: F.struct((a["r"] + b["r"]).alias("r"), (a["q"] + b["q"]).alias("q"), F.concat(a["out"], F.array(F.struct(a["r"].alias("r"), a["q"].alias("q"), b["out"].alias("out")))).alias("out")), lambda a: a["out"]
    )
    shifted = lambda b: F.transform(b["out"], lambda o: F.struct(o["op"].alias("op"), o["n"].alias("n"), (o["roff"] + b["r"]).alias("roff"), (o["qoff"] + b["q"]).alias("qoff")))
    return F.when(F.length(cigar) <= 2 * RUN, F.aggregate(ops, start, step, lambda a: a["out"])).otherwise(F.flatten(F.transform(placed, shifted)))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN")


def quality_sum(qual: Column, least: int = 15, length: Column | None = None) -> Column:
    """Sum of the qualities that reach least, from text offset by 33; where it is absent, 255 for each of length bases."""
    absent = F.lit(0).cast("long") if length is None else length.cast("long") * 255
    return F.when(qual.isNull(), absent).otherwise(_quality_sum(qual, least))


def _quality_sum(qual: Column, least: int) -> Column:
    return F.aggregate(F.split(qual, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(F.ascii(c) - 33 >= least, F.ascii(c) - 33).otherwise(0))


def natural_key(name: Column) -> Column:
    """A string whose byte order is the natural order of names: runs of digits compare as numbers."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda x: F.ltrim(x, F.lit("0"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number(x)).cast("string"), 3, "0"), number(x))).otherwise(x)), "")


def flag_rank(flag: Column) -> Column:
    bit = lambda b, by: flag.bitwiseAND(F.lit(b)) * by
    return bit(0xC0, 256) + bit(0x100, 8) + F.floor(bit(0x800, 1) / 8)


def tag_text(tags: Column, name: str) -> Column:
    """The value of a tag as text, null where there is none."""
    return F.try_element_at(tags, F.lit(name))["v"]


def md_runs(md: Column) -> Column:
    """Array of (kind, text) of a mismatch string: = for matching bases (a number), X for one base of the reference, D for deleted ones."""
    parts = F.regexp_extract_all(md, F.lit("([0-9]+|\\^[A-Za-z]+|[A-Za-z])"), F.lit(1))
    kind = lambda x: F.when(x.startswith("^"), "D").when(x.rlike("^[0-9]"), "=").otherwise("X")
    return F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), F.ltrim(x, F.lit("^")).alias("text")))


def percent_encoded(label: Column) -> Column:
    """A label as part of a file name: bytes other than letters, digits, dot, hyphen and underscore are written as %XX."""
    each = F.transform(F.split(label, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9._-]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.array_join(each, "")


def parse_region(text: str) -> tuple[str, int, int | None]:
    """(name, 0-based start, end or None) of name, name:start or name:start-end with 1-based inclusive numbers; commas may divide digits."""
    import re

    m = re.fullmatch(r"(.+):([0-9][0-9,]*)(?:-([0-9][0-9,]*)?)?", text)
    if not m:
        return text, 0, None
    start, end = int(m[2].replace(",", "")), int(m[3].replace(",", "")) if m[3] else None
    if start < 1 or end is not None and end < start:
        raise ValueError(f"region {text!r} is empty or begins before 1")
    return m[1], start - 1, end


def parse_size(text: str) -> int:
    """Bytes of a number with an optional suffix K, M or G."""
    unit = {"K": 10, "M": 20, "G": 30}.get(text[-1:].upper())
    return int(text[:-1]) << unit if unit else int(text)


def general(value: Column, digits: int = 6) -> Column:
    """A number as C's %g writes it: digits significant, no trailing zeros, an exponent below -4 or from digits on. A tie is rounded by its decimal text, not by its binary value."""
    mantissa = F.regexp_extract(F.format_string(f"%.{digits - 1}e", value), "^(-?[0-9.]+)e", 1)
    power = F.regexp_extract(F.format_string(f"%.{digits - 1}e", value), "e([+-][0-9]+)$", 1).cast("int")
    short = lambda t: F.when(t.contains("."), F.regexp_replace(t, "\\.?0+$", "")).otherwise(t)
    fixed = F.lit("")
    for k in range(digits + 4):
        fixed = F.when(power == digits - 1 - k, F.format_string(f"%.{k}f", value)).otherwise(fixed)
    scientific = F.concat(short(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(value == 0, "0").when((power < -4) | (power >= digits), scientific).otherwise(short(fixed))


def little_endian(value: Column, size: int) -> Column:
    """The lowest size bytes of a whole number, the least first."""
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), ""))
