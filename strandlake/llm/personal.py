"""Personal data with Spark expressions only: patterns propose, checksums confirm, nearby words adjust a score.

Kinds: email, ip, card (Luhn) and phone are the base; iban (mod-97) is added. The patterns are written with possessive
quantifiers and run starts, so that they take linear time and constant stack on texts of any length; they match what
the plain forms match: a maximal run cannot begin inside itself, except just behind the match before (\\G).

Defined cases: a null text is empty; a null doc_id and repeated rows stay, one row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single separators that has 14 to 19 of them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: Strings one of which a text needs for the pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|courriel|correo",
    "ip": "\\bip\\b|address|host|server|adresse",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
#: Score without and with a context word within NEAR code points before the span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
LIFT, NEAR = 0.1, 40

_SPAN = "struct<kind:string,start:int,end:int,text:string>"
_DIGITS = "regexp_replace(s.text, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": "forall(split(s.text, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', right(ltrim('0', x), 3)) as int) <= 255)",
    # Luhn: from the right, every second digit doubled, nine taken off what passes nine.
    "card": f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> if(i % 2 = 0, cast(d as int), if(cast(d as int) > 4, 2 * cast(d as int) - 9, 2 * cast(d as int)))), 0, (a, d) -> a + d) % 10 = 0",
    "phone": f"length({_DIGITS}) between 10 and 15",
    # Mod-97 over the number got by moving four characters to the end and writing A as 10 ... Z as 35.
    "iban": "length(replace(s.text, ' ', '')) between 15 and 34 and aggregate(split(concat(substr(replace(s.text, ' ', ''), 5), substr(s.text, 1, 4)), ''), 0,"
    " (a, c) -> if(c between '0' and '9', (a * 10 + cast(try_cast(c as int) as int)) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1",
}


def _spans(kind: str, text: str) -> str:
    """SQL for the array of confirmed spans of a kind: pieces between matches and the matches give the places."""
    like = "r'" + PATTERNS[kind] + "'"
    pairs = f"zip_with(split({text}, {like}, -1), regexp_extract_all({text}, {like}, 0), (p, m) -> struct(length(p) as gap, m as m))"
    found = (
        f"aggregate({pairs}, struct(0 as at, cast(array() as array<{_SPAN}>) as out), (a, x) -> if(x.m is null, a, struct(a.at + x.gap + length(x.m) as at,"
        f" concat(a.out, array(struct('{kind}' as kind, a.at + x.gap as start, a.at + x.gap + length(x.m) as end, x.m as text))) as out)), a -> a.out)"
    )
    tried = f"contains({text}, '{NEEDS[kind]}')" if kind in NEEDS else f"{text} rlike {like}"
    return f"if({tried}, filter({found}, s -> {CHECKS[kind]}), cast(array() as array<{_SPAN}>))"


def find_personal(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, spans: array of (kind, start, end, text, score) by start, then kind as listed; code points, end exclusive."""
    rows = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    for kind in KINDS:
        rows = rows.withColumn(kind, F.expr(_spans(kind, "body")))
    rank = "case s.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    near = "lower(substr(body, greatest(1, s.start + 1 - {n}), least({n}, s.start)))".format(n=NEAR)
    lifted = "case s.kind " + " ".join(f"when '{k}' then {PRIOR[k]}D + if({near} rlike r'{CONTEXT[k]}', {LIFT}D, 0D)" for k in KINDS) + " end"
    spans = f"transform(array_sort(transform(concat({', '.join(KINDS)}), s -> struct(s.start as start, {rank} as rank, s.end as end, s.kind as kind, s.text as text))), s -> struct(s.kind as kind, s.start as start, s.end as end, s.text as text, {lifted} as score))"
    return rows.select("path", F.expr(spans).alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
