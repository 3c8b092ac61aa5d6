"""Secret scans over an incremental ledger of content-addressed blobs.

Every text is a version addressed by the SHA-256 of its UTF-8 bytes. The ledger holds what each (blob, rule version) pair gave;
a scan reads only texts of pairs that the ledger lacks, one row a blob, appends them, and joins the findings back to all paths.

Base rules (fixed): assign, access and hex, leftmost non-overlapping per kind, failing matches dropped. Added rules: private key
headers, prefixed vendor tokens and signed web tokens. Offsets are code points, the end exclusive.

Defined cases: a null text is the empty blob; null and repeated paths stay, one row each; an empty table gives no rows; texts of
any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.bits import bit_filter
from strandlake.llm.stage import drop_staged, staged
from strandlake.llm.text import lean

RULE_VERSION = "2024-1"
BASE = ("assign", "access", "hex")
ADDED = ("private_key", "vendor_token", "web_token")
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), lambda m: True),  # a maximal run, so shorter runs are just those that would be dropped
    "private_key": (re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"), lambda m: True),
    "vendor_token": (re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"), lambda m: True),
    "web_token": (re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), lambda m: True),
}
ORDER = {k: i for i, k in enumerate((*BASE, *ADDED))}


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    text = text or ""
    out = [(kind, m.start(), m.end()) for kind, (rule, ok) in RULES.items() for m in rule.finditer(text) if ok(m)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


SCHEMA = "blob string, spans array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.schema([("blob", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x.as_py())] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW.field(1).type)], schema=_ARROW)


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): every path with its blob and spans; the new ledger rows (blob, rule_version, spans).

    ledger: earlier entries, of any rule version. Only hashes are dealt out to find unseen blobs; texts are scanned where they
    lie and never shuffled. A bit filter names one row of each unseen blob; a row it lets pass by mistake is scanned in vain.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    paths = docs.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"))
    unseen = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == version).select("blob").distinct(), "blob", "left_anti")
    unseen = staged(unseen, "unseen")
    texts = bit_filter(unseen, "blob", "path").passing(docs.select(F.sha2(body, 256).alias("blob"), body.alias("body"), F.col(path).alias("path")), "blob", "path")
    scanned = texts.select("blob", "body").mapInArrow(lean(_scan), SCHEMA).join(unseen.select("blob"), "blob", "left_semi").dropDuplicates(["blob"])
    entries = staged(scanned.select("blob", F.lit(version).alias("rule_version"), "spans"), "ledger")
    drop_staged(unseen)
    known = found_blobs(entries, ledger, version)
    return paths.join(known, "blob", "left"), entries


def found_blobs(entries: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """blob, spans of every blob with findings under the rule version."""
    known = entries if ledger is None else ledger.where(F.col("rule_version") == version).dropDuplicates(["blob"]).unionByName(entries)
    return known.where(F.size("spans") > 0).select("blob", "spans")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def digest(rows: DataFrame) -> DataFrame:
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return rows.select(
        F.col("path").alias("doc_id"),
        *[F.size(F.filter(spans, _of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(spans).alias("spans"),
    )


def redacted(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of text replaced by [kind]; overlapping spans are replaced together by the first one's kind.

    Only texts that may have findings are shuffled to meet them, all others stay where they lie. Columns of any name may stand beside the text.
    """
    _, entries = scan_ledger(docs, ledger, path, text)
    known = found_blobs(entries, ledger, RULE_VERSION)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # names that cannot clash with those used here
    body = f"c{names.index(text)}"
    rows = docs.toDF(*inner)
    blob = F.sha2(F.coalesce(F.col(body), F.lit("")), 256)
    found = bit_filter(known, "blob")
    clean = found.passing(rows, blob, negate=True)
    rows = found.passing(rows, blob).withColumn("blob", blob).join(known, "blob", "left")
    state = "struct(0 as at, '' as out)"
    # Pieces before each span and its mark; what an earlier span has covered is left out.
    fold = (
        f"aggregate(spans, {state}, (a, s) -> if(s.end <= a.at, a, struct(s.end as at, concat(a.out, if(s.start >= a.at, concat(substr({body}, a.at + 1, s.start - a.at), '[', s.kind, ']'), '')) as out)),"
        f" a -> concat(a.out, substr({body}, a.at + 1)))"
    )
    dirty = rows.withColumn(body, F.when(F.col("spans").isNull(), F.col(body)).otherwise(F.expr(fold))).select(*inner)
    return clean.union(dirty).toDF(*names)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, ledger = scan_ledger(docs)
    # The same texts again, as a later version of the corpus would hold most of them: all are in the ledger, none is scanned.
    rows, _ = scan_ledger(docs, ledger)
    return digest(rows)


def plain_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in find_secrets(text) if k in BASE).encode()).hexdigest()
