"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Every stage takes whole tables: a null, empty or very long text is a text like others, rows are told apart by their place, so repeated rows and
null ids stay or go one by one, an empty table gives no rows, and columns beside doc_id and text are carried through whatever their
names. A table with text as the only string column to work on needs no others. What each stage decides on its edge cases is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, jaccard, packing, quality, secrets
from strandlake.llm.stage import staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above.

    A null or empty text is scored as one chunk of padding; without labels of both classes every score is the share of label 1, 0.5 without any.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, score="_score_of_stage").where(F.col("_score_of_stage") >= quality.THRESHOLD).drop("_score_of_stage")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked at a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id; null ids come last.

    Rows without words link with nothing and stay. Rows are told apart by their place in docs, not by id, so it must be read from files, where each reading gives the same places.
    """
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    groups = jaccard.jaccard_components(keyed.select("_row", "text"), k=5, similarity="0.8", id_column="_row")
    ranked = groups.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row")).alias("first"))
    return keyed.join(ranked.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Texts and items without words match nothing; rows of one id go together if any of them holds an item, a null id being an id like others.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind in brackets; n_chars follows the text.

    A null text has no secrets and stays null; equal texts are scanned once and all redacted alike.
    """
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is the end id alone."""
    return packing.pack(staged(packing.cut_pieces(docs), "pieces"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier, the edit distances and the tokenizer are beyond SQL; tests hold the operators against brute force and run the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
