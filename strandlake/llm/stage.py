"""Tables written to the cluster's shared folder, so that lineage is cut and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine (local master), and one in
    the warehouse, which all machines share, on a cluster; never a machine's own folder there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("strandlake.stage.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/strandlake-stage"
        spark.conf.set("strandlake.stage.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """df, written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Lets the driver collect what earlier rounds left: compiled plans it no longer runs, and shuffle files of plans no longer
    referred to, which Spark's cleaner deletes when their plans are collected and otherwise looks for twice an hour only."""
    spark._jvm.System.gc()
