"""Connected components by alternating large-star and small-star rounds, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.stage import drop_staged, staged


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the least node around it. Minima are pre-aggregated; no list is gathered."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the least of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node id reachable.

    Rows with a null end or a = b carry no link and are left out. The number of rounds is logarithmic; max_rounds only
    guards against a table that changes while it is read, and reaching it is an error, never a wrong answer.
    """
    now = staged(_canonical(edges), "edges")
    mark = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or not row.n:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            out._staged_path = now._staged_path  # for drop_staged, once the result is read
            return out
        mark = (row.n, row.h)
        then = staged(_canonical(_small_star(_canonical(_large_star(now)))), "edges")
        drop_staged(now)
        now = then
    raise RuntimeError("components did not settle")
