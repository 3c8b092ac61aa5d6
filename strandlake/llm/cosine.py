"""Exact cosine near-duplicates by a dual traversal of a cover tree.

On unit vectors cosine >= s means distance <= sqrt(2 - 2 s). Nested levels of centres with halving radii are built on the driver from
a bounded sample; every vector is then assigned to its nearest centre of the finest level, and each node gets the covering
radius of all vectors below it, whatever the sample missed. Two nodes further apart than both covering radii plus the distance
hold no link; the traversal descends from the pair of the root with itself and leaves pairs of leaves. Neighbouring leaves form
groups of up to UNIT vectors, larger leaves are cut, so no task holds more than two units of about UNIT vectors. A vector travels
to a pair of units only if it lies within reach of the ball of one of the other's leaves, and within reach of the plane between
that leaf's centre and its own. In each pair of units the cosine is computed in double precision.

Equal vectors are joined first and counted. Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; shorter vectors are continued with zeros; repeated rows are vectors of their own; a null vec_id is a
component of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.components import connected_components
from strandlake.llm.stage import staged

#: Most centres sampled, vectors for each centre, and vectors of a unit.
CENTRES, PER_CENTRE, UNIT = 2048, 64, 4096
#: Vectors that a task places at once, and rows of a batch that it sends.
SLICE, SENT = 256, 16384
#: Distances are compared with this much to spare, far above rounding, before the exact cosine decides.
SPARE = 1e-6


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Unit rows in double precision, short ones continued with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    # Scaled first, so that squares of extreme components neither overflow nor vanish.
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


class CoverTree:
    def __init__(self, points: np.ndarray, reach: float) -> None:
        self.points = points
        chosen = [0]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(np.array([0]), np.array([0]))]  # centres of a level and the place of each one's parent
        near = np.linalg.norm(points - points[0], axis=1)
        radius = 1.0
        while True:
            parents = list(chosen)
            while near.max() > radius:
                i = int(near.argmax())
                chosen.append(i)
                near = np.minimum(near, np.linalg.norm(points - points[i], axis=1))
            centres = np.array(chosen)
            gap = self._gaps(points[centres], points[np.array(parents)])
            self.levels.append((centres, gap.argmin(1)))
            if radius <= reach / 2 or len(chosen) == len(points):
                break
            radius /= 2
        self.leaves = points[self.levels[-1][0]]

    @staticmethod
    def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))

    def groups(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves in the tree's order, and where in it each group of up to UNIT vectors (or one larger leaf) begins."""
        at = np.arange(len(self.leaves))
        path = [at]
        for _, up in self.levels[:0:-1]:
            at = up[at]
            path.append(at)
        order = np.lexsort(path)
        begin, held = [0], 0
        for i, n in enumerate(size[order].tolist()):
            if held and held + n > UNIT:
                begin.append(i)
                held = 0
            held += n
        return order, np.array(begin)

    def pairs(self, radius: np.ndarray, full: np.ndarray, reach: float) -> np.ndarray:
        """Pairs (i <= j) of leaves with vectors that may hold a link; radius: covering radius of each leaf."""
        radii = [radius]
        used = [full]
        for (centres, up), (parents, _) in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            r, u = np.zeros(len(parents)), np.zeros(len(parents), bool)
            gap = np.linalg.norm(self.points[centres] - self.points[parents][up], axis=1)
            np.maximum.at(r, up[used[-1]], (gap + radii[-1])[used[-1]])
            np.logical_or.at(u, up, used[-1])
            radii.append(r)
            used.append(u)
        radii, used = radii[::-1], used[::-1]
        near = np.array([[bool(used[0][0])]])
        for depth in range(1, len(self.levels)):  # a level's matrix has CENTRES * CENTRES entries at most
            centres, up = self.levels[depth]
            at, r, u = self.points[centres], radii[depth], used[depth]
            near = near[up][:, up] & u[:, None] & u & (self._gaps(at, at) <= r[:, None] + r + reach + SPARE)
        return np.argwhere(np.triu(near))


def _link_blocks(similarity: float, width: int):
    """The function that counts links and joins components inside one pair of units."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        key = [x.as_py() for x in key]
        ids, copies, side = (table.column(c).to_numpy() for c in ("id", "copies", "side"))
        x = _matrix(table.column("embedding").combine_chunks(), width)
        order = np.lexsort((ids, side))
        ids, copies, side, x = ids[order], copies[order], side[order], x[order]
        cut = int(np.searchsorted(side, 1))
        alone = key[0] == key[2] and key[1] == key[3]  # a unit with itself
        a, b = (x, x) if alone else (x[:cut], x[cut:])
        link = a @ b.T >= similarity
        if alone:
            np.fill_diagonal(link, False)
            counts = link @ copies
        else:
            counts = np.concatenate([link @ copies[cut:], copies[:cut] @ link])
        lower = ids.copy()
        # Only rows and columns with a link take part in what follows.
        rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0)) + (0 if alone else cut)
        link = link[np.ix_(rows, cols - (0 if alone else cut))]
        far = np.iinfo(np.int64).max
        while len(rows):
            then = lower.copy()
            then[rows] = np.minimum(then[rows], np.where(link, lower[cols][None], far).min(1))
            then[cols] = np.minimum(then[cols], np.where(link, then[rows][:, None], far).min(0))
            if (then == lower).all():
                break
            lower = then
        has = counts > 0
        return pa.table({"id": ids[has], "links": counts[has].astype(np.int64), "low": lower[has]})

    return run


def near_duplicates(vectors: DataFrame, similarity: float = 0.95, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id_column, n_links, component_id, kept for every row of vectors."""
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * similarity)
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(kind).alias("embedding"))
    usable = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    good = rows.where(usable)
    rest = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    kinds = staged(good.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n, width = kinds.agg(F.count("*"), F.max(F.size("embedding"))).first()
    final = lambda df: df.select(F.col("id").alias(id_column), "n_links", F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))
    if not n:
        return final(rest)
    sample = kinds.orderBy(F.xxhash64("rep"), "rep").limit(min(CENTRES, max(16, n // PER_CENTRE))).select("embedding").toArrow()
    tree = CoverTree(_matrix(sample.column(0).combine_chunks(), width), reach)
    leaves = spark.sparkContext.broadcast(tree.leaves)  # at most CENTRES rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = leaves.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            leaf = (x @ centres.T).argmax(1) if len(x) else np.empty(0, np.int64)
            gap = np.linalg.norm(x - centres[leaf], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(leaf.astype(np.int32)), pa.array(gap)], names=["id", "embedding", "copies", "leaf", "gap"])

    placed = staged(kinds.select(F.col("rep").alias("id"), "embedding", "copies").mapInArrow(assign, f"id long, embedding {kind}, copies long, leaf int, gap double"), "leaves")
    radius, size = np.zeros(len(tree.leaves)), np.zeros(len(tree.leaves), np.int64)
    for r in placed.groupBy("leaf").agg(F.max("gap").alias("gap"), F.count("*").alias("n")).collect():  # a row a leaf
        radius[r.leaf], size[r.leaf] = r.gap, r.n
    order, begin = tree.groups(size)
    group = np.empty(len(order), np.int64)
    group[order] = np.searchsorted(begin, np.arange(len(order)), side="right") - 1
    mates = np.zeros((len(order), len(order)), bool)
    low, high = tree.pairs(radius, size > 0, reach).T
    mates[low, high] = mates[high, low] = True
    units = np.maximum(1, -(-np.bincount(group, size).astype(np.int64) // UNIT))
    plan = spark.sparkContext.broadcast((order, begin, group, mates, radius, units))  # CENTRES * CENTRES bytes at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = leaves.value
        order, begin, group, mates, radius, units = plan.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                x = _matrix(part.column(1), width)
                ids, leaf = part.column(0).to_numpy(), part.column(3).to_numpy()
                mine = group[leaf]
                own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % units[mine]
                dots = x @ centres.T
                ball = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= radius + reach + SPARE
                plane = dots[np.arange(len(x)), leaf][:, None] - dots <= reach * apart[leaf] + SPARE
                near = np.logical_or.reduceat((ball & plane & mates[leaf])[:, order], begin, axis=1)
                near[np.arange(len(x)), mine] = True
                row, other = np.nonzero(near)
                times = units[other]
                unit = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, other = np.repeat(row, times), np.repeat(other, times)
                ga, ua = mine[row], own[row]
                side = (other < ga) | ((other == ga) & (unit < ua))
                ends = [np.where(side, other, ga), np.where(side, unit, ua), np.where(side, ga, other), np.where(side, ua, unit), side]
                for i in range(0, len(row), SENT):
                    out = part.select(["id", "embedding", "copies"]).take(pa.array(row[i : i + SENT]))
                    yield pa.RecordBatch.from_arrays([*out.columns, *[pa.array(c[i : i + SENT].astype(np.int32)) for c in ends]], names=["id", "embedding", "copies", "la", "ua", "lb", "ub", "side"])

    dealt = placed.mapInArrow(send, f"id long, embedding {kind}, copies long, la int, ua int, lb int, ub int, side int")
    found = staged(dealt.groupBy("la", "ua", "lb", "ub").applyInArrow(_link_blocks(similarity, width), "id long, links long, low long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    known = kinds.join(counts, kinds.rep == counts.id, "left").drop("id").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    return final(good.join(known, "embedding").select("id", "n_links", "c").union(rest))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
