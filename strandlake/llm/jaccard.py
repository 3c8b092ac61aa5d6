"""N-gram Jaccard join by token-combination prefixes.

A text's tokens are the 64-bit hashes of its distinct word shingles. All tokens are put in one global order: tokens outside a
bounded table of frequent ones first, then the frequent ones, each by hash. Texts whose Jaccard similarity reaches t share at
least a = ceil(t (n + m) / (1 + t)) of their n and m tokens, so their prefixes of n - a + 1 + G tokens share at least 1 + G. Frequent tokens fall into G classes
by hash; hence two such prefixes share a single rare token or two tokens of one frequent class. Rare tokens are indexed alone,
frequent ones in pairs within their class. G grows with the band of set sizes (powers of two), so pairs stay few; a text that may
meet one of the next band is indexed for both, there by the shorter prefix that the larger partner allows. The order only has to be the same for all texts, so neither the size of the
table of frequent tokens nor a mistaken entry can lose a link.

Equal sets are joined first, by a 128-bit digest of the set, and one of each goes on. Indexed places that hold several sets are
joined in rounds: for ROUNDS rounds, linear in the places' rows, each set is compared with its place's pivot of the round, the
first by a hash, later the set nearest to earlier pivots, and exact links are joined into components. Places with one pivot are taken together as a star, so that sets that
share many places meet once, not once a place. Then only sets of one star that still lie in different components meet, in slots of
sizes that may link and in salts of about SPLIT sets, and only pairs that pass the bounds below come out of that join.

Three bounds that every link meets prune pairs before any text is read: the sizes' ratio, and two bitmap filters, a narrow one of
NARROW bits and a wide one of one to four bits for each token. Each bit is the parity of the tokens that fall there, so two sets
differ in at least as many tokens as in bits; with as many bits as tokens near misses fail, so what is left are the links between
components and pairs within about 0.02 of the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.bits import bit_filter
from strandlake.llm.components import connected_components
from strandlake.llm.stage import drop_staged, staged, tidy
from strandlake.llm.text import WordHasher, blocks, distinct_by_text, lean, mix, shingles_by_text, texts_of, words_by_text

#: Most frequent tokens in the broadcast table (8 bytes each), and the least count in it.
FREQUENT, LEAST = 1 << 17, 8
#: Tokens are counted in so many ranges of their hash, FLUSH tokens of a task at a time.
RANGES, FLUSH = 256, 1 << 20
#: Bits of the narrow sketch, and the least and most of the wide one.
NARROW, WIDE = 256, (256, 1 << 16)
#: Sets of a star that one task compares with the others of their sizes.
SPLIT = 4096
#: Pairs with a common pivot are verified in chunks of so many.
CHUNK = 32


def frequent_counts(docs: DataFrame, k: int) -> DataFrame:
    """(token, n): how many texts hold each token, from all texts, by lossy counting: of each FLUSH tokens of a task those met
    once are forgotten, so what is shuffled are repeated tokens, and a count may be too low by one for each flush.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held, kept = np.empty(FLUSH, np.uint64), 0

        def out() -> pa.RecordBatch:
            mine = held[:kept]
            mine.sort()
            # Where runs of equal values of two or more begin and end.
            same = np.zeros(kept + 1, bool)
            np.equal(mine[1:], mine[:-1], out=same[1:kept])
            first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
            value, n = mine[first], last - first + 1
            edge = np.searchsorted(value >> np.uint64(32), np.arange(RANGES + 1, dtype=np.uint64))  # value holds 40 bits, its top 8 pick the range
            rows = [r for r in range(RANGES) if edge[r + 1] > edge[r]]
            low, count = value.astype("<u4"), n.astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), *[pa.array([x[edge[r] : edge[r + 1]].tobytes() for r in rows], pa.binary()) for x in (low, count)]], names=["part", "value", "n"]
            )

        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            for i, j in blocks(offsets):
                h, _, _, first = words_by_text(hasher, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                _, token = distinct_by_text(*shingles_by_text(h, first, k))
                for at in range(0, len(token), FLUSH // 2):
                    part = token[at : at + FLUSH // 2]
                    if kept + len(part) > FLUSH:
                        yield out()
                        kept = 0
                    held[kept : kept + len(part)] = part >> np.uint64(24)
                    kept += len(part)
        if kept:
            yield out()

    def total(key: tuple, table: pa.Table) -> pa.Table:
        value, n = (np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column(c)]) for c in ("value", "n"))
        order = np.argsort(value)
        value, n = value[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        n = np.add.reduceat(n, at)
        keep = n >= LEAST
        best = np.argsort(-n[keep], kind="stable")[:FREQUENT]  # no range can give more to the table than it holds
        token = value[at][keep][best].astype(np.int64) | (key[0].as_py() << 32)
        return pa.table({"token": pa.array(token), "n": pa.array(n[keep][best])})

    parts = docs.select("text").mapInArrow(lean(run), "part int, value binary, n binary")
    return parts.groupBy("part").applyInArrow(total, "token long, n long")


def frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent tokens, sorted, by their top 40 bits. At most FREQUENT of them come to the driver."""
    rows = frequent_counts(docs, k).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.uint64))


class Rule:
    """The join's numbers for a similarity of part / whole."""

    def __init__(self, similarity: str) -> None:
        self.t = Fraction(similarity)
        self.least = max(1, math.ceil(self.t / (1 - self.t))) if self.t < 1 else 1 << 62  # smaller sets link with equal ones only

    def classes(self, band: int) -> int:
        smallest = max(1 << band, self.least)
        return max(1, min((1 << band) // 16, math.ceil(self.t * smallest) - 1))

    def need(self, n: int, band: int) -> int:
        """Least number of tokens shared with any partner in the band; one in a later band than the set's own has 2^band at least."""
        partner = max(math.ceil(self.t * n), 1 << band if band >= n.bit_length() else 0)
        return math.ceil(self.t * (n + partner) / (1 + self.t))

    def sizes(self, a: str, b: str) -> str:
        num, den = self.t.numerator, self.t.denominator
        return f"least({a}, {b}) * {den} >= greatest({a}, {b}) * {num}"

    def slot(self, n: str) -> str:
        """SQL for a number of sizes such that linked sets lie in the same or in neighbouring ones."""
        return f"cast(floor(ln({n}) / {max(-math.log(self.t), 1e-3) * (1 + 1e-6)!r}D) as int)"

    def differ(self, bits: str, a: str, b: str) -> str:
        """SQL for the bound on the tokens in which two sets (structs of n and sketches) differ, by the number of differing bits."""
        num, den = self.t.numerator, self.t.denominator
        return f"({bits}) * {den + num} <= ({a}.n + {b}.n) * {den - num}"

    def may_link(self, a: str, b: str) -> str:
        """SQL for what a pair of sets a, b (structs of n, bits and wide) has to meet before it is compared."""
        narrow = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(NARROW // 64))
        # Of sketches of different widths the wider one is folded to half its width: it has at most twice the bits.
        half = lambda x, y: f"if(size({x}.wide) > size({y}.wide), transform(slice({x}.wide, 1, size({y}.wide)), (v, i) -> v ^ {x}.wide[i + size({y}.wide)]), {x}.wide)"
        wide = f"aggregate(zip_with({half(a, b)}, {half(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (n, d) -> n + d)"
        return f"{self.sizes(a + '.n', b + '.n')} and {self.differ(narrow, a, b)} and {self.differ(wide, a, b)}"

    def linked(self, both: int, a: int, b: int) -> bool:
        return both * self.t.denominator >= self.t.numerator * (a + b - both)


def sketch(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the tokens at each of the bits, as 64-bit words; halves of it folded together are the sketch of half the bits."""
    parity = np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(bool)).view(np.int64)


def wide_bits(n: int) -> int:
    return min(max(2 << n.bit_length(), WIDE[0]), WIDE[1])


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, rule: Rule) -> np.ndarray:
    """The index keys of a set of sorted distinct tokens."""
    n = len(tokens)
    if n < rule.least:
        return np.empty(0, np.uint64)
    top = tokens >> np.uint64(24)
    at = np.searchsorted(frequent, top)
    often = frequent[np.minimum(at, len(frequent) - 1)] == top if len(frequent) else np.zeros(n, bool)
    ordered = np.concatenate([tokens[~often], tokens[often]])
    rare = n - int(often.sum())
    out = []
    own = n.bit_length() - 1
    for band in sorted({own, int(n / rule.t).bit_length() - 1}):
        g = rule.classes(band)
        p = min(n, n - rule.need(n, band) + 1 + g)
        salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64)
        out.append(mix(ordered[: min(p, rare)] ^ salt))
        if p > rare + 1:
            late = ordered[rare:p]
            kind = (late >> np.uint64(8)) % np.uint64(g)
            order = np.argsort(kind, kind="stable")
            late, size = late[order], np.bincount(kind.astype(np.int64), minlength=g)
            begin = np.cumsum(size) - size
            for m in np.unique(size[size > 1]):
                i, j = np.triu_indices(m, 1)
                group = late[begin[size == m][:, None] + np.arange(m)]
                out.append(mix(mix(group[:, i] ^ salt) * np.uint64(3) + mix(group[:, j] ^ salt)).ravel())
    return np.unique(np.concatenate(out))


def _sets(column: pa.Array, k: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text."""
    data, offsets = texts_of(column)
    for i, j in blocks(offsets):
        h, _, _, first = words_by_text(hasher, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        owner, token = distinct_by_text(*shingles_by_text(h, first, k))
        edge = np.searchsorted(owner, np.arange(j - i + 1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield token[a:b]


def describe(docs: DataFrame, k: int, similarity: str, frequent: np.ndarray) -> DataFrame:
    """id, n, set_a, set_b (128 bits that stand for the set), bits and wide (its sketches), keys of docs(id, text)."""
    spark = docs.sparkSession
    table, rule = spark.sparkContext.broadcast(frequent), Rule(similarity)
    longs = pa.list_(pa.int64())
    kinds = {"id": pa.int64(), "n": pa.int64(), "set_a": pa.int64(), "set_b": pa.int64(), "bits": longs, "wide": longs, "keys": longs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, often = WordHasher(), table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, a, b, bits, wide, keys = [], [], [], [], [], []
                for tokens in _sets(part.column(1), k, hasher):
                    n.append(len(tokens))
                    a.append(tokens.sum(dtype=np.uint64))
                    b.append(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    wide.append(sketch(tokens, wide_bits(len(tokens))))
                    bits.append(np.bitwise_xor.reduce(wide[-1].reshape(-1, NARROW // 64), axis=0))
                    keys.append(prefix_keys(tokens, often, rule).view(np.int64))
                columns = [part.column(0), pa.array(n, pa.int64()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], *[pa.array(x, longs) for x in (bits, wide, keys)]]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return docs.select("id", "text").mapInArrow(lean(run), "id long, n long, set_a long, set_b long, bits array<long>, wide array<long>, keys array<long>")


def _similarity(rule: Rule, a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of sorted distinct tokens, 0 if they do not link."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both) if both and rule.linked(both, len(a), len(b)) else 0.0


def verify(pairs: DataFrame, docs: DataFrame, k: int, similarity: str) -> DataFrame:
    """The linked pairs (a, b) of distinct pairs (a, b) with their similarity, whole texts compared exactly.

    A pivot a with many partners is read once a chunk of them. Rows meet by the hash of (a, chunk) and are sorted so that the
    pivot comes first; a task holds one pivot at a time. Of an id with several texts any one may link.
    """
    rule = Rule(similarity)
    keyed = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK))).alias("chunk"))
    wanted = keyed.select(F.col("b").alias("want"), "a", "chunk", F.lit(1).alias("kind")).union(keyed.select(F.col("a").alias("want"), "a", "chunk", F.lit(0).alias("kind")).distinct())
    texts = bit_filter(wanted.select("want").distinct(), "want").passing(docs.select("id", "text").where("id is not null"), "id")
    rows = wanted.join(texts, F.col("want") == F.col("id")).select("a", "chunk", "kind", "want", "text")
    dealt = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        pivot, mine = None, []
        for batch in batches:
            left, right, near = [], [], []
            owners, chunks, kinds, wants = (batch.column(i).to_pylist() for i in range(4))
            for i, tokens in enumerate(_sets(batch.column(4), k, hasher)):
                if kinds[i] == 0:
                    mine = [*mine, tokens] if pivot == (owners[i], chunks[i]) else [tokens]
                    pivot = (owners[i], chunks[i])
                elif pivot == (owners[i], chunks[i]) and (found := max(_similarity(rule, x, tokens) for x in mine)):
                    left.append(owners[i])
                    right.append(wants[i])
                    near.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(near, pa.float64())], names=["a", "b", "similarity"])

    return dealt.mapInArrow(lean(run), "a long, b long, similarity double")


def jaccard_components(docs: DataFrame, k: int = 5, similarity: str = "0.8", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row: the smallest id reachable by links of at least the similarity.

    Defined cases: a null, empty or wordless text has no shingles and its own component; with fewer than k words the whole
    sequence is the one shingle; a null id is a component of its own (null); rows that repeat an id are one document, which a
    link of any of its texts joins, a row for each; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    spark, rule = docs.sparkSession, Rule(similarity)
    made: list[DataFrame] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        made.append(staged(df, label))
        return made[-1]

    seen = kept(describe(docs, k, similarity, frequent_tokens(docs, k)), "sets")
    told = seen.where("n > 0 and id is not null")
    # Equal sets: one stands for all; sizes are part of the key.
    first = kept(told.groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep")), "reps")
    sets = seen.where(F.size("keys") > 0).join(first.select("n", "set_a", "set_b", F.col("rep").alias("id")), ["n", "set_a", "set_b", "id"], "left_semi")
    shapes = sets.select("id", F.struct("n", "bits", "wide").alias("s"))
    # Keys are dealt out once. Of keys held by just the same sets (told by count, least and greatest id and sums of hashes) one is enough.
    dealt = sets.select("id", F.explode("keys").alias("key")).repartition("key")
    hashed = F.xxhash64("id")
    held = dealt.groupBy("key").agg(
        F.count("*").alias("m"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.shiftrightunsigned(hashed, 33)).alias("h"), F.sum(hashed.bitwiseAND(F.lit(2**31 - 1))).alias("g")
    ).where("low < high")
    chosen = held.groupBy("m", "low", "high", "h", "g").agg(F.min("key").alias("key")).select("key")
    places = kept(dealt.join(chosen, "key").select("key", "id"), "places")
    tidy(spark)
    # A document with several texts joins their sets.
    several = told.groupBy("id").agg(F.min(F.struct("n", "set_a", "set_b")).alias("low"), F.max(F.struct("n", "set_a", "set_b")).alias("high")).where("low <> high").select("id")
    links = kept(told.join(several, "id", "left_semi").join(first, ["n", "set_a", "set_b"]).select(F.col("id").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")), "links")

    def one_hop() -> DataFrame:
        """(node, component): the least id next to each linked set. Sets with one label are connected, so a place of one label is settled."""
        low = F.least("a", "b")
        return links.select(F.col("a").alias("node"), low.alias("c")).union(links.select(F.col("b").alias("node"), low.alias("c"))).groupBy("node").agg(F.min("c").alias("component"))

    def all_hops() -> DataFrame:
        made.append(connected_components(links))
        return made[-1]

    linked = not links.isEmpty()
    state = one_hop() if linked else None
    tried: DataFrame | None = None
    for number in range(ROUNDS + 1):
        if number == ROUNDS and linked:
            state = all_hops()
        # Each place's sets with their components; a place of one component is settled.
        now = places.withColumn("c", F.col("id")) if state is None else places.join(state, places.id == state.node, "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        # The pivot: by hash at first, then the set nearest to most of the pivots before, which are spent. Any choice gives the same links.
        spent = links.select(F.col("b").alias("id"), "similarity").union(links.select(F.col("a").alias("id"), F.lit(-1e9).alias("similarity")))
        near = spent.groupBy("id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1023.0), F.sum("similarity"))).alias("near"))
        turn = F.shiftleft(F.coalesce(F.col("near") * 1024, F.lit(0)).cast("long"), 43) + F.shiftrightunsigned(F.xxhash64("id", F.lit(number)), 21)
        now = now.join(near, "id", "left").withColumn("mine", turn).drop("near")
        spread = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("mine").alias("turn")).where("low < high")
        # Places with the same pivot become one star: whoever shares a place shares a star, each set is in it once, and all are partners of its pivot.
        stars = now.join(spread.select("key", "turn"), "key").select("turn", "id", "c", "mine").distinct()
        if number < ROUNDS:
            pivots = stars.where("turn = mine").select("turn", F.col("id").alias("a"), F.col("c").alias("ca"))
            met = stars.join(pivots, "turn").where("c <> ca").select("a", F.col("id").alias("b"))
        else:
            # The rest: sets of a star in different components, by neighbouring slots of size, the smaller set on the left.
            sized = stars.join(stars.groupBy("turn").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("salts")), "turn")
            rest = sized.join(shapes, "id").withColumn("slot", F.expr(rule.slot("s.n")))
            left = rest.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(-1)), F.col("salts")).cast("int"))
            right = rest.withColumn("slot", F.explode(F.array("slot", F.col("slot") - 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            meet = "x.turn = y.turn and x.slot = y.slot and x.salt = y.salt and x.c <> y.c and (x.s.n < y.s.n or x.s.n = y.s.n and x.id < y.id) and "
            met = left.alias("x").join(right.alias("y"), F.expr(meet + rule.may_link("x.s", "y.s"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        pairs = met.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
        if number < ROUNDS:
            pairs = pairs.join(shapes.select(F.col("id").alias("lo"), F.col("s").alias("x")), "lo").join(shapes.select(F.col("id").alias("hi"), F.col("s").alias("y")), "hi").where(rule.may_link("x", "y"))
        pairs = pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"), "lo", "hi").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["lo", "hi"], "left_anti")
        fresh = kept(pairs, "pairs")
        tried = fresh.select("lo", "hi") if tried is None else tried.union(fresh.select("lo", "hi"))
        if not fresh.isEmpty():
            sized = fresh.join(fresh.groupBy("a").agg(F.count("*").alias("n")), "a")
            links = links.union(kept(verify(sized, docs, k, similarity), "links"))
            linked = True
            state = one_hop() if number < ROUNDS else all_hops()
        tidy(spark)
    members = told.select("id", "n", "set_a", "set_b").join(first, ["n", "set_a", "set_b"])
    # A component's smallest id is among its representatives: each is the least of its copies.
    component = F.col("rep") if state is None else F.coalesce("component", "rep")
    found = (members if state is None else members.join(state, members.rep == state.node, "left")).select("id", "n", component.alias("c"))
    rest = seen.where("n = 0 or id is null").select("id", "n", F.col("id").alias("c"))
    out = staged(found.union(rest), "classes")
    drop_staged(*made)
    tidy(spark)
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


#: Rounds of pivots before what is still apart is compared in full.
ROUNDS = 2


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4, similarity="0.85")
