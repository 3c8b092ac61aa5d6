"""Benchmark decontamination: random-walk embeddings of item-sized windows, met by sampled positions, then the exact edit distance.

A document holds an item of W words if some run of its words is within e = floor(EDITS x W) word edits of it. The walk of
Chakraborty, Goldenberg and Koucky writes a word at each step and then moves on or stays, by a random bit of the word and the
step; words that two texts share in order bring their walks together again after an edit, so a small edit distance becomes a small
Hamming distance. Of each of WALKS walks, SAMPLES times BITS positions are taken together as a bucket; a window that shares a bucket with an item
is decided by the exact distance. Samples are few bits and many, for walks that agree in two steps of five.

Windows are opened at every place of a stretch where a match can lie (every e / 32 words for long items). A bound that loses
nothing says where that is: of e + 1 disjoint pieces of the item at least one is unchanged in the run, so the e + 1 pieces that fewest
items share are looked up at every place of a text; each find gives the only stretch where the run can lie, and a run there also shares at least W - q + 1 - q x e
of the item's q-word grams. So recall is that of the buckets alone, wherever the edits are and whatever stands around the passage. Pieces and grams have GRAM words, in items of less than SMALL words one.

Defined cases: null, empty and wordless texts and items match nothing; null doc ids stay; repeated rows give repeated matches
once each (rows are told apart by nothing but doc_id); empty tables give no rows; texts and items of any length are read whole; other columns are ignored.
Benchmarks of any size are taken in blocks of ITEMS items, each broadcast by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.text import PLACE, WordHasher, blocks, lean, mix, texts_of, words_by_text

EDITS, GRAM, SMALL = 0.2, 3, 6
#: Most items broadcast together, and most rows of finds that are held at a time.
ITEMS, FINDS = 20_000, 1 << 20
MAP_BITS = 22
#: Walks, samples of each, and positions of a sample: what recall needs at the full bound of edits.
WALKS, SAMPLES, BITS = 16, 8, 2
#: Windows are opened this often within the edits allowed.
STARTS = 32


def edits_allowed(words: int) -> int:
    return int(EDITS * words)


def infix_edits(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(least edits between item and any run of words, end of that run), exactly."""
    n = len(words)
    row, step = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, symbol in enumerate(item, 1):
        then = np.empty(n + 1, np.int64)
        then[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (words != symbol), out=then[1:])
        row = np.minimum.accumulate(then - step) + step
    return int(row.min()), int(row.argmin())


def grams_of(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    n = len(words) - size + 1
    return mix(sum((words[i : i + n] * PLACE[i + 8] for i in range(size)), np.zeros(max(n, 0), np.uint64))) if n > 0 else np.empty(0, np.uint64)


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values from low to high of each row."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def slices(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows with about FINDS in sum, one row at least."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FINDS, "right")))
        yield slice(at, end)
        at = end


def sampled_steps(words: int) -> np.ndarray:
    """(walk, sample, bit): the steps whose words make the buckets of items of so many words; walks reach an item's end after twice its words, on average."""
    return np.random.default_rng(words).integers(0, max(2, words * 3 // 2), (WALKS, SAMPLES, BITS))


def buckets(windows: np.ndarray) -> np.ndarray:
    """(window, walk, sample): the buckets of windows of one length, whose words are rows of hashes, 0 where a text has ended."""
    n, size = windows.shape
    steps = sampled_steps(size)
    wanted, place = np.unique(steps, return_inverse=True)
    place = place.reshape(steps.shape)
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1)
    at, row = np.zeros((n, WALKS), np.int64), np.arange(n)[:, None]
    salt = mix(np.arange(1, WALKS + 1, dtype=np.uint64) * PLACE[30])
    turns = np.arange(1, int(wanted[-1]) // 64 + 2, dtype=np.uint64) * PLACE[31]
    seen = np.empty((len(wanted), n, WALKS), np.uint64)
    k = 0
    for step in range(int(wanted[-1]) + 1):
        word = padded[row, at]
        if wanted[k] == step:
            seen[k] = word
            k += 1
        # Each 64 steps a word has new bits in each walk.
        bits = mix(word ^ salt ^ turns[step // 64])
        at = np.minimum(at + ((bits >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64), size)
    out = np.zeros((n, WALKS, SAMPLES), np.uint64)
    for w in range(WALKS):
        for b in range(BITS):
            out[:, w] += seen[place[w, :, b], :, w].T * PLACE[32 + b]
    return mix(out)


class Index:
    """Items by grams of one size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int) -> None:
        self.items, self.size = items, size
        self.words = np.array([len(w) for _, w in items])
        self.edits = np.array([edits_allowed(n) for n in self.words])
        #: Least number of an item's grams in a run that matches it.
        self.least = self.words - size + 1 - size * self.edits
        #: The buckets of each item; items of one length walk together.
        self.buckets = np.empty((len(items), WALKS, SAMPLES), np.uint64)
        for n in np.unique(self.words):
            same = np.flatnonzero(self.words == n)
            for i in range(0, len(same), 256):
                part = same[i : i + 256]
                self.buckets[part] = buckets(np.stack([items[j][1] for j in part]))
        grams = [grams_of(w, size) for _, w in items]
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        self.owned = np.unique(self.pair(np.concatenate(grams), owner))
        pairs = [np.unique(g) for g in grams]
        self.grams, held = np.unique(np.concatenate(pairs), return_counts=True)
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[(self.grams >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
        key, item, offset = [], [], []
        for i, g in enumerate(grams):
            need, of = self.edits[i] + 1, held[np.searchsorted(self.grams, g)]
            best = None
            for phase in range(size):
                at = np.arange(phase, len(g), size)
                if len(at) >= need:
                    at = at[np.argsort(of[at], kind="stable")[:need]]
                    best = at if best is None or of[at].sum() < of[best].sum() else best
            key.append(g[best])
            item.append(np.full(need, i))
            offset.append(best)
        self.key, self.item, self.offset = np.concatenate(key), np.concatenate(item), np.concatenate(offset)
        order = np.argsort(self.key, kind="stable")
        self.key, self.item, self.offset = self.key[order], self.item[order], self.offset[order]

    @staticmethod
    def pair(gram: np.ndarray, item: np.ndarray) -> np.ndarray:
        return mix(gram + item.astype(np.uint64) * PLACE[12])

    def stretches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end word) of every stretch where a run may match an item; those of an item in a text do not overlap."""
        seen = grams_of(words, self.size)
        at = np.flatnonzero(self.map[(seen >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        at = at[self.grams[np.minimum(np.searchsorted(self.grams, seen[at]), len(self.grams) - 1)] == seen[at]]
        text = np.searchsorted(first, at, "right") - 1
        inside = at + self.size <= first[text + 1]  # a gram must not reach into the next text
        at, text = at[inside], text[inside]
        if not len(at):
            return
        low, high = np.searchsorted(self.key, seen[at], "left"), np.searchsorted(self.key, seen[at], "right")
        kept = []
        for part in slices(high - low):
            row, k = ranges(low[part], high[part])
            row += part.start
            item = self.item[k]
            begin = at[row] - self.offset[k] - self.edits[item]
            a = np.maximum(begin, first[text[row]])
            b = np.minimum(begin + self.words[item] + 2 * self.edits[item], first[text[row] + 1])
            near = np.searchsorted(at, b - self.size, "right") - np.searchsorted(at, a, "left")
            good = near >= self.least[item]
            kept.append(np.stack([item[good], text[row[good]], a[good], b[good]], 1))
        found = np.concatenate(kept)
        if not len(found):
            return
        # Stretches of an item that overlap become one.
        item, owner, a, b = found[np.lexsort((found[:, 2], found[:, 0]))].T
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (owner[1:] != owner[:-1]) | (a[1:] > b[:-1])])
        last = np.append(np.flatnonzero(new)[1:], len(item)) - 1
        item, owner, a, b = item[new], owner[new], a[new], b[last]
        low, high = np.searchsorted(at, a, "left"), np.searchsorted(at, b - self.size, "right")
        for part in slices(high - low):
            row, k = ranges(low[part], high[part])
            pair = self.pair(seen[at[k]], item[part][row])
            mine = self.owned[np.minimum(np.searchsorted(self.owned, pair), len(self.owned) - 1)] == pair
            enough = np.bincount(row[mine], minlength=part.stop - part.start) >= self.least[item[part]]
            for x in np.flatnonzero(enough) + part.start:
                yield int(owner[x]), int(item[x]), int(a[x]), int(b[x])


    def meets(self, item: int, words: np.ndarray) -> bool:
        """Whether a window of the stretch of words shares a bucket with the item."""
        size, edits = int(self.words[item]), int(self.edits[item])
        starts = np.arange(0, max(1, len(words) - (size - edits) + 1), max(1, edits // STARTS))
        if edits // STARTS > 1:  # an unchanged passage is always met
            starts = np.union1d(starts, np.flatnonzero(words == self.items[item][1][0]))
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        for i in range(0, len(starts), 256):
            if (buckets(padded[starts[i : i + 256, None] + np.arange(size)]) == self.buckets[item]).any():
                return True
        return False


def index(items: list[tuple[int, str]]) -> list[Index]:
    hasher = WordHasher()
    sized: dict[int, list] = {}
    for i, text in items:
        words = hasher(np.frombuffer((text or "").encode(), np.uint8))[0]
        if len(words) and i is not None:
            sized.setdefault(1 if len(words) < SMALL else GRAM, []).append((i, words))
    return [Index(x, size) for size, x in sorted(sized.items())]


def matches(hasher: WordHasher, indexes: list[Index], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, edits, first byte, end byte) of the best run for each item that a text of the block holds."""
    words, s, e, first = words_by_text(hasher, data, offsets)
    if not len(words):
        return []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for x in indexes:
        for text, i, a, b in x.stretches(words, first):
            item, item_words = x.items[i]
            if not x.meets(i, words[a:b]):
                continue
            edits, end = infix_edits(item_words, words[a:b])
            if edits <= x.edits[i] and edits < best.get((text, item), (1 << 30,))[0]:
                # The end is the first of that distance, so the run back from it is the one that ends there.
                length = infix_edits(item_words[::-1], words[a : a + end][::-1])[1]
                best[text, item] = (edits, int(s[a + end - length]), int(e[a + end - 1]))
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, first_byte, end_byte: each benchmark item that a document holds, with its best run."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    n = items.count()
    passes = -(-n // ITEMS) or 1
    out = None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        table = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()])
        found = _search(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")), table)
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_byte", "end_byte")).alias("m")).select("doc_id", "item_id", "m.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns. A null id is an id like others here."""
    found = find_leaks(docs, benchmark, id_column, text).select(F.col("doc_id").alias("_leaked_id")).distinct()
    return docs.join(found, F.col(id_column).cast("long").eqNullSafe(F.col("_leaked_id")), "left_anti")


def _search(docs: DataFrame, table) -> DataFrame:
    kinds = ("doc_id", "item_id", "edits", "first_byte", "end_byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, hasher = index(table.value), WordHasher()
        for batch in batches:
            rows = []
            data, offsets = texts_of(batch.column(1))
            for i, j in blocks(offsets):
                found = matches(hasher, indexes, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = offsets[i] - offsets[i : j + 1]
                rows += [(batch.column(0)[i + t].as_py(), item, edits, a + int(at[t]), b + int(at[t])) for t, item, edits, a, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=kinds)

    return docs.mapInArrow(lean(run), ", ".join(f"{k} long" for k in kinds))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "edits")
