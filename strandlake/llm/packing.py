"""Packing token sequences by non-negative least squares over a histogram of lengths.

A document's ids are those of the tokenizer, then id 1; a document longer than a sequence is cut at multiples of it. Lengths are
counted over all pieces; shallow combinations of lengths that fill a sequence exactly are enumerated, non-negative least squares
solves how often each repeats, the counts are rounded down, and what is left is packed greedily, a run of equal sequences at a time.
The plan's size depends on the sequence length alone; pieces find their place in it by their rank among those of their length.

Defined cases: a null or empty text is the single id 1; repeated rows are packed once each; null ids stay; an empty table gives no
rows; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.stage import staged
from strandlake.llm.text import LONG, MASK, SPACE, SpanHasher, blocks, eights, lean, texts_of

SEQUENCE, END_ID = 2048, 1
#: Ranks of a length are counted apart in buckets of about so many pieces, so that a common length is no single task's work.
BUCKET = 1 << 17
#: Places of the table of units met before, and ids and bytes kept for them before it is emptied.
SLOT_BITS = 19
SLOTS, POOL = 1 << SLOT_BITS, 1 << 23
#: The tokenizer's pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Places of white space outside 09-0D and 20, which texts hold seldom: 1C-1F, U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    for lead, second, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        at = np.flatnonzero(data == lead)
        at = at[at + 1 < len(data)]
        at = at[np.isin(data[at + 1], second)]
        if third is not None:
            at = at[at + 2 < len(data)]
            at = at[np.isin(data[at + 2], third)]
        found.append(at)
    return np.concatenate(found)


class Encoder:
    """Ids of the tokenizer for runs of texts.

    Its pattern splits text before a space that follows something else than white space, whatever stands further away. The
    units between such spaces are hashed together in numpy; ids of units met before come from a table of SLOTS places, new ones
    from the tokenizer's ranks in tiktoken. A hash only finds the place: ids are taken where the unit's bytes are those kept there.
    Texts with a special token's string or odd white space are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [x.content.encode() for x in added.values()]
        # Byte-level tokens write bytes that are not printable as the code points from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.hasher = SpanHasher()
        self._clear()

    def _clear(self) -> None:
        #: By place: where its ids begin in pool and how many they are, where its bytes begin in kept and how many.
        self.place, self.count, self.begin, self.size = (np.zeros(SLOTS, np.int32) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.kept, self.filled = np.zeros(1 << 20, np.uint8), 0

    def _add(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _keep(self, raw: bytes) -> int:
        if self.filled + len(raw) + 8 > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros(max(len(self.kept), len(raw) + 8), np.uint8)])
        at = self.filled
        self.kept[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        self.filled += len(raw)
        return at

    def _known(self, view: np.ndarray, s: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether the unit kept at each slot has just the bytes of the span."""
        held = np.ndarray(len(self.kept) - 7, "<u8", self.kept, strides=(1,))
        begin = self.begin[slot]
        mask = MASK[np.minimum(size, 8)]
        same = (self.size[slot] == size) & ((view[s] ^ held[begin]) & mask == 0)
        more, at = np.flatnonzero(same & (size > 8)), 8
        while len(more):
            same[more] = (view[s[more] + at] ^ held[begin[more] + at]) & MASK[np.minimum(size[more] - at, 8)] == 0
            at += 8
            more = more[same[more] & (size[more] > at)]
        return same

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a run of UTF-8 bytes."""
        if self.used + self.filled > POOL:
            self._clear()
        n = len(data)
        if not n:
            return [np.empty(0, np.uint32)] * (len(offsets) - 1)
        odd = set(np.searchsorted(offsets, _odd_space(data), "right") - 1)
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        starts = np.zeros(n + 1, bool)
        starts[1:n] = (data[1:] == 0x20) & ~SPACE[data[:-1]]
        starts[offsets[:-1]] = True
        starts[n] = False
        s = np.flatnonzero(starts)
        e = np.append(s[1:], n)
        size, view = e - s, eights(data)
        h = self.hasher.spans(data, s, e, view)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = (size <= LONG) & self._known(view, s, size, slot)
        place, count = self.place[slot], self.count[slot]
        miss = np.flatnonzero(~known)
        if len(miss):
            units = [raw[a:b] for a, b in zip(s[miss].tolist(), e[miss].tolist(), strict=True)]
            number = {u: i for i, u in enumerate(dict.fromkeys(units))}
            found = [array("I", self.encode(u.decode())) for u in number]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            at = self._add(np.frombuffer(b"".join(x.tobytes() for x in found), np.uint32)) + np.cumsum(sizes) - sizes
            nth = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
            place[miss], count[miss] = at[nth], sizes[nth]
            # Units of up to LONG bytes are kept; of two for one place the later one stays.
            _, first = np.unique(nth, return_index=True)
            short = np.flatnonzero(size[miss[first]] <= LONG)
            lengths = size[miss[first]][short]
            begin = self._keep(b"".join(u for u in number if len(u) <= LONG)) + np.cumsum(lengths) - lengths
            to = slot[miss[first]][short]
            last = len(to) - 1 - np.unique(to[::-1], return_index=True)[1]
            to, short, lengths, begin = to[last], short[last], lengths[last], begin[last]
            self.place[to], self.count[to], self.begin[to], self.size[to] = at[short], sizes[short], begin, lengths
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(place - before[:-1], count) + np.arange(before[-1])]
        cut = before[np.searchsorted(s, offsets)]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids: array<int>) of each piece."""
    path = path or tokenizer_path()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            names = batch.column(0).to_pylist()
            data, offsets = texts_of(batch.column(1))
            for i, j in blocks(offsets):
                for doc, found in zip(names[i:j], encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                    body = np.concatenate([found, end])
                    for a in range(0, len(body), sequence):
                        piece = body[a : a + sequence]
                        rows.append((doc, a, len(piece), zlib.crc32(piece), len(body)))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(lean(run), schema)


def combinations(lengths: np.ndarray, counts: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, ...]]:
    """Multisets of at most three present lengths whose sum is the sequence; of those with three, the four most plentiful middle ones of each longest length."""
    have = np.zeros(sequence + 1, np.int64)
    have[lengths] = counts
    out = [(sequence,)] if have[sequence] else []
    out += [(a, sequence - a) for a in range(sequence // 2, sequence) if have[a] and have[sequence - a]]
    for a in range(sequence - 2, sequence // 3, -1):
        if have[a]:
            rest = sequence - a
            b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
            supply = np.minimum(have[b], have[rest - b])
            for i in np.argsort(-supply, kind="stable")[:4]:
                if supply[i]:
                    out.append((a, int(b[i]), int(rest - b[i])))
    return out


def solve_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 near the least of |A x - histogram|^2, A holding how often a combination uses a length: accelerated projected gradient."""
    if not combos:
        return np.zeros(0)
    row = np.concatenate([np.array(c) for c in combos])
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    b = histogram.astype(float)
    scale = max(1.0, b.max())
    b = b / scale
    times_a = lambda x: np.bincount(row, x[column], len(b))
    times_t = lambda y: np.bincount(column, y[row], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):
        v = times_t(times_a(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        then = np.maximum(0, z - step * times_t(times_a(z) - b))
        t_then = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = then + (t - 1) / t_then * (then - x), then, t_then
    return x * scale


def plan(histogram: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, left[lengths], sequence)
    out = []
    for combo, want in sorted(zip(combos, np.floor(solve_counts(combos, left) + 1e-6).astype(np.int64), strict=True), key=lambda x: -x[1]):
        use = {n: combo.count(n) for n in combo}
        times = min([int(want), *(int(left[n]) // k for n, k in use.items())])
        if times > 0:
            for n, k in use.items():
                left[n] -= k * times
            out.append((combo, times))
    # Greedy on what is left: the longest piece, then again and again the longest that still fits; repeated while the counts allow.
    while left.any():
        room, used, bag = sequence, np.zeros_like(left), []
        while room > 0:
            fit = np.flatnonzero(left[: room + 1] - used[: room + 1])
            if not len(fit):
                break
            n = int(fit[-1])
            k = min(room // n, int(left[n] - used[n]))
            used[n] += k
            bag += [n] * k
            room -= n * k
        at = np.flatnonzero(used)
        times = int((left[at] // used[at]).min())
        left -= used * times
        out.append((tuple(bag), times))
    return out


def slots(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, end rank, sequence of the first rank, offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for combo, times in steps:
        offset = 0
        for n in combo:
            rank = taken.get(n, 0)
            out.setdefault(n, []).append((rank, rank + times, base, offset))
            taken[n] = rank + times
            offset += n
        base += times
    return out


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read more than once; give a written table."""
    spark = pieces.sparkSession
    # At most as many rows as a sequence has ids.
    histogram = np.zeros(sequence + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r.length] = r.n
    buckets = -(-histogram // BUCKET)
    # The plan and the buckets have a row for each length of a sequence at most, so their size is bounded.
    dealt = spark.createDataFrame([(int(n), int(buckets[n])) for n in np.flatnonzero(histogram)], "length long, _buckets long")
    keyed = pieces.join(F.broadcast(dealt), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_buckets")).cast("int")).drop("_buckets")
    by_length: dict[int, dict[int, int]] = {}
    for r in keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n")).collect():  # at most pieces / BUCKET rows and one for each length
        by_length.setdefault(r.length, {})[r._bucket] = r.n
    rows = []
    for length, places in slots(plan(histogram, sequence)).items():
        held = [by_length[length].get(k, 0) for k in range(int(buckets[length]))]
        rows.append((length, [0, *np.cumsum(held).tolist()], places))
    table = spark.createDataFrame(rows, "length long, bases array<long>, places array<struct<a:long,b:long,base:long,offset:long>>")
    local = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = keyed.withColumn("_local", local).join(F.broadcast(table), "length")
    placed = placed.withColumn("_rank", F.element_at("bases", F.col("_bucket") + 1) + F.col("_local"))
    placed = placed.withColumn("_place", F.filter("places", lambda p: (F.col("_rank") >= p["a"]) & (F.col("_rank") < p["b"]))[0])
    return placed.select(*pieces.columns, (F.col("_place.base") + F.col("_rank") - F.col("_place.a")).alias("sequence_id"), F.col("_place.offset").alias("offset"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(staged(cut_pieces(docs), "pieces"))
