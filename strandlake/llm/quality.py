"""A byte-level convolutional classifier of whole texts, trained and run in numpy.

Filters of WIDTH bytes slide over the UTF-8 bytes of the whole text; overlapping chunks of CHUNK bytes take each filter's
maximum; a logistic layer gives each chunk a logit, and the mean logit over all chunks of the text gives one probability.

The network is fitted on the driver on a bounded sample of labelled texts: at most TRAIN_ROWS of each class, those least by a
hash of their id, and of these in that order as many as hold TRAIN_BYTES bytes; a longer text is passed over, never cut. It learns
from all chunks of each text. Classes are weighted by their counts over all usable labels.
Scoring reads every byte of every text.

Defined cases: a null or empty text is scored as one chunk of padding; null ids are scored and held out by no fold (held_out
false); repeated rows stay; without usable labels of both classes every score is the share of label 1 (0.5 if none);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.text import blocks, give_back, lean, texts_of

WIDTH, FILTERS, STEP = 6, 12, 64
#: A chunk is CHUNK // STEP segments; the next begins STEP bytes before it ends.
CHUNK = 512
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE = 1024, 1 << 23, 18, 64, 0.01
THRESHOLD = 0.3
BLOCK = 1 << 19
#: Chunks whose filter values are held at a time in training.
PART = 64
#: A filter value below all others, for places past the end of a text.
NONE = np.float32(-1e30)


def fold_is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _responses(padded: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter values at each byte of a run that ends with WIDTH - 1 bytes of padding."""
    n = len(padded) - (tables.shape[0] - 1)
    out = np.take(tables[0], padded[:n], axis=0)
    for k in range(1, tables.shape[0]):
        out += np.take(tables[k], padded[k : k + n], axis=0)
    out += bias
    return out


class Network:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.tables = (rng.normal(0, 0.3, (WIDTH, 256, FILTERS))).astype(np.float32)
        self.tables[:, 0] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.top = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.shift = np.float32(0)

    def fit(self, chunks: np.ndarray, size: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
        """chunks: (n, CHUNK + WIDTH - 1) bytes, at the first size of which filters begin; owner: text of each; label and weight of each text. Adam on the log loss."""
        rng = np.random.default_rng(seed)
        params = [self.tables, self.bias, self.top]
        slope, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        shift_m = shift_v = 0.0
        by_text = [np.flatnonzero(owner == i) for i in range(len(label))]
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for at in range(0, len(order), BATCH):
                texts = order[at : at + BATCH]
                rows = np.concatenate([by_text[i] for i in texts])
                local = np.repeat(np.arange(len(texts)), [len(by_text[i]) for i in texts])
                data = chunks[rows]
                # Filter values are made for PART chunks at a time, so that memory does not follow the longest texts.
                best = np.empty((len(rows), FILTERS), np.int64)
                peak = np.empty((len(rows), FILTERS), np.float32)
                for i in range(0, len(rows), PART):
                    some = data[i : i + PART]
                    values = np.take(self.tables[0], some[:, :CHUNK], axis=0)
                    for k in range(1, WIDTH):
                        values += np.take(self.tables[k], some[:, k : k + CHUNK], axis=0)
                    values[np.arange(CHUNK) >= size[rows[i : i + PART]][:, None]] = NONE
                    best[i : i + PART] = values.argmax(1)
                    peak[i : i + PART] = np.take_along_axis(values, best[i : i + PART, None, :], 1)[:, 0] + self.bias
                active = np.maximum(peak, 0)
                count = np.bincount(local, minlength=len(texts))
                logit = np.bincount(local, active @ self.top + self.shift, len(texts)) / count
                p = 1 / (1 + np.exp(-logit))
                g = (p - label[texts]) * weight[texts] / weight[texts].sum()
                row_g = (g / count)[local].astype(np.float32)
                d_top = active.T @ row_g + 1e-4 * self.top
                d_peak = row_g[:, None] * self.top * (peak > 0)
                d_tables = 1e-5 * self.tables
                filters = np.broadcast_to(np.arange(FILTERS), best.shape)
                for k in range(WIDTH):
                    np.add.at(d_tables[k], (np.take_along_axis(data, best + k, 1), filters), d_peak)
                t += 1
                for i, d in enumerate((d_tables, d_peak.sum(0), d_top)):
                    slope[i] = 0.9 * slope[i] + 0.1 * d
                    square[i] = 0.99 * square[i] + 0.01 * d * d
                    params[i] -= RATE * (slope[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-7)
                shift_m, shift_v = 0.9 * shift_m + 0.1 * row_g.sum(), 0.99 * shift_v + 0.01 * row_g.sum() ** 2
                self.shift -= np.float32(RATE * (shift_m / (1 - 0.9**t)) / (np.sqrt(shift_v / (1 - 0.99**t)) + 1e-7))
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability a text, from all of its bytes. Texts are laid out on borders of STEP bytes, padded with zeros."""
        sizes = np.diff(offsets)
        segments = -(-(sizes + WIDTH - 1) // STEP)
        first = np.concatenate([[0], np.cumsum(segments)])
        out, total = np.zeros(int(first[-1]) * STEP + WIDTH - 1, np.uint8), int(offsets[-1])
        place = np.arange(total) + np.repeat(first[:-1] * STEP - offsets[:-1], sizes)
        out[place] = data[:total]
        # Filters start at bytes of a text only (an empty one has one place); the padding behind it is long enough for them.
        past = np.ones(len(out), bool)
        past[place] = False
        past[first[:-1] * STEP] = False
        peaks = np.empty((int(first[-1]), FILTERS), np.float32)
        for a in range(0, len(peaks), 4096):
            b = min(a + 4096, len(peaks))
            values = _responses(out[a * STEP : b * STEP + WIDTH - 1], self.tables, self.bias)
            values[past[a * STEP : b * STEP]] = NONE
            values.reshape(b - a, STEP, FILTERS).max(1, out=peaks[a:b])
        per, hop = CHUNK // STEP, CHUNK // STEP - 1
        chunks = np.maximum(1, -(-(segments - 1) // hop))
        owner = np.repeat(np.arange(len(sizes)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = first[owner] + nth * hop
        end = np.minimum(begin + per, first[owner + 1])
        peak = peaks[begin].copy()
        for k in range(1, per):
            np.maximum(peak, peaks[np.minimum(begin + k, end - 1)], out=peak)
        logit = np.maximum(peak, 0) @ self.top + self.shift
        mean = np.bincount(owner, logit, len(sizes)) / chunks
        return 1 / (1 + np.exp(-np.clip(mean, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | float:
    """A network fitted on labels(doc_id, quality) outside the held-out fold; the share of label 1 where one class lacks."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~fold_is_held_out(F.col("doc_id"))).select("doc_id", "quality")
    counts = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    chosen = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    # Whole texts of the chosen rows, each under the bound, then as many as fit into it: what comes to the driver is bounded.
    bodies = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text").between(1, TRAIN_BYTES))
    found = bodies.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "quality", "text", F.xxhash64("doc_id").alias("turn"))
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("turn", "doc_id", "quality", "text").rowsBetween(Window.unboundedPreceding, 0))
    found = sorted(found.withColumn("upto", upto).where(F.col("upto") <= TRAIN_BYTES).collect(), key=lambda r: (r.doc_id, r.quality, r.text))
    if len({r.quality for r in found}) < 2:
        return counts.get(1, 0) / sum(counts.values())
    parts, owner, size = [], [], []
    for i, r in enumerate(found):
        data = np.frombuffer(r.text.encode(), np.uint8)
        cut, inside = chunks_of(data)
        parts.append(cut)
        size.append(inside)
        owner.append(np.full(len(cut), i))
    label = np.array([r.quality for r in found], np.float32)
    share = np.array([counts[q] / sum(counts.values()) / (label == q).mean() for q in (0, 1)], np.float32)
    model = Network().fit(np.concatenate(parts), np.concatenate(size), np.concatenate(owner), label, share[label.astype(int)])
    del found, parts
    give_back()
    return model


def chunks_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text as score lays them out, each with the bytes that filters at its end reach, and at how many of its bytes filters begin."""
    segments = -(-(len(data) + WIDTH - 1) // STEP)
    hop = CHUNK // STEP - 1
    begin = np.arange(max(1, -(-(segments - 1) // hop))) * hop * STEP
    padded = np.zeros(int(begin[-1]) + CHUNK + WIDTH - 1, np.uint8)
    padded[: len(data)] = data
    return padded[begin[:, None] + np.arange(CHUNK + WIDTH - 1)], np.clip(len(data) - begin, 1, CHUNK)


def scored(docs: DataFrame, model: Network | float, text: str = "text", keep: tuple[str, ...] | None = None, score: str = "score") -> DataFrame:
    """docs, or its columns keep, with a column score, from whole texts only. A column of that name in docs gives way."""
    fields = [f for f in docs.schema.fieldNames() if f != score]
    docs = docs.select(*fields)
    at = fields.index(text)
    kept = [fields.index(f) for f in keep or fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(at))
            out = np.empty(batch.num_rows)
            for i, j in blocks(offsets, BLOCK):
                out[i:j] = model if isinstance(model, float) else model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(out)], names=[*[fields[k] for k in kept], score])

    return docs.mapInArrow(lean(run), docs.select(*[fields[k] for k in kept], F.lit(0.0).alias(score)).schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)

    rows = scored(docs.select(F.col("doc_id").cast("long"), "text"), model, keep=("doc_id",))
    return rows.select("doc_id", fold_is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
