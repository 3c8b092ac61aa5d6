"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Normalised words are runs of letters and digits (and of bytes beyond ASCII), lower-cased. For each template, stretches of a text are
taken that begin and end with bigrams of the template. A stretch of m bigrams can reach the coefficient d with a template of t
distinct ones only if d / (2 - d) <= m' / t <= (2 - d) / d for its m' distinct bigrams, and if it holds enough of the template's;
only templates that pass both bounds are compared exactly. Of overlapping findings the one with the most shared bigrams stays.

Defined cases: a null or empty text holds no licence; texts of any length are read whole; null ids and repeated rows stay;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.licence_texts import TEMPLATES
from strandlake.llm.text import PLACE, WordHasher, blocks, lean, mix, texts_of

DICE = 0.8
#: Less than any difference of bounds over counts, more than their rounding errors: a coefficient of just DICE is one.
TINY = 1e-6
MAP_BITS = 20
#: Bytes that are no part of a word become spaces.
PLAIN = np.full(256, 0x20, np.uint8)
for _c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    PLAIN[_c] = _c


def bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * PLACE[20] + words[1:] * PLACE[21]) if len(words) > 1 else np.empty(0, np.uint64)


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE) -> None:
        self.hasher, self.dice = WordHasher(), dice
        self.names = [n for n, _ in templates]
        all_grams = [bigrams(self.hasher(PLAIN[np.frombuffer(t.encode(), np.uint8)])[0]) for _, t in templates]
        self.grams = [np.unique(g) for g in all_grams]
        #: How many bigrams a template has for each distinct one.
        self.repeats = [len(g) / len(u) for g, u in zip(all_grams, self.grams, strict=True)]
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[(np.concatenate(self.grams) >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(text, licence, coefficient, first byte, end byte) by text and place."""
        words, s, e = self.hasher(PLAIN[data], offsets[1:-1])
        first = np.searchsorted(s, offsets)
        gram = bigrams(words)
        near = np.flatnonzero(self.map[(gram >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        if not len(near):
            return []
        text = np.searchsorted(first, near, "right") - 1
        inside = near + 1 < first[text + 1]
        near, text = near[inside], text[inside]
        found = []
        # The place before each one that has the same bigram, or -1.
        order = np.argsort(gram, kind="stable")
        before = np.full(len(gram), -1)
        same = gram[order[1:]] == gram[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        for k, mine in enumerate(self.grams):
            at = np.searchsorted(mine, gram[near])
            is_mine = mine[np.minimum(at, len(mine) - 1)] == gram[near]
            places, owner = near[is_mine], text[is_mine]
            t = len(mine)
            least, most = self.dice / (2 - self.dice) * t - TINY, (2 - self.dice) / self.dice * t + TINY
            # A stretch of at most that many distinct bigrams from each place on, repeated as in the template.
            end = np.minimum(np.searchsorted(places, places + int(most * self.repeats[k]), "right"), np.searchsorted(owner, owner, "right"))
            shared = np.minimum(end - np.arange(len(places)), t)
            for i in np.flatnonzero(2 * shared >= self.dice * (t + shared) - TINY):
                p, last = int(places[i]), int(end[i])
                # A bigram is new in a stretch if it was last seen before it.
                seen = np.cumsum(before[places[i:last]] < p)
                if 2 * seen[-1] < self.dice * (t + seen[-1]) - TINY:
                    continue
                m = np.cumsum(before[p : places[last - 1] + 1] < p)[places[i:last] - p]
                d = np.where((least <= m) & (m <= most), 2 * seen / (t + m), 0.0)
                j = int(d.argmax())
                if d[j] >= self.dice:
                    found.append((int(owner[i]), -int(seen[j]), -float(d[j]), k, p, int(places[i + j]) + 2))
        out: list[tuple[int, int, int, int, float]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for owner_i, _, d, k, a, b in sorted(found):
            spans = taken.setdefault(owner_i, [])
            if all(b <= x or a >= y for x, y in spans):
                spans.append((a, b))
                out.append((owner_i, a, b, k, -d))
        return [(t, self.names[k], d, int(s[a]), int(e[b - 1])) for t, a, b, k, d in sorted(out)]


def find_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, licence, dice, first_byte, end_byte of each finding in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, dice)
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = texts_of(batch.column(1))
            rows = []
            for i, j in blocks(offsets):
                base = int(offsets[i])
                for t, name, d, a, b in known.find(data[base : offsets[j]], offsets[i : j + 1] - base):
                    shift = base - int(offsets[i + t])
                    rows.append((ids[i + t], name, d, a + shift, b + shift))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "licence", "dice", "first_byte", "end_byte"])

    return docs.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(lean(run), "doc_id long, licence string, dice double, first_byte long, end_byte long")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
