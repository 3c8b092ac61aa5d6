"""Word and shingle hashes of whole texts, vectorised over the bytes of an Arrow batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa



def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives freed memory back: workers live on from stage to stage, and what one has
    freed but kept would stand beside what the next one needs."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return out


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes hashed at a time: bounds the memory of a task whatever the length of a text.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: The low bytes of a word of 8 that count, by how many there are.
MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans of more bytes than this are hashed one by one, so that the number of rounds over the others is bounded.
LONG = 256


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte of data on as one word, zeros behind the end; a view of a copy."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


class SpanHasher:
    """64-bit hashes of spans of a run of bytes, 8 bytes a round: each round is a bijection of the state and of its bytes, so
    spans of one length up to 8 bytes never collide and longer ones are mixed without a structure that texts could meet."""

    def spans(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
        """view: eights(data), where the caller has it."""
        view = eights(data) if view is None else view
        size = e - s
        out = mix(view[s] & MASK[np.minimum(size, 8)] ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        more = np.flatnonzero((size > 8) & (size <= LONG))
        at = 8
        while len(more):
            out[more] = mix((out[more] * np.uint64(0xD6E8FEB86659FD93)) ^ (view[s[more] + at] & MASK[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(blake2b(data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
        return out


class WordHasher(SpanHasher):
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of byte strings, A-Z lower-cased, without a Python loop over words."""

    def __call__(self, data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, end byte) of each word; cuts: places that end a word besides white space (ends of texts)."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        word = ~SPACE[data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        ends = np.zeros(n + 1, bool)
        ends[1:n] = word[:-1] & ~word[1:]
        ends[n] = word[-1]
        if cuts is not None and len(cuts):
            inner = cuts[(cuts > 0) & (cuts < n)]
            starts[inner] |= word[inner]
            ends[inner] |= word[inner - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        return self.spans(LOWER[data], s, e), s, e


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about size bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def words_by_text(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each text and the end) for a run of texts."""
    h, s, e = hasher(data, offsets[1:-1])
    return h, s, e, np.searchsorted(s, offsets)


#: Odd multipliers that give a shingle's words their places.
PLACE = _RNG.integers(2**62, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles_by_text(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the shingles of k words of each text; a text with fewer words has them all as one shingle."""
    n = np.diff(first)
    per = np.where(n >= k, n - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), per)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    out = np.zeros(len(owner), np.uint64)
    for i in range(k):
        out += h[at + i] * PLACE[i]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = n[short] > i
            extra[has] += h[first[short][has] + i] * PLACE[i]
        extra += n[short].astype(np.uint64) * PLACE[63]
        owner, out = np.concatenate([owner, short]), np.concatenate([out, extra])
    return owner, mix(out)


def distinct_by_text(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """owner and value sorted by owner, then value, each pair once."""
    order = np.argsort(value)
    small = len(owner) == 0 or owner.max() < 65536
    order = order[np.argsort(owner[order].astype(np.uint16) if small else owner[order], kind="stable")]
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]
