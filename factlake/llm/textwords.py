"""Words and word windows of a whole Arrow text column, hashed with array operations.

A word is a run of characters other than the six ASCII white-space characters, so words can be
found and hashed on the UTF-8 bytes. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_PHRASE = U(0xD1342543DE82EF95)
_STEP = U(0x9E3779B97F4A7C15)
_SHORT = 64  # bytes of a word that are hashed in array steps of eight

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = np.asarray(x, U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a run of texts. ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray  # the UTF-8 bytes, lower-cased if asked
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes wherever they stand.

        Eight bytes at a time pass through ``mix``, which isn't linear in them, so words can't cancel
        as they do in a polynomial modulo 2**64. Words above 64 bytes are hashed by BLAKE2b.
        """
        size = self.ends - self.starts
        out = mix(size.astype(U) * _STEP + U(salt))
        padded = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        here = np.flatnonzero(size <= _SHORT) if (size > _SHORT).any() else None
        at, left = (self.starts, size) if here is None else (self.starts[here], size[here])
        while len(at):
            part = eight[at]
            unused = np.maximum(8 - left, 0).astype(U) * U(8)
            part = (part << unused) >> unused
            if here is None:
                out = mix(out * _STEP ^ part)
            else:
                out[here] = mix(out[here] * _STEP ^ part)
            more = np.flatnonzero(left > 8)
            here = more if here is None else here[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _SHORT):
            word = blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8))
            out[i] = int.from_bytes(word.digest())
        return out


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Find the words of each text."""
    data, offsets = utf8(texts)
    if lower:
        data = LOWER[data]
    space = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, nulls as empty, and where each text begins and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rolling(hashes: np.ndarray, k: int, step: np.uint64 = _PHRASE) -> np.ndarray:
    """A polynomial in ``step`` over each k hashes in a row, by joining halves."""
    if k == 1:
        return hashes.copy()
    half = k // 2
    out = rolling(hashes, half, step)
    power = U(pow(int(step), half, 1 << 64))
    out = out[: max(0, len(out) - half)] * power + out[half:]
    if k % 2:
        out = out[: max(0, len(out) - 1)] * step + hashes[k - 1 :]
    return out


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """The words at which k words in a row stay in one text."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return np.flatnonzero(left >= k)


def phrases(hashes: np.ndarray, first: np.ndarray, k: int, step: np.uint64 = _PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that stay in one text, and the index of their first word."""
    at = inside(first, k)
    return mix(rolling(hashes, k, step)[at]) if len(at) else np.zeros(0, U), at


def slices(batch: pa.RecordBatch | pa.Table, text: str, most: int = 1 << 21, rows: int = 4096) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cut a batch into runs of whole rows with about ``most`` bytes of text and at most ``rows`` rows, to bound memory."""
    release()
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    total = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        before = total[i - 1] if i else 0
        j = max(i + 1, min(i + rows, int(np.searchsorted(total, before + most, "right"))))
        yield batch.slice(i, j - i)
        i = j
    release()


def release() -> None:
    """Give memory that arrays no longer use back to the system, where its allocator can.

    Workers live through many tasks, and what one task freed would count against the next one's limit.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another allocator, which does as it likes
    _TRIM = None


def loosened(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A struct column whose fields may all be null, as a schema without nullability declares them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fields = [pa.field(f.name, f.type) for f in column.type]
    return pa.StructArray.from_arrays([column.field(i) for i in range(len(fields))], fields=fields)
