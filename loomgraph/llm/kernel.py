"""Word arithmetic on whole Arrow text columns.

A text column is read as one byte buffer.  Words, their 64-bit hashes and the hashes of word
n-grams come from a few numpy passes over it, in chunks of about ``CHUNK`` bytes so that memory is
bounded by the chunk (or by the longest single document).  Documents are never cut.
"""
from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STATE = "_loomgraph_worker_state"


def worker_state(key, make: Callable):
    """A value that lives as long as the Python worker (models, word caches), made on first use."""
    holder = sys.modules.setdefault(_STATE, types.ModuleType(_STATE)).__dict__
    if key not in holder:
        holder[key] = make()
    return holder[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the (odd) base and of its inverse modulo 2**64."""
    def make(size: int):
        out = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        return tuple(out)

    kept = worker_state("powers", lambda: [make(2 * CHUNK)])
    if len(kept[0][0]) < n:
        return make(n)
    return kept[0][0][:n], kept[0][1][:n]


class Texts(NamedTuple):
    """Documents ``first`` up to ``last`` of a batch: their bytes and where each begins."""
    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """The column's UTF-8 bytes, whole documents at a time; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(buffers[1], kind, n + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(raw) * np.asarray(column.is_valid())
        if lengths.sum() != raw[-1] - raw[0]:  # a null slot may hold bytes
            column = column.fill_null("")
            yield from text_chunks(column, limit)
            return
    first = 0
    while first < n:
        last = int(np.searchsorted(raw, raw[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield Texts(first, last, data[raw[first]:raw[last]], raw[first:last + 1] - raw[first])
        first = last


def row_slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        taken = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, taken + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def byte_table(separators) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: Separators of blank-split words, and of alphanumeric words, as byte tables.
BLANKS = byte_table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Hash and byte range of each word, the document it is in, and each document's word range."""
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    bounds: np.ndarray


def words(texts: Texts, separators: np.ndarray = BLANKS, fold: bool = True) -> Words:
    """The words of some documents, lower-cased (A-Z) unless ``fold`` is off."""
    data, offsets = LOWER[texts.data] if fold else texts.data, texts.offsets
    n_docs, size = len(offsets) - 1, len(data)
    if not size:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, empty, np.zeros(n_docs + 1, np.int64))
    inside = ~separators[data]
    before = np.empty(size + 1, bool)  # before[i]: position i-1 belongs to the same run
    before[0] = False
    before[1:] = inside
    before[offsets[:-1][offsets[:-1] < size]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(size, bool)  # after[i]: position i+1 continues the run
    after[:-1] = inside[1:] & before[1:-1]
    after[-1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    docs = np.searchsorted(offsets, starts, "right") - 1
    bounds = np.searchsorted(starts, offsets)
    return Words(hashes, starts, ends, docs, bounds)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` hashes (runs across documents too; the caller masks those)."""
    size = len(hashes)
    if size < n:
        return np.zeros(0, np.uint64)
    up, down = powers(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:size - n + 1] + np.uint64(n))


def as_long(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))
