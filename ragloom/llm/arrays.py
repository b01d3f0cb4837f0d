"""Array helpers for code that runs inside ``mapInArrow`` tasks.

Spark hands a task Arrow record batches; a string column is then one byte buffer
plus offsets, which numpy reads without making a Python string per row.  All
helpers work on such buffers, a few megabytes at a time, so a task's memory
follows ``CHUNK_BYTES`` (or the longest single text) and not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

U = np.uint64
#: Odd multipliers; any fixed odd 64-bit numbers would do.
_BASES = [(U(p), U(pow(p, -1, 1 << 64))) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_COMBINE = np.array([0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xF1357AEA2E62A9C5, 0x2545F4914F6CDD1D, 0xDA942042E4DD58B5, 0x9FB21C651E98DF25], dtype=U)

#: The white space that separates words everywhere in this subpackage: blank and \t \n \v \f \r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 64), base, dtype=U)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (multiply and xor-shift)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def sorted_distinct(a: np.ndarray) -> np.ndarray:
    """Sorted values without repeats; numpy's own unique() hashes, which codes with equal low bits slow down many times."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``, which gives freed memory back to the system at a task's end.

    Spark keeps a worker process for later tasks and stages, and the process
    would keep what its largest task had freed.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


class Texts(NamedTuple):
    """Some consecutive rows of a string column: bytes, and rows+1 offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column.  Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column in runs of rows of about ``limit`` bytes; a longer text comes alone."""
    raw, offsets = flat(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        own = offsets[at : end + 1]
        yield Texts(at, raw[own[0] : own[-1]], own - own[0])
        at = end


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each place of a are those from b, eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    # A long range is one comparison of its own, so the loop below has few turns.
    for i in np.flatnonzero(size > 4096):
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    left, at = np.flatnonzero((size > 0) & (size <= 4096)), 0
    while len(left):
        differ = wide[a[left] + at] ^ wide[b[left] + at]
        rest = size[left] - at
        short = rest < 8
        differ[short] &= (U(1) << (rest[short] * 8).astype(U)) - U(1)
        same[left[differ != 0]] = False
        left, at = left[(differ == 0) & (rest > 8)], at + 8
    return same


class Words(NamedTuple):
    """Words of some texts: byte range and hash of each, and rows+1 word offsets."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words(t: Texts, lower: bool = False) -> Words:
    """Maximal runs of non-space bytes, which is ``[^\\x20\\x09-\\x0D]+`` on UTF-8.

    The hash of a word is a polynomial in its bytes, read off prefix sums so
    that no loop over words is needed, then finalised.
    """
    data, offsets = t.data, t.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none.view(U), np.zeros(len(offsets), np.int64))
    if lower:
        data = LOWER[data]
    space = _SPACE[data]
    full = np.flatnonzero(np.diff(offsets))
    first, last = offsets[full], offsets[full + 1] - 1
    starts, ends = ~space, ~space
    starts[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    starts[first] = ~space[first]
    ends[last] = ~space[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(start, end, _polynomial(data, start, end, 0), np.searchsorted(start, offsets))


def _polynomial(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Finalised polynomial hash of the bytes of each word, to one of two bases."""
    base, inverse = _BASES[which]
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * _power(base, f"p{which}", len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(inverse, f"q{which}", len(data))[start] + (end - start).astype(U))


def second_hash(t: Texts, w: Words) -> np.ndarray:
    """A hash of the same words, case kept, that owes nothing to the first."""
    return _polynomial(t.data, w.start, w.end, 1) if len(w.start) else w.hash


class Shingles(NamedTuple):
    hash: np.ndarray
    offsets: np.ndarray


def shingles(w: Words, n: int) -> Shingles:
    """Hash of each n-word window; a text of 1 to n-1 words has one shingle, all its words."""
    count = np.diff(w.offsets)
    if not len(w.hash):
        return Shingles(w.hash, w.offsets)
    acc = np.zeros(len(w.hash), dtype=U)
    for k in range(n):
        acc[: max(len(acc) - k, 0)] += w.hash[k:] * _COMBINE[k]
    acc = mix(acc)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    starts = np.repeat(w.offsets[:-1], own) + ranges(own)
    out = acc[starts]
    offsets = np.concatenate([[0], np.cumsum(own)])
    for r in np.flatnonzero((count > 0) & (count < n)):
        h = w.hash[w.offsets[r] : w.offsets[r + 1]]
        out[offsets[r]] = mix((h * _COMBINE[: len(h)]).sum(dtype=U, keepdims=True) + U(len(h)))[0]
    return Shingles(out, offsets)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, concatenated."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths)


def distinct(s: Shingles) -> Shingles:
    """Each row's hashes sorted and without repeats."""
    row = np.repeat(np.arange(len(s.offsets) - 1), np.diff(s.offsets))
    order = np.lexsort((s.hash, row))
    h, row = s.hash[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return Shingles(h[keep], np.searchsorted(row[keep], np.arange(len(s.offsets))))


def per_row(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduceat`` by row, with a value for rows that have none."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[full])
    return out


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def whole_groups(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes that never cut a group; batches come sorted by their first column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        if held and size >= limit:
            key = b.column(0).to_numpy(zero_copy_only=False)
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.argmax(key != last)) if (key != last).any() else b.num_rows
            if cut:
                held.append(b.slice(0, cut))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [b.slice(cut)], b.slice(cut).nbytes
            continue
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)


def group_cuts(key: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal values, with the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
