"""Suffix-array deduplication of 100-byte strings by bucket-pointer refinement.

Every byte covered by a 100-byte string that also starts earlier goes.  The
candidates come from ``repeats``; where units of one anchor differ, their windows
are sorted by bucket-pointer refinement: places start in buckets of their 32-byte
prefix, and the buckets that still hold several are refined by sorting on the
bucket of the place a prefix further on.  The new bucket pointers are written
back, so the next turn reads buckets that earlier turns have refined: 32 bytes
become 64, and two buckets of 64 that overlap make 100.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.arrays import U, Texts, chunks, mix, ranges, tidy
from ragloom.llm.repeats import Kind, Symbols, merged, repeated_ranges, with_texts

LENGTH = 100
GRAM = 32
_A, _B, _C, _D = (U(m) for m in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def gram_buckets(data: np.ndarray, a: np.uint64 = _A, b: np.uint64 = _B) -> np.ndarray:
    """64-bit bucket of the 32 bytes from each place, built from halves: 8, 16, 32."""
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    h = np.ndarray(len(data) + GRAM, dtype="<u8", buffer=padded.data, strides=(1,)).astype(U)
    for half in (8, 16):
        h = mix(h[:-half] * a + (h[half:] ^ (h[half:] >> U(29))) * b)
    return h[: len(data)]


def byte_symbols(t: Texts) -> Symbols:
    at = np.arange(len(t.data))
    return Symbols(gram_buckets(t.data), gram_buckets(t.data, _C, _D), t.offsets, at, at + 1)


def refine(bucket: np.ndarray, depth: int, places: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of places whose first ``length`` bytes are compared, given buckets by the first ``depth``.

    While twice the depth fits, all places that later turns read are refined by
    the bucket one depth further on; the last turn reads the refined bucket that
    ends where the string ends.  Places alone in their bucket are left as they are.
    """
    pointer = bucket.copy()

    def turn(active: np.ndarray, offset: int) -> None:
        active = active[np.argsort(pointer[active], kind="stable")]
        own = pointer[active]
        same = own[1:] == own[:-1]
        active = active[np.append(same, False) | np.insert(same, 0, False)] if len(active) else active
        if not len(active):
            return
        a = active[np.lexsort((pointer[active + offset], pointer[active]))]
        own, later = pointer[a], pointer[a + offset]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (later[1:] != later[:-1])
        pointer[a] = mix(own * _A + later * _B)[np.flatnonzero(new)[np.cumsum(new) - 1]]

    while depth < length:
        if 2 * depth <= length:
            last = length - 2 * depth
            turn(np.union1d(places, places + last) if last else places, depth)
            depth *= 2
        else:
            turn(places, length - depth)
            depth = length
    return pointer[places]


def byte_spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(t.data))
    return at, at + 1, t.offsets


def byte_classes(t: Texts, first: np.ndarray) -> np.ndarray:
    return refine(gram_buckets(t.data), GRAM, first, LENGTH)


#: Places at which eight bytes are read to see all of a window.
_EIGHTS = [*range(0, LENGTH - 8, 8), LENGTH - 8]


def _eights(t: Texts) -> np.ndarray:
    padded = np.concatenate([t.data, np.zeros(8, np.uint8)])
    return np.ndarray(len(t.data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))


def byte_equal(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide, same = _eights(t), np.ones(len(a), dtype=bool)
    for at in _EIGHTS:
        same &= wide[a + at] == wide[b + at]
    return same


def byte_ids(t: Texts, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = _eights(t)
    p, q = np.zeros(len(first), U), np.zeros(len(first), U)
    for at in _EIGHTS:
        x = wide[first + at].astype(U)
        p, q = mix(p * _A + x), mix((q ^ x) * _C + _D)
    return p, q


BYTES = Kind(LENGTH, GRAM, byte_symbols, byte_spans, byte_classes, byte_equal, byte_ids, False)


def deduplicate_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row, with keep_text also kept_text, and the columns to carry.

    Keys are whole numbers and order the documents; rows that repeat a key and
    text are one document, each with its row.  Of rows that repeat a key with
    other texts, each loses what is found in any of them, at the same places;
    give such rows keys of their own.  Null and empty texts give zeros
    and the hash of nothing; rows with a null key are not judged.  A cut inside
    a character leaves a broken one, which kept text drops and the hash keeps.
    Only key, text and the columns to carry are read; a carried column may not
    have a name of the result.
    """
    clash = {key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"} & set(carry)
    if clash:
        raise ValueError(f"columns of the result cannot be carried: {sorted(clash)}")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = repeated_ranges(rows, BYTES, "suffixes")
    wide, extra = keep_text, len(carry)
    names = ["key", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * wide

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(2 + extra)
            at = want.offsets.to_numpy().astype(np.int64)
            at, items = at - at[0], want.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            row, lo, hi = merged(row, items.field(0).to_numpy(), items.field(1).to_numpy())
            span_at = np.searchsorted(row, np.arange(b.num_rows + 1))
            removed, sha, kept = [], [], []
            for c in chunks(b.column(1)):
                raw = c.data.tobytes()
                for r in range(c.rows):
                    own = raw[c.offsets[r] : c.offsets[r + 1]]
                    spans = range(span_at[c.first + r], span_at[c.first + r + 1])
                    if spans:
                        cuts = [0, *(int(x) for s in spans for x in (lo[s], hi[s])), len(own)]
                        own = b"".join(own[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                    removed.append(int(c.offsets[r + 1] - c.offsets[r]) - len(own))
                    sha.append(hashlib.sha256(own).hexdigest())
                    if wide:
                        kept.append(own.decode(errors="ignore"))
            n_bytes = np.concatenate([np.diff(c.offsets) for c in chunks(b.column(1))]) if b.num_rows else np.zeros(0, np.int64)
            columns = [b.column(0), *b.columns[2 : 2 + extra], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(span_at), pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * wide, names=names)

    kinds = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    ddl = f"key long{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * wide
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *carry)
    return with_texts(rows, found, "left").mapInArrow(tidy(cut), ddl).withColumnRenamed("key", key)
