"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs
that skip one word, and of its words' first letters (once if they occur, once
more if they occur twice); punctuation separates words.  Shards of the training
rows run FTRL-proximal on their own, with a learning rate per coordinate and L1
on all weights but the constant's, and their states are averaged after each
pass.  L1 leaves few weights, which are all that scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.arrays import LOWER, U, Shingles, Texts, batch, chunks, group_cuts, mix, per_row, sorted_distinct, tidy, words
from ragloom.session import stash, text_batches, unstash

BITS = 20
SIZE = (1 << BITS) + 1
#: Labelled rows to learn from at most, those with the smallest hash of their key.
MAX_TRAIN_ROWS = 20_000
#: Training rows that a feature needs.
MIN_ROWS = 3
SHARDS = 4
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
#: Bytes of a word that stand for its beginning.
STEM = 5

_BREAKS = np.arange(256, dtype=np.uint8)
_BREAKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20
_PAIR, _SKIP, _STEM = U(0x8CB92BA72F3D8DD7), U(0xF1357AEA2E62A9C5), U(0x100000001B3)
#: L1 by feature: none on the constant, which comes last.
_PENALTY = np.full(SIZE, L1)
_PENALTY[-1] = 0.0


class Model(NamedTuple):
    """Non-zero weights by feature; the last feature is the constant."""

    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(SIZE, dtype=np.float32)
        out[self.index] = self.weight
        return out


def features(t: Texts) -> Shingles:
    """Distinct feature numbers (below 2**BITS) of each text, sorted."""
    data = LOWER[_BREAKS[t.data]]
    w = words(Texts(t.first, data, t.offsets))
    row, h = w.row, w.hash
    pair = row[1:] == row[:-1]
    skip = row[2:] == row[:-2]
    padded = np.concatenate([data, np.zeros(STEM, np.uint8)])
    stem = np.zeros(len(h), U)
    for k in range(STEM):
        stem = stem * _STEM + np.where(w.start + k < w.end, padded[w.start + k], 0) + U(1)
    stem = np.sort((row.astype(U) << U(BITS)) | (mix(stem) >> U(64 - BITS)))
    again = sorted_distinct(stem[1:][stem[1:] == stem[:-1]])
    again = (again >> U(BITS) << U(BITS)) | (mix(again & U(SIZE - 2)) >> U(64 - BITS))
    all_h = np.concatenate([h, (h[:-1] * _PAIR + h[1:])[pair], (h[:-2] * _SKIP + h[2:])[skip]])
    all_row = np.concatenate([row, row[1:][pair], row[2:][skip]])
    code = sorted_distinct(np.concatenate([(all_row.astype(U) << U(BITS)) | (all_h >> U(64 - BITS)), stem, again]))
    return Shingles((code & U(SIZE - 2)).astype(np.int64), np.searchsorted(code >> U(BITS), np.arange(t.rows + 1).astype(U)))


def ftrl(rows: Iterator[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (features, label) rows, changing the state z, n in place."""
    for x, y in rows:
        zx, nx, penalty = z[x], n[x], _PENALTY[x]
        root = np.sqrt(nx)
        w = np.where(np.abs(zx) <= penalty, 0.0, (np.sign(zx) * penalty - zx) / ((BETA + root) / ALPHA + L2))
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        sigma = (np.sqrt(nx + g * g) - root) / ALPHA
        z[x] = zx + g - sigma * w
        n[x] = nx + g * g


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= _PENALTY, 0.0, (np.sign(z) * _PENALTY - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold


def _packed(x: np.ndarray) -> bytes:
    """Sorted feature numbers as compressed differences."""
    return pa.compress(np.diff(x, prepend=0).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data.as_buffer(), 4 * n, codec="zstd"), np.uint32), dtype=np.int64)


def _dense(block: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(block, SIZE * np.dtype(kind).itemsize, codec="zstd"), kind)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, passes: int = PASSES) -> Model:
    """Learn from labelled rows that are not held out.

    At most max_rows of them, so the list of keys may be broadcast and no text
    is shuffled; the texts' features are written once.  Features of fewer than
    MIN_ROWS training rows have no weight.  Rows with a null label or key are
    left out, and labels that repeat a key count as the largest.  The state is
    SIZE pairs of numbers, whatever the input, and SHARDS of them come to the
    driver in each pass; without labelled rows all scores are 0.5.
    """
    sc = docs.sparkSession.sparkContext
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    rows = rows.select("label", F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int").alias("shard"), "text", F.xxhash64("key").alias("turn"))
    schema = pa.schema([("label", pa.int32()), ("shard", pa.int32()), ("turn", pa.int64()), ("n", pa.int32()), ("x", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(2)):
                f = features(c)
                x = [_packed(f.hash[lo:hi]) for lo, hi in zip(f.offsets[:-1], f.offsets[1:], strict=True)]
                yield batch(schema, *(b.column(i).slice(c.first, c.rows) for i in (0, 1, 3)), np.diff(f.offsets), x)

    data = stash(rows.mapInArrow(tidy(extract), "label int, shard int, turn long, n int, x binary"), "toxicity-features")
    block = pa.schema([("z", pa.binary()), ("n", pa.binary())])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(SIZE, np.int32)
        for b in batches:
            for x, n in zip(b.column(1), b.column(0).to_pylist(), strict=True):
                times[_unpacked(x, n)] += 1
        if times.any():
            yield batch(block, [pa.compress(times.tobytes(), codec="zstd", asbytes=True)], [b""])

    times = np.zeros(SIZE, np.int64)
    for r in data.select("n", "x").coalesce(SHARDS).mapInArrow(tidy(seen), "z binary, n binary").toLocalIterator():
        times += _dense(bytes(r.z), np.int32)
    use = times >= MIN_ROWS
    use[-1] = True
    shared_use = sc.broadcast(use)
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    dealt = data.repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn", "x").select("shard", "label", "n", "x")
    for turn in range(passes):
        start = sc.broadcast((z, n))

        def learn(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            """A shard comes whole and in order; every shard starts from the state of the last pass."""
            z0, n0 = start.value
            use, shard = shared_use.value, None
            z = n = z0

            def moved() -> Iterator[pa.RecordBatch]:
                if shard is not None:
                    yield batch(block, *([pa.compress((a - b).astype(np.float32).tobytes(), codec="zstd", asbytes=True)] for a, b in ((z, z0), (n, n0))))

            for b in batches:
                own = b.column(0).to_numpy()
                y, size = b.column(1).to_numpy(), b.column(2).to_numpy()
                cuts = group_cuts(own)
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if own[lo] != shard:
                        yield from moved()
                        z, n, shard = z0.copy(), n0.copy(), own[lo]
                    order = lo + np.random.default_rng(turn).permutation(hi - lo)
                    packed = ((_unpacked(b.column(3)[r], size[r]), int(y[r])) for r in order)
                    ftrl(((np.append(x[use[x]], SIZE - 1), y) for x, y in packed), z, n)
            yield from moved()

        moves = [(_dense(bytes(r.z), np.float32), _dense(bytes(r.n), np.float32)) for r in dealt.mapInArrow(tidy(learn), "z binary, n binary").collect()]
        # Shards that saw a feature share its move.
        by = np.maximum(sum((dz != 0) | (dn != 0) for dz, dn in moves), 1) if moves else 1
        z, n = z + sum(dz for dz, _ in moves) / by, n + sum(dn for _, dn in moves) / by
        start.destroy()
    shared_use.destroy()
    unstash(data)
    w = weights(z, n)
    index = np.flatnonzero(w)
    return Model(index.astype(np.int32), w[index].astype(np.float32))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted for each row; empty and null texts score the constant alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.dense()
        for b in batches:
            for c in chunks(b.column(1)):
                f = features(c)
                total = per_row(np.add, w[f.hash].astype(np.float64), f.offsets, 0.0) + float(w[-1])
                p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows), pa.array(p)], names=["key", "score"])

    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(apply), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows and score every row of docs.

    Null and empty texts get the score of the constant; rows with a null key
    are scored and not held out; repeated rows each give a row; an empty table
    gives none.  Only key, text and label are read, whatever else there is.
    """
    text_batches(docs.sparkSession)
    return score(docs, train(docs, labels, **options), options.get("key", "doc_id"), options.get("text", "text"))
