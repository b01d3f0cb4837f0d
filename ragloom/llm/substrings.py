"""Incremental deduplication of word windows over a log-structured fingerprint index.

The index is a list of immutable runs, each a table bucketed and sorted by the
anchors of its documents' windows.  A new batch is written as the newest run; it
is merge-joined, bucket by bucket, with itself and with older runs; what shares
an anchor is compared, and runs of similar size are compacted into one, which
keeps a unit's smallest document only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.arrays import U, Texts, chunks, equal_bytes, mix, second_hash, tidy, words
from ragloom.llm.repeats import Kind, Symbols, compare_windows, judged, merged, scan_units, with_texts
from ragloom.session import stash, text_batches, unstash

WINDOW = 13
GRAM = 5
#: A run is merged with the one before it if it has more than this share of its rows.
SIMILAR = 0.6

_WEIGHTS = mix(np.arange(101, 101 + GRAM, dtype=U)) | U(1)


def word_symbols(t: Texts) -> Symbols:
    w = words(t)
    grams = []
    for h in (w.hash, second_hash(t, w)):
        gram = np.zeros(len(h), U)
        for k in range(GRAM):
            gram[: max(len(h) - k, 0)] += h[k:] * _WEIGHTS[k]
        grams.append(mix(gram))
    return Symbols(*grams, w.offsets, w.start, w.end)


def word_spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words(t)
    return w.start, w.end, w.offsets


def word_ids(t: Texts, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(t)
    out = []
    for h in (w.hash, second_hash(t, w)):
        window = np.zeros(len(h), U)
        for k in range(WINDOW):
            window[: max(len(h) - k, 0)] += mix(h[k:] + U(k)) * _WEIGHTS[k % GRAM]
        out.append(mix(window)[first])
    return out[0], out[1]


def word_classes(t: Texts, first: np.ndarray) -> np.ndarray:
    return word_ids(t, first)[0]


def word_equal(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word by word: lengths and hashes first, then the bytes."""
    w = words(t)
    size = w.end - w.start
    same = np.ones(len(a), dtype=bool)
    for values in (size, w.hash):
        for k in range(WINDOW):
            same &= values[a + k] == values[b + k]
    left = np.flatnonzero(same)
    i, j = a[left], b[left]
    # A window that goes on from the pair before it has one new word.
    on = np.zeros(len(left), dtype=bool)
    on[1:] = (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1)
    whole = np.arange(WINDOW)
    p = np.concatenate([(i[~on, None] + whole).ravel(), i[on] + WINDOW - 1])
    q = np.concatenate([(j[~on, None] + whole).ravel(), j[on] + WINDOW - 1])
    wrong = np.flatnonzero(~equal_bytes(t.data, w.start[p], w.start[q], size[p]))
    if len(wrong):
        n = len(size)
        for k in range(WINDOW):
            same[left] &= ~np.isin((i + k) * n + j + k, p[wrong] * n + q[wrong])
    return same


WORDS = Kind(WINDOW, GRAM, word_symbols, word_spans, word_classes, word_equal, word_ids, True)


class FingerprintIndex:
    """Runs of window fingerprints, oldest first.

    Batches come in the order of their keys: a later batch's documents have
    larger keys than all earlier ones, or are judged as if they had.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        """``buckets``: of every run; by default as many as the session's shuffle partitions, so that they follow the input."""
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []

    def _write(self, units: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        dealt = units.repartition(self.buckets, "anchor").sortWithinPartitions("anchor", "unit")
        dealt.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor", "unit").saveAsTable(name)
        return name

    def _live(self, run: str) -> DataFrame:
        return self.spark.table(run).where("not settled")

    def add(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """(key, lo, hi) ranges of words that repeat, for a batch of (key, text); history: the texts of all batches up to this one."""
        settled = F.col("anchor").isNull()
        units = scan_units(batch, WORDS).withColumn("settled", settled).withColumn("anchor", F.coalesce("anchor", F.xxhash64("key")))
        run = self._write(units)
        new = self._live(run)
        shared = Window.partitionBy("anchor")
        hit = (F.min("key").over(shared) != F.max("key").over(shared)) | F.max("hot").over(shared)
        marked = new.withColumn("hit", hit)
        for i, old in enumerate(self.runs):
            anchors = self._live(old).select("anchor").distinct().withColumn(f"old{i}", F.lit(True))
            marked = marked.join(anchors.hint("merge"), "anchor", "left").withColumn("hit", F.col("hit") | F.col(f"old{i}").isNotNull()).drop(f"old{i}")
        both = marked.where("hit").drop("hit", "settled").withColumn("new", F.lit(True))
        for old in self.runs:
            known = self._live(old).join(new.select("anchor").hint("merge"), "anchor", "left_semi").drop("settled").withColumn("new", F.lit(False))
            both = both.unionByName(known)
        both = stash(both, "fingerprint-candidates")
        found = stash(judged(both.repartition("anchor", "salt"), WORDS), "fingerprint-matches")
        compared = stash(compare_windows(history, found.where("state = 2"), WORDS), "fingerprint-windows")
        settled_here = self.spark.table(run).where("settled").select("key", "lo", "hi")
        out = stash(settled_here.union(found.where("state = 1").select("key", "lo", "hi")).union(compared), "fingerprint-ranges")
        unstash(both, found, compared)
        self.runs.append(run)
        return out

    def compact(self) -> None:
        """Merge the newest runs while they are of similar size."""
        while len(self.runs) > 1:
            sizes = [self._live(r).count() for r in self.runs[-2:]]
            if sizes[1] <= SIMILAR * sizes[0]:
                return
            pair = self.runs[-2:]
            first = F.min(F.struct("key", "lo", "hi", "salt")).alias("first")
            both = self._live(pair[0]).unionByName(self._live(pair[1])).groupBy("anchor", "unit").agg(first, F.max("hot").alias("hot"))
            new = self._write(both.select("anchor", F.col("first.salt").alias("salt"), "unit", *(F.col(f"first.{c}").alias(c) for c in ("key", "lo", "hi")), "hot", F.lit(False).alias("settled")))
            self.runs[-2:] = [new]
            self._drop(*pair)

    def _drop(self, *runs: str) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE {r}")

    def drop(self) -> None:
        self._drop(*self.runs)
        self.runs = []


def deduplicate_words(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 3, buckets: int | None = None) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every row, the table taken in ``batches`` by key.

    Each batch is judged against the runs of those before it, which are
    compacted in between, so the last of three reads a compacted run.

    A word goes if a window of WINDOW words over it also starts in a document
    with a smaller key.  Null and empty texts have no words; rows that repeat a
    key are one document and each give a row (with other texts, each loses what
    is found in any of them, at the same places); rows with a null key are not
    judged.  Only key and text are read.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    cuts = rows.approxQuantile("key", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    index = FingerprintIndex(df.sparkSession, buckets)
    found = None
    for i in range(len(cuts) + 1):
        part = rows if not cuts else rows.where((F.col("key") > cuts[i - 1] if i else F.lit(True)) & (F.col("key") <= cuts[i] if i < len(cuts) else F.lit(True)))
        ranges = index.add(part, rows if i == len(cuts) else rows.where(F.col("key") <= cuts[i]))
        found = found.union(ranges) if found else ranges
        if i < len(cuts):
            index.compact()
    index.drop()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(2)
            at = want.offsets.to_numpy().astype(np.int64)
            at, items = at - at[0], want.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            row, lo, hi = merged(row, items.field(0).to_numpy(), items.field(1).to_numpy())
            span_at = np.searchsorted(row, np.arange(b.num_rows + 1))
            n, removed, sha = [], [], []
            for c in chunks(b.column(1)):
                raw = c.data.tobytes()
                for r in range(c.rows):
                    own = raw[c.offsets[r] : c.offsets[r + 1]].split()
                    n.append(len(own))
                    for s in range(span_at[c.first + r + 1] - 1, span_at[c.first + r] - 1, -1):
                        del own[lo[s] : hi[s]]
                    removed.append(n[-1] - len(own))
                    sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["key", "n_words", "n_removed", "kept_sha256"])

    return with_texts(rows, found, "left").mapInArrow(tidy(cut), "key long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("key", key)
