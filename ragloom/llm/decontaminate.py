"""Benchmark decontamination: size-partitioned MinHash containment search.

An item Q of n shingles is found in a document X if |Q & X| >= t * |Q|, however
long X is.  Items are partitioned by size, each partition holding sizes within a
factor of two; its items are indexed by their k smallest shingle hashes (a
bottom-k MinHash), where k = n - ceil(t*n) + 1 follows from the largest size n
there.  A document that holds t of an item misses at most n - ceil(t*n) of its
shingles, so it must hold one of the k: the search loses nothing.  Partitions are
searched one by one, and only by documents with enough shingles for the smallest
item there.  Candidates are verified by counting all shingles of the item in the
document.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.arrays import U, Shingles, batch, chunks, distinct, group_cuts, lists, ranges, shingles, signed, sorted_distinct, tidy, words
from ragloom.session import stash

WORDS = 5
CONTAINED = 0.8
#: Shingles of all items together up to which the index is broadcast (16 bytes each).
BROADCAST_SHINGLES = 2_000_000


def sketch_size(n: int, contained: float = CONTAINED) -> int:
    return n - math.ceil(contained * n - 1e-9) + 1


def shingle_sets(df: DataFrame, key: str, text: str, n: int = WORDS) -> DataFrame:
    """key, and the sorted distinct shingle hashes of each text, letters A-Z lowered."""
    schema = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                s = distinct(shingles(words(c, lower=True), n))
                yield batch(schema, b.column(0).slice(c.first, c.rows), lists(signed(s.hash), s.offsets, pa.int64()))

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(tidy(sets), "key long, shingles array<long>")


class Partition(NamedTuple):
    """Items of similar size: the smallest size, the sketch hashes in order, and the item of each."""

    least: int
    hash: np.ndarray
    owner: np.ndarray
    #: Whether any sketch hash begins with these 16 bits: most shingles of a corpus end here.
    seen: np.ndarray


class ItemIndex:
    """Items, given by (id, shingles), by size partition."""

    def __init__(self, rows: list[tuple[int | None, list[int]]], contained: float = CONTAINED):
        self.contained = contained
        rows = sorted((r for r in rows if r[1]), key=lambda r: len(r[1]))
        self.items = pa.array([r[0] for r in rows], type=pa.int64())
        self.sizes = np.array([len(r[1]) for r in rows], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.shingles = np.array([h for r in rows for h in r[1]], dtype=np.int64).view(U)
        for i in range(len(rows)):
            self.shingles[self.at[i] : self.at[i + 1]].sort()
        level = np.frexp(self.sizes)[1]
        cuts = group_cuts(level)
        self.partitions = [self._partition(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def _partition(self, lo: int, hi: int) -> Partition:
        k = np.minimum(sketch_size(int(self.sizes[hi - 1]), self.contained), self.sizes[lo:hi])
        owner = np.repeat(np.arange(lo, hi), k)
        h = self.shingles[self.at[owner] + ranges(k)]
        order = np.lexsort((owner, h))
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(h >> U(48)).view(np.int64)] = True
        return Partition(int(self.sizes[lo]), h[order], owner[order], seen)

    def _candidates(self, p: Partition, s: Shingles) -> np.ndarray:
        """Row times number of items plus item, for the rows that share a sketch hash with an item of the partition."""
        maybe = np.flatnonzero(p.seen[(s.hash >> U(48)).view(np.int64)])
        row = np.searchsorted(s.offsets, maybe, "right") - 1
        long = np.diff(s.offsets)[row] >= self.contained * p.least - 1e-9
        maybe, row = maybe[long], row[long]
        lo, hi = np.searchsorted(p.hash, s.hash[maybe], "left"), np.searchsorted(p.hash, s.hash[maybe], "right")
        n = hi - lo
        return np.repeat(row, n) * len(self.sizes) + p.owner[np.repeat(lo, n) + ranges(n)]

    def search(self, s: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item index, shared shingles) of every item contained in a row; s: shingles by row, in any order."""
        rows, items, shared = [], [], []
        own, held = -1, s.hash[:0]
        for p in sorted_distinct(np.concatenate([np.zeros(0, np.int64), *(self._candidates(p, s) for p in self.partitions)])):
            r, i = divmod(int(p), len(self.sizes))
            if r != own:
                own, held = r, sorted_distinct(s.hash[s.offsets[r] : s.offsets[r + 1]])
            q = self.shingles[self.at[i] : self.at[i + 1]]
            at = np.minimum(np.searchsorted(held, q), len(held) - 1)
            common = int((held[at] == q).sum())
            if common >= self.contained * self.sizes[i] - 1e-9:
                rows.append(r)
                items.append(i)
                shared.append(common)
        return np.array(rows, np.int64), np.array(items, np.int64), np.array(shared, np.int64)


def _index(items: DataFrame, item_key: str, text: str, contained: float, n: int) -> tuple[DataFrame, ItemIndex | None]:
    """The items' shingle sets, and their index if it may be broadcast; an id with several texts is several items."""
    sets = shingle_sets(items, item_key, text, n).where(F.size("shingles") > 0).dropDuplicates(["key", "shingles"])
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    if total > BROADCAST_SHINGLES:
        return sets, None
    return sets, ItemIndex([(r.key, r.shingles) for r in sets.collect()], contained)


def contained_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", contained: float = CONTAINED, n: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item found in a document.

    A text of fewer than n words is one shingle, all its words; empty and null
    texts have none and are never found.  Equal items are each reported, and an
    id that comes with several texts is several items; null ids are reported as
    null; repeated document rows give repeated result rows.  Only the two keys and
    texts are read, so other columns, clashing or not, don't matter.  While the
    items' shingles fit BROADCAST_SHINGLES the index is broadcast and documents
    are scanned in place; beyond that, both sides meet by shingle hash.
    """
    sets, index = _index(items, item_key, text, contained, n)
    if index is None:
        return _by_join(docs, sets, doc_key, text, contained, n)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            keys = b.column(0)
            for c in chunks(b.column(1)):
                rows, found, common = index.search(shingles(words(c, lower=True), n))
                if len(rows):
                    yield batch(schema, keys.take(pa.array(rows + c.first)), index.items.take(pa.array(found)), index.sizes[found], common)

    out = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(search), "doc_id long, item_id long, n_item long, n_shared long")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _by_join(docs: DataFrame, sets: DataFrame, doc_key: str, text: str, contained: float, n: int) -> DataFrame:
    """The same result for item sets too large to broadcast: candidates by a join on sketch hashes, then verified by arrays.

    Rows and items get their numbers before they are written, so that both uses of a number see the same row.
    """
    sets = stash(sets.withColumn("n_item", F.size("shingles").cast("long")).withColumn("item", F.monotonically_increasing_id()), "items")
    k = (F.col("n_item") - F.ceil(F.lit(contained) * F.col("n_item") - 1e-9) + 1).cast("int")
    # Hashes are compared as unsigned numbers when the index sorts them; any k of them will do here.
    sketch = sets.select("item", F.explode(F.slice(F.sort_array("shingles"), F.lit(1), k)).alias("h"))
    held = stash(shingle_sets(docs, doc_key, text, n).withColumn("row", F.monotonically_increasing_id()), "document-shingles")
    pairs = held.select("row", F.explode("shingles").alias("h")).join(sketch, "h").select("row", "item").distinct()
    items = sets.select("item", F.col("key").alias("item_id"), F.col("shingles").alias("q"), "n_item")
    both = pairs.join(held.select("row", F.col("key").alias("doc_id"), "shingles"), "row").join(items, "item")
    both = both.withColumn("n_shared", F.size(F.array_intersect("shingles", "q")).cast("long"))
    return both.where(F.col("n_shared") >= contained * F.col("n_item") - 1e-9).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", contained: float = CONTAINED, n: int = WORDS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; documents are filtered where they are read.

    Each row is judged by its own text, so rows with null or repeated keys, null
    and empty texts all have a defined result: they stay unless their text holds
    an item.
    """
    sets, index = _index(items, item_key, text, contained, n)
    if index is None:
        # Rows are numbered, as keys may be null or repeat.
        row = "row_" + uuid.uuid4().hex
        numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
        leaks = _by_join(numbered, sets, row, text, contained, n).select(F.col("doc_id").alias(row))
        return numbered.join(leaks, row, "left_anti").drop(row)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for c in chunks(b.column(at)):
                keep[index.search(shingles(words(c, lower=True), n))[0] + c.first] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidy(clean), docs.schema)
