"""MinHash near-duplicates with an LSH forest.

A text's set is its distinct n-word shingles.  Texts with equal sets form a
class; one representative of each goes on.

1. Forest.  Each tree reads the 64 minima in an order of its own and sorts
   representatives by them.  Those that share a tree's first MIN_DEPTH minima are
   a region.  Within a region, neighbours by longest common prefix come first;
   only parts that are still apart after that are compared at smaller depth, down
   to the region itself.  Comparisons are of signatures and joined at ESTIMATE,
   well below the threshold, so the pieces that come out hold every true link.
2. Candidate groups are the components of these pieces.
3. Links are confirmed on full shingle sets inside candidate groups.  A group
   larger than CAP is laid out as a grid of block pairs, so no task holds it
   whole; a task gives back a spanning star, not pairs.
4. Components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.arrays import U, Shingles, batch, chunks, distinct, group_cuts, lists, mix, per_row, ranges, shingles, signed, tidy, whole_groups, words
from ragloom.llm.components import components
from ragloom.session import stash, text_batches, unstash

MINIMA = 64
TREES = 16
MIN_DEPTH = 3
DEEP = 16
#: Share of equal minima that joins two texts for confirmation; 0.8 is five standard deviations above it.
ESTIMATE = 0.55
#: Members of a region or of a block that one task compares.
CAP = 1024
#: Candidate rows up to which the confirming scan may be a broadcast join.
BROADCAST_ROWS = 400_000

_MULTIPLIERS = mix(np.arange(1, MINIMA + 1, dtype=U)) | U(1)
_SECOND = U(0xD6E8FEB86659FD93)


def _identity(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    return per_row(np.add, mix(s.hash), s.offsets, U(0)), per_row(np.add, mix(s.hash * _SECOND), s.offsets, U(0))


def _signatures(s: Shingles) -> np.ndarray:
    out = np.empty((len(s.offsets) - 1, MINIMA), dtype=np.uint32)
    for k in range(MINIMA):
        out[:, k] = per_row(np.minimum, s.hash * _MULTIPLIERS[k], s.offsets, U(0)) >> U(32)
    return out


def _orders(signatures: np.ndarray, tree: int) -> np.ndarray:
    """The minima as this tree reads them."""
    return np.roll(signatures, -tree * (MINIMA // TREES), axis=1)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def region_pieces(signatures: np.ndarray, tree: int) -> np.ndarray:
    """Label of each member of a region: members whose signatures chain together above ESTIMATE share it."""
    read = _orders(signatures, tree)
    order = np.lexsort(read[:, DEEP - 1 :: -1].T)
    read = read[order]
    n = len(read)
    parent = np.arange(n)
    same = read[1:] == read[:-1]
    depth = np.cumprod(same[:, :DEEP], axis=1).sum(axis=1)
    close = same.mean(axis=1) >= ESTIMATE
    for i in np.argsort(-depth, kind="stable"):
        if close[i]:
            parent[_find(parent, i + 1)] = _find(parent, i)
    label = np.array([_find(parent, i) for i in range(n)])
    # What is still apart is compared at the region's depth: the smaller pieces against all others.
    for piece in sorted(np.unique(label), key=lambda p: (label == p).sum())[:-1]:
        own = np.flatnonzero(label == piece)
        if not len(own):
            continue
        rest = np.flatnonzero(label != piece)
        step = max(1, (1 << 23) // (len(own) * MINIMA))
        for lo in range(0, len(rest), step):
            part = rest[lo : lo + step]
            near = (read[own][:, None, :] == read[part][None, :, :]).mean(axis=2) >= ESTIMATE
            for other in np.unique(label[part[near.any(axis=0)]]):
                label[label == label[own[0]]] = other
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def linked_pieces(sets: Shingles, percent: int) -> np.ndarray:
    """Label of each set: sets joined by chains of links |A & B| * 100 >= percent * |A | B| share it.

    Breadth first: each set meets, through the inverted lists of its shingles,
    all sets not reached yet; lists are rebuilt when half of their sets are.
    """
    n = len(sets.offsets) - 1
    size = np.diff(sets.offsets)
    _, number = np.unique(sets.hash, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    label = np.full(n, -1)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        left = label[owner] < 0
        order = np.argsort(number[left], kind="stable")
        start = np.searchsorted(number[left][order], np.arange(number.max() + 2)) if len(number) else np.zeros(1, np.int64)
        return owner[left][order], start

    holder, start = postings()
    in_lists = n
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            i = queue.pop()
            ids = number[sets.offsets[i] : sets.offsets[i + 1]]
            times = start[ids + 1] - start[ids]
            common = np.bincount(holder[np.repeat(start[ids], times) + ranges(times)], minlength=n)
            new = np.flatnonzero((label < 0) & (100 * common >= percent * (size[i] + size - common)))
            label[new] = seed
            queue += new.tolist()
            left = int((label < 0).sum())
            if not left:
                break
            if left * 2 < in_lists:
                holder, start = postings()
                in_lists = left
    return label


def _stars(nodes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each node to the smallest node with its label."""
    order = np.lexsort((nodes, label))
    nodes, label = nodes[order], label[order]
    cuts = group_cuts(label)
    centre = np.repeat(nodes[cuts[:-1]], np.diff(cuts)) if len(nodes) else nodes
    keep = nodes != centre
    return nodes[keep], centre[keep]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id and kept for every row.

    Letters A-Z are lowered; a text of fewer than n words is one shingle; texts
    without words have none, link with nothing and are kept.  Keys are whole
    numbers; rows that repeat a key count as one document, and each gives a row;
    rows with a null key are kept and linked with nothing.  Only key and text
    are read.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sketch_schema = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("minima", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                s = distinct(shingles(words(c, lower=True), n))
                p, q = _identity(s)
                minima = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * MINIMA), c.rows, [None, pa.py_buffer(_signatures(s).tobytes())]).cast(pa.binary())
                yield batch(sketch_schema, b.column(0).slice(c.first, c.rows), np.diff(s.offsets), signed(p), signed(q), minima)

    sketches = stash(rows.mapInArrow(tidy(sketch), "key long, size long, p long, q long, minima binary"), "sketches")
    live = sketches.where("size > 0 and key is not null")
    classes = stash(live.groupBy("size", "p", "q").agg(F.min("key").alias("rep"), F.min("minima").alias("minima")), "classes")

    region_schema = pa.schema([("region", pa.int64()), ("rep", pa.int64())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, MINIMA)
                region = np.empty((len(s), TREES), dtype=U)
                for t in range(TREES):
                    h = np.full(len(s), t, dtype=U)
                    for label in _orders(s, t)[:, :MIN_DEPTH].T:
                        h = mix(h * _SECOND + label)
                    region[:, t] = (h & ~U(TREES - 1)) | U(t)
                yield batch(region_schema, signed(region.reshape(-1)), np.repeat(b.column(0).to_numpy(), TREES))

    planted = classes.select("rep", "minima").mapInArrow(tidy(plant), "region long, rep long")
    regions = planted.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("least")).where("members > 1")
    members = stash(planted.join(regions, "region"), "regions")
    # A region beyond the cap is taken as one piece, which loses no link: step 3 looks at full sets.
    wide = members.where(F.col("members") > CAP).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    signatures = classes.groupBy("rep").agg(F.min("minima").alias("minima"))
    narrow = members.where(F.col("members") <= CAP).join(signatures, "rep").select("region", "rep", "minima")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            region, rep = t["region"].to_numpy(), t["rep"].to_numpy()
            s = np.frombuffer(b"".join(t["minima"].to_pylist()), np.uint32).reshape(-1, MINIMA)
            cuts = group_cuts(region)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                a, b = _stars(rep[lo:hi], region_pieces(s[lo:hi], int(region[lo]) & (TREES - 1)))
                if len(a):
                    yield batch(_EDGES, a, b)

    pieces = narrow.repartition("region").sortWithinPartitions("region").mapInArrow(tidy(grow), "a long, b long")
    groups = components(pieces.union(wide))
    groups = groups.union(groups.select("component", "component").distinct())
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / F.lit(CAP)).cast("int")
    candidates = groups.join(sizes, "component").select(F.col("node").alias("key"), "component", blocks.alias("blocks"))
    candidates = stash(candidates, "candidates")
    unstash(members)
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    found = rows.join(candidates, "key").select("component", "blocks", "key", "text")
    set_schema = pa.schema([("component", pa.int64()), ("blocks", pa.int32()), ("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(3)):
                s = distinct(shingles(words(c, lower=True), n))
                yield batch(set_schema, *(b.column(i).slice(c.first, c.rows) for i in range(3)), lists(signed(s.hash), s.offsets, pa.int64()))

    full = found.mapInArrow(tidy(sets), "component long, blocks int, key long, shingles array<long>").where(F.size("shingles") > 0)
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    full = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "key", "shingles")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1 << 20):
            cell, node = t["cell"].to_numpy(), t["key"].to_numpy()
            column = t["shingles"].combine_chunks()
            at = column.offsets.to_numpy().astype(np.int64)
            at, h = at - at[0], column.flatten().to_numpy().view(U)
            cuts = group_cuts(cell)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    s = Shingles(h[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    a, b = _stars(node[lo:hi], linked_pieces(s, percent))
                    if len(a):
                        yield batch(_EDGES, a, b)

    links = full.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(confirm), "a long, b long")
    joined = components(links)
    reps = classes.select("size", "p", "q", "rep").join(joined, F.col("rep") == F.col("node"), "left")
    reps = reps.select("size", "p", "q", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("key", "size", "p", "q").join(reps, ["size", "p", "q"], "left")
    out = out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).alias("c"))
    out = out.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("c", key)).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(key)))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the smallest key, with all columns of df."""
    gone = stash(near_duplicates(df, key, text, n, percent).where("not kept").select(key).distinct(), "near-duplicates")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return df.join(gone, key, "left_anti")
