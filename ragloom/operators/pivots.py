"""Vectors in blocks by their distances to pivots, and which blocks of a table can hold what a query looks for.

Each vector lies in a cell: its nearest pivot, cut by the distance to it.  Cells
come in blocks of at most ``BLOCK`` vectors, each with the least and the largest
distance to every pivot.  By the triangle inequality a query whose own distance
lies outside such an interval is at least as far from all of the block.  Only
the directory of cells, ``CELLS`` rows at most, passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.session import spread, stash, task_groups, text_batches, unstash

PIVOTS = 32
#: Vectors of the sample that pivots and cells are chosen from; it bounds what the driver reads.
SAMPLE = 4096
#: Vectors in a block of a table, and in one of queries.
BLOCK = 1024
ASKING = 256
#: Groups at most that blocks which tasks hold are dealt into.
GROUPS = 48
#: Cells at most: the directory that every routing task gets.
CELLS = 4096

BLOCKS = "cell int, block long, sizes array<int>, keys array<long>, vectors binary, table binary, low array<double>, high array<double>, most double"


class Grid(NamedTuple):
    """Pivots, and for each of the first few of them, which are centres of cells, the distances at which its cells are cut."""

    pivots: np.ndarray
    cuts: list[np.ndarray]
    #: An orthonormal turn of the coordinates, those that hold most of the sample first.
    axes: np.ndarray

    @property
    def size(self) -> int:
        """Cells."""
        return sum(len(c) + 1 for c in self.cuts)

    def cell(self, distances: np.ndarray) -> np.ndarray:
        near = distances[:, : len(self.cuts)].argmin(axis=1)
        first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])])
        out = np.empty(len(near), np.int32)
        for p in np.unique(near):
            own = near == p
            out[own] = first[p] + np.searchsorted(self.cuts[p], distances[own, p], side="right")
        return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean, a row for each vector; exact under the root where all products are whole and below 2**53."""
    x = x.astype(float)
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T), 0.0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, each filled up with zeros, or cut, to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def grid(df: DataFrame, vector: str, count: int = PIVOTS, sample: int = SAMPLE, least_rows: int = 2 * BLOCK) -> tuple[Grid, int]:
    """Pivots far from each other, from the vectors of the smallest hashes, with cuts so that cells of that sample are even; and the width.

    Pivots only decide how much is skipped, never what is found.  A table of no
    more than ``least_rows`` is one cell around the origin.
    """
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    width = width or 0
    if n <= least_rows:
        return Grid(np.zeros((1, width)), [np.zeros(0)], np.eye(width)), width
    taken = df.select(vector).orderBy(F.xxhash64(vector)).limit(sample).toArrow().column(0)
    x = matrix(taken, width).astype(float) if len(taken) else np.zeros((1, width))
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
        if far.max() <= 1e-9:
            break
        chosen.append(int(far.argmax()))
    d = distances(x, x[chosen])
    cells = min(CELLS, max(1, n // BLOCK))
    near = d[:, :cells].argmin(axis=1)
    cuts = []
    for p in range(min(cells, len(chosen))):
        own = np.sort(d[near == p, p])
        parts = max(1, round(cells * len(own) / len(x)))
        cuts.append(np.unique(own[[len(own) * i // parts for i in range(1, parts)]]) if len(own) and parts > 1 else np.zeros(0))
    return Grid(x[chosen], cuts, np.linalg.eigh(np.nan_to_num(x.T @ x))[1][:, ::-1]), width


def distinct_vectors(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(keys, vector): the k smallest keys of equal vectors, more of which no list of k needs; a vector that fills a third of the table is cut down before it meets."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).distinct()
    least = Window.partitionBy("v").orderBy("k")
    rows = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k)
    return rows.groupBy("v").agg(F.array_sort(F.collect_list("k")).alias("keys")).select("keys", F.col("v").alias("vector"))


def blocked(rows: DataFrame, by: Grid, width: int, size: int = BLOCK) -> DataFrame:
    """Rows (keys array<long>, vector array<number>) packed by cell; see BLOCKS.  ``table`` has each vector's distances to all pivots.  The caller writes them out."""
    whole = rows.schema["vector"].dataType.elementType.typeName() == "long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = by.cell(distances(matrix(b.column(1), width), by.pivots))
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1)], names=["cell", "keys", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            keys, x = t.column(1).combine_chunks(), matrix(t.column(2), width).astype(np.int64 if whole else float)
            d = distances(x, by.pivots)
            number += 1
            cols = [[t.column(0)[0].as_py()], [number], [np.diff(keys.offsets.to_numpy())], [keys.flatten().to_numpy()], [x.tobytes()], [d.tobytes()], [d.min(axis=0)], [d.max(axis=0)], [float((x.astype(float) ** 2).sum(axis=1).max())]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, types, strict=True)], names=["cell", "block", "sizes", "keys", "vectors", "table", "low", "high", "most"])

        held_rows = 0
        for b in batches:
            while b.num_rows:
                cell = b.column(0).to_numpy()
                if held and (held_rows >= size or held[0].column(0)[0].as_py() != cell[0]):
                    yield out()
                    held, held_rows = [], 0
                take = min(int((cell != cell[0]).argmax()) or len(cell), size - held_rows)
                held.append(b.slice(0, take))
                held_rows += take
                b = b.slice(take)
        if held:
            yield out()

    placed = rows.select("keys", "vector").mapInArrow(place, f"cell int, keys array<long>, vector {rows.schema['vector'].dataType.simpleString()}")
    return placed.repartition("cell").sortWithinPartitions("cell", "keys").mapInArrow(pack, BLOCKS)


def vectors_of(raw: bytes | pa.Scalar, width: int, whole: bool) -> np.ndarray:
    raw = raw.as_buffer() if isinstance(raw, pa.Scalar) else raw
    x = np.frombuffer(raw, np.int64 if whole else np.float64)
    return x.reshape(-1, width) if width else np.zeros((0, 0), x.dtype)


class Directory(NamedTuple):
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    most: np.ndarray


def directory(blocks: DataFrame, by: Grid) -> Directory:
    """Intervals of each cell, combined before the shuffle; ``CELLS`` and a cell for each pivot at most.  Of a single cell nothing has to be known."""
    n = len(by.pivots)
    if by.size == 1:
        return Directory(np.zeros(1, np.int32), np.full((1, n), -np.inf), np.full((1, n), np.inf), np.full(1, np.inf))
    ends = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(n)]
    rows = blocks.groupBy("cell").agg(*ends, F.max("most").alias("most")).toPandas()
    return Directory(rows["cell"].to_numpy(np.int32), rows[[f"low{i}" for i in range(n)]].to_numpy(float), rows[[f"high{i}" for i in range(n)]].to_numpy(float), rows["most"].to_numpy(float))


def least_distance(own: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """(queries, intervals): a lower bound of the distance of each query to whatever lies between low and high, less a slack for rounding."""
    out = np.zeros((len(own), len(low)))
    for p in range(own.shape[1]):
        np.maximum(out, np.maximum(own[:, p, None] - high[None, :, p], low[None, :, p] - own[:, p, None]), out=out)
    return np.maximum(out - slack, 0.0)


def product_bound(square: np.ndarray, most: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Upper bound of inner products from squared norms and a lower bound of distances: |q - c|^2 = |q|^2 + |c|^2 - 2qc."""
    total = square[:, None] + most[None, :]
    return (total - apart * apart) / 2 + 1e-9 * (total + 1)


def rounding(square: np.ndarray, most: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What distances of such vectors may be off by, generously."""
    top = float((pivots * pivots).sum(axis=1).max()) if pivots.size else 0.0
    return 1e-6 * (np.sqrt(square)[:, None] + np.sqrt(most)[None, :] + top**0.5)


def route(asking: DataFrame, by: Grid, cells: Directory, width: int, whole: bool, least: str | None = None) -> DataFrame:
    """(block, cell) of query blocks and the cells that may hold something for a query of theirs.

    ``least`` names a column with the score that each query has to reach; without
    it, each query names the one cell of the largest bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                square = (vectors_of(b.column(1)[r], width, whole).astype(float) ** 2).sum(axis=1)
                own = vectors_of(b.column(2)[r], len(by.pivots), False)
                bound = product_bound(square, cells.most, least_distance(own, cells.low, cells.high, rounding(square, cells.most, by.pivots)))
                if least is None:
                    found = np.unique(bound.argmax(axis=1)) if len(cells.cell) else np.zeros(0, int)
                else:
                    found = np.flatnonzero((bound >= b.column(3)[r].values.to_numpy(zero_copy_only=False)[:, None]).any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b.column(0)[r].as_py(), np.int64)), pa.array(cells.cell[found])], names=["ask", "cell"])

    return asking.select("ask", "q_vectors", "q_table", *([least] if least else [])).mapInArrow(run, "ask long, cell int")


def together(held: DataFrame, passing: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Rows for ``met_rows``: blocks (id, ...) that tasks hold, and blocks (cell, block, ...) that pass by those that name their cell.

    pairs: (id, cell), or None if all meet all.  Held blocks are dealt into
    ``GROUPS`` groups at most, a task for each, and a passing block goes to a group once,
    however many there name it: what is shuffled grows with the blocks, not
    with the pairs of them.
    """
    groups = task_groups(held.sparkSession, GROUPS)
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group")
    none = F.lit(None).cast("array<long>").alias("ids")
    if pairs is None:
        named = passing.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), none)
    else:
        ids = pairs.select(group, "id", "cell").groupBy("group", "cell").agg(F.collect_list("id").alias("ids"))
        named = spread(ids, "cell").join(passing, "cell")
    first = held.select(group, F.lit(0).alias("side"), none, F.struct(*held.columns).alias("held"))
    then = named.select("group", F.lit(1).alias("side"), "ids", F.struct(*passing.columns).alias("passing"))
    both = first.unionByName(then, allowMissingColumns=True)
    return both.repartitionById(groups, F.col("group")).sortWithinPartitions("side").select("side", "ids", "held", "passing")


def met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[int] | None, dict | None]]:
    """(held, None, None) of each block that a task holds, then (None, ids, passing) of each that passes, ids None if it meets all."""
    for b in batches:
        columns = [{b.column(c).type.field(i).name: b.column(c).field(i) for i in range(b.column(c).type.num_fields)} for c in (2, 3)]
        for r in range(b.num_rows):
            at = b.column(0)[r].as_py()
            row = {name: column[r] for name, column in columns[at].items()}
            yield (None, b.column(1)[r].as_py(), row) if at else (row, None, None)


class Pair(NamedTuple):
    """A block of queries and a block of the table, as a kernel gets them: vectors, distances to pivots, scores to reach, intervals."""

    q: np.ndarray
    q_table: np.ndarray
    least: np.ndarray
    d: np.ndarray
    d_table: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pivots: np.ndarray

    def alive(self) -> np.ndarray:
        """Queries for which something in the block may reach their score."""
        square, most = (self.q.astype(float) ** 2).sum(axis=1), (self.d.astype(float) ** 2).sum(axis=1).max(keepdims=True)
        apart = least_distance(self.q_table, self.low, self.high, rounding(square, most, self.pivots))
        return np.flatnonzero(product_bound(square, most, apart)[:, 0] >= self.least)


#: Places of queries, places of vectors, scores, and how many pairs were worked out.
Kernel = Callable[[Pair, int], tuple[np.ndarray, np.ndarray, np.ndarray, int]]


def search(rows: DataFrame, asked: DataFrame, k: int, kernel: Kernel, exclude_self: bool, report: bool = False, least_rows: int = 2 * BLOCK, tables: bool = True) -> DataFrame:
    """(ask, place, q, d, sim) of the k best, at least, of each query; ``ranked`` ranks them.

    rows: (keys, vector); asked: the same with one key each.  Every query first
    meets the cell that looks best; its k-th score there is what other cells
    have to reach.  In both rounds tasks hold queries and blocks pass by.  ``exclude_self``
    leaves out the row of a query's own key and vector.  ``report`` returns
    instead (pairs, evaluated) of each two blocks that met in the second round.
    With a single cell the first round is all.  ``tables``: whether the kernel
    looks at the distances of single vectors to the pivots, which are a third of what passes.
    """
    by, width = grid(rows, "vector", least_rows=least_rows)
    whole = rows.schema["vector"].dataType.elementType.typeName() == "long"
    blocks = blocked(rows, by, width)
    asking = blocked(asked, by, width, ASKING).select(F.col("cell").alias("q_cell"), F.col("block").alias("ask"), F.col("keys").alias("asked"), F.col("vectors").alias("q_vectors"), F.col("table").alias("q_table"))
    kind = "long" if whole else "double"
    n_pivots = len(by.pivots)

    def best(i: np.ndarray, s: np.ndarray, dk: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((dk, -s, i))
        i, s, dk = i[order], s[order], dk[order]
        few = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[few], s[few], dk[few]

    def found_in(held: dict, block: dict, pair: Pair) -> tuple[np.ndarray, ...]:
        """(i, s, dk) of a block's best for some queries."""
        i, j, s, _ = kernel(pair, k + exclude_self)
        # Each vector stands for the smallest keys that have it.
        size = block["sizes"].values.to_numpy()
        n, first = size[j], (np.cumsum(size) - size)[j]
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j, s, dk = np.repeat(i, n), np.repeat(j, n), np.repeat(s, n), block["keys"].values.to_numpy()[at]
        if exclude_self:
            # A row of the query's key with another vector is another row.
            own = np.flatnonzero(held["keys"][i] == dk)
            own = own[(pair.q[i[own]] == pair.d[j[own]]).all(axis=1)]
            i, s, dk = (np.delete(x, own) for x in (i, s, dk))
        return i, s, dk

    def score(batches: Iterator[pa.RecordBatch], only_count: bool) -> Iterator[pa.RecordBatch]:
        """Keeps the k best of each query so far, whose last score is what later blocks have to reach."""
        asks: dict[int, dict] = {}
        for ask, ids, block in met_rows(batches):
            if ask:
                q, least = vectors_of(ask["q_vectors"], width, whole), ask["least"]
                want = least.values.to_numpy(zero_copy_only=False).copy() if least.is_valid else np.full(len(q), -np.inf)
                none = np.zeros(0, np.int64), np.zeros(0, q.dtype), np.zeros(0, np.int64)
                asks[ask["id"].as_py()] = {"keys": ask["asked"].values.to_numpy(), "q": q, "table": vectors_of(ask["q_table"], n_pivots, False), "want": want, "best": none}
                continue
            d = vectors_of(block["vectors"], width, whole)
            d_table = vectors_of(block["table"], n_pivots, False) if tables else np.zeros((len(d), 0))
            low, high = (block[c].values.to_numpy()[None] for c in ("low", "high"))
            for name in asks if ids is None else ids:
                own = asks[name]
                pair = Pair(own["q"], own["table"], own["want"], d, d_table, low, high, by.pivots)
                if only_count:
                    yield pa.RecordBatch.from_arrays([pa.array([len(own["q"]) * len(d)]), pa.array([kernel(pair, k + exclude_self)[3]])], names=["pairs", "evaluated"])
                    continue
                new = found_in(own, block, pair)
                if not len(new[0]):
                    continue
                i, s, _ = own["best"] = best(*(np.concatenate(x) for x in zip(own["best"], new, strict=True)))
                count = np.bincount(i, minlength=len(own["q"]))
                full = count >= k
                last = s[np.cumsum(count)[full] - 1].astype(float)
                own["want"][full] = np.maximum(own["want"][full], np.nextafter(last, -np.inf) if whole else last)
        for name, own in asks.items():
            i, s, dk = own["best"]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), name, np.int64)), pa.array(i.astype(np.int32)), pa.array(own["keys"][i]), pa.array(dk), pa.array(s)], names=["ask", "place", "q", "d", "sim"])

    def met(pairs: DataFrame | None, asking: DataFrame, only_count: bool = False) -> DataFrame:
        out = "pairs long, evaluated long" if only_count else f"ask long, place int, q long, d long, sim {kind}"
        asking = asking.select(F.col("ask").alias("id"), "asked", "q_vectors", "q_table", "least")
        rows = together(asking, blocks.select("cell", "block", "sizes", "keys", "vectors", *(["table"] if tables else []), "low", "high"), None if pairs is None else pairs.select(F.col("ask").alias("id"), "cell"))
        return rows.mapInArrow(lambda batches: score(batches, only_count), out)

    text_batches(rows.sparkSession, 64, 32)
    unknown = F.lit(None).cast("array<double>")
    if by.size == 1:
        return met(None, asking.withColumn("least", unknown), report)
    blocks, asking = stash(blocks, "pivot-blocks"), stash(asking.drop("q_cell"), "pivot-queries")
    cells = directory(blocks, by)
    first = stash(route(asking, by, cells, width, whole), "pivot-first")
    seeds = stash(met(first, asking.withColumn("least", unknown)), "pivot-seeds")
    last = seeds.withColumn("r", F.row_number().over(Window.partitionBy("ask", "place").orderBy(F.desc("sim"), "d"))).where(F.col("r") == k)
    had = last.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("sim").cast("double").alias("s")))).alias("had"))
    none = F.lit(float("-inf"))
    reach = F.transform("asked", lambda x, i: F.coalesce(F.try_element_at("had", i), none))
    reach = stash(asking.join(had, "ask", "left").withColumn("least", reach).drop("had"), "pivot-reach")
    unstash(asking)
    rest = route(reach, by, cells, width, whole, "least").join(first, ["ask", "cell"], "left_anti")
    return met(rest, reach, True) if report else seeds.unionByName(met(rest, reach))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(q, d, sim, rank) of search()'s rows, ties to the smaller key."""
    w = Window.partitionBy("ask", "place").orderBy(F.desc("sim"), "d")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("q", "d", "sim", "rank")
