"""Nearest points of clouds of any size: blocks split by count, and rings that end where the k-th distance closes.

A cloud's box is cut into cells by halving, as deep as its number of points
asks; inside a cell, points lie along a space-filling curve and are packed into
blocks of ``BLOCK`` points, each with its own box.  So dense parts have small
blocks.  A block of queries first meets the blocks nearest to it that hold k
points; the k-th distance found there is the ring within which other blocks are
looked up, by the cells that it touches at a level where those are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.session import spread, stash, text_batches, unstash

AXES = ("x", "y", "z")
#: Points in a block of a cloud, and of queries.
BLOCK = 512
ASKING = 256
#: Points of a cloud that are one cell still.
CELL = 4096
#: Halvings of an axis that a place on the curve has.
BITS = 16

PACKED = "cloud_id long, prefix long, block long, n int, ids array<long>, points binary, low array<double>, high array<double>"


def _frame(s: DataFrame) -> DataFrame:
    """(cloud_id, lx, ly, lz, edge, level, size): each cloud's corner, longest edge, depth of cells and number of points."""
    low, high = [F.min(c).alias(f"l{c}") for c in AXES], [F.max(c).alias(f"h{c}") for c in AXES]
    box = s.groupBy("cloud_id").agg(*low, *high, F.count(F.lit(1)).alias("size"))
    edge = F.greatest(*[F.col(f"h{c}") - F.col(f"l{c}") for c in AXES], F.lit(1e-300))
    level = F.ceil(F.log2(F.col("size") / CELL) / 3).cast("int")
    return box.select("cloud_id", "lx", "ly", "lz", edge.alias("edge"), F.greatest(F.lit(0), F.least(level, F.lit(BITS - 1))).alias("level"), "size")


def _spread(c: Column) -> Column:
    """Two zero bits after each of 16 bits."""
    for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _packed(df: DataFrame, frame: DataFrame, size: int) -> DataFrame:
    """Points (cloud_id, point_id, x, y, z) in blocks, see PACKED; a block lies in one cell of its cloud.  Points outside the box lie in a cell at its border."""
    top = F.lit((1 << BITS) - 1)
    at = lambda c: F.greatest(F.lit(0), F.least(top, F.floor((F.col(c) - F.col(f"l{c}")) / F.col("edge") * (1 << BITS)))).cast("long")
    d = df.where(" and ".join(f"{c} is not null" for c in AXES)).join(frame, "cloud_id")
    code = _spread(at("x")).bitwiseOR(F.shiftleft(_spread(at("y")), 1)).bitwiseOR(F.shiftleft(_spread(at("z")), 2))
    d = d.select(F.col("cloud_id").cast("long").alias("cloud_id"), F.col("point_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in AXES], code.alias("code"), "level")
    d = d.withColumn("prefix", F.expr(f"shiftright(code, 3 * ({BITS} - level))"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held)
            xyz = np.stack([t.column(c).to_numpy() for c in AXES], axis=1)
            number += 1
            cols = [[t.column("cloud_id")[0].as_py()], [t.column("prefix")[0].as_py()], [number], [len(xyz)], [t.column("id").to_numpy()], [xyz.tobytes()], [xyz.min(axis=0)], [xyz.max(axis=0)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

        for b in batches:
            while b.num_rows:
                key = [b.column(c).to_numpy() for c in ("cloud_id", "prefix")]
                if held and (rows >= size or any(held[0].column(c)[0].as_py() != k[0] for c, k in zip(("cloud_id", "prefix"), key, strict=True))):
                    yield out()
                    held, rows = [], 0
                other = (key[0] != key[0][0]) | (key[1] != key[1][0])
                take = min(int(other.argmax()) or b.num_rows, size - rows)
                held.append(b.slice(0, take))
                rows, b = rows + take, b.slice(take)
        if held:
            yield out()

    d = d.select("cloud_id", "prefix", "code", "id", *AXES)
    return d.repartition("cloud_id", "prefix").sortWithinPartitions("cloud_id", "prefix", "code", "id").mapInArrow(pack, PACKED)


def _gap2(low: np.ndarray, high: np.ndarray, xyz: np.ndarray) -> np.ndarray:
    """Squared distance of points to a box."""
    away = np.maximum(np.maximum(low - xyz, xyz - high), 0.0)
    return (away * away).sum(axis=1)


def _meet(k: int):
    """A task over (cloud_id, q_ids, q_points, reach, ids, points, low, high): the k nearest points of a block for each query that it may help."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cloud, q_ids, q_raw, reach, ids, raw, low, high = (c[r] for c in b.columns)
                q, d = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, 3) for x in (q_raw, raw))
                rows = np.arange(len(q))
                if reach.is_valid:
                    rows = np.flatnonzero(_gap2(low.values.to_numpy(), high.values.to_numpy(), q) <= reach.values.to_numpy())
                # In the order in which the axes are added everywhere.
                d2 = np.zeros((len(rows), len(d)))
                for c in range(3):
                    off = q[rows, c, None] - d[None, :, c]
                    d2 += off * off
                i, j = np.divmod(np.arange(d2.size), max(1, len(d)))
                if reach.is_valid:
                    i, j = np.nonzero(d2 <= reach.values.to_numpy()[rows, None])
                elif k < len(d):
                    kth = np.partition(d2, k - 1, axis=1)[:, k - 1] + 2e-9
                    i, j = np.nonzero(d2 <= kth[:, None])
                found, own = d2[i, j], ids.values.to_numpy()[j]
                order = np.lexsort((own, np.round(found, 9), i))
                i, found, own = i[order], found[order], own[order]
                few = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, found, own = i[few], found[few], own[few]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), cloud.as_py(), np.int64)), pa.array(q_ids.values.to_numpy()[rows[i]]), pa.array(own), pa.array(found)], names=["cloud_id", "q", "s", "d2"])

    return run


FOUND = "cloud_id long, q long, s long, d2 double"


def _box_gap2() -> Column:
    """Squared distance between the boxes (q_low, q_high) and (low, high)."""
    away = F.zip_with(F.arrays_zip("q_low", "q_high"), F.arrays_zip("low", "high"), lambda a, b: F.greatest(b["low"] - a["q_high"], a["q_low"] - b["high"], F.lit(0.0)))
    return F.aggregate(away, F.lit(0.0), lambda s, x: s + x * x)


def nearest_points(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
    """(cloud_id, q, s, d2): the k nearest points of s, at least, to each point of q in the same cloud; the caller ranks them.

    Where no cloud has more than two blocks of points, all pairs of a cloud meet
    by a plain join.  Clouds of up to ``CELL`` points are met block by block at
    once.  If there is a larger one, blocks are written out and met in two rounds, see the module:
    the work of a query then follows k and the density around it, not the
    cloud.  Points without a coordinate take no part.
    """
    text_batches(q.sparkSession, 256, 32)
    known = " and ".join(f"{c} is not null" for c in AXES)
    frame = _frame(s.where(known))
    largest, deepest = frame.agg(F.max("size"), F.max("level")).first()
    if (largest or 0) <= 2 * BLOCK:
        a = q.where(known).select("cloud_id", F.col("point_id").alias("q"), *AXES)
        b = s.where(known).select("cloud_id", F.col("point_id").alias("s"), *[F.col(c).alias(f"b_{c}") for c in AXES])
        d2 = sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in AXES), F.lit(0.0))
        return a.join(b, "cloud_id").select("cloud_id", "q", "s", d2.alias("d2"))
    asked = _packed(q, frame, ASKING).select("cloud_id", F.col("prefix").alias("q_prefix"), F.col("block").alias("ask"), F.col("ids").alias("q_ids"), F.col("points").alias("q_points"), F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    blocks = _packed(s, frame, BLOCK)
    columns = ["cloud_id", "q_ids", "q_points", "reach", "ids", "points", "low", "high"]
    if not deepest:
        met = asked.withColumn("reach", F.lit(None).cast("array<double>")).join(blocks, "cloud_id")
        return met.select(*columns).mapInArrow(_meet(k), FOUND)
    asked, blocks, frame = stash(asked, "asking-points"), stash(blocks, "point-blocks"), stash(frame, "cloud-frames")

    # Blocks by the cells of all levels that they lie in.
    levels = F.explode(F.sequence(F.lit(0), F.col("level"))).alias("at")
    up = "shiftright({0}, 3 * (level - at))"
    places = blocks.join(frame.select("cloud_id", "level"), "cloud_id").select("cloud_id", "level", levels, "prefix", "block", "n", "low", "high").withColumn("cell", F.expr(up.format("prefix")))
    cells = places.groupBy("cloud_id", "at", "cell").agg(F.sum("n").alias("points_there"))

    # First the nearest blocks of the smallest cell around that holds k points.
    own = asked.join(frame.select("cloud_id", "level", "size"), "cloud_id").select("cloud_id", "ask", "q_low", "q_high", "level", "size", levels, "q_prefix").withColumn("cell", F.expr(up.format("q_prefix")))
    full = own.join(cells, ["cloud_id", "at", "cell"]).where(F.col("points_there") >= F.least(F.lit(k), F.col("size")))
    start = full.groupBy("cloud_id", "ask").agg(F.max_by(F.struct("at", "cell", "q_low", "q_high"), "at").alias("c")).select("cloud_id", "ask", "c.*")
    near = start.join(places.drop("level"), ["cloud_id", "at", "cell"]).withColumn("gap", _box_gap2())
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ask").orderBy("gap", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stash(near.withColumn("before", before).where(F.col("before") < k).select("ask", "block"), "first-blocks")
    payload = blocks.select("block", "ids", "points", "low", "high")
    asks = asked.select("ask", "cloud_id", "q_ids", "q_points")
    seeds = spread(first, "ask", "block").join(asks, "ask").join(payload, "block").withColumn("reach", F.lit(None).cast("array<double>"))
    seeds = stash(seeds.select("ask", *columns).mapInArrow(_asked(k), f"ask long, {FOUND}"), "first-points")

    # The ring of each query is its k-th distance so far.
    w = Window.partitionBy("ask", "q").orderBy(F.round("d2", 9), "s")
    kth = seeds.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).groupBy("ask").agg(F.map_from_entries(F.collect_set(F.struct("q", "d2"))).alias("rings"))
    far = F.lit(float("inf"))
    rings = asked.join(kth, "ask", "left").withColumn("reach", F.transform("q_ids", lambda x: F.coalesce(F.try_element_at("rings", x) + 1e-9, far))).drop("rings")
    rings = stash(rings.withColumn("ring", F.array_max("reach")), "rings")

    # Cells that the ring touches, three along an axis at most.
    r = rings.select("cloud_id", "ask", "q_low", "q_high", "ring").join(frame, "cloud_id")
    wide = F.array_max(F.zip_with("q_high", "q_low", lambda a, b: a - b)) + 2 * F.sqrt("ring")
    at = F.floor(F.log2(2 * F.col("edge") / F.greatest(F.col("wide"), F.col("edge") * 2.0**-BITS)))
    r = r.withColumn("wide", wide).withColumn("at", F.when(F.col("wide") > 2 * F.col("edge"), 0).otherwise(F.least(F.col("level"), F.greatest(F.lit(0), at))).cast("int"))
    cell_of = lambda v, c: F.greatest(F.lit(0), F.least(F.floor((v - F.col(f"l{c}")) / F.col("edge") * F.pow(F.lit(2.0), F.col("at"))), F.pow(F.lit(2.0), F.col("at")) - 1)).cast("int")
    for n, c in enumerate(AXES):
        low, high = (cell_of(F.when(F.col("ring") == far, sign * 1e300).otherwise(F.col(f"q_{e}")[n] + sign * F.sqrt("ring") * (1 + 1e-9)), c) for e, sign in (("low", -1), ("high", 1)))
        r = r.withColumn(f"c{c}", F.explode(F.sequence(low, high)))
    cell = _spread(F.col("cx").cast("long")).bitwiseOR(F.shiftleft(_spread(F.col("cy").cast("long")), 1)).bitwiseOR(F.shiftleft(_spread(F.col("cz").cast("long")), 2))
    r = r.select("cloud_id", "ask", "at", cell.alias("cell"), "q_low", "q_high", "ring")
    rest = r.join(places.drop("level"), ["cloud_id", "at", "cell"]).where(_box_gap2() <= F.col("ring")).select("ask", "block")
    rest = spread(rest.join(first, ["ask", "block"], "left_anti"), "ask", "block")
    met = rest.join(rings.select("ask", "cloud_id", "q_ids", "q_points", "reach"), "ask").join(payload, "block")
    unstash(asked)
    return met.select(*columns).mapInArrow(_meet(k), FOUND).union(seeds.drop("ask"))


def _asked(k: int):
    """The same task with the number of the query block in front."""
    meet = _meet(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                for out in meet(iter([one.drop_columns(["ask"])])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, one.column("ask")[0].as_py(), np.int64)), *out.columns], names=["ask", *out.schema.names])

    return run
