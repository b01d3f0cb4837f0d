"""Blocks of points that a task holds, and blocks of other points that pass by them: what no ring around a point bounds.

Points are packed as for ``nearest_points`` and written out.  The blocks that
ask are dealt into groups, a task for each, and a block that is met goes once to each group
that holds points of a cloud that names its cloud.  So what is shuffled
grows with the points, no pair leaves a task, and boxes tell which blocks
have to be looked into.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators.nearest import ASKING, AXES, BLOCK, _frame, _packed
from ragloom.operators.pivots import met_rows, together
from ragloom.session import stash, text_batches

KNOWN = " and ".join(f"{c} is not null" for c in AXES)


def _meeting(q: DataFrame, s: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Rows for ``met_rows``: blocks of q, and those of s in the clouds ``by`` that their own cloud ``of`` names, or in the same; the outermost of a cloud first."""
    text_batches(q.sparkSession, 64, 32)
    asked, frame = (_frame(x.where(KNOWN)) for x in (q, s))
    asked, blocks = stash(_packed(q, asked, ASKING), "asking-points"), _packed(s, frame, BLOCK).join(frame.drop("level", "size"), "cloud_id")
    away = sum((F.pow(F.greatest(*[F.abs(F.col(e)[n] - F.col(f"l{c}") - F.col("edge") / 2) for e in ("low", "high")]), F.lit(2.0)) for n, c in enumerate(AXES)), F.lit(0.0))
    blocks = stash(blocks.select(F.col("cloud_id").alias("cell"), "block", F.col("ids").alias("names"), "points", "low", "high", away.alias("away")), "point-blocks")
    named = asked.select(F.col("block").alias("id"), F.col("cloud_id").alias("of"))
    named = named.select("id", F.col("of").alias("cell")) if pairs is None else named.join(pairs.select("of", F.col("by").alias("cell")).distinct(), "of").select("id", "cell")
    held = asked.select(F.col("block").alias("id"), "cloud_id", F.col("ids").alias("names"), "points", "low", "high")
    return together(held, blocks, named).sortWithinPartitions("side", F.desc("passing.away"), "passing.block")


def _points(row: dict) -> np.ndarray:
    return np.frombuffer(row["points"].as_buffer(), np.float64).reshape(-1, 3)


class _Held:
    """The blocks of a task that meet a cloud, with their boxes side by side."""

    def __init__(self, rows: list[dict]):
        self.cloud = np.array([r["cloud_id"].as_py() for r in rows])
        self.ids = [r["names"].values.to_numpy() for r in rows]
        self.points = [_points(r) for r in rows]
        self.low, self.high = (np.array([r[c].values.to_numpy() for r in rows]) for c in ("low", "high"))


def _box(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return row["low"].values.to_numpy(), row["high"].values.to_numpy()


def _square(off: np.ndarray) -> np.ndarray:
    """In the order in which the axes are added everywhere."""
    return off[..., 0] * off[..., 0] + off[..., 1] * off[..., 1] + off[..., 2] * off[..., 2]


def _least2(low: np.ndarray, high: np.ndarray, box: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Squared distance of boxes (or points) to a box; no pair is computed to be nearer, as rounding keeps order."""
    return _square(np.maximum(np.maximum(box[0] - high, low - box[1]), 0.0))


def _most2(low: np.ndarray, high: np.ndarray, box: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Squared distance of the farthest corners."""
    return _square(np.maximum(high - box[0], box[1] - low))


def _distances2(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(d)))
    for c in range(3):
        off = q[:, c, None] - d[None, :, c]
        off *= off
        out += off
    return out


def _below(q: np.ndarray, d: np.ndarray, least: float) -> int:
    """How many pairs have a squared distance below ``least``: by one product, and those that it leaves open one by one."""
    scale = float((q * q).sum(axis=1).max() + (d * d).sum(axis=1).max())
    slack = 1e-13 * scale + 1e-300
    if not np.isfinite(scale) or slack > least:
        return int(np.count_nonzero(_distances2(q, d) < least))
    one = lambda x: np.ones((len(x), 1))
    near = np.hstack([q, (q * q).sum(axis=1, keepdims=True), one(q)]) @ np.hstack([-2 * d, one(d), (d * d).sum(axis=1, keepdims=True)]).T
    sure, maybe = int(np.count_nonzero(near < least - slack)), int(np.count_nonzero(near <= least + slack))
    if sure < maybe:
        i, j = np.nonzero((near >= least - slack) & (near <= least + slack))
        sure += int(np.count_nonzero(_square(q[i] - d[j]) < least))
    return sure


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Held, dict]]:
    """(cloud, the blocks that meet it, block) of each block that passes."""
    rows: dict[int, dict] = {}
    held: dict[int, _Held] = {}
    with np.errstate(invalid="ignore", over="ignore"):
        for one, ids, two in met_rows(batches):
            if one:
                rows[one["id"].as_py()] = one
                continue
            cloud = two["cell"].as_py()
            if cloud not in held:
                held[cloud] = _Held([rows[i] for i in ids])
            yield cloud, held[cloud], two


def count_within(q: DataFrame, s: DataFrame, radius: float) -> DataFrame:
    """(cloud_id, n): pairs of a cloud within a radius, counted where they meet; two blocks that lie within it, or beyond, as a whole are not looked into."""
    # What rounds to the bound at 9 places is no longer within.
    least = (round(radius * radius * 1e9) - 0.5) / 1e9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = defaultdict(int)
        for cloud, held, block in _meet(batches):
            d, box = _points(block), _box(block)
            inside = _most2(held.low, held.high, box) < least
            found[cloud] += len(d) * sum(len(held.points[h]) for h in np.flatnonzero(inside))
            for h in np.flatnonzero(~inside & ~(_least2(held.low, held.high, box) >= least)):
                found[cloud] += _below(held.points[h], d, least)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["cloud_id", "n"])

    n = _meeting(q, s).mapInArrow(run, "cloud_id long, n long").groupBy("cloud_id").agg(F.sum("n").alias("n"))
    return n.where("n > 0")


#: Distances that are no number count as above all others.
_TOP = np.finfo(float).max


def farthest_of(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
    """(cloud_id, q, s, d2) of the k farthest points of s, at least, from each point of q in the same cloud; the caller ranks them.

    Outer blocks come first, so most others soon cannot reach a query's k-th
    distance.  A distance that is not known stands behind all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[_Held, list[np.ndarray], list[np.ndarray], np.ndarray]] = {}
        for cloud, held, block in _meet(batches):
            if cloud not in state:
                best = [np.full((len(p), k), -np.inf) for p in held.points]
                state[cloud] = held, best, [np.zeros(b.shape, np.int64) for b in best], np.full(len(best), -np.inf)
            _, best, names, need = state[cloud]
            d, ids, box = _points(block), block["names"].values.to_numpy(), _box(block)
            for h in np.flatnonzero(~(np.round(_most2(held.low, held.high, box), 9) < need)):
                q_ = held.points[h]
                rows = np.flatnonzero(~(np.round(_most2(q_, q_, box), 9) < best[h][:, -1]))
                if not len(rows):
                    continue
                d2 = np.round(_distances2(q_[rows], d), 9)
                d2 = np.where(np.isnan(d2), np.inf, np.minimum(d2, _TOP))
                least = best[h][rows, -1]
                if k < len(d):
                    least = np.maximum(least, -np.partition(-d2, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(d2 >= least[:, None])
                if not len(i):
                    continue
                one = np.unique(i)
                i = np.concatenate([i, np.repeat(one, k)])
                far, own = np.concatenate([d2[i[: len(j)], j], best[h][rows[one]].reshape(-1)]), np.concatenate([ids[j], names[h][rows[one]].reshape(-1)])
                order = np.lexsort((own, -far, i))
                i, far, own = i[order], far[order], own[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                few = place < k
                best[h][rows[i[few]], place[few]], names[h][rows[i[few]], place[few]] = far[few], own[few]
                need[h] = best[h][:, -1].min()
        for cloud, (held, best, names, _) in state.items():
            for h, far in enumerate(best):
                i, j = np.nonzero(far > -np.inf)
                found = far[i, j]
                found = np.where(found == np.inf, np.nan, np.where(found == _TOP, np.inf, found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), cloud, np.int64)), pa.array(held.ids[h][i]), pa.array(names[h][i, j]), pa.array(found)], names=["cloud_id", "q", "s", "d2"])

    found = _meeting(q, s).mapInArrow(run, "cloud_id long, q long, s long, d2 double")
    # Points without a place: the k smallest of a cloud may fill up short lists, and have the k smallest of all themselves.
    unknown = F.lit(None).cast("double").alias("d2")
    least = Window.partitionBy("cloud_id").orderBy("s")

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.select("cloud_id", F.col("point_id").alias("s")).withColumn("r", F.row_number().over(least)).where(F.col("r") <= k).drop("r")

    short = s.groupBy("cloud_id").agg(F.count(F.when(F.expr(KNOWN), 1)).alias("n")).where(F.col("n") < k).select("cloud_id")
    filled = q.where(KNOWN).join(short, "cloud_id", "left_semi").join(smallest(s.where(f"not ({KNOWN})")), "cloud_id")
    odd = q.where(f"not ({KNOWN})").join(smallest(s), "cloud_id")
    return found.unionByName(filled.unionByName(odd).select("cloud_id", F.col("point_id").alias("q"), "s", unknown))


def reach_of(box: float | None, tau: float, edge: float = 10.0) -> float:
    """The largest squared distance whose root is less than ``tau``, if a box is scaled to ``edge``."""
    within = lambda d2: math.sqrt(d2) * edge / max(box, 1e-8) < tau
    if box is None or math.isnan(box):
        return -1.0
    d2 = (tau * max(box, 1e-8) / edge) ** 2
    while not within(d2):
        d2 = math.nextafter(d2, -math.inf)
    while within(math.nextafter(d2, math.inf)):
        d2 = math.nextafter(d2, math.inf)
    return d2


def shares_within(q: DataFrame, s: DataFrame, pairs: DataFrame) -> DataFrame:
    """(of, by, share): the share of the points of cloud ``of`` in q with a point of cloud ``by`` in s at a squared distance of at most ``reach``; pairs: (of, by, reach).

    A query stops at the first such point.
    """
    reach = {(r["of"], r["by"]): r["reach"] for r in pairs.where("of is not null and by is not null").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[_Held, np.ndarray, list[np.ndarray]]] = {}
        for cloud, held, block in _meet(batches):
            if cloud not in state:
                state[cloud] = held, np.array([reach[int(of), cloud] for of in held.cloud]), [np.arange(len(p)) for p in held.points]
            _, far, left = state[cloud]
            d, box = _points(block), _box(block)
            for h in np.flatnonzero(~(_least2(held.low, held.high, box) > far)):
                if not len(left[h]):
                    continue
                q_ = held.points[h][left[h]]
                near = np.flatnonzero(~(_least2(q_, q_, box) > far[h]))
                if len(near):
                    left[h] = np.delete(left[h], near[(_distances2(q_[near], d) <= far[h]).any(axis=1)])
        for cloud, (held, _, left) in state.items():
            n, miss = np.array([len(p) for p in held.points]), np.array([len(x) for x in left])
            yield pa.RecordBatch.from_arrays([pa.array(held.cloud), pa.array(np.full(len(n), cloud, np.int64)), pa.array(n), pa.array(n - miss)], names=["of", "by", "n", "hits"])

    found = _meeting(q, s, pairs).mapInArrow(run, "of long, by long, n long, hits long")
    return found.groupBy("of", "by").agg((F.sum("hits") / F.sum("n")).alias("share"))
