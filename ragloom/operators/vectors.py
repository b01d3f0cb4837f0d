"""Similarity of vector tables: block products, exact and approximate nearest neighbours, prototypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import vectors as V
from ragloom.operators.allscores import Scores, against_all, every_pair
from ragloom.operators.pivots import BLOCK, Pair, blocked, directory, grid, matrix, met_rows, ranked, search, together, vectors_of
from ragloom.session import spread, stash, text_batches


def block_products(q: DataFrame, d: DataFrame, q_key: str, q_vec: str, d_key: str, d_vec: str) -> DataFrame:
    """(q, d, sim): inner products of all pairs of two vector tables, rounded to 9 places.

    For results that have a row for each pair; see ``allscores``.  ``top_k`` and
    ``similar_pairs`` look only at what can matter.
    """
    q, d = q.select(F.col(q_key).alias("q"), F.col(q_vec).alias("qv")), d.select(F.col(d_key).alias("d"), F.col(d_vec).alias("dv"))
    return against_all(q, d, every_pair, "q long, d long, sim double")


def _best_of_block(p: Pair, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A kernel of ``search``: one product for the queries that the block's intervals leave, and the k best of each, ties too."""
    rows = p.alive()
    s = np.round(p.q[rows] @ p.d.T, 9)
    need = p.least[rows]
    if k < len(p.d) and len(rows):
        need = np.maximum(need, -np.partition(-s, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero(s >= need[:, None])
    return rows[i], j, s[i, j], s.size


def _keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def top_k(q: DataFrame, d: DataFrame, k: int, q_key: str = "q", q_vec: str = "qv", d_key: str = "d", d_vec: str = "dv", exclude_self: bool = False, report: bool = False) -> DataFrame:
    """(q, d, sim, rank): exact nearest by inner product, rounded to 9 places, ties to the smaller id.

    Vectors lie in cells around pivots.  A query first meets the cell that looks
    best; then only cells and blocks whose distances to the pivots leave room
    for its k-th score.  On grouped vectors that is a small part (``report``
    tells: pairs of the blocks that met in the second round, and pairs worked
    out); on vectors without any structure no exact way can skip much.  Null
    keys and vectors take no part.
    """
    rows, asked = (_keyed(*own).select(F.array("key").alias("keys"), "vector") for own in ((d, d_key, d_vec), (q, q_key, q_vec)))
    found = search(rows, asked, k, _best_of_block, exclude_self, report, tables=False)
    return found if report else ranked(found, k)


#: Leading coordinates that a pair's bound is worked out from at first.
PREFIX = 16


def _pairs_above(a: np.ndarray, b: np.ndarray, least: float, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, sim, candidates) of the rows of a and b with a product of at least ``least``, rounded to 9 places.

    Coordinates are turned and sorted so that the first hold most.  The product
    of the first some, and the norms of what is left of both, bound the whole
    product; pairs below go, the others get more coordinates, until few are left
    to be worked out in full.
    """
    x, y = a @ axes, b @ axes
    m, width = PREFIX, a.shape[1]
    # Products of half the precision, of vectors of these lengths, are off by less.
    some = np.float32(least - 1e-7 - 1e-5 * max(1.0, float(np.sqrt((x * x).sum(axis=1).max(initial=0.0) * (y * y).sum(axis=1).max(initial=0.0)))))
    while True:
        # The norms of the rest are one more coordinate of the product.
        ends = [np.hstack([z[:, :m], np.sqrt(np.maximum((z[:, m:] ** 2).sum(axis=1, keepdims=True), 0.0))]).astype(np.float32) for z in (x, y)]
        bound = ends[0] @ ends[1].T
        i, j = np.nonzero(bound >= some)
        if m >= width or 16 * len(i) <= bound.size:
            break
        m *= 2
    sim = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        sim[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    sim = np.round(sim, 9)
    keep = sim >= least
    return i[keep], j[keep], sim[keep], len(i)


def similar_pairs(df: DataFrame, least: float, key: str = "id", vector: str = "v", strict: bool = True, report: bool = False) -> DataFrame:
    """(i, j, sim) with i < j of cosine above (or, not strict, at least) a threshold: an exact join.

    A cosine of unit vectors bounds their distance, so blocks whose intervals of
    distances to a pivot lie further apart never meet; blocks that meet are
    filtered by the leading coordinates.  ``report``: (pairs, candidates) of
    each two blocks that met.
    """
    rows = _keyed(df, key, vector).select(F.array("key").alias("keys"), V.l2_normalize(F.col("vector")).alias("vector"))
    by, width = grid(rows, "vector")
    table = stash(blocked(rows, by, width, BLOCK).select("cell", "block", "keys", "vectors", "low", "high", "most"), "pivot-blocks")
    cells = directory(table, by)
    apart = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                low, high = (b.column(c)[r].values.to_numpy() for c in (1, 2))
                gap = np.maximum(cells.low - high, low - cells.high).max(axis=1)
                found = cells.cell[gap <= apart]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b.column(0)[r].as_py(), np.int64)), pa.array(found)], names=["id", "cell"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones: dict[int, tuple[np.ndarray, ...]] = {}
        for one, ids, two in met_rows(batches):
            row = one or two
            own = (row["keys"].values.to_numpy(), vectors_of(row["vectors"], width, False), *(row[c].values.to_numpy() for c in ("low", "high")))
            if one:
                ones[one["id"].as_py()] = own
                continue
            (bk, y, b_low, b_high), block = own, two["block"].as_py()
            for first in ids:
                if first > block:
                    continue
                ak, x, a_low, a_high = ones[first]
                away = max(np.max(b_low - a_high, initial=0.0), np.max(a_low - b_high, initial=0.0)) > apart
                i, j, sim, looked = _pairs_above(x[: 0 if away else None], y, least, by.axes)
                if report:
                    yield pa.RecordBatch.from_arrays([pa.array([len(x) * len(y)]), pa.array([looked])], names=["pairs", "candidates"])
                    continue
                # A block with itself has each pair twice.
                i, j, sim = (z[(ak[i] < bk[j]) | (first != block)] for z in (i, j, sim))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ak[i]), pa.array(bk[j]), pa.array(sim)], names=["i", "j", "sim"])

    text_batches(df.sparkSession, 64, 32)
    pairs = table.select("block", "low", "high").mapInArrow(near, "id long, cell int")
    one = table.select(F.col("block").alias("id"), "keys", "vectors", "low", "high")
    met = together(one, table.select("cell", "block", "keys", "vectors", "low", "high"), pairs)
    if report:
        return met.mapInArrow(join, "pairs long, candidates long")
    p = met.mapInArrow(join, "i long, j long, sim double")
    if strict:
        p = p.where(F.col("sim") > least)
    return p.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sim").where("i < j")


def mean_vectors(df: DataFrame, group: str, vector: str, weight: str | None = None, unit: bool = False) -> DataFrame:
    """(group, v): mean of a group's vectors, position by position, so that no group is gathered whole."""
    rows = df.select(group, F.posexplode(vector).alias("pos", "x"), *([weight] if weight else []))
    mean = F.sum(F.col("x") * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-9)) if weight else F.avg("x")
    flat = rows.groupBy(group, "pos").agg(mean.alias("m"))
    out = flat.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    return out.withColumn("v", V.l2_normalize(F.col("v"))) if unit else out


#: Rows of a bucket that a task compares at once; larger buckets are compared in a grid of parts.
BUCKET = 4096
#: Expected recall of pairs that lie exactly at the distance; closer ones are found more often.
RECALL = 0.98


def _turns_and_tables(n: int, dimensions: int, distance: float) -> tuple[np.ndarray, int]:
    """Random turns, and how many tables they make.

    Vectors share a part of a key if, turned, the same coordinate is largest, with
    the same sign.  A key has as many parts as leave about 16 of n vectors
    without structure in a bucket, and there are as many tables as find pairs at
    the distance with ``RECALL``; drawn pairs tell how often those share a part.
    """
    g = np.random.default_rng(7)
    parts = max(1, int(np.ceil(np.log(max(n / 16, 2)) / np.log(2 * dimensions))))
    x, away = g.normal(size=(2, 4000, dimensions))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    cosine = max(-1.0, 1 - distance * distance / 2)
    y = cosine * x + np.sqrt(1 - cosine * cosine) * away
    share = float((_largest(x) == _largest(y)).mean()) ** parts
    tables = 1 if share >= RECALL else min(256, int(np.ceil(np.log(1 - RECALL) / np.log(1 - max(share, 1e-9)))))
    return np.linalg.qr(g.normal(size=(tables * parts, dimensions, dimensions)))[0], tables


def _largest(x: np.ndarray) -> np.ndarray:
    """The coordinate of largest size, with its sign."""
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] < 0)


def _hashed(df: DataFrame, distance: float, key: str, vector: str, of: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """(id, v, keys), a key for each table, of all rows or those with an id in ``of``; dimensions and tables, which follow from all rows."""
    n, dimensions = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    dimensions = max(1, dimensions or 1)
    turns, tables = _turns_and_tables(n, dimensions, distance)
    parts = len(turns) // tables

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dimensions).astype(float, copy=False)
            keys = np.zeros((len(x), tables), np.int64)
            for t in range(tables):
                for turn in turns[t * parts : (t + 1) * parts]:
                    keys[:, t] = keys[:, t] * 2 * dimensions + _largest(x @ turn)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), tables).cast(pa.list_(pa.int64()))], names=["id", "v", "keys"])

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if of is not None:
        rows = spread(rows.join(of, "id", "left_semi"), "id")
    return rows.mapInArrow(keyed, "id long, v array<double>, keys array<long>"), dimensions, tables


def nearest_by_hash(df: DataFrame, distance: float, key: str = "id", vector: str = "v") -> DataFrame:
    """(i, j, distance) of unit vectors within a distance, by random turns: approximate, for tables too large for blocks.

    See ``_turns_and_tables`` for the keys.  Vectors of one key in a table meet
    in a task, and a pair is given in the first table that it shares.
    """
    rows, dimensions, tables = _hashed(df, distance, key, vector)
    rows = stash(rows, "hash-keys")
    flat = rows.select("id", F.posexplode("keys").alias("t", "k"))
    large = flat.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    large = large.select("t", "k", F.ceil(F.col("n") / (BUCKET // 2)).cast("int").alias("n"))
    placed = rows.select("id", "v", "keys", F.posexplode("keys").alias("t", "k")).join(large, ["t", "k"], "left")
    # A row of part p of a large bucket goes to each pair of parts (p, other), named by the smaller and the larger.
    own = F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))).cast("int").alias("own")
    placed = placed.select("*", own).select("*", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("other"))
    placed = placed.select("t", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("r"), "own", "id", "v", "keys")
    bucket = ["t", "k", "p", "r"]

    def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        first, p, r = (t.column(c)[0].as_py() for c in ("t", "p", "r"))
        own, ids = t.column("own").to_numpy(), t.column("id").to_numpy()
        x, keys = matrix(t.column("v"), dimensions).astype(float, copy=False), matrix(t.column("keys"), tables)
        ones, twos = np.flatnonzero(own == p), np.flatnonzero(own == r)
        square = (x * x).sum(axis=1)
        for at in range(0, len(ones), 512):
            few = ones[at : at + 512]
            i, j = np.nonzero(square[few][:, None] + square[twos] - 2 * (x[few] @ x[twos].T) <= distance * distance + 1e-6)
            i, j = few[i], twos[j]
            new = (ids[i] < ids[j]) if p == r else (ids[i] != ids[j])
            new &= ~(keys[i, :first] == keys[j, :first]).any(axis=1)
            i, j = i[new], j[new]
            apart = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
            i, j, apart = (z[apart < distance] for z in (i, j, apart))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(apart)], names=["i", "j", "distance"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for b in batches:
            names = np.stack([b.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])) if len(names) else np.zeros(0, int)
            for start, stop in zip(cuts, np.append(cuts[1:], len(names)), strict=True):
                if held and name != tuple(names[start]):
                    yield from compared(held)
                    held = []
                name = tuple(names[start])
                held.append(b.slice(start, stop - start))
        if held:
            yield from compared(held)

    return spread(placed, *bucket).sortWithinPartitions(*bucket).mapInArrow(join, "i long, j long, distance double")


def k_means(df: DataFrame, k: int, key: str = "id", vector: str = "v", rounds: int = 10) -> DataFrame:
    """(key, group, pos, offset, group_max): offset from the centroid and the group's largest value, by position.

    Centres begin as the vectors of the k smallest keys and move ``rounds``
    times to the means of their groups; a group that nothing is nearest to keeps
    its centre, ties go to the first.  Vectors of one round are summed position
    by position before the shuffle; only the k centres pass through the driver.
    """
    rows = df.select(key, vector)
    centres = np.array([r[0] for r in rows.orderBy(key).limit(k).select(vector).collect()], dtype=float)

    def assigned() -> DataFrame:
        table = centres.copy()

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1), table.shape[1])
                # Squared distance but for the vector's own norm.
                group = ((table * table).sum(axis=1) - 2 * (x @ table.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(group.astype(np.int32))], names=[key, vector, "group"])

        return rows.mapInArrow(nearest, f"{key} {rows.schema[key].dataType.simpleString()}, {vector} array<double>, group int")

    for _ in range(rounds if len(centres) else 0):
        moved = centres.copy()
        for r in assigned().select("group", F.posexplode(vector).alias("pos", "x")).groupBy("group", "pos").agg(F.avg("x").alias("m")).collect():
            moved[r["group"], r["pos"]] = r["m"]
        if np.array_equal(moved, centres):
            break
        centres = moved
    if not len(centres):
        return rows.select(key, F.lit(0).alias("group"), F.lit(0).alias("pos"), F.lit(0.0).alias("offset"), F.lit(0.0).alias("group_max")).limit(0)
    table = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "group int, centre array<double>")
    found = assigned().join(F.broadcast(table), "group")
    flat = found.select(key, "group", F.posexplode(F.zip_with(vector, "centre", lambda a, b: F.struct(a.alias("x"), (a - b).alias("offset")))).alias("pos", "s"))
    flat = flat.select(key, "group", "pos", "s.x", "s.offset")
    return flat.join(flat.groupBy("group", "pos").agg(F.max("x").alias("group_max")), ["group", "pos"])


def hash_recall(df: DataFrame, distance: float, key: str = "id", vector: str = "v", every: int = 100) -> DataFrame:
    """(exact, found): how many neighbours within a distance the rows whose key is divisible by ``every`` have, by all scores of those rows, and how many of them ``nearest_by_hash`` finds; unit vectors.

    All rows pass by those that ask.  The hashes find a pair nearer than the
    distance if the two share a key in any table, so only the neighbours'
    own keys are worked out, and no bucket.
    """
    least = round(1 - distance * distance / 2, 9)

    def near(s: Scores) -> list[np.ndarray]:
        # A pair of two asking rows is given once.
        i, j = np.nonzero((s.sim >= least) & ((s.q % every != 0)[:, None] | (s.d < s.q[:, None])))
        return [np.minimum(s.q[i], s.d[j]), np.maximum(s.q[i], s.d[j])]

    rows = df.select(F.col(key).alias("q"), V.l2_normalize(F.col(vector)).alias("qv"))
    asked = rows.where(F.col("q") % every == 0).select(F.col("q").alias("d"), F.col("qv").alias("dv"))
    exact = stash(against_all(rows, asked, near, "i long, j long"), "exact-neighbours")
    ends = stash(_hashed(df, distance, key, vector, exact.select(F.col("i").alias("id")).union(exact.select("j")).distinct())[0], "hash-keys")
    one, two = (ends.select(F.col("id").alias(side), F.col("v").alias(f"{side}v"), F.col("keys").alias(f"{side}keys")) for side in ("i", "j"))
    apart = F.sqrt(F.aggregate(F.zip_with("iv", "jv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    shared = F.exists(F.zip_with("ikeys", "jkeys", lambda x, y: x == y), lambda x: x)
    got = exact.distinct().join(one, "i").join(two, "j").where(shared & (apart < distance)).select("i", "j").distinct().withColumn("hit", F.lit(1))
    return exact.join(got, ["i", "j"], "left").agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"))
