"""Exact top-k by inner product through a pivot table (LAESA).

Each vector's distances to many pivots are worked out once and stored beside it
(the pivot table).  For a query, the largest difference of a row of that table
from its own distances is a lower bound of the distance, and with both norms an
upper bound of the inner product.  Candidates are evaluated in the order of
their bounds until the next bound cannot reach the k-th score found; so nothing
is left out, and pivots only decide how much is evaluated.  Whole cells and
blocks go by the intervals of their distances before their rows are looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.pivots import Pair, distinct_vectors, product_bound, ranked, rounding, search

SCALE = 1024
#: Candidates of the first step in bound order; each step takes four times as many as the one before.
STEP = 32
#: Vectors longer than this (after scaling) take no part, as their products would not fit a long.
LONGEST = 2.0**31


def whole_products(q: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows i of q and j of d: in doubles where every sum stays below 2**53, else in 64-bit integers.

    Most of all pairs: one product of the rows concerned; a few: pair by pair.
    """
    norms = [np.sqrt((x.astype(float) ** 2).sum(axis=1).max()) for x in (q, d)]
    if norms[0] * norms[1] < 2.0**52:
        q, d = q.astype(float), d.astype(float)
    if 4 * len(i) > len(q) * len(d):
        return (q @ d.T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.einsum("ij,ij->i", q[i[part]], d[j[part]]).astype(np.int64)
    return out


def in_bound_order(p: Pair, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A kernel of ``search``: pairs whose score is among the k best of the block, or ties with them, and reaches what the query needs."""
    rows = p.alive()
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none, 0
    q, table, reach = p.q[rows], p.q_table[rows], p.least[rows]
    square, squares = (q.astype(float) ** 2).sum(axis=1), (p.d.astype(float) ** 2).sum(axis=1)
    apart = np.zeros((len(q), len(p.d)))
    for c in range(table.shape[1]):
        np.maximum(apart, np.abs(table[:, c, None] - p.d_table[None, :, c]), out=apart)
    apart = np.maximum(apart - rounding(square, squares, p.pivots), 0.0)
    bound = product_bound(square, squares, apart)
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.full((len(q), k), -np.inf)
    found, at, step, looked = [], 0, STEP, 0
    while at < len(p.d):
        i, j = np.nonzero(bound[:, at : at + step] >= reach[:, None])
        if not len(i):
            break
        col = order[i, j + at]
        s = whole_products(q, p.d, i, col)
        looked += len(i)
        found.append((i, col, s))
        # The k-th best so far is what later candidates have to reach.
        block = np.full((len(q), k + min(step, len(p.d) - at)), -np.inf)
        block[:, :k] = best
        block[i, k + j] = s
        best = -np.partition(-block, k - 1, axis=1)[:, :k]
        reach = np.maximum(reach, best.min(axis=1))
        at, step = at + step, step * 4
    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)
    keep = s >= reach[i] - np.abs(reach[i]) * 2.0**-50
    return rows[i[keep]], j[keep], s[keep], looked


def scaled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector array<long>) of floor(1024 x); rows with a null key or vector, or a component that is null or not finite, go, and vectors longer than LONGEST."""
    x = F.col(vector)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.col(key).isNotNull() & x.isNotNull()).where(fine)
    long_ = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") * SCALE, F.lit(2.0)))
    return rows.where(long_ < LONGEST**2).select(F.col(key).cast("long").alias("key"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("vector"))


def pivot_top_k(df: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", ask_every: int = 100, report: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose key is divisible by ``ask_every``, ties to the smaller key.

    Equal vectors meet as one, which stands for the k + 1 smallest of their
    keys: no list can need more, so a vector that fills a third of the table
    costs what any other does.  Equal rows count once; rows of one key with
    other vectors are rows of their own, in asking and in being found.  A
    shorter vector counts as filled up with zeros.  Fewer than k other rows give
    a shorter list, an empty table none.  ``report``: see ``search``.
    """
    rows = scaled(df, key, vector)
    asked = rows.where(F.col("key") % ask_every == 0).distinct().select(F.array("key").alias("keys"), "vector")
    found = search(distinct_vectors(rows, "key", "vector", k + 1), asked, k, in_bound_order, exclude_self=True, report=report, least_rows=0)
    if report:
        return found
    return ranked(found, k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("d").alias("vec_id"), F.col("sim").alias("score"))
