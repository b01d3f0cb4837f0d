"""Blocks of clouds that pass by each other against all pairs, with ties and points without a place."""

import math

import numpy as np
import pytest

from ragloom.operators import allclouds as C
from ragloom.operators import clouds as P

SCHEMA = "cloud_id long, point_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(3)
    out = [(1, i, *map(float, x)) for i, x in enumerate(g.normal(size=(700, 3)).round(1))]
    out += [(2, 5000 + i, *map(float, x)) for i, x in enumerate(g.normal(size=(300, 3)))]
    # Equal points, one without a place, one infinitely far, one cloud with a single known point, one with none.
    out += [(3, 9000 + i, 1.0, 1.0, 1.0) for i in range(5)] + [(1, 8000, None, 0.0, 0.0), (2, 8001, math.inf, 0.0, 0.0)]
    return out + [(4, 9100, 0.0, 0.0, 0.0), (4, 9101, None, None, None), (4, 9102, None, None, None), (5, 9200, None, 1.0, 1.0), (None, 9300, 0.0, 0.0, 0.0)]


def distances(rows):
    for c in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == c]
        for a in own:
            for b in own:
                known = None not in a and None not in b
                yield c, a[1], b[1], round(sum((x - y) * (x - y) for x, y in zip(a[2:], b[2:], strict=True)), 9) if known else None


def test_farthest_points_of_each(spark, rows):
    best = {}
    for c, q, s, d2 in distances(rows):
        key = (1,) if d2 is None else (0, -math.inf if math.isnan(d2) else -min(d2, 1e300))
        best.setdefault((c, q), []).append((*key, s) if d2 is not None else (1, 0.0, s))
    want = {(c, q, x[2], i + 1) for (c, q), found in best.items() for i, x in enumerate(sorted(found)[:2])}
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.neighbours(df, df, 2, farthest=True)
    assert {(r.cloud_id, r.q, r.s, r["rank"]) for r in got.collect()} == want


def test_pairs_within_are_counted_where_they_meet(spark, rows):
    want = {}
    for c, _, _, d2 in distances(rows):
        if d2 is not None and d2 < 0.09:
            want[c] = want.get(c, 0) + 1
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.cloud_id: r.n for r in C.count_within(df, df, 0.3).collect()} == want


def test_shares_within(spark, rows):
    few = [r for r in rows if None not in r and math.isfinite(r[2])]
    reach = {(1, 2): 0.01, (2, 1): 0.04, (3, 1): 0.0, (4, 5): 1.0}
    want = {}
    for (a, b), far in reach.items():
        own, other = ([r for r in few if r[0] == c] for c in (a, b))
        if own and other:
            want[a, b] = np.mean([any(sum((x - y) * (x - y) for x, y in zip(p[2:], o[2:], strict=True)) <= far for o in other) for p in own])
    df = spark.createDataFrame(rows, SCHEMA).where("x is null or x < 100")
    pairs = spark.createDataFrame([(*k, v) for k, v in reach.items()], "of long, by long, reach double")
    got = {(r["of"], r["by"]): r.share for r in C.shares_within(df, df, pairs).collect()}
    assert got == pytest.approx(want)


def test_reach_is_the_last_distance_within():
    for box in (1.07, 3.0, 0.0, 1e-12, 1e6):
        far = C.reach_of(box, 0.5)
        within = lambda d2: math.sqrt(d2) * 10 / max(box, 1e-8) < 0.5
        assert within(far) and not within(math.nextafter(far, math.inf))
    assert C.reach_of(None, 0.5) == C.reach_of(math.nan, 0.5) == -1.0
