"""Scores of queries with all items against plain numpy, with ties, missing labels and a handful of scores at a time."""

import numpy as np
import pytest

from ragloom.operators import allscores as A


@pytest.fixture(params=[1 << 21, 50])
def tables(spark, monkeypatch, request):
    monkeypatch.setattr(A, "SCORES", request.param)
    monkeypatch.setattr(A, "ASKING", 16)
    g = np.random.default_rng(5)
    d, q = g.integers(-2, 3, (60, 4)).astype(float), g.integers(-2, 3, (90, 4)).astype(float)
    label = lambda i: None if i % 7 == 0 else i % 5
    frame = lambda n, v, step: spark.createDataFrame([(2 * i + step, x.tolist(), label(i)) for i, x in enumerate(v)], f"{n} long, {n}v array<double>, {n}_label long")
    return frame("q", q, 1), frame("d", d, 0), q @ d.T, label


def order(row):
    return np.lexsort((np.arange(len(row)), -row))


def test_ranks_and_nearest(tables):
    q, d, sim, _ = tables
    want = {(2 * i + 1, 2 * int(j), r + 1) for i, row in enumerate(sim) for r, j in enumerate(order(row))}
    assert {tuple(r) for r in A.against_all(q, d, A.every_rank, "q long, d long, rank long").collect()} == want
    assert {(r.q, r.d, r["rank"]) for r in A.nearest(q, d, 5).collect()} == {x for x in want if x[2] <= 5}
    assert A.nearest(q, d, 100).count() == sim.size and A.nearest(q, d.limit(0), 5).count() == 0


def test_first_ranks(tables):
    """A query without a relevant item has no row; a missing label equals none."""
    q, d, sim, label = tables
    want = {}
    for i, row in enumerate(sim):
        hits = [r + 1 for r, j in enumerate(order(row)) if label(i) is not None and label(j) == label(i)]
        if hits:
            want[2 * i + 1] = hits[0]
    out = A.first_ranks(q, d, A.same_label)
    assert {r.q: r["rank"] for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == 6 and "Window" not in out._jdf.queryExecution().toString()
    own = {2 * i + 1: list(order(row)).index(i) + 1 for i, row in enumerate(sim) if i < 60}
    got = {r.q: r for r in A.nearest_and_first(q, d, 3, A.item_before).collect()}
    assert {k: r["first"] for k, r in got.items()} == {2 * i + 1: own.get(2 * i + 1) for i in range(90)}
    assert all(got[2 * i + 1].d == [2 * int(j) for j in order(row)[:3]] for i, row in enumerate(sim))


def test_ndcg(tables):
    q, d, sim, label = tables
    gain = lambda rels: sum((2**r - 1) / np.log2(k + 2) for k, r in enumerate(rels))
    grade = lambda s: np.where(A.item_before(s), 2, A.same_label(s))
    got = {r.q: r.ndcg for r in A.graded_ndcg(q, d, grade, 10).collect()}
    binary = {r.q: r.ndcg for r in A.first_and_ndcg(q, d, A.same_label, 5).collect()}
    for i, row in enumerate(sim):
        same = [int(label(i) is not None and label(j) == label(i)) for j in order(row)]
        rels = [2 if j == i else s for j, s in zip(order(row), same, strict=True)]
        ideal = gain(sorted(rels, reverse=True)[:10])
        assert got[2 * i + 1] == pytest.approx(gain(rels[:10]) / ideal if ideal else 0.0)
        assert (2 * i + 1 in binary) == (sum(same) > 0)
        if sum(same):
            assert binary[2 * i + 1] == pytest.approx(gain(same[:5]) / gain(sorted(same, reverse=True)[:5]))


def test_blocks_go_to_a_group_once(spark):
    """However many held blocks of a group name its cell, and each of them meets it."""
    from ragloom.operators import pivots

    held = spark.range(200).selectExpr("id", "id * 10 AS x")
    passing = spark.createDataFrame([(c, 10 * c + b) for c in range(3) for b in range(4)], "cell int, block long")
    pairs = held.selectExpr("id", "cast(id % 3 AS int) AS cell")
    rows = pivots.together(held, passing, pairs)
    assert rows.count() <= 200 + 12 * pivots.GROUPS

    def meet(batches):
        mine = []
        for one, ids, two in pivots.met_rows(batches):
            if one:
                mine.append(one["id"].as_py())
                continue
            for i in mine if ids is None else ids:
                assert i in mine
                yield pivots.pa.RecordBatch.from_arrays([pivots.pa.array([i]), pivots.pa.array([two["block"].as_py()])], names=["i", "block"])

    got = sorted(map(tuple, rows.mapInArrow(meet, "i long, block long").collect()))
    assert got == [(i, 10 * (i % 3) + b) for i in range(200) for b in range(4)]
    assert pivots.together(held, passing, None).mapInArrow(meet, "i long, block long").count() == 200 * 12


def test_six_places_as_in_c(spark):
    from ragloom.plans.vectors import six_places

    x = [0.1234565, 0.1234575, -0.0000004, 1234.5, 0.0000005, 0.5, -0.2345675, 2.0000015]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(six_places("x")).collect()]
    assert got == ["%.6f" % v for v in x]


def test_rows_of_a_rank_lie_together(spark, monkeypatch):
    """And a table is copied for two tasks of each core, 12 at least, not for 48 of any session."""
    monkeypatch.setattr(A, "ASKING", 1)
    s = A.Scores(np.array([1, 3]), np.zeros(2), np.array([0, 2, 4]), np.zeros(3), np.array([[0.1, 0.5, 0.5], [0.3, 0.2, 0.9]]))
    q, d, rank = A.every_rank(s)
    assert list(rank) == [1, 1, 2, 2, 3, 3] and list(q) == [1, 3] * 3 and list(d) == [2, 4, 4, 0, 0, 2]
    q, d, sim = A.every_pair(s)
    assert list(d) == [0, 0, 2, 2, 4, 4] and list(q) == [1, 3] * 3 and list(sim) == [0.1, 0.3, 0.5, 0.2, 0.5, 0.9]
    v = spark.range(60).selectExpr("id AS q", "array(cast(id AS double), 1D) AS qv")
    out = A.against_all(v, v.toDF("d", "dv"), A.every_rank, "q long, d long, rank long")
    assert out.rdd.getNumPartitions() == 12 and out.count() == 3600


def test_stash_deletes_what_was_shuffled(spark):
    import time

    from ragloom.session import stash

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {b for b in map(str, _listed(blocks)) if b.startswith("shuffle_")}
    had = left()
    stash(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "sum")
    until = time.time() + 5
    while left() - had and time.time() < until:
        time.sleep(0.1)
    assert not left() - had


def _listed(blocks):
    found = blocks.getAllBlocks()
    return [found.apply(i) for i in range(found.size())]
