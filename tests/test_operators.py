"""Hand-made cases, brute force and invariants for operators that SQL does not cover."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators import clouds as P
from ragloom.operators import corpus as C
from ragloom.operators import dedup as D
from ragloom.operators import graph as G
from ragloom.operators import ranking as K
from ragloom.operators import segmentation as M
from ragloom.operators import setmatch as S_
from ragloom.operators import vectors as O
from ragloom.sources import tables as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, X.norm_ws(F.lit(" a \t b\n\nc "))) == "a b c"
    assert one(spark, X.clean_paragraph(F.lit("one two[12] three four five six seven eight nine [3] ten"))).startswith("one two three")
    assert one(spark, X.clean_paragraph(F.lit("too short [1]"))) == ""
    assert one(spark, X.has_term(F.lit("Two Oaks stand"), F.lit("oak"), plural=True))
    assert not one(spark, X.has_term(F.lit("soaked"), F.lit("oak"), plural=True))
    assert one(spark, X.has_term(F.lit("a c++ b"), F.lit("c++")))
    assert one(spark, X.n_words(F.lit("  "))) == 0
    page = "  &amp;lt;B&amp;gt; &eacute; "
    assert one(spark, X.html_unescape(F.lit(page))) == html.unescape(html.unescape(page)).strip().lower()


def replay(confidence, pairs):
    """Every row takes its turn on what is still there."""
    left = set(confidence)
    for row in sorted(confidence):
        partners = [j for i, j in pairs if i == row and j in left]
        higher = [confidence[j] > confidence[row] for j in partners]
        if row in left:
            left -= set(partners[: higher.index(True)] + [row] if any(higher) else partners)
    return left


def greedy(n, pairs):
    near = {frozenset(p) for p in pairs}
    kept = []
    for i in range(n):
        if not any(frozenset((i, k)) in near for k in kept):
            kept.append(i)
    return set(kept)


@pytest.mark.parametrize("seed", range(3))
def test_dedup_rules(spark, seed):
    g = np.random.default_rng(seed)
    n = 30
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in g.integers(0, n, (35, 2)) if a != b})
    rows = {i: float(g.choice([0.6, 0.7, 0.9])) for i in range(n)}
    r = spark.createDataFrame(list(rows.items()), "id long, confidence double")
    p = spark.createDataFrame(pairs, "i long, j long")
    assert {x.id for x in D.drop_in_turn(r, p).collect()} == replay(rows, pairs)
    assert {x.id for x in D.keep_greedily(r, p).collect()} == greedy(n, pairs)


@pytest.mark.parametrize("seed", range(2))
def test_turns_with_partners_on_both_sides(spark, seed):
    """Ranked partners may come before their row, as with nearest neighbours."""
    g = np.random.default_rng(seed)
    rows = {i: float(g.choice([0.6, 0.7, 0.9])) for i in range(20)}
    pairs = [(i, int(j)) for i in rows for j in g.permutation(20)[:2] if i != j]
    ranked = [(i, j, k) for k, (i, j) in enumerate(pairs)]
    r = spark.createDataFrame(list(rows.items()), "id long, confidence double")
    p = spark.createDataFrame(ranked, "i long, j long, rank long")
    assert {x.id for x in D.drop_in_turn(r, p).collect()} == replay(rows, pairs)


def test_turns_of_a_dense_table_take_few_rounds(spark, monkeypatch):
    """Where all rows are linked over a few others, rounds follow the turns that wait for each other, not the number of turns."""
    g = np.random.default_rng(5)
    rows = {i: float(g.choice([0.6, 0.7, 0.9])) for i in range(150)}
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in g.integers(0, 150, (900, 2)) if a != b})
    rounds, stash = [], D.stash
    monkeypatch.setattr(D, "stash", lambda df, name: rounds.append(name) or stash(df, name))
    r = spark.createDataFrame(list(rows.items()), "id long, confidence double")
    assert {x.id for x in D.drop_in_turn(r, spark.createDataFrame(pairs, "i long, j long")).collect()} == replay(rows, pairs)
    assert rounds.count("dropped") <= 12


def test_corpus_with_semantic_dedup(spark):
    """Of near texts, in the order of ids, the more confident stays; small corpora are left as they are."""
    words = [f"w{k}" for k in range(40)]
    base = "the " + " ".join(words)
    texts = [(1, base, 0.9), (2, base.replace("w3 ", "x3 "), 0.7), (3, base.replace("w5 ", "x5 "), 0.9), (4, "the " + " ".join(w[::-1] for w in words), 0.9)]
    rows = spark.createDataFrame([(i, t, "en", "caption", c) for i, t, c in texts], "doc_id long, text string, category string, source string, confidence double")
    kept = lambda **how: {r.doc_id for r in C.build_corpus(rows, ["the"], **how).collect()}
    unit = [np.bincount([hash(w) % 512 for w in t.split()], minlength=512) for _, t, _ in texts]
    assert unit[0] @ unit[1] / np.linalg.norm(unit[0]) / np.linalg.norm(unit[1]) > 0.85
    assert kept() == kept(similar=0.85) == {1, 2, 3, 4}
    assert kept(similar=0.85, above=0) == {1, 4}


def test_nearest_by_hash_recall(spark):
    """At least nine of ten pairs within the distance, in truth nearly all."""
    g = np.random.default_rng(3)
    v = g.normal(size=(300, 64))
    v = np.concatenate([v, v + g.normal(size=v.shape) * 0.4])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    near = {(i, j) for i, j in zip(*np.where(d < 0.5), strict=True) if i < j}
    found = {(r.i, r.j) for r in O.nearest_by_hash(rows, 0.5).collect()}
    assert len(near) > 100 and found <= near and len(found) >= 0.9 * len(near)


def test_farthest_points(spark):
    """Against a plain loop; a cloud of fewer points gives them all."""
    g = np.random.default_rng(4)
    rows = [(c, i, *map(float, g.normal(size=3))) for c, n in ((0, 40), (1, 3)) for i in range(n)]
    got = P.farthest_points(spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double"), 6)
    got = {(r.cloud_id, r.place): r.point_id for r in got.collect()}
    for c in (0, 1):
        p = np.array([r[2:] for r in rows if r[0] == c])
        chosen = [0]
        while len(chosen) < min(6, len(p)):
            chosen.append(int(((p[:, None] - p[chosen][None]) ** 2).sum(axis=2).min(axis=1).argmax()))
        assert [got[c, k] for k in range(len(chosen))] == chosen and (c, len(chosen)) not in got


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "x", "d")], "src string, rel string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in G.closure(s, e, "r").collect()} == {"a", "b", "c"}


def test_hops(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 4, 5)], "graph_id long, src long, dst long")
    n = spark.createDataFrame([(1, k) for k in range(1, 6)], "graph_id long, node long")
    h = {(r.a, r.b): r.hops for r in G.hops(e, n).collect()}
    assert h[1, 3] == 2 and h[3, 1] == 2 and h[2, 2] == 0 and h[1, 4] == 510 and len(h) == 25


def test_metrics_by_hand(spark):
    s = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.8), (2, 10, 0.1), (2, 11, 0.1), (2, 12, 0.5)], "q long, d long, sim double")
    r = K.ranked(s)
    assert [x.d for x in r.where("q = 1").orderBy("rank").collect()] == [10, 11, 12]
    h = K.hits(r, ((F.col("q") == 1) & (F.col("d") >= 11)) | ((F.col("q") == 2) & (F.col("d") == 12)))
    assert {x.q: x.rr for x in K.reciprocal_rank(h).collect()} == {1: 0.5, 2: 1.0}
    at = {x.k: x for x in K.at_k(h, 2).collect()}
    assert at[1].rr == 0.5 and at[2].recall == 0.75 and at[2].precision == 0.5
    assert at[2].ndcg == pytest.approx((1 / np.log2(3) / (1 + 1 / np.log2(3)) + 1) / 2)


def test_confusion_by_hand(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("z", "a")], "truth string, pred string")
    k = M.class_counts(M.confusion(p, ["a", "b", "c"], "z"))
    rows = {r["class"]: r for r in k.collect()}
    assert (rows["a"].tp, rows["a"].fp, rows["a"].fn, rows["a"].tn) == (1, 0, 1, 1)
    s = M.summary(k).first()
    assert s.oa == pytest.approx(200 / 3) and s.miou == pytest.approx((50 + 50 + 0) / 3)
    assert M.summary(k, eps=1e-10).first().miou == pytest.approx((50 + 50 + 100) / 3)


def test_neighbours_and_ball_agree_with_numpy(spark):
    g = np.random.default_rng(1)
    xyz = g.random((60, 3))
    df = spark.createDataFrame([(1, i, *map(float, p), 0.0) for i, p in enumerate(xyz)], "cloud_id long, point_id long, x double, y double, z double, f1 double")
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    near = {(r.q, r.s) for r in P.within(df, df, 0.3).collect()}
    assert near == {(i, j) for i in range(60) for j in range(60) if d[i, j] < 0.09}
    for r in P.neighbours(df, df, 3).collect():
        assert np.argsort(d[r.q], kind="stable")[r["rank"] - 1] == r.s
    chosen = [r.point_id for r in P.farthest_points(df, 8).orderBy("place").collect()]
    gaps = [min(d[chosen[k], c] for c in chosen[:k]) for k in range(1, 8)]
    assert chosen[0] == 0 and all(a >= b - 1e-12 for a, b in zip(gaps, gaps[1:], strict=False))
    covered = {r.point_id for r in P.voxel_rounds(P.voxels(df, 0.4)).collect()}
    assert covered == set(range(60))


def test_balls_of_large_clouds_stop_at_the_first_ids(spark, monkeypatch):
    """Rounds of ids find the same as a plain search, in a dense heap, a thin rest and an empty place, and few pairs meet."""
    monkeypatch.setattr(P, "PLAIN", 50)
    monkeypatch.setattr(P, "FIRST", 16)
    met, plain = [], P.within
    monkeypatch.setattr(P, "within", lambda *a: met.append(plain(*a).cache()) or met[-1])
    g = np.random.default_rng(3)
    xyz = np.concatenate([g.normal(0, 0.05, (1200, 3)), g.normal(0, 0.6, (300, 3)), [[9.0, 9.0, 9.0]]])
    ids = g.permutation(len(xyz))
    schema = "cloud_id long, point_id long, x double, y double, z double"
    odd = [(2, 7, 0.0, 0.0, 0.0), (2, 5, 0.2, 0.0, 0.0), (2, 3, float("inf"), 0.0, 0.0), (2, 4, None, 0.0, 0.0), (2, 6, float("nan"), 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(1, int(i), *map(float, p)) for i, p in zip(ids, xyz, strict=True)] + odd, schema)
    got = {}
    for r in P.ball_query(df, df, 0.2, 6).orderBy("place").collect():
        got.setdefault((r.cloud_id, r.q), []).append(r.s)
    want = {}
    for i, p in zip(ids, xyz, strict=True):
        found = sorted(ids[np.round(((xyz - p) ** 2).sum(axis=1), 9) < 0.04].tolist())[:6]
        want[1, int(i)] = found + found[:1] * (6 - len(found))
    assert {k: v for k, v in got.items() if k[0] == 1} == want
    # A squared distance of exactly 0.04 is not below it; points without a place are near nothing.
    assert {k: v for k, v in got.items() if k[0] != 1} == {(2, 7): [7] * 6, (2, 5): [5] * 6}
    assert len(met) > 1 and sum(m.count() for m in met) < 40 * len(xyz)


def test_spheres_take_the_nearest_points_only(spark, monkeypatch, tmp_path):
    """As the SQL says, with coordinates missing or not finite, and without all pairs within the radius."""
    import duckdb

    from ragloom.plans import QUERIES, SQL

    monkeypatch.setattr(P, "within", None)
    v = np.random.default_rng(2).normal(0, 0.1, (120, 4))
    v[10, 0], v[20, 1], v[31, 2] = np.nan, np.inf, -np.inf
    rows = [(i, [None if (i, k) == (40, 0) else float(x) for k, x in enumerate(r)], i % 2) for i, r in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {tuple(r[:4]): r[4] for r in c.execute(SQL["pc_sphere_tukey"]).fetchall()}
    got = {tuple(r)[:4]: r.weight for r in QUERIES["pc_sphere_tukey"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len(want) > 20 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("n, k", [(3, 5), (5000, 4), (30000, 6)])
def test_nearest_points_of_small_and_large_clouds(spark, n, k):
    """An even cloud with a dense heap and a pile of one place, and small clouds; queries inside and far outside."""
    g = np.random.default_rng(n)
    xyz = g.random((n, 3))
    xyz[: n // 3] = 0.4 + 0.001 * g.random((n // 3, 3))
    xyz[n // 3 : n // 3 + n // 20] = 0.7
    asked = np.concatenate([xyz[:: max(1, n // 40)], [[2.0, 0.5, -1.0], [0.5, 0.5, 0.5]]])
    schema = "cloud_id long, point_id long, x double, y double, z double"
    support = spark.createDataFrame([(1, i, *p) for i, p in enumerate(xyz.tolist())] + [(2, 9, 0.0, 0.0, 0.0), (2, 8, 1.0, None, 0.0)], schema)
    q = spark.createDataFrame([(1, i, *p) for i, p in enumerate(asked.tolist())] + [(2, 1, 5.0, 5.0, 5.0), (3, 1, 0.0, 0.0, 0.0)], schema)
    got = {(r.cloud_id, r.q, r["rank"]): r.s for r in P.neighbours(q, support, k).collect()}
    assert {x for x in got if x[0] != 1} == {(2, 1, 1)} and got[2, 1, 1] == 9
    for i, p in enumerate(asked):
        d = np.round(sum((p[c] - xyz[:, c]) ** 2 for c in range(3)), 9)
        best = np.lexsort((np.arange(n), d))[:k]
        assert [d[got[1, i, r + 1]] for r in range(len(best))] == [d[b] for b in best]
        assert [got[1, i, r + 1] for r in range(len(best))] == best.tolist()


def test_ranks_of_large_groups_need_no_window_over_them(spark, monkeypatch):
    from ragloom.operators import ranks

    g = np.random.default_rng(3)
    rows = [(int(g.integers(3)), i, float(g.choice([0.5, g.random(), g.random()]))) for i in range(4000)]
    df = spark.createDataFrame(rows, "grp long, id long, v double")
    order = {}
    for k in range(3):
        for place, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))):
            order[i] = place + 1
    assert {r.id: r.place for r in ranks.ranked_in_groups(df, "grp", F.col("v"), "id").collect()} == order
    few = ranks.ranked_in_groups(df, "grp", F.col("v"), "id", most=700)
    assert {r.id: r.place for r in few.collect()} == {i: p for i, p in order.items() if p <= 700}
    rest = ranks.ranked_in_groups(df, "grp", F.col("v"), "id", most=70, keep_rest=True)
    assert {r.id: r.place for r in rest.collect()} == {i: p if p <= 70 else None for i, p in order.items()}


def test_ingest_replays_and_drops_late_copies(spark, tmp_path):
    """Three runs over a growing folder: a text comes in once, by its smallest id of the batch that brought it; a lost commit is made up for."""
    from ragloom.streaming.ingest import ingest

    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    text = lambda k: f"Text  number {k} of nine words and one more."

    def more(*rows):
        spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema("doc_id long, text string").parquet(source), target, marks).awaitTermination()
        return {(r.doc_id, r.text) for r in spark.read.parquet(target).collect()}

    clean = lambda k: text(k).replace("  ", " ")
    assert more((5, text(1)), (4, text(1).upper()), (6, text(2)), (7, "short")) == {(4, clean(1).upper()), (6, clean(2))}
    assert more((1, text(1)), (8, text(3))) == {(4, clean(1).upper()), (6, clean(2)), (8, clean(3))}
    # The last batch's commit is lost: it runs again from the state before it.
    commits = sorted((tmp_path / "marks" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert more((2, text(3)), (9, text(4))) == {(4, clean(1).upper()), (6, clean(2)), (8, clean(3)), (9, clean(4))}
    assert spark.read.parquet(target).count() == 4


def test_k_means_moves_to_the_means(spark):
    v = [[0.0, 0.0], [10.0, 0.0], [0.0, 1.0], [10.0, 1.0], [0.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    got = {(r.id, r.pos): (r.group, r.offset, r.group_max) for r in O.k_means(df, 2).collect()}
    assert got[0, 1] == (0, -1.0, 2.0) and got[3, 1] == (1, 0.5, 1.0) and len(got) == 10
    assert O.k_means(df.limit(0), 2).count() == 0


def test_block_products_agree_with_numpy(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 7)
    g = np.random.default_rng(2)
    v = g.standard_normal((40, 5))
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "id long, v array<double>")
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -np.inf)
    for r in O.top_k(df, df, 4, "id", "v", "id", "v", exclude_self=True).collect():
        assert np.argsort(-s[r.q], kind="stable")[r["rank"] - 1] == r.d


def grouped_vectors(spark, n=6000, width=12, groups=30, seed=4):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((groups, width))
    v = centres[np.arange(n) % groups] / np.linalg.norm(centres[np.arange(n) % groups], axis=1, keepdims=True) + 0.03 * g.standard_normal((n, width))
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


def test_top_k_skips_blocks_of_grouped_vectors(spark):
    """The same rows as from all products, of which few are worked out."""
    v, df = grouped_vectors(spark)
    q = df.where("id % 20 = 0")
    s = np.round(v[::20] @ v.T, 9)
    got = {(r.q, r["rank"]): (r.d, r.sim) for r in O.top_k(q, df, 5, "id", "v", "id", "v", exclude_self=True).collect()}
    for i in range(300):
        s[i, 20 * i] = -np.inf
        best = np.argsort(-s[i], kind="stable")[:5]
        assert [got[20 * i, k + 1] for k in range(5)] == [(d, s[i, d]) for d in best]
    looked = O.top_k(q, df, 5, "id", "v", "id", "v", exclude_self=True, report=True).groupBy().sum("evaluated").first()[0] or 0
    assert looked < 0.15 * s.size


def test_top_k_of_equal_vectors_of_short_tables_and_of_none(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(3000)], "id long, v array<double>")
    got = O.top_k(rows.where("id < 2"), rows, 4, "id", "v", "id", "v", exclude_self=True).orderBy("q", "rank").collect()
    assert [(r.q, r.d) for r in got] == [(0, 3), (0, 6), (0, 9), (0, 12), (1, 2), (1, 4), (1, 5), (1, 7)]
    few = O.top_k(rows.where("id < 2"), rows.where("id < 3"), 4, "id", "v", "id", "v", exclude_self=True)
    assert few.groupBy("q").count().collect() == [(0, 2), (1, 2)] or {tuple(r) for r in few.groupBy("q").count().collect()} == {(0, 2), (1, 2)}
    assert O.top_k(rows, rows.limit(0), 4, "id", "v", "id", "v").count() == 0 and O.top_k(rows.limit(0), rows, 4, "id", "v", "id", "v").count() == 0


@pytest.mark.parametrize("n", [600, 6000])
def test_similar_pairs_is_exact_and_looks_at_few(spark, n):
    v, df = grouped_vectors(spark, n, seed=8)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s, 1) > 0.995), strict=True)}
    got = {(r.i, r.j): r.sim for r in O.similar_pairs(df, 0.995).collect()}
    assert got.keys() == want and all(abs(x - s[k]) < 2e-9 for k, x in got.items())
    looked = O.similar_pairs(df, 0.995, report=True).groupBy().sum("pairs", "candidates").first()
    assert looked[1] < 0.1 * n * n / 2 + 2 * len(want)


def test_leading_coordinates_leave_few_candidates_of_scattered_vectors():
    g = np.random.default_rng(6)
    v = g.standard_normal((400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[5]
    i, j, sim, looked = O._pairs_above(v[:200], v, 0.85, np.eye(64))
    assert {(a, b) for a, b in zip(i, j, strict=True) if a < b} == {(5, 7)} and looked < 0.0625 * 200 * 400


def test_terms_are_found_in_one_walk(spark):
    from ragloom.functions.automaton import PIECE, terms_held
    from ragloom.operators.corpus import ATTRIBUTES

    terms = [x for own in ATTRIBUTES.values() for x in own] + ["a.b", "(x", "oak|pine", "é", "aab", "aaab"]
    texts = ["wooden oaken scarred redblue", "woo", "mid-century mid-centur", "a.b axb (x", "oak|pine", "", None, "singlequeen" * 3, "greygrayoversized full-size ART DECO".lower(), "café", "aaaab", "x" * (PIECE - 3) + "mid-century" + "y" * 3 * PIECE + "wooden"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", terms_held(F.col("t"), terms).alias("found")).collect():
        t = texts[r.k]
        assert (r.found is None and t is None) or sorted(r.found) == sorted({x for x in terms if x in t})


def test_numbered_and_even_split(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"))
    assert [r.row for r in S.numbered(df, "k").orderBy("k").collect()] == list(range(1000))
    sizes = [r["count"] for r in S.even_split(df, "k", 7).groupBy("slice").count().orderBy("slice").collect()]
    assert sizes == [round((i + 1) * 1000 / 7) - round(i * 1000 / 7) for i in range(7)]


def test_rest_works_without_training_operators(tmp_path):
    """Nothing outside the subpackage imports it: without its folders and the pipeline, all other queries are there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "ragloom", tmp_path / "ragloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path)
    look = "import __spark_entry__ as e, bench; from ragloom.plans import QUERIES, SQL; assert e.queries().keys() == QUERIES.keys() and e.oracle_sql().keys() == SQL.keys()"
    subprocess.run([sys.executable, "-c", look], cwd=tmp_path, check=True, timeout=120)


def test_set_scores_all_pairs(spark):
    """Every shape meets every caption, as the column expressions over the full cross join have it, and as the batches of eight have theirs."""
    from ragloom.operators import setmatch as S
    from ragloom.plans import QUERIES
    from ragloom.plans.fixtures import sets
    from ragloom.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    parts, words = (d.where(d[k] < 12).cache() for d, k in zip(sets(Tables(spark, folder)), ("shape", "caption")))
    got = {(r.shape, r.caption): r for r in S.all_pair_scores(parts, words, tile=5).collect()}
    assert len(got) == 144
    pairs = S.part_words(parts, words, 1 << 40).cache()
    want = {
        "t2i": S.set_scores(S.cross_attention(pairs, True)),
        "i2t": S.set_scores(S.cross_attention(pairs, False)),
        "transport": S.relaxed_transport(pairs).withColumnRenamed("cost", "score"),
        **{k: pairs.groupBy("shape", "caption").agg(S.aggregate(k, pairs.x).alias("score")) for k in ("LogSumExp", "Max", "Sum", "Mean")},
    }
    for name, df in want.items():
        rows = df.collect()
        assert len(rows) == 144 and all(abs(got[r.shape, r.caption][name] - r.score) < 1e-9 for r in rows), name
    shapes, captions = (d.select(k).distinct().count() for d, k in zip(sets(Tables(spark, folder)), ("shape", "caption")))
    assert QUERIES["set_scores_all"](spark, folder).count() == shapes * captions


def test_tiles_of_sets_pass_once_by_each_group(spark):
    """What is shuffled does not grow with the pairs of tiles: smaller tiles, of which there are more, make no more copies."""
    from ragloom.operators import pivots
    from ragloom.operators import setmatch as S

    parts, words = (spark.range(400).select(F.col("id").alias(k), F.array(F.rand(1), F.rand(2)).alias(v)) for k, v in (("shape", "pv"), ("caption", "wv")))
    met = []
    real = S.together
    try:
        S.together = lambda *frames: met.append(real(*frames)) or met[-1]
        assert S.all_pair_scores(parts, words, tile=2).count() == 400 * 400
    finally:
        S.together = real
    assert met[0].count() <= 200 + 200 * pivots.GROUPS


def test_hash_search_compares_few_and_finds_most(spark, monkeypatch):
    """Each pair once, nine of ten at least of those near, with large buckets in parts; unlike vectors seldom share a key."""
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(size=(600, 32)), np.repeat(g.normal(size=(1, 32)), 60, axis=0)])
    x[300:600] = x[:300] + 0.25 * x[300:600]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = {(i, j) for i, j in zip(*np.nonzero(np.linalg.norm(x[:, None] - x, axis=2) < 0.5), strict=True) if i < j}
    monkeypatch.setattr(O, "BUCKET", 16)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = [(r.i, r.j) for r in O.nearest_by_hash(d, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) <= near and len(got) >= 0.9 * len(near)
    assert {(i, j) for i, j in near if i >= 600} <= set(got)
    turns, tables = O._turns_and_tables(100_000, 64, 0.5)
    y = g.normal(size=(2, 20_000, 64))
    same = [np.all([O._largest(y[0] @ t) == O._largest(y[1] @ t) for t in turns[k * len(turns) // tables : (k + 1) * len(turns) // tables]], axis=0) for k in range(tables)]
    assert np.sum(same) / y.shape[1] < 0.02


def test_word_jaccard_all_pairs(spark):
    """Every pair that shares a word is found, whatever the ids' remainders; the others are 0."""
    from ragloom.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    bags = [{r[0]: set((r[1] or "").lower().split()) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()} for name, key in (("benchmark", "item_id"), ("documents", "doc_id"))]
    want = {(q, d): round(len(a & b) / len(a | b), 6) for q, a in bags[0].items() for d, b in bags[1].items() if a & b}
    got = {(r.q, r.d): r.jaccard for r in QUERIES["word_jaccard_all"](spark, folder).collect()}
    assert any(q % 20 != d % 20 for q, d in want)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_vocabulary_of_all_documents(spark):
    """Words and labels of odd documents are numbered too; 0 is left for words outside the vocabulary given."""
    from ragloom.operators.vocabulary import decode, encode, vocabulary
    from ragloom.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    bags = [{w for r in docs if r.doc_id % 2 in rest for w in (r.text or "").lower().split()} for rest in ((0,), (0, 1))]
    got = {r.word for r in QUERIES["vocab_build_all"](spark, folder).collect()}
    assert got == bags[1] > bags[0]
    assert QUERIES["join_left_default_all"](spark, folder).where("idx = 0").count() == 0
    assert QUERIES["src_class_index_all"](spark, folder).count() == sum(r.source is not None for r in docs)

    known = vocabulary(spark.createDataFrame([("b A",), ("c",)], "text string"))
    rows = encode(spark.createDataFrame([(1, "c x a"), (2, "y")], "id long, text string"), "id", "text", known)
    assert {r.id: r.ids for r in rows.collect()} == {1: [3, 0, 1], 2: [0]}
    assert {r.id: r.text for r in decode(rows, "id", known).collect()} == {1: "c a"}


def test_words_are_looked_up_once_for_a_chunk(spark, monkeypatch):
    """Several chunks and batches, nulls, unknown words; no row for each place of a word is shuffled."""
    from ragloom.operators import vocabulary as V

    monkeypatch.setattr(V, "CHUNK", 500)
    monkeypatch.setattr(V, "ROWS", 20)
    monkeypatch.setattr(V, "text_batches", lambda s, rows: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    g = np.random.default_rng(7)
    texts = {i: " ".join(g.choice(["a", "B", "c", "\u00e9", "x"], 50)) for i in range(200)} | {200: "", 201: None, 202: "x", 203: " \t"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    known = V.vocabulary(spark.createDataFrame([("a b c \u00e9",)], "text string"))
    order = ["a", "b", "c", "\u00e9"]
    ids = {i: [order.index(w) + 1 if w in order else 0 for w in (t or "").lower().split()] for i, t in texts.items()}
    up = lambda x: F.when(x > 0, x + 1).otherwise(0)
    try:
        coded, terms = V._coded(df.select("id", V.tokens(F.lower("text")).alias("items")), "id")
        chunks = coded.select("chunk").distinct().count()
        assert coded.count() == len(texts) and chunks > 5 and terms.count() <= 5 * chunks
        encoded = V.encode(df, "id", "text", known)
        assert {r.id: r.ids for r in encoded.collect()} == ids
        want = {i: " ".join(order[k] for k in v if 0 < k < 4) for i, v in ids.items() if any(0 < k < 4 for k in v)}
        recoded = V.recode(df, "id", "text", known, up)
        assert {r.id: r.text for r in recoded.collect()} == want
        again = V.decode(encoded.withColumn("ids", F.transform("ids", up)), "id", known)
        assert {r.id: r.text for r in again.collect()} == want
        missing = spark.createDataFrame([(1, [2, None, 1]), (2, None), (3, [9]), (4, [])], "id long, ids array<long>")
        assert {r.id: r.text for r in V.decode(missing, "id", known).collect()} == {1: "b a"}
        assert "explode" not in recoded._jdf.queryExecution().toString() + encoded._jdf.queryExecution().toString()
        assert V.encode(df.limit(0), "id", "text", known).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_whole_graphs(spark, tmp_path):
    """Graphs of all edges with ids as they are: paths longer than twelve, against a breadth-first search."""
    from ragloom.plans import QUERIES

    # Supplier 1 has a chain of 20 edges, a cycle apart from it and a loop; supplier 2 a single edge with large ids.
    edges = [(1, k, k + 1) for k in range(100, 120)] + [(1, 7, 8), (1, 8, 9), (1, 9, 7), (1, 50, 50), (2, 10**6, 2 * 10**6)]
    rows = [(g, a, b, 40.0) for g, a, b in edges]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want, members = {}, {}
    for g in (1, 2):
        near = {}
        for _, a, b in (e for e in edges if e[0] == g):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        members[g] = sorted(near)
        for a in near:
            dist, todo = {a: 0}, [a]
            for x in todo:
                for y in near[x] - dist.keys():
                    dist[y] = dist[x] + 1
                    todo.append(y)
            want |= {(g, a, b): dist.get(b, 510) for b in near}
    rows = QUERIES["graph_hops_all"](spark, str(tmp_path)).collect()
    assert all(members[r.graph_id][r.pos] == r.node for r in rows) and len(rows) == sum(map(len, members.values()))
    got = {(r.graph_id, r.node, b): h for r in rows for b, h in zip(members[r.graph_id], r.hops, strict=True)}
    assert got == want and got[1, 100, 120] == 20

    top = len(members[1])
    padded = {(r.graph_id, r.pos): (r.value, r["mask"]) for r in QUERIES["graph_pad_mask_all"](spark, str(tmp_path)).collect()}
    assert padded == {(g, k): (m[k], 1) if k < len(m) else (0, 0) for g, m in members.items() for k in range(top)}


def test_hops_of_small_graphs_shuffle_edges_once(spark, monkeypatch):
    """Graphs of both sizes, with given nodes or the edges' ends, strings and nulls, against a breadth-first search; small ones join nothing."""
    g = np.random.default_rng(2)
    name = lambda v: None if v == 7 else f"n{v}"
    edges = [(k, name(a), name(b)) for k, n in ((1, 90), (2, 9)) for a, b in g.integers(0, n, (n, 2)).tolist()] + [(4, f"n{i}", f"n{i + 1}") for i in range(70)]
    edges += [(3, "n0", name(b)) for b in range(240)]
    e = spark.createDataFrame(edges, "graph_id long, src string, dst string")
    monkeypatch.setattr(G, "SMALL", 200)
    given = sorted({(k, x) for k, a, b in edges for x in (a, b) if x != "n3"} | {(2, "alone")}, key=str)
    for nodes in (sorted({(k, x) for k, a, b in edges for x in (a, b)}, key=str), given):
        near, members, want = {}, {}, {}
        for k, a, b in edges:
            if a is not None and b is not None:
                near.setdefault((k, a), set()).add(b)
                near.setdefault((k, b), set()).add(a)
        for k, x in nodes:
            members.setdefault(k, []).append(x)
        for k, own in members.items():
            own.sort(key=lambda x: (x is None, x or ""))
            for a in own:
                dist, todo = ({}, []) if a is None else ({a: 0}, [a])
                for x in todo:
                    for y in near.get((k, x), set()) - dist.keys():
                        dist[y] = dist[x] + 1
                        todo.append(y)
                want |= {(k, a, b): dist.get(b, 510) for b in own}
        n = spark.createDataFrame(nodes, "graph_id long, node string") if nodes is given else None
        rows = G.hop_arrays(e, n).collect()
        assert len(rows) == len(nodes) and all(members[r.graph_id][r.pos] == r.node for r in rows)
        assert {(r.graph_id, r.node, b): h for r in rows for b, h in zip(members[r.graph_id], r.hops, strict=True)} == want
        pairs = G.hops(e, n).collect()
        assert len(pairs) == len(want) and {(r.graph_id, r.a, r.b): r.hops for r in pairs} == want
    monkeypatch.undo()
    plan = G.hops(e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan


def test_evidence_words_are_made_once(spark):
    """As by a search for each phrase, in a plan with one search, for the phrase of two words."""
    from ragloom.functions import text as X
    from ragloom.plans.corpus import EVIDENCE, _hits

    d = spark.createDataFrame([("The and, DE_x la_ art deco",), ("",), (None,), ("Art Deco. the",), ("__the the1 la der-die",)], "text string")
    one_by_one = sum((X.has_term(F.col("text"), F.lit(x)).cast("int") for x in EVIDENCE), F.lit(0))
    assert [r[0] for r in d.select(_hits("text")).collect()] == [r[0] for r in d.select(one_by_one).collect()]
    assert d.select(_hits("text"))._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 1


def test_html_unescape_takes_small_batches(spark):
    from ragloom.plans import QUERIES

    QUERIES["html_unescape"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 32 << 20


def test_upper_as_in_duckdb(spark):
    import duckdb

    from ragloom.plans.corpus import upper

    words = ["erßie", "ﬁx", "ŉa", "été", "", "Ab1"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(upper(F.col("w"))).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [w]).fetchone()[0] for w in words]


def test_html_unescape_as_in_duckdb(spark, tmp_path):
    import duckdb

    from ragloom.plans import QUERIES, SQL

    pages = ["a &quot</title> &amp;lt;B&amp;gt;", "&nbsp;x &lt &copy=1 &amp;amp;lt; &ampquot;", "\u00a0\u3000 \u0130\u03a3 \u0391\u03a3", "\n a\t", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["html_unescape"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(duck.execute(SQL["html_unescape"]).fetchall())


def test_asked_pairs_leave_their_task_as_results(spark):
    """No pair is joined or sorted, and halves at the seventh place go where DuckDB takes them."""
    import duckdb

    from ragloom.plans import QUERIES

    for name in ("raw_norms_asked", "part_word_cost_asked"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
    x = [-0.0649515, 0.2573175, 0.1292225, 0.5, -1e-9, 0.0000005, 2.5e9, float("inf")]
    assert S_.six_places(np.array(x)).tolist() == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in x]


def test_recall_counts_what_the_hashes_find(spark):
    """From keys alone, without meeting in buckets: the same as from all pairs found."""
    g = np.random.default_rng(4)
    v = np.repeat(g.standard_normal((300, 16)), 3, axis=0) + 0.11 * g.standard_normal((900, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    s = np.round(v @ v.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s, 1) >= 0.875), strict=True) if i % 10 == 0 or j % 10 == 0}
    found = {(r.i, r.j) for r in O.nearest_by_hash(df, 0.5).collect()}
    got = O.hash_recall(df, 0.5, every=10)
    assert tuple(got.first()) == (len(want), len(want & found)) and 0 < len(want & found)
    assert "posexplode" not in got._jdf.queryExecution().logical().toString()


def test_blocks_pass_without_what_no_kernel_reads(spark):
    """And products of half the precision leave every pair in that whole ones find."""
    from ragloom.operators import pivots

    real, met = pivots.together, []
    _, df = grouped_vectors(spark, 3000, seed=9)
    try:
        pivots.together = lambda *frames: met.append(frames[1].columns) or real(*frames)
        O.top_k(df, df, 2, "id", "v", "id", "v", exclude_self=True)
    finally:
        pivots.together = real
    assert met and all("table" not in columns for columns in met)
    g = np.random.default_rng(6)
    a = g.standard_normal((64, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = 0.92 * a + np.sqrt(1 - 0.92**2) * np.linalg.qr(np.column_stack([a[0], g.standard_normal(64)]))[0][:, 1]
    s = np.round(np.einsum("ij,kj->ik", a, b), 9)
    i, j, _, _ = O._pairs_above(a, b, 0.92, np.eye(64))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(s >= 0.92)), strict=True))
