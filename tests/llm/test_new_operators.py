"""Pivot-table top-k, source divergence and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from ragloom.llm import conversations as C
from ragloom.llm import divergence as V
from ragloom.llm import topk as T
from tests.llm.conftest import SF

# Top-k by pivots


def plain_top_k(rows, k=10, every=100):
    fine = {(i, tuple(np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int).tolist())) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.array([*v, *[0] * (width - len(v))], dtype=object)) for i, v in fine]
    out = []
    for q, v in fine:
        if q % every == 0:
            best = sorted((-int((v * w).sum()), i) for i, w in fine if i != q or list(w) != list(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, rank int, score int")


def test_top_k_equals_plain(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert found(T.pivot_top_k(table)) == plain_top_k([(r.vec_id, r.embedding) for r in table.collect()])


def test_top_k_odd_rows(spark):
    """Nulls, non-finite components, ties, a frequent vector, short, empty, repeated and long vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(i, [0.5, 0.25, 0.0, 0.125]) for i in range(300, 500)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan"), 1.0, 0.0, 0.0]), (800, [float("inf"), 1.0, 0.0, 0.0]), (900, []), (1000, [1.0, 2.0]), (1000, [2.0, 2.0, 1.0, 0.0]), (100, rows[100][1]), (1100, [1e6, -1e6, 3e5, 0.1]), (1101, [9e5, -1e6, 3e5, 0.1]), (1200, [1e30, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    fine = [(i, v) for i, v in rows if i != 1200]
    assert found(T.pivot_top_k(embeddings(spark, [(i, v, "k", 1, 2) for i, v in rows]))) == plain_top_k(fine)


def test_top_k_of_few_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert found(T.pivot_top_k(embeddings(spark, [(*r, "k", 1, 2) for r in few]))) == plain_top_k(few)
    assert found(T.pivot_top_k(embeddings(spark, [(*r, "k", 1, 2) for r in few]).limit(0))) == []


def test_pivots_eliminate_on_groups_of_near_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 24] + 0.02 * rng.normal(size=16)).tolist(), "k", 1, 2) for i in range(4800)]
    table = embeddings(spark, rows)
    assert found(T.pivot_top_k(table)) == plain_top_k([r[:2] for r in rows])
    looked = T.pivot_top_k(table, report=True).groupBy().sum("evaluated").first()[0] or 0
    assert looked < 0.1 * 48 * 4800


def test_bound_order_stops_early_and_exactly():
    rng = np.random.default_rng(9)
    d = np.round(rng.normal(size=(600, 3)) * 1000).astype(np.int64)
    q = d[:40] + 1
    pivots = d[:8].astype(float)
    from ragloom.operators.pivots import Pair, distances

    table = distances(d, pivots)
    pair = Pair(q, distances(q, pivots), np.full(40, -np.inf), d, table, table.min(axis=0)[None], table.max(axis=0)[None], pivots)
    i, j, s, looked = T.in_bound_order(pair, 5)
    scores = q @ d.T
    assert (s == scores[i, j]).all() and looked < 40 * 600
    for r in range(40):
        assert sorted(s[i == r])[-5:] == sorted(scores[r])[-5:]


# Divergence of sources


def plain_divergence(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w.translate(lower) for w in term.findall(text)]
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {x[1] for x in rows}:
        kept = [w for w, n in docs[lang].items() if n >= 3]
        sources = sorted({s for _, x, s in rows if x == lang}, key=lambda s: s.encode())
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(x, sum(f(p[s][w], p[x][w]) for w in kept)) for x in sources if x != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if counts[lang, s][w] > 0 and p[s][w] > q[w]]
            for part, own in (("pair", pairs), ("term", terms)):
                own = sorted(own, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(own) if part == "pair" or r < 200]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_divergence_equals_plain(spark, docs):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert audited(V.source_divergence(docs)) == plain_divergence(rows)


@pytest.mark.parametrize("segment, groups", [(4, 2), (4096, 128)])
def test_divergence_in_small_segments_and_blocks(spark, segment, groups):
    """Nulls, a group without terms, a language without kept ones, a language of one source, ties; whatever the blocks."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "ÄRGER", "ärger", "x1y", "straße", "東京", "a_b", "it's"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("one two three", "fr", "f1"), ("four", "fr", "f2"), ("same same same", "it", "only")] + [("same words here", "it", "only")] * 4
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "text string, lang string, source string, n int, term string, rank int")
    assert audited(V.source_divergence(df, segment=segment, block=groups)) == plain_divergence(rows)


def test_divergence_of_nothing(nothing):
    from pyspark.sql import functions as F

    assert V.source_divergence(nothing.withColumn("lang", F.lit("en"))).collect() == []


def test_equal_subtrees_are_one_node_and_priced_once():
    counts = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0]])
    forest = V.Forest(counts)
    assert [len(left) for left, _ in forest.children] == [2, 3, 2]
    pair, a, b, times = forest.walk(np.array([0]), np.array([1]))
    got = {(int(forest.counts[x]), int(forest.counts[y])): int(n) for x, y, n in zip(a, b, times)}
    assert got == Counter(zip(counts[0].tolist(), counts[1].tolist())) and (pair == 0).all()


def test_large_counts_are_exact():
    """Beyond 64 bits the same numbers come from Python's."""
    big = np.array([20_000_000_000, 3], dtype=object)
    assert V._share(big, 50_000_000_000).tolist() == [1 + 10**9 * 20_000_000_001 // 50_000_000_000, 1 + 10**9 * 4 // 50_000_000_000]


# Repair of conversations

SPACES = " \t\n\v\f\r"


def plain_repair(rows):
    """Every edit tried, cheapest and then least first, by recursion."""
    n = len(rows)
    onward = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = lambda s, r: {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((r[:1], s))

    @lru_cache(None)
    def best(k, s, inserted):
        options = [(0, "")] if k == n and s in (0, 3) else []
        if inserted < 2:
            c, a = best(k, onward[s], inserted + 1)
            options.append((c + 2, "I" + a))
        if k < n:
            role, gone, cut = rows[k]
            c, a = best(k + 1, s, 0)
            options.append((c + 3, "D" + a))
            if not gone:
                to = kept(s, role)
                if to is not None:
                    c, a = best(k + 1, to, 0)
                    options.append((c + cut, "K" + a))
                c, a = best(k + 1, onward[s], 0)
                options.append((c + 2 + cut, "R" + a))
        return min(options) if options else (10**9, "")

    return best(0, 0, 0)


def plain_conversations(table):
    out = []
    every = defaultdict(list)
    for conv, turn, role, text in table:
        own = every[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, own in every.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        count = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = plain_repair(tuple((r, f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, faults)))
        state, k, lines = 0, 0, []
        for x in audit:
            if x == "I":
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                lines.append({2: "user:", 3: "assistant:"}[state])
                continue
            _, role, text = own[k]
            k += 1
            if x == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                lines.append(f"{role}:{text}")
            elif x == "R":
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                lines.append({2: "user:", 3: "assistant:"}[state] + text)
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def repaired(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[c] for c in names) for r in C.repair_conversations(df).collect()), key=repr)


def test_repair_equals_plain(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert repaired(table) == plain_conversations([tuple(r) for r in table.collect()])


def odd_conversations(seed, n):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "usher", "ai"], ["Yes.", "No", "", None, " \t", "a. ", "ü?", "b.!\n", "long " * 2000 + "."]
    return [(rng.choice([None, *range(n)]), rng.choice([None, *range(7)]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts)) for _ in range(n * 6)]


@pytest.mark.parametrize("seed", range(3))
def test_repair_of_odd_conversations(spark, seed):
    """Nulls in every column, ties, repeated rows, unknown roles, empty and long texts, extra columns."""
    rows = odd_conversations(seed, 150)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, audit string, copy int, fact int")
    assert repaired(df) == plain_conversations(rows)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    gone = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "Hello.") for c, t in gone]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert repaired(df) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in gone], key=repr)
    assert repaired(df.limit(0)) == []


def test_repair_of_all_short_conversations():
    """Every conversation of up to four rows over roles and faults."""
    kinds = [0, 1, 2, 3, 2 | C.MUST_GO, 2 | C.IS_TRUNCATED, 3 | C.IS_TRUNCATED, 1 | C.IS_TRUNCATED]
    every = [np.array(f, np.uint8) for n in range(5) for f in itertools.product(kinds, repeat=n)]
    got = C.repair_many(every)
    for f, (cost, letters) in zip(every, got, strict=True):
        rows = tuple(("tsua"[x & 3], bool(x & C.MUST_GO), bool(x & C.IS_TRUNCATED)) for x in f.tolist())
        assert (cost, "".join(C.LETTERS[x] for x in letters)) == plain_repair(rows)


def test_a_long_conversation_is_repaired_in_spans(monkeypatch):
    rng = np.random.default_rng(7)
    for n in (9, 30, 64, 200):
        facts = rng.integers(0, 12, n).astype(np.uint8)
        facts[facts & 12 == 12] &= 7
        monkeypatch.setattr(C, "SPAN", 8)
        cost, letters = C.repair_many([facts])[0]
        rows = tuple(("tsua"[x & 3], bool(x & C.MUST_GO), bool(x & C.IS_TRUNCATED)) for x in facts.tolist())
        assert (cost, "".join(C.LETTERS[x] for x in letters)) == plain_repair(rows)
