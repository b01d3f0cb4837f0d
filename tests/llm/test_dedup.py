"""Suffix-array, near-duplicate and substring deduplication, and the pipeline, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ragloom.llm import repeats
from ragloom.llm.arrays import Texts, equal_bytes, words
from ragloom.llm.components import components
from ragloom.llm.neardup import drop_near_duplicates, near_duplicates
from ragloom.llm.substrings import WORDS, FingerprintIndex, deduplicate_words, word_equal
from ragloom.llm.suffixes import BYTES, byte_classes, deduplicate_bytes
from ragloom.session import stash
from tests.llm.conftest import SF, split_words


def brute_bytes(rows):
    seen, out = {}, Counter()
    for i, t in sorted({(i, t or "") for i, t in rows}):
        raw = t.encode()
        for p in range(len(raw) - 99):
            seen.setdefault(raw[p : p + 100], (i, p))
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=np.int8)
        for p in range(len(raw) - 99):
            if seen[raw[p : p + 100]] < (i, p):
                gone[p : p + 100] = 1
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out[i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_words(rows):
    first, out = {}, Counter()
    texts = [(i, split_words(t)) for i, t in rows]
    for i, w in texts:
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    for i, w in texts:
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_components(rows, n, percent=80):
    sets = []
    for i, t in rows:
        w = split_words(t, lower=True)
        sets.append((i, {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i), find(i) == i) for i, s in sets)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def passages(spark):
    """Shared passages at many places of random text, so that one anchor meets many contexts; also periodic texts."""
    g = np.random.default_rng(5)
    word = lambda: "".join(g.choice(list("abcdefgh"), g.integers(1, 7)))
    shared = [" ".join(word() for _ in range(25)) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(g.integers(0, 30)))]
        for _ in range(g.integers(0, 3)):
            s = shared[g.integers(4)]
            lo, hi = sorted(g.integers(0, len(s), 2))
            parts += [s if g.random() < 0.5 else s[lo:hi], " ".join(word() for _ in range(g.integers(0, 10)))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "ab" * 300), (201, "x" + "ab" * 250), (202, "tick tock " * 40), (203, "tock tick " * 30), (204, "é" * 120), (205, "aé" * 90)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_bytes_against_brute_force(spark, docs, odd, nothing):
    assert deduplicate_bytes(nothing).count() == 0
    few = odd.where("source <> 'very long'")
    for df in (passages(spark), few, docs.where("doc_id < 60")):
        rows = pairs(df)
        assert Counter(tuple(r) for r in deduplicate_bytes(df).collect()) == brute_bytes(rows)
    assert deduplicate_bytes(odd).count() == odd.count()


@pytest.mark.parametrize("cap", [0, 2])
def test_bytes_with_hot_anchors(spark, monkeypatch, cap):
    """The way for anchors with many contexts gives the same."""
    monkeypatch.setattr(repeats, "CAP", cap)
    df = passages(spark)
    assert Counter(tuple(r) for r in deduplicate_bytes(df).collect()) == brute_bytes(pairs(df))


def test_kept_text_and_carried_columns(spark):
    df = passages(spark).selectExpr("doc_id", "text", "'x' lang")
    for r in deduplicate_bytes(df, keep_text=True, carry=["lang"]).collect():
        assert r.lang == "x" and (r.doc_id > 203 or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256)


def test_bucket_refinement_classes():
    g = np.random.default_rng(3)
    base = g.integers(0, 3, 600).astype(np.uint8)
    strings = [base[a : a + n] for a, n in zip(g.integers(0, 300, 40), g.integers(100, 180, 40), strict=True)]
    data, length = np.concatenate(strings), np.array([len(s) for s in strings])
    content = [s[p : p + 100].tobytes() for s in strings for p in range(len(s) - 99)]
    number = {}
    want = [number.setdefault(c, len(number)) for c in content]
    t = Texts(0, data, np.concatenate([[0], np.cumsum(length)]))
    first = np.concatenate([np.arange(a, b - 99) for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)])
    got = byte_classes(t, first).tolist()
    number = {}
    assert [number.setdefault(c, len(number)) for c in got] == want


def test_classes_that_mix_windows_are_told_apart():
    """Windows are compared themselves, so a class that holds different ones removes nothing wrong."""
    text = np.frombuffer((b"".join(b"%03d-" % k for k in range(30)) * 2)[:230], np.uint8)
    t = Texts(0, text, np.array([0, 115, 230]))
    same = BYTES._replace(classes=lambda t, first: np.zeros(len(first), np.int64))
    key, lo = np.array([1, 2]), np.array([0, 0])
    want = sorted(zip(*(x.tolist() for x in repeats.late_windows(t, key, lo, BYTES)), strict=True))
    assert sorted(zip(*(x.tolist() for x in repeats.late_windows(t, key, lo, same)), strict=True)) == want


def test_bytes_compared_in_eights():
    g = np.random.default_rng(5)
    data = g.integers(0, 2, 9000).astype(np.uint8)
    data[4500:] = data[:4500]
    data[[4600, 6000, 8999]] ^= 1
    a = g.integers(0, 4400, 2000)
    b = np.where(g.random(2000) < 0.7, a + 4500, g.integers(0, 4400, 2000))
    size = np.minimum(g.choice([0, 1, 3, 7, 8, 9, 16, 100, 4400], 2000), 9000 - np.maximum(a, b))
    want = [data[x : x + n].tobytes() == data[y : y + n].tobytes() for x, y, n in zip(a, b, size, strict=True)]
    assert equal_bytes(data, a, b, size).tolist() == want and 0 < sum(want) < 2000


@pytest.mark.parametrize("kind", [BYTES, WORDS])
def test_units_under_one_hash_are_told_apart(kind):
    """Units are compared on their texts, so a hash that never tells any apart gives the same repeats; white space is no difference of words."""
    parts = ["".join(f"{k}-{j:03d} " for j in range(60)) for k in "abc"]
    texts = [parts[0] + parts[1], parts[1] + parts[2], parts[2] + parts[0], parts[0].replace(" ", "\n ") + "end"]
    raw = [t.encode() for t in texts]
    t = Texts(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    s = kind.symbols(t)
    u = repeats.units(s, kind)
    at = s.offsets[u.row]
    ends = s.start[at + u.lo], s.end[at + u.hi + kind.window - 1]
    found = []
    for unit in (u.unit, np.zeros_like(u.unit)):
        live, late = repeats.settle(kind, t.data, u.anchor, unit, u.row, u.lo, u.hi, *ends)
        found.append(late.select(["key", "lo", "hi"]).to_pylist())
        keys = list(zip(live["anchor"].to_pylist(), live["unit"].to_pylist(), strict=True))
    assert found[0] == found[1] and len(found[0]) >= 3
    assert len(set(keys)) > len(set(u.anchor.tolist())) // 2
    assert any(r["key"] == 3 for r in found[0]) == kind.by_document


def test_words_are_compared_by_their_bytes(monkeypatch):
    """With a hash that holds nothing, and words of one length, only the bytes tell windows apart."""
    text = " ".join([f"{k:03d}" for k in range(40)] + [f"{k:03d}" for k in range(20)] + ["xyz"] + [f"{k:03d}" for k in range(21, 40)]).encode()
    t = Texts(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w = text.split()
    monkeypatch.setattr("ragloom.llm.substrings.words", lambda t: plain._replace(hash=np.zeros_like(plain.hash)))
    plain = words(t)
    a, b = np.arange(28), np.arange(28) + 40
    assert word_equal(t, a, b).tolist() == [w[i : i + 13] == w[j : j + 13] for i, j in zip(a, b, strict=True)]


def test_odd_keys(spark):
    """Keys above 2**53 beside a null key, and keys that repeat with other texts, nulls and nothing."""
    line = "".join(f"{k:05d} " for k in range(40))
    big = spark.createDataFrame([(2**60, line), (2**60 + 1, line), (None, line)], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in deduplicate_bytes(big).collect()}
    assert found == {2**60: 0, 2**60 + 1: len(line), None: 0}
    found = {r.doc_id: r.n_removed for r in deduplicate_words(big, batches=1, buckets=2).collect()}
    assert found == {2**60: 0, 2**60 + 1: 40, None: 0}
    twins = spark.createDataFrame([(1, line), (2, "short"), (2, "x " * 300 + line), (2, None), (2, ""), (3, line)], "doc_id long, text string")
    assert deduplicate_bytes(twins).count() == deduplicate_words(twins, buckets=2).count() == 6


@pytest.mark.parametrize("batches", [1, 3])
def test_words_against_brute_force(spark, odd, nothing, batches):
    assert deduplicate_words(nothing, batches=batches).count() == 0
    for df in (passages(spark), odd):
        assert Counter(tuple(r) for r in deduplicate_words(df, batches=batches, buckets=4).collect()) == brute_words(pairs(df))


def test_words_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CAP", 1)
    df = passages(spark)
    assert Counter(tuple(r) for r in deduplicate_words(df, buckets=4).collect()) == brute_words(pairs(df))


def test_index_compacts_runs(spark):
    rows = passages(spark).selectExpr("doc_id key", "text")
    index = FingerprintIndex(spark, 4)
    for lo in (0, 60):
        index.add(rows.where(f"key >= {lo} and key < {lo + 60}"), rows)
    assert len(index.runs) == 2
    index.compact()
    assert len(index.runs) == 1
    live = spark.table(index.runs[0])
    assert live.count() == live.select("anchor", "unit").distinct().count()
    index.drop()


@pytest.mark.parametrize("cap", [1024, 8])
def test_near_duplicates_against_brute_force(spark, docs, odd, nothing, monkeypatch, cap):
    """Small caps send regions and groups through the ways for large ones."""
    monkeypatch.setattr("ragloom.llm.neardup.CAP", cap)
    monkeypatch.setattr("ragloom.llm.neardup.BROADCAST_ROWS", 400_000 if cap > 8 else 0)
    assert near_duplicates(nothing).count() == 0
    g = np.random.default_rng(7)
    rows = []
    for family in range(6):
        base = [f"w{x}" for x in g.integers(0, 500, 80)]
        for k in range(20):
            w = list(base)
            for p in g.integers(0, 80, g.integers(0, 7)):
                w[p] = f"e{g.integers(1000)}"
            rows.append((1000 * family + k, " ".join(w).upper() if k % 5 == 0 else " ".join(w)))
    copies = spark.createDataFrame(rows, "doc_id long, text string")
    for df, n in ((copies, 4), (copies, 5), (odd.dropDuplicates(["doc_id"]), 4), (docs, 4)):
        assert Counter(tuple(r) for r in near_duplicates(df, n=n).collect()) == brute_components(pairs(df), n)


def test_near_duplicates_with_repeated_rows(odd):
    """Rows that repeat a key are one document, each with its row; without words nothing is linked."""
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(odd, n=4).collect())
    assert got[9, 9, True] == 2 and got[6, 1, False] == 1 and got.total() == odd.count()
    assert all(i == c and kept for i, c, kept in got if i != 6)


def test_stages_on_odd_tables(spark, odd):
    """Every stage takes nulls, empty texts, repeated rows, columns with names that operators use, and no rows at all."""
    extra = "cast(doc_id as string) key, 1 n_words, 'x' kept, 'y' component_id, 2 n, 'z' kept_text, array(1) ids"
    docs = odd.selectExpr("doc_id", "text", "'en' lang", "source", "cast(length(text) as long) n_chars", *extra.split(", "))
    docs = docs.union(docs.limit(1).selectExpr("cast(null as long)", "text", "lang", "'null id'", *docs.columns[4:]))
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        assert set(corpus_pipeline.COLUMNS) <= set(stage(spark, docs, SF).columns) or name == "bpe_encoding"
    kept = {name: Counter(r.source for r in stage(spark, docs, SF).select("source").collect()) for name, stage in corpus_pipeline.STAGES[1:4]}
    assert kept["near_dedup"]["copy of 1"] == 0 and kept["near_dedup"]["repeated row"] + kept["near_dedup"]["lines"] == 2 and kept["near_dedup"]["null id"] == 1
    assert kept["suffix_dedup"]["null text"] == kept["suffix_dedup"]["empty"] == 0 and kept["suffix_dedup"]["null id"] == 1
    assert kept["benchmark_decontamination"] == Counter(r.source for r in docs.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {k: 100 for k in range(101, 160)} | {201: 200}


def test_pipeline_stages(spark):
    """Each stage against what it promises, on its own input."""
    from ragloom.llm.decontaminate import contained_items
    from ragloom.llm.quality import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stash(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
    for name, (before, after) in list(kept.items())[:-1]:
        assert sorted(after.columns) == sorted(corpus_pipeline.COLUMNS), name
    before, after = kept["quality_rules"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality(before).where("kept").collect()}
    before, after = kept["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {k[0] for k in brute_components(pairs(before), 5) if k[3]}
    before, after = kept["suffix_dedup"]
    want = {k[0]: k[4] for k in brute_bytes(pairs(before))}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r.text for r in after.collect()}
    assert set(got) == {i for i, h in want.items() if h != empty}
    assert sum(hashlib.sha256(t.encode()).hexdigest() == want[i] for i, t in got.items()) > 0.9 * len(got)
    before, after = kept["benchmark_decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in contained_items(before, bench).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaks
    before, after = kept["bpe_encoding"]
    assert all(len(r.ids) == r.n_tokens for r in after.collect()) and after.count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == after.count()
