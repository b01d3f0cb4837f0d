"""Quality rules, sharding, decontamination, BPE, toxicity and LM scores against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.llm.bpe import Encoder, Vocabulary, bpe, compile_lexicon, map_lexicon
from ragloom.llm.decontaminate import contained_items, decontaminate
from ragloom.llm.lm import lm_scores
from ragloom.llm.quality import cascade, default_rules, good, order_rules, quality
from ragloom.llm.sharding import assign_shards
from ragloom.llm.toxicity import ALPHA, BETA, L1, L2, SIZE, ftrl, toxicity, weights
from tests.llm.conftest import SF, split_words

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def measures(text):
    text = text or ""
    words = [w.decode() for w in split_words(text)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_measures(odd, docs):
    for df in (odd, docs):
        for r in quality(df, sample_rows=0).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_keeps_columns_and_rows(odd, nothing):
    assert quality(odd).count() == odd.count()
    assert set(odd.columns) <= set(quality(odd, sample_rows=0).columns)
    assert quality(nothing).count() == 0


def test_quality_with_clashing_names(odd):
    """A column named like a result gives way to it; the filter keeps every column as it was."""
    plain = {(r.doc_id, r.n_words, r.kept) for r in quality(odd.select("doc_id", "text"), sample_rows=0).collect()}
    clash = odd.selectExpr("doc_id", "text n_words", "'x' kept", "1 base_failed", "'y' `a.b`")
    assert {(r.doc_id, r.n_words, r.kept) for r in quality(clash, text="n_words", sample_rows=0).collect()} == plain
    left = good(clash, text="n_words", sample_rows=0).collect()
    assert {r.doc_id for r in left} == {i for i, _, kept in plain if kept} and all(r.kept == "x" and r["a.b"] == "y" for r in left)


def test_filter_equals_the_verdict(docs, nothing):
    assert {r.doc_id for r in good(docs).collect()} == {r.doc_id for r in quality(docs, sample_rows=0).where("kept").collect()}
    assert good(nothing).columns == nothing.columns and good(nothing).count() == 0


def test_rule_order_does_not_change_the_verdict(docs):
    rules = default_rules()
    assert {r.name for r in order_rules(docs, rules)} == {r.name for r in rules}
    kept = lambda rs: {r.doc_id for r in cascade(docs.withColumn("_quality_text", F.coalesce("text", F.lit(""))), rs).where("_quality_rejected is null").collect()}
    assert kept(rules) == kept(rules[::-1])


def test_sharding(odd, docs, nothing):
    assert assign_shards(nothing).count() == 0
    for df in (odd, docs):
        rows = assign_shards(df).collect()
        assert len(rows) == df.count()
        texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
        for r in rows:
            draws = [int(hashlib.md5(f"{r.doc_id}:{k}".encode()).hexdigest()[:13], 16) for k in range(25)]
            assert r.shard == draws.index(max(draws[:24])) and r.grown_shard == draws.index(max(draws))
            assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "key")
        for k in range(24):
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_sharding_weights(spark):
    keys = spark.range(20000).selectExpr("id doc_id", "'' text")
    n = Counter(r.shard for r in assign_shards(keys, shards=3, weights=[1, 2, 1]).collect())
    assert abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02


def shingle_set(text, n):
    w = split_words(text, lower=True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_contained(docs, items):
    out = Counter()
    sets = [(i, shingle_set(t, 5)) for i, t in items]
    for d, t in docs:
        own = shingle_set(t, 5)
        for i, q in sets:
            if q and 10 * len(q & own) >= 8 * len(q):
                out[d, i, len(q), len(q & own)] += 1
    return out


@pytest.mark.parametrize("limit", [10**9, 0])
def test_contained_items(spark, odd, docs, nothing, monkeypatch, limit):
    """Broadcast and join give the same pairs as brute force, for short, empty and repeated items too."""
    monkeypatch.setattr("ragloom.llm.decontaminate.BROADCAST_SHINGLES", limit)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = spark.createDataFrame([(100, "a b c d e f g h"), (101, None), (102, ""), (103, "WORD"), (104, "same line here same line here"), (105, "a b c d e f g h"), (105, "WORD"), (None, "word"), (None, None)], "item_id long, text string")
    for d, q in ((docs, bench), (odd, some), (odd, bench), (nothing, bench), (odd, some.limit(0))):
        got = Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contained_items(d, q).collect())
        assert got == brute_contained([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in q.collect()])
    assert {r.source for r in decontaminate(odd, some).collect()} == {"null text", "empty", "only space", "odd characters", "very long"}
    assert decontaminate(nothing, bench).count() == 0 and decontaminate(odd, some.limit(0)).count() == odd.count()
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and contained_items(clean, bench).count() == 0


#: Contractions, a special token, and characters that lower-casing, composing or white space treat in their own way.
PIECES = [*"aeinth \t\n", "'s", "'ll", "<|endoftext|>", "\u0130", "\u03a3", "\u00df", "\x1c", "\x85", "\u200b", "\u0301"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_equals_library(odd, docs, nothing, library):
    assert bpe(nothing, PATH).count() == 0
    for df in (odd, docs):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        want = Counter()
        for i, t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe(df, PATH, lexicon_size=50).collect()) == want


def test_bpe_keeps_ids_and_text(odd, library):
    for r in bpe(odd, PATH, keep_ids=True, keep_text=True).collect():
        assert library.decode(r.ids, skip_special_tokens=False) == r.decoded and r.n_tokens == len(r.ids)


def test_bpe_of_long_words(library, monkeypatch):
    """A heap for each long word gives what merging in step gives, and a word of a million letters what the library gives, within seconds."""
    import random
    import time

    from ragloom.llm import bpe as module

    v = Vocabulary(open(PATH, encoding="utf-8").read())
    rng = random.Random(2)
    words = ["".join(rng.choices(rng.choice(["etaoin", "ab", "thé ünd"]), k=rng.randint(1, 700))).replace(" ", "x") for _ in range(60)] + ["a" * 513, "ab" * 256]
    monkeypatch.setattr(module, "LONG", 1 << 30)
    in_step = v.merge_all(words)
    monkeypatch.setattr(module, "LONG", 0)
    assert v.merge_all(words) == in_step
    monkeypatch.undo()
    long = "".join(rng.choices("etaoinshrdlu", k=1_000_000))
    began = time.perf_counter()
    [(ids, decoded)] = Encoder(v, map_lexicon(compile_lexicon({b"the": v.merge_all(["the"])[0]}))).encode([f"the {long} tin"])
    assert time.perf_counter() - began < 60
    want = library.encode(f"the {long} tin", add_special_tokens=False).ids
    assert [int(x) for x in ids.split()] == want and decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.characters(exclude_categories=["Cn", "Co", "Cs"]), st.sampled_from(PIECES))).map("".join))
def test_bpe_any_text(library, text):
    v = test_bpe_any_text.__dict__.setdefault("v", Vocabulary(open(PATH, encoding="utf-8").read()))
    lexicon = compile_lexicon({w.encode(): v.merge_all([w])[0] for w in ("the", "tin", "in", "a")})
    [(ids, decoded)] = Encoder(v, map_lexicon(lexicon)).encode([text])
    want = library.encode(text, add_special_tokens=False).ids
    assert [int(x) for x in ids.split()] == want and decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.lists(st.integers(0, 99), max_size=3)), st.binary(max_size=5))
def test_transducer_is_a_map(entries, other):
    t = map_lexicon(compile_lexicon(entries))
    words = [*entries, other]
    for w, rank in zip(words, t.ranks(words), strict=True):
        assert (t.output(rank) if rank >= 0 else None) == entries.get(w)


def test_transducer_shares_suffixes():
    words = {a + b: [1] for a in (b"in", b"on", b"un") for b in (b"doing", b"going")}
    assert len(map_lexicon(compile_lexicon(words)).accepts) == 8


def test_toxicity_on_held_out_rows(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.95 and right > sum(truth[r.doc_id] == 0 for r in held)
    clean = [r.score for r in held if not truth[r.doc_id]]
    assert all(np.mean([r.score > c for c in clean]) > 0.5 for r in held if truth[r.doc_id])
    assert {r.score for r in toxicity(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity(nothing, labels).count() == 0
    assert toxicity(odd, odd.selectExpr("doc_id", "cast(null as int) toxic", "text")).count() == odd.count()


def test_ftrl_equals_a_plain_loop():
    """One pass over random rows against the published update, feature by feature."""
    g = np.random.default_rng(1)
    rows = [(np.append(np.unique(g.integers(0, 30, 6)), SIZE - 1), int(g.random() < 0.4)) for _ in range(300)]
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    ftrl(iter(rows), z, n)
    zs, ns = Counter(), Counter()

    def weight(i):
        l1 = L1 if i < SIZE - 1 else 0.0
        return 0.0 if abs(zs[i]) <= l1 else -(zs[i] - math.copysign(l1, zs[i])) / ((BETA + math.sqrt(ns[i])) / ALPHA + L2)

    for x, y in rows:
        own = {int(i): weight(int(i)) for i in x}
        gradient = 1 / (1 + math.exp(-sum(own.values()))) - y
        for i, w in own.items():
            sigma = (math.sqrt(ns[i] + gradient**2) - math.sqrt(ns[i])) / ALPHA
            zs[i] += gradient - sigma * w
            ns[i] += gradient**2
    assert np.allclose(weights(z, n)[sorted(zs)], [weight(i) for i in sorted(zs)])


def test_null_and_large_keys(spark):
    """Keys come back as they are: null, above 2**53, and repeated with other texts."""
    df = spark.createDataFrame([(2**60, "one two"), (2**60 + 1, "one two"), (None, "one two"), (5, "x"), (5, None), (5, "")], "doc_id long, text string")
    keys = Counter(r.doc_id for r in df.collect())
    labels = df.selectExpr("doc_id", "1 toxic")
    for out in (toxicity(df, labels), lm_scores(df), bpe(df, PATH), assign_shards(df)):
        assert Counter(r.doc_id for r in out.select("doc_id").collect()) == keys


def brute_base(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update([*split_words(t, lower=True), "end"])
    n, v, out = sum(c.values()), len(c), Counter()
    for i, t in rows:
        tokens = [*split_words(t, lower=True), "end"]
        out[i, held[i], len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    return out


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_lm_base_and_gain(odd, docs, nothing, monkeypatch, frequent):
    monkeypatch.setattr("ragloom.llm.lm.FREQUENT_WORDS", frequent)
    assert lm_scores(nothing).count() == 0
    for df in (odd, docs):
        got = lm_scores(df).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base([(r.doc_id, r.text) for r in df.collect()])
        assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    # Held-out texts cost less than their own byte frequencies would.
    held = {r.doc_id for r in got if r.held_out}
    seen = Counter(b for r in df.collect() if r.doc_id in held for b in (r.text or "").encode())
    n = sum(seen.values())
    entropy = -sum(c / n * math.log2(c / n) for c in seen.values())
    assert -sum(r.score for r in got if r.held_out) / math.log10(2) / n < 0.8 * entropy


def test_mixed_probabilities_sum_to_one(docs):
    import numpy as np

    from ragloom.llm.lm import code_bits, train_mixer

    m = train_mixer(docs.select("text"))
    context = int.from_bytes(b" the ", "little")
    codes = (np.arange(256, dtype=np.uint64) << np.uint64(40)) | np.uint64(context)
    assert abs((2.0 ** -code_bits(m, codes)).sum() - 1) < 1e-9


def test_lm_costs_equal_exact_counts(docs):
    """Node counts are those of the full (context, bit prefix), however many there are: none shares a slot with another."""
    import numpy as np

    from ragloom.llm.lm import SMOOTH, STEPS, code_bits, train_mixer

    texts = docs.where("doc_id % 2 = 0").select("text")
    m = train_mixer(texts)
    nodes = Counter()
    for (text,) in texts.collect():
        raw = bytes(5) + text.encode() + b"\0"
        for i in range(5, len(raw)):
            for k in range(6):
                for bit in range(8):
                    nodes[raw[i - k : i], bit, raw[i] >> 7 - bit] += 1
    asked = [raw[i - 5 : i + 1] for i in range(5, len(raw), 7)] + [bytes(x) for x in (b" the x", b"qzvkjq", b"\xff\xfe\xfd\xfc\xfb\xfa", b"zthe z")]
    want = []
    for g in asked:
        cost = 0.0
        for bit in range(8):
            prefix, y = g[5] >> 8 - bit, g[5] >> 7 - bit & 1
            n = [[nodes[g[5 - k : 5], bit, prefix << 1 | v] for v in (0, 1)] for k in range(6)]
            gate = (0 if sum(n[5]) else 1 if sum(n[3]) else 2) * 256 + (1 << bit | prefix)
            s = float(np.clip(sum(w * math.log((b + SMOOTH) / (a + SMOOTH)) for w, (a, b) in zip(m.weights[gate], n, strict=True)), -12, 12))
            p = 0.5 / (1 + math.exp(-s)) + 0.5 * m.refined[gate, int(np.rint((min(max(s, -8), 8) + 8) * (STEPS - 1) / 16))]
            cost -= math.log2(p if y else 1 - p)
        want.append(cost)
    got = code_bits(m, np.array([int.from_bytes(g, "little") for g in asked], dtype=np.uint64))
    assert np.abs(got - want).max() < 1e-9


def test_lm_scores_sum_the_costs_of_all_grams(docs, monkeypatch):
    """Every text gets the costs of its own 6-grams back, over many small chunks and ranges, held-out ones included."""
    import numpy as np

    from ragloom.llm.lm import code_bits, held_out, lm_scores, train_mixer

    monkeypatch.setattr("ragloom.llm.lm.ASK", 20_000)
    monkeypatch.setattr("ragloom.llm.lm.CHUNK", 5_000)
    m = train_mixer(docs.where(~held_out(docs.doc_id)).select("text"))
    got = {r.doc_id: -r.score / math.log10(2) for r in lm_scores(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in sorted(texts.items())[:12]:
        raw = bytes(5) + text.encode() + b"\0"
        codes = np.array([int.from_bytes(raw[k : k + 6], "little") for k in range(len(raw) - 5)], dtype=np.uint64)
        assert abs(code_bits(m, codes).sum() - got[i]) < 1e-6 * got[i]
