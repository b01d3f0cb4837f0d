"""Language-model scores: a unigram base, and logistic context mixing over bytes.

Context mixing predicts each bit of each byte from several contexts (the last 0
to 5 bytes) and the byte's bits so far.  Every (context, bit prefix) node holds
counts of zeros and ones; each context's prediction is stretched to the logistic
domain, and a weight vector, gated by the bit prefix and by how long a context
is known, mixes them.  An adaptive map then refines the mixed probability from
what really followed such predictions.

All of it is learned from all training texts: Spark counts their byte 6-grams,
which is all that the node counts depend on; tasks learn the mixing weights
online over the 6-grams, each prediction made without the occurrence that it
predicts, and weights are averaged by gate.

Counts are exact and grow with the texts.  The 6-grams are dealt out by their
last three context bytes, so that a task has every 6-gram of its longer contexts
and reads their nodes off sorted sums; contexts of up to two bytes come from the
byte 3-grams, of which there are 2**24 at most, and are broadcast.  Texts are
cut into chunks; a chunk's distinct 6-grams go to the tasks that hold their
contexts, and the costs come back to the chunk, whose texts sum them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.arrays import U, Texts, batch, chunks, group_cuts, lists, mix, per_row, sorted_distinct, tidy, whole_groups, words
from ragloom.llm.frequent import frequent
from ragloom.session import stash, text_batches, unstash

ORDER = 5
#: Contexts up to this length are broadcast, longer ones are dealt out by their last LOW + 1 bytes.
LOW = 2
#: Bit prefixes times three states: order 5 known, order 3 known, neither.
GATES = 256 * 3
STEPS = 33
SMOOTH = 0.4
CHUNK = 1 << 20
#: 6-grams whose node counts are held at a time, and that a range of contexts has on average.
PIECE = 1 << 14
RANGE = 100_000
#: Bytes of text whose distinct 6-grams are asked for together.
ASK = 6 << 20
#: Words whose counts every task holds; rarer ones are joined.
FREQUENT_WORDS = 1 << 18
_CONTEXT = [U((1 << 8 * k) - 1) for k in range(ORDER + 1)]
LOG10_2 = float(np.log10(2.0))


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """48-bit code of each symbol with the five before it, and row offsets; an end symbol 0 closes each text, zeros stand before it."""
    n, pad = t.rows, ORDER + 1
    flat = np.zeros(len(t.data) + pad * n + 8, dtype=np.uint8)
    lengths = np.diff(t.offsets)
    row = np.repeat(np.arange(n), lengths)
    flat[np.arange(len(t.data)) + row * pad + ORDER] = t.data
    wide = np.ndarray(len(flat) - 7, dtype="<u8", buffer=flat.data, strides=(1,))
    own = lengths + 1
    offsets = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(offsets[-1]) + np.repeat(np.arange(n), own) * ORDER
    return wide[at].astype(U) & U((1 << 48) - 1), offsets


def folded(codes: np.ndarray, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Codes with most repeats folded, and for each code its place among them, in linear time."""
    if not len(codes):
        return codes, np.zeros(0, np.int32)
    slot = (mix(codes) >> U(64 - bits)).view(np.int64)
    table = np.zeros(1 << bits, dtype=np.int64)
    table[slot] = np.arange(len(codes))
    rep = table[slot]
    rep = np.where(codes[rep] == codes, rep, np.arange(len(codes)))
    is_rep = np.zeros(len(codes), dtype=bool)
    is_rep[rep] = True
    return codes[is_rep], (np.cumsum(is_rep, dtype=np.int32) - np.int32(1))[rep]


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sum of n (or the count) of each."""
    if n is None:
        codes, place = folded(codes)
        n = np.bincount(place, minlength=len(codes))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    if not len(codes):
        return codes, n
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _counts(train: DataFrame, codes_of, name: str) -> DataFrame:
    """(code, n) over a text column; each task merges its own counts, flushing them when they are many."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for c in chunks(b.column(0), CHUNK):
                held.append(counted(codes_of(c)))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [counted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield batch(schema, held[0][0].view(np.int64), held[0][1])
                        held, size = [], 0
        if held:
            code, n = counted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            yield batch(schema, code.view(np.int64), n)

    return stash(train.mapInArrow(tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), name)


class Mixer(NamedTuple):
    counts: DataFrame | None
    ranges: int
    low: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    refined: np.ndarray


def _turned(codes: np.ndarray) -> np.ndarray:
    """Codes with the nearest byte of the context highest and the symbol lowest: all of a context lie together."""
    return (codes & _CONTEXT[ORDER]) << U(8) | codes >> U(40)


def _unturned(turned: np.ndarray) -> np.ndarray:
    return (turned & U(255)) << U(40) | turned >> U(8)


def _range(turned: np.ndarray, ranges: int) -> np.ndarray:
    """The range of contexts that a turned code belongs to, as _range_column has it."""
    return (((turned >> U(24)) * U(2654435761) >> U(16)) % U(ranges)).astype(np.int32)


def _range_column(ranges: int) -> Column:
    context = F.shiftrightunsigned("code", 16).bitwiseAND(F.lit(0xFFFFFF))
    return (F.shiftrightunsigned(context * F.lit(2654435761), 16) % F.lit(ranges)).cast("int")


def _keys(codes: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes of the context and the symbol."""
    return ((codes >> U(8 * (ORDER - k))) & _CONTEXT[k]) << U(8) | codes >> U(40)


def _table(codes: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (context, symbol) keys of one context length, and the sums of n before each and after the last."""
    keys, n = counted(_keys(codes, k), n)
    return keys, np.concatenate([[0], np.cumsum(n)])


def _tables(m: Mixer, codes: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return m.low + [_table(codes, n, k) for k in range(LOW + 1, ORDER + 1)]


def _node_counts(tables: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones (bits x contexts x codes) at each code's nodes: a node is a run of keys, halved by the next bit."""
    zeros, ones = np.empty((8, ORDER + 1, len(codes))), np.empty((8, ORDER + 1, len(codes)))
    symbol = codes >> U(40)
    for k, (keys, before) in enumerate(tables):
        at = _keys(codes, k) & ~U(255)
        lo, hi = before[np.searchsorted(keys, at)], before[np.searchsorted(keys, at + U(256))]
        for bit in range(8):
            half = U(128 >> bit)
            mid = before[np.searchsorted(keys, at + half)]
            zeros[bit, k], ones[bit, k] = mid - lo, hi - mid
            y = (symbol & half) > 0
            lo, hi, at = np.where(y, mid, lo), np.where(y, hi, mid), np.where(y, at + half, at)
    return zeros, ones


def _inputs(a: np.ndarray, b: np.ndarray, codes: np.ndarray, bit: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretched predictions (contexts x codes), gate and bit; ``own``: leave one occurrence of the bit out."""
    symbol = codes >> U(40)
    prefix = ((U(1) << U(bit)) | (symbol >> U(8 - bit))).view(np.int64)
    y = ((symbol >> U(7 - bit)) & U(1)).astype(np.float64)
    if own:
        a, b = np.maximum(a - (1 - y), 0), np.maximum(b - y, 0)
    seen = a + b
    state = np.where(seen[5] > 0, 0, np.where(seen[3] > 0, 1, 2))
    return np.log((b + SMOOTH) / (a + SMOOTH)), state * 256 + prefix, y


def _squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -20, 20)))


def _mixed(m: Mixer, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return np.clip((m.weights[gate] * x.T).sum(axis=1), -12, 12)


def _step(stretched: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(stretched, -8, 8) + 8) * (STEPS - 1) / 16).astype(np.int64)


def _costs(m: Mixer, tables: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray) -> np.ndarray:
    """Cost in bits of each code's symbol after its context, given the tables of its contexts."""
    total = np.zeros(len(codes))
    for lo in range(0, len(codes), PIECE):
        part = codes[lo : lo + PIECE]
        zeros, ones = _node_counts(tables, part)
        for bit in range(8):
            x, gate, y = _inputs(zeros[bit], ones[bit], part, bit, own=False)
            s = _mixed(m, x, gate)
            p = 0.5 * _squash(s) + 0.5 * m.refined[gate, _step(s)]
            total[lo : lo + PIECE] -= np.log2(np.where(y > 0, p, 1 - p))
    return total


def code_bits(m: Mixer, codes: np.ndarray) -> np.ndarray:
    """Cost in bits of a few codes, asked by the driver: the 6-grams of their ranges are brought here."""
    wanted = sorted_distinct(_range(_turned(codes), m.ranges)).tolist()
    have = m.counts.where(_range_column(m.ranges).isin(wanted)).toArrow()
    return _costs(m, _tables(m, have["code"].to_numpy().view(U), have["n"].to_numpy()), codes)


def _dealt(m: Mixer) -> DataFrame:
    """(range, code, n), with ranges whole in a task and one after the other."""
    return m.counts.select(_range_column(m.ranges).alias("range"), "code", "n").repartition(m.ranges, "range").sortWithinPartitions("range", F.xxhash64("code"))


def _broadcast(m: Mixer):
    return m.counts.sparkSession.sparkContext.broadcast(m._replace(counts=None))


def _learn_weights(start: Mixer, rate: float = 0.02) -> np.ndarray:
    """Gated weights: every task learns online over its 6-grams, then gates are averaged by how often they were used."""
    shared = _broadcast(start)
    schema = pa.schema([("gate", pa.int32()), ("used", pa.float64()), ("w", pa.list_(pa.float64()))])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m = m._replace(weights=m.weights.copy())
        used = np.zeros(GATES)
        for t in whole_groups(batches):
            all_codes, all_n = t.column(1).to_numpy().view(U), t.column(2).to_numpy()
            tables = _tables(m, all_codes, all_n)
            # Codes of a range come in no order of context, so that a task's steps see all kinds.
            for lo in range(0, len(all_codes), 4096):
                codes, n = all_codes[lo : lo + 4096], all_n[lo : lo + 4096].astype(np.float64)
                zeros, ones = _node_counts(tables, codes)
                for bit in range(8):
                    x, gate, y = _inputs(zeros[bit], ones[bit], codes, bit, own=True)
                    miss = (y - _squash(_mixed(m, x, gate))) * n
                    mass = np.bincount(gate, n, minlength=GATES)
                    for k in range(ORDER + 1):
                        m.weights[:, k] += rate * np.bincount(gate, miss * x[k], minlength=GATES) / np.maximum(mass, 1)
                    used += mass
        hit = np.flatnonzero(used)
        w = m.weights[hit]
        yield batch(schema, hit.astype(np.int32), used[hit], lists(w.reshape(-1), np.arange(len(hit) + 1) * (ORDER + 1), pa.float64()))

    out = start.weights.copy()
    rows = _dealt(start).mapInArrow(tidy(learn), "gate int, used double, w array<double>")
    means = [(F.sum(F.col("used") * F.col("w")[k]) / F.sum("used")).alias(f"w{k}") for k in range(ORDER + 1)]
    for r in rows.groupBy("gate").agg(*means).collect():
        out[r.gate] = [r[f"w{k}"] for k in range(ORDER + 1)]
    return out


def _learn_map(m: Mixer) -> np.ndarray:
    """What followed predictions of each gate and step, against a start at the identity."""
    shared = _broadcast(m)
    schema = pa.schema([("cell", pa.int32()), ("ones", pa.float64()), ("n", pa.float64())])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hits, total = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
        for t in whole_groups(batches):
            all_codes, all_n = t.column(1).to_numpy().view(U), t.column(2).to_numpy()
            tables = _tables(m, all_codes, all_n)
            for lo in range(0, len(all_codes), PIECE):
                codes, n = all_codes[lo : lo + PIECE], all_n[lo : lo + PIECE].astype(np.float64)
                zeros, ones = _node_counts(tables, codes)
                for bit in range(8):
                    x, gate, y = _inputs(zeros[bit], ones[bit], codes, bit, own=True)
                    cell = gate * STEPS + _step(_mixed(m, x, gate))
                    hits += np.bincount(cell, n * y, minlength=len(hits))
                    total += np.bincount(cell, n, minlength=len(hits))
        hit = np.flatnonzero(total)
        yield batch(schema, hit.astype(np.int32), hits[hit], total[hit])

    ones, total = m.refined.reshape(-1) * 20, np.full(GATES * STEPS, 20.0)
    for r in _dealt(m).mapInArrow(tidy(follow), "cell int, ones double, n double").groupBy("cell").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect():
        ones[r.cell] += r.ones
        total[r.cell] += r.n
    return np.clip(ones / total, 1e-5, 1 - 1e-5).reshape(GATES, STEPS)


def train_mixer(texts: DataFrame) -> Mixer:
    """Context mixing learned from all rows of a one-column frame of texts."""
    spark = texts.sparkSession
    counts = _counts(texts, lambda c: grams(c)[0], "byte-grams")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // RANGE)
    short = counts.groupBy(F.shiftrightunsigned("code", 8 * (ORDER - LOW)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    code, n = short["code"].to_numpy().view(U) << U(8 * (ORDER - LOW)), short["n"].to_numpy()
    identity = np.tile(_squash(np.arange(STEPS) * 16 / (STEPS - 1) - 8), (GATES, 1))
    m = Mixer(counts, ranges, [_table(code, n, k) for k in range(LOW + 1)], np.full((GATES, ORDER + 1), 0.3), identity)
    m = m._replace(weights=_learn_weights(m))
    return m._replace(refined=_learn_map(m))


def _distinct(codes: list[np.ndarray], ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct turned codes, their ranges, and the order that puts ranges together."""
    turned = sorted_distinct(_turned(np.concatenate(codes))) if codes else np.zeros(0, U)
    own = _range(turned, ranges)
    return turned, own, np.argsort(own, kind="stable")


def _asked(rows: DataFrame, ranges: int) -> DataFrame:
    """(chunk, range, n, data): each chunk's texts (range -1), and its distinct 6-grams by range, sorted, as differences."""
    schema = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def chunk(held: list[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in held:
                w.write_batch(b)
        yield batch(schema, [at], [-1], [len(held)], [sink.getvalue().to_pybytes()])
        turned, own, order = _distinct([folded(grams(c)[0])[0] for b in held for c in chunks(b.column(1), CHUNK)], ranges)
        turned, own = turned[order], own[order]
        cuts, zstd = group_cuts(own), pa.Codec("zstd")
        data = [zstd.compress(np.diff(turned[lo:hi], prepend=U(0)).tobytes(), asbytes=True) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        yield batch(schema, np.full(len(data), at), own[cuts[:-1]], np.diff(cuts), data)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for c in chunks(b.column(1), CHUNK):
                held.append(b.slice(c.first, c.rows))
                size += len(c.data)
                if size >= ASK:
                    yield from chunk(held, at)
                    at, held, size = at + 1, [], 0
        if held:
            yield from chunk(held, at)

    return stash(rows.mapInArrow(tidy(ask), "chunk long, range int, n long, data binary"), "lm-asked")


def _answered(m: Mixer, asked: DataFrame) -> DataFrame:
    """(chunk, range, n, data): the costs of what was asked, in the same order."""
    shared = _broadcast(m)
    schema = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, zstd = shared.value, pa.Codec("zstd")
        current, held, tables = None, [], None
        for b in batches:
            own, chunk, code, n = b.column(0).to_numpy(), b.column(1), b.column(2), b.column(3).to_numpy()
            model = chunk.is_null().to_numpy(zero_copy_only=False)
            cuts = group_cuts(own * 2 + ~model)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if own[lo] != current:
                    current, held, tables = own[lo], [], None
                if model[lo]:
                    held.append((code.slice(lo, hi - lo).to_numpy().view(U), n[lo:hi]))
                    continue
                if tables is None:
                    codes, times = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, kind) for k, kind in ((0, U), (1, np.int64)))
                    order = np.argsort(_turned(codes))
                    codes, times = codes[order], times[order]
                    tables = _tables(m, codes, times)
                    known, cost = _turned(codes), _costs(m, tables, codes)
                    held = []
                for i in range(lo, hi):
                    turned = np.cumsum(np.frombuffer(zstd.decompress(b.column(4)[i].as_buffer(), decompressed_size=8 * int(n[i])), U), dtype=U)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, turned), len(known) - 1)
                        out, new = cost[place], known[place] != turned
                    else:
                        out, new = np.zeros(len(turned)), np.ones(len(turned), dtype=bool)
                    out[new] = _costs(m, tables, _unturned(turned[new]))
                    yield batch(schema, [chunk[i].as_py()], [int(own[i])], [int(n[i])], [out.tobytes()])

    asks = asked.where("range >= 0").select("range", "chunk", F.lit(None).cast("long").alias("code"), "n", "data")
    model = m.counts.select(_range_column(m.ranges).alias("range"), F.lit(None).cast("long").alias("chunk"), "code", "n", F.lit(None).cast("binary").alias("data"))
    both = model.union(asks).repartition(m.ranges, "range").sortWithinPartitions("range", F.col("chunk").asc_nulls_first())
    return both.mapInArrow(tidy(answer), "chunk long, range int, n long, data binary")


def lm_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Tokens are lower-cased words and one end; score is the mixer's log10
    probability of the text's bytes and its end.  Null texts count as empty
    (one token); a null key is in training; repeated rows stay.  With nothing
    to learn from all counts are 0.  Only key and text are read.  The base is of
    lower-cased words, score of the text as it stands, capitals and all.
    """
    # Rows hold whole chunks of texts or costs, so batches are kept small.
    text_batches(df.sparkSession, megabytes=8)
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    train = rows.where(~held_out(F.col("key"))).select("text")
    word_counts = _counts(train, lambda c: words(c, lower=True).hash, "word-counts")
    known, in_words = word_counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_train = train.count()
    n, v = in_words + n_train, known + (1 if n_train else 0)
    top = frequent(word_counts, FREQUENT_WORDS).toArrow()
    top_code, top_n = top["code"].to_numpy().view(U), top["n"].to_numpy()
    order = np.argsort(top_code)
    shared = sc.broadcast((top_code[order], np.log10(top_n[order] + 1.0)))
    mixer = train_mixer(train)
    ranges = mixer.ranges
    end_log = float(np.log10(n_train + 1.0))
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_common long, common double, bits double, n_bytes long, rare array<long>, rare_n array<long>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers to a chunk come sorted by range, its texts after them."""
        code, log_n = shared.value
        answers: list[np.ndarray] = []
        for own, data in ((b.column(1)[i].as_py(), b.column(3)[i]) for b in batches for i in range(b.num_rows)):
            if own >= 0:
                answers.append(np.frombuffer(data.as_buffer()))
                continue
            parts = []
            for b in pa.ipc.open_stream(data.as_buffer()):
                for c in chunks(b.column(1), CHUNK):
                    gram, at = grams(c)
                    parts.append((b, c, at, *folded(gram)))
            turned, _, order = _distinct([p[3] for p in parts], ranges)
            cost = np.empty(len(turned))
            cost[order] = np.concatenate(answers) if answers else np.zeros(0)
            answers, order = [], None
            for b, c, at, kinds, place in parts:
                bits = per_row(np.add, cost[np.searchsorted(turned, _turned(kinds))][place], at, 0.0)
                w = words(c, lower=True)
                kinds, place = folded(w.hash)
                found = np.minimum(np.searchsorted(code, kinds), max(len(code) - 1, 0))
                hit = code[found] == kinds if len(code) else np.zeros(len(kinds), dtype=bool)
                value = np.where(hit, log_n[found], 0.0) if len(code) else np.zeros(len(kinds))
                common = per_row(np.add, value[place], w.offsets, 0.0)
                n_common = per_row(np.add, hit[place].astype(np.int64), w.offsets, 0)
                miss = np.flatnonzero(~hit[place])
                row, h = np.searchsorted(w.offsets, miss, "right") - 1, w.hash[miss]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(h)))
                cuts = np.searchsorted(row[first], np.arange(c.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.first, c.rows), pa.array(np.diff(w.offsets)), pa.array(n_common), pa.array(common), pa.array(bits), pa.array(np.diff(c.offsets)), lists(h[first].view(np.int64), cuts, pa.int64()), lists(times, cuts, pa.int64())],
                    names=["key", "n_words", "n_common", "common", "bits", "n_bytes", "rare", "rare_n"],
                )

    asked = _asked(rows, ranges)
    meet = _answered(mixer, asked).union(asked.where("range < 0")).repartition("chunk").sortWithinPartitions("chunk", F.col("range") < 0, "range")
    measured = stash(meet.mapInArrow(tidy(measure), schema).withColumn("row", F.monotonically_increasing_id()), "lm-measures")
    # What is left to read are the measures and the word counts.
    unstash(asked, mixer.counts)
    rare = measured.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("code"), F.col("r.rare_n").alias("times"))
    rare = rare.join(word_counts, "code").groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("rare_log"))
    out = measured.drop("rare", "rare_n").join(rare, "row", "left")
    base = F.col("common") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(end_log) - (F.col("n_words") + 1) * F.log10(F.lit(float(n + v + 1)))
    return out.select(
        F.col("key").alias(key),
        held_out(F.col("key")).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(1 if n_train else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-F.col("bits") * LOG10_2).alias("score"),
        (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
