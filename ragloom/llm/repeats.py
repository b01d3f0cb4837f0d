"""What suffix-array and substring deduplication share: finding repeated windows without moving all of them.

A window is W consecutive symbols (bytes or words).  Its anchor is the smallest
hash among its k-grams, so equal windows have equal anchors.  Consecutive windows
with one anchor form a unit, of W - k + 1 windows at most, and only units travel:
(anchor, unit hash, document, window range).  Equal units repeat as a whole.
Only where one anchor has different units, windows have to be compared singly;
the symbols of such units are fetched from the texts then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.arrays import U, Texts, batch, chunks, equal_bytes, flat, group_cuts, mix, ranges, signed, tidy, whole_groups
from ragloom.session import stash, text_batches

#: Different units of an anchor up to which one task compares them; others are compared by a shuffle of single windows.
CAP = 512
#: Units that a task gathers before it settles repeats among them.
SETTLE_UNITS = 400_000
#: Bytes of their texts that it holds meanwhile; a longer text comes alone.
SETTLE_BYTES = 1 << 25
#: Bytes of text whose open units are copied at a time.
FETCH_BYTES = 1 << 18

_MUL = mix(np.arange(11, 75, dtype=U)) | U(1)


class Symbols(NamedTuple):
    """Symbols of some texts for one window kind: two independent k-gram hashes at each place, row offsets and byte ranges.

    The first hash chooses anchors, the second tells units of one anchor apart.
    """

    gram: np.ndarray
    proof: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Kind(NamedTuple):
    """How a text splits into symbols, and what counts as earlier.

    What is fetched of a text, to compare windows, is a slice of it that holds
    whole symbols, and the last three functions work on such slices.
    """

    window: int
    gram: int
    symbols: Callable[[Texts], Symbols]
    #: Byte range of each symbol, and row offsets.
    spans: Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Class of each window of some slices, given its first symbol: equal windows share it, others most likely don't.
    classes: Callable[[Texts, np.ndarray], np.ndarray]
    #: Whether the windows at two lists of first symbols are equal, byte by byte or word by word.
    equal: Callable[[Texts, np.ndarray, np.ndarray], np.ndarray]
    #: 128 bits of the content of each window.
    ids: Callable[[Texts, np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: True: a window repeats if it starts in a smaller document; False: also earlier in the same one.
    by_document: bool


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    done = 1
    while done * 2 <= w:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (w - done)], a[w - done :]) if w > done else a


class Units(NamedTuple):
    anchor: np.ndarray
    unit: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def units(s: Symbols, kind: Kind) -> Units:
    """Units of all rows; lo and hi are the first and last window of each, counted in its row."""
    w = kind.window - kind.gram + 1
    n = len(s.gram)
    none = np.zeros(0, np.int64)
    if n < kind.window:
        return Units(none, none, none, none, none)
    low = sliding_min(s.gram[: n - kind.gram + 1], w)
    count = np.maximum(np.diff(s.offsets) - kind.window + 1, 0)
    first = s.offsets[:-1]
    valid = np.zeros(n + 1, dtype=np.int8)
    has = count > 0
    np.add.at(valid, first[has], 1)
    np.add.at(valid, first[has] + count[has], -1)
    valid = np.cumsum(valid[: len(low)]) > 0
    start = np.ones(len(low), dtype=bool)
    start[1:] = (low[1:] != low[:-1]) | (s.gram[: len(low) - 1] == low[:-1]) | ~valid[:-1]
    start[first[has]] = True
    start &= valid
    lo = np.flatnonzero(start)
    ends = np.flatnonzero(valid & np.concatenate([(start | ~valid)[1:], [True]]))
    row = np.searchsorted(s.offsets, lo, "right") - 1
    span = ends - lo
    last = span + kind.window - kind.gram
    unit = mix(span.astype(U) + U(1))
    for j in range(-(-(w - 1 + kind.window) // kind.gram)):
        unit += mix(s.proof[lo + np.minimum(j * kind.gram, last)] * _MUL[j])
    return Units(signed(low[lo]), signed(mix(unit)), row, lo - s.offsets[row], ends - s.offsets[row])


def merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi) by key, overlapping and touching ones joined."""
    if not len(key):
        return key, lo, hi
    order = np.lexsort((hi, lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    cuts = group_cuts(key)
    # Shifting each key's ranges past those of the key before lets one running maximum serve all.
    shift = np.repeat(np.concatenate([[0], np.cumsum(np.maximum.reduceat(hi, cuts[:-1]) + 1)[:-1]]), np.diff(cuts))
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (lo + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], lo[at], np.append(reach[at[1:] - 1], reach[-1]) - shift[at]


RANGES = pa.schema([("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
UNITS = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("unit", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("hot", pa.bool_())])
UNIT_DDL = "anchor long, salt int, unit long, key long, lo long, hi long, hot boolean"


def same_units(kind: Kind, data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the units at two lists of byte ranges hold the same symbols.

    Most are equal byte for byte.  Others, as words with other white space
    between them, are compared by ``kind.equal``: a unit's first and last window
    cover all of it.
    """
    size = a_end - a
    same = size == b_end - b
    same[same] = equal_bytes(data, a[same], b[same], size[same])
    rest = np.flatnonzero(~same)
    cost = np.cumsum(size[rest] + b_end[rest] - b[rest])
    at = 0
    while at < len(rest):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FETCH_BYTES, side="right")))
        pair = rest[at:stop]
        start, end = np.concatenate([a[pair], b[pair]]), np.concatenate([a_end[pair], b_end[pair]])
        length = end - start
        t = Texts(0, data[np.repeat(start, length) + ranges(length)], np.concatenate([[0], np.cumsum(length)]))
        _, _, offsets = kind.spans(t)
        first, last, n = offsets[:-1], offsets[1:] - kind.window, len(pair)
        ok = np.flatnonzero(np.diff(offsets)[:n] == np.diff(offsets)[n:])
        equal = kind.equal(t, first[ok], first[n + ok]) & kind.equal(t, last[ok], last[n + ok])
        same[pair[ok[equal]]] = True
        at = stop
    return same


def settle(kind: Kind, data: np.ndarray, *parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Repeats among some units, given their texts: first the units that stay, then ranges of those that repeat.

    ``parts``: anchor, unit, key, first and last window, and byte range in ``data`` of each unit.
    """
    while True:
        anchor, unit, key, lo, hi, start, end = parts
        order = np.lexsort((lo, key, unit, anchor))
        parts = anchor, unit, key, lo, hi, start, end = tuple(x[order] for x in parts)
        cuts = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]) | (anchor[1:] != anchor[:-1])) + 1, [len(unit)]])
        head = np.repeat(cuts[:-1], np.diff(cuts))
        late = key != key[head] if kind.by_document else (key != key[head]) | (lo != lo[head])
        at = np.flatnonzero(late)
        wrong = at[~same_units(kind, data, start[at], end[at], start[head[at]], end[head[at]])]
        if not len(wrong):
            break
        # Different units met under one hash: those unlike its first form another.
        unit[wrong] = signed(mix(unit[wrong].view(U) + U(1)))
    # The place of each unit among its anchor's.
    nth = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    by_anchor = group_cuts(anchor)
    place = nth - np.repeat(nth[by_anchor[:-1]], np.diff(by_anchor))
    most = np.repeat(np.maximum.reduceat(place, by_anchor[:-1]), np.diff(by_anchor))
    live = ~late
    yield batch(UNITS, anchor[live], (place[live] // CAP).astype(np.int32), unit[live], key[live], lo[live], hi[live], most[live] >= CAP)
    k, a, z = merged(key[late], lo[late], hi[late] + kind.window)
    yield batch(UNITS, pa.nulls(len(k), pa.int64()), (k & 0xFFFFFF).astype(np.int32), np.zeros(len(k), np.int64), k, a, z, np.zeros(len(k), bool))


def scan_units(rows: DataFrame, kind: Kind) -> DataFrame:
    """Units of a (key, text) frame.

    Repeats among the units a task holds at a time are settled at once, each compared with the first of its unit on the texts,
    which the task holds as well: they come back as plain
    ranges (anchor null, spread by salt), so an anchor of every document sends a
    few rows per settling and not one per document.  An anchor with more than CAP
    different units among them is marked hot, and what exceeds CAP gets a salt.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[np.ndarray] = []
        size = n_bytes = 0
        for b in batches:
            # Nulls are filled first: numpy would make floats of a column that has some, which merges large keys.
            keys = b.column(0).fill_null(0).to_numpy()
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1)):
                s = kind.symbols(c)
                u = units(s, kind)
                row = u.row + c.first
                ok = known[row]
                if ok.any():
                    at = s.offsets[u.row[ok]]
                    parts.append((u.anchor[ok], u.unit[ok], keys[row[ok]], u.lo[ok], u.hi[ok], n_bytes + s.start[at + u.lo[ok]], n_bytes + s.end[at + u.hi[ok] + kind.window - 1]))
                    held.append(c.data.copy())
                    size, n_bytes = size + len(parts[-1][0]), n_bytes + len(c.data)
                if size >= SETTLE_UNITS or n_bytes >= SETTLE_BYTES:
                    yield from settle(kind, np.concatenate(held), *(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts, held, size, n_bytes = [], [], 0, 0
        if parts:
            yield from settle(kind, np.concatenate(held), *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return rows.mapInArrow(tidy(scan), UNIT_DDL)


def judged(all_units: DataFrame, kind: Kind) -> DataFrame:
    """(key, lo, hi, anchor, state, hot): state 1 for ranges [lo, hi) that repeat, 2 for units whose windows must be compared."""
    place = F.struct("key") if kind.by_document else F.struct("key", "lo")
    same = Window.partitionBy("anchor", "salt", "unit")
    near = Window.partitionBy("anchor", "salt")
    u = all_units.withColumn("late", (place != F.min(place).over(same)) & F.col("anchor").isNotNull())
    u = u.withColumn("kinds", F.max("unit").over(near) != F.min("unit").over(near)).withColumn("heat", F.max("hot").over(near) | (F.count(F.lit(1)).over(near) > CAP * 8))
    state = F.when(F.col("anchor").isNull() | F.col("late"), 1).when(F.col("kinds") | F.col("heat"), 2)
    hi = F.when(F.col("late"), F.col("hi") + kind.window).otherwise(F.col("hi"))
    return u.select("key", "lo", hi.alias("hi"), "anchor", state.alias("state"), F.col("heat").alias("hot")).where("state is not null")


def _by_document(ranges_: DataFrame, *extra: str) -> DataFrame:
    """One row per document: its ranges, of which a document has no more than windows."""
    return ranges_.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", *extra)).alias("ranges"))


def with_texts(rows: DataFrame, ranges_: DataFrame, how: str, *extra: str) -> DataFrame:
    """(key, text, ranges) by joining texts with ranges; a shuffle of both at every size."""
    return rows.join(_by_document(ranges_, *extra), "key", how)


def _windows(t: Texts, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, place in it and first symbol of every window of some slices."""
    _, _, offsets = kind.spans(t)
    own = np.maximum(np.diff(offsets) - kind.window + 1, 0)
    unit, place = np.repeat(np.arange(len(own)), own), ranges(own)
    return unit, place, offsets[unit] + place


def late_windows(t: Texts, key: np.ndarray, lo: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Key and place of every window that repeats among some slices, each compared with the first of its class itself."""
    unit, place, first = _windows(t, kind)
    cls = kind.classes(t, first)
    k, p = key[unit], lo[unit] + place
    while True:
        order = np.lexsort((p, k, cls))
        cuts = group_cuts(cls[order])
        head = np.empty(len(order), np.int64)
        head[order] = np.repeat(order[cuts[:-1]], np.diff(cuts))
        late = np.flatnonzero(k != k[head] if kind.by_document else (k != k[head]) | (p != p[head]))
        wrong = late[~kind.equal(t, first[late], first[head[late]])]
        if not len(wrong):
            return k[late], p[late]
        # Different windows met in a class by chance: those unlike its first form another.
        _, cls = np.unique(np.stack([cls.astype(np.int64), np.isin(np.arange(len(cls)), wrong)]), axis=1, return_inverse=True)
        cls = cls.reshape(-1)


def compare_windows(rows: DataFrame, open_units: DataFrame, kind: Kind) -> DataFrame:
    """(key, lo, hi) of repeated windows among units of one anchor.

    Units of a cold anchor meet in one task, which compares their windows by
    ``kind.classes``.  Windows of hot anchors are shuffled singly by 128 bits of
    their content, after repeats inside a batch are settled, so no group of
    units has to meet.
    """
    schema = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("key", pa.int64()), ("lo", pa.int64()), ("symbols", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            want = b.column(2)
            at, items = want.offsets.to_numpy().astype(np.int64), want.flatten()
            at = at - at[0]
            lo, hi, anchor, hot = (items.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for c in chunks(b.column(1), FETCH_BYTES):
                starts, ends, offsets = kind.spans(c)
                own = np.repeat(np.arange(c.rows), np.diff(at[c.first : c.first + c.rows + 1]))
                part = np.arange(at[c.first], at[c.first + c.rows])
                # A key that comes with several texts has ranges of them all: a range that a text has no place for is none of its own.
                fits = hi[part] + kind.window <= np.diff(offsets)[own]
                own, part = own[fits], part[fits]
                if not len(part):
                    continue
                start, end = starts[offsets[own] + lo[part]], ends[offsets[own] + hi[part] + kind.window - 1]
                size = end - start
                flat = c.data[np.repeat(start, size) + ranges(size)]
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                symbols = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat.tobytes())])
                yield batch(schema, anchor[part], hot[part], keys[c.first + own], lo[part], symbols)

    fetched = with_texts(rows, open_units.select("key", "lo", "hi", "anchor", "hot"), "inner", "anchor", "hot").mapInArrow(tidy(fetch), "anchor long, hot boolean, key long, lo long, symbols binary")
    # Written once, as both ways below read it.
    fetched = stash(fetched, "open-units")
    hot_keys = open_units.where("hot").limit(1).count() > 0

    def repeats(key: np.ndarray, lo: np.ndarray, symbols: pa.Array) -> pa.RecordBatch:
        """Repeats among the windows of some units."""
        k, p = late_windows(Texts(0, *flat(symbols)), key, lo, kind)
        return batch(RANGES, *merged(k, p, p + kind.window))

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2 << 20):
            # Windows of different anchors differ, so one comparison serves many anchors.
            yield repeats(t["key"].to_numpy(), t["lo"].to_numpy(), t["symbols"])

    out = fetched.where("not hot").select("anchor", "key", "lo", "symbols").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(cold), "key long, lo long, hi long")
    if not hot_keys:
        return out
    single = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("key", pa.int64()), ("lo", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                t = Texts(0, *flat(part.column(2)))
                unit, place, first = _windows(t, kind)
                p, q = kind.ids(t, first)
                yield batch(single, signed(p), signed(q), part.column(0).to_numpy()[unit], part.column(1).to_numpy()[unit] + place)

    windows = fetched.where("hot").select("key", "lo", "symbols").mapInArrow(tidy(split), "p long, q long, key long, lo long")
    place = F.col("key") if kind.by_document else F.struct("key", "lo")
    least = windows.groupBy("p", "q").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    repeated = windows.join(least, ["p", "q"]).where(place != F.col("least"))
    return out.union(repeated.select("key", "lo", (F.col("lo") + kind.window).alias("hi")))


def repeated_ranges(rows: DataFrame, kind: Kind, name: str) -> DataFrame:
    """(key, lo, hi) ranges of symbols covered by repeated windows, over a (key, text) frame; written to the shared folder."""
    text_batches(rows.sparkSession)
    # Dealt as the windows of judged() ask for it, so units move once; settled ranges, without an anchor, are spread by their salt.
    dealt = scan_units(rows, kind).repartition("anchor", "salt")
    found = stash(judged(dealt, kind), f"{name}-units")
    compared = stash(compare_windows(rows, found.where("state = 2"), kind), f"{name}-windows")
    return found.where("state = 1").select("key", "lo", "hi").union(compared)

