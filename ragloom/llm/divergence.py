"""How the sources of a language differ in their terms, by hash-consed segment trees of counts.

Each (lang, source) group has a segment tree over the term ids of its language,
with its counts at the leaves.  Nodes are hash-consed: subtrees of equal counts,
in one tree or in several, are one node with one number.  Two trees are walked
at once from their roots; a pair of nodes that comes up again is only counted,
so equal pairs are priced once, at the leaves that they lead to.

A language's ids are cut into segments of about ``SEGMENT`` terms by a hash of the
term; a task has the subtrees of two blocks of ``GROUPS`` sources over one
segment, and only their partial sums leave it.  All arithmetic is in whole
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.arrays import LOWER, chunks, tidy
from ragloom.session import stash, text_batches, unstash

UNIT = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
SEGMENT = 4096
GROUPS = 128
#: Node pairs that a task walks at once.
WALK = 1 << 21
#: Counts from here on are reckoned in Python's whole numbers, as 64 bits would not hold UNIT times as much.
WIDE = 9_000_000_000

#: Bytes that make terms: letters of ASCII, and all of other characters.
_TERM = np.zeros(256, dtype=bool)
_TERM[0x80:] = True
_TERM[ord("A") : ord("Z") + 1] = True
_TERM[ord("a") : ord("z") + 1] = True


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of term bytes; none crosses a text's end."""
    inside = _TERM[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    first, last = offsets[full], offsets[full + 1] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[cut], *(np.add.reduceat(v[order], cut) if len(cut) else v[:0] for v in values)


COUNTS = "lang string, source string, term string, n long, docs long"


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of texts, counted by group in pieces of some megabytes; and a row without a term for each group."""
    for b in batches:
        lang, source = (b.column(i).dictionary_encode() for i in (1, 2))
        groups = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()

        def out(group: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray, lang=lang, source=source) -> pa.RecordBatch:
            own = [x.dictionary.take(pa.array(i)) for x, i in ((lang, group // len(source.dictionary)), (source, group % len(source.dictionary)))]
            return pa.RecordBatch.from_arrays([*own, term, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

        present = np.unique(groups)
        yield out(present, pa.nulls(len(present), pa.string()), np.zeros(len(present)), np.zeros(len(present)))
        for t in chunks(b.column(0), 8 << 20):
            start, end = term_runs(t.data, t.offsets)
            if not len(start):
                continue
            # Every second of these strings is a term, the others are what lies between.
            edges = np.stack([start, end], axis=1).reshape(-1).astype(np.int64)
            spans = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(LOWER[t.data])))
            coded = spans.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
            code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            row = np.searchsorted(t.offsets, start, side="right") - 1
            pair, n = _sums(row * many + code, np.ones(len(code), np.int64))
            key, n, docs = _sums(groups[t.first + pair // many] * many + pair % many, n, np.ones(len(pair), np.int64))
            for at in range(0, len(key), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield out(key[part] // many, coded.dictionary.take(pa.array(key[part] % many)).cast(pa.string()), n[part], docs[part])


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) of all terms, counted before the shuffle; each group also has a row with a null term.  Nulls read as ''."""
    own = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    found = df.select(*own).mapInArrow(_count, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total)."""
    return 1 + UNIT * (count + 1) // total


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Forest:
    """Hash-consed trees over the rows of a matrix of counts; its width is a power of two, -1 stands where no term is.

    ``leaves[r, c]`` and ``roots[r]`` are numbers of nodes of their level; a node
    of level k has two children of level k - 1.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, number = np.unique(counts, return_inverse=True)
        number = number.reshape(counts.shape)
        self.leaves = number
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while number.shape[1] > 1:
            left, right = number[:, ::2], number[:, 1::2]
            size = int(number.max()) + 1
            nodes, up = np.unique(left.astype(np.int64) * size + right, return_inverse=True)
            self.children.append((nodes // size, nodes % size))
            number = up.reshape(left.shape)
        self.roots = number[:, 0]

    def walk(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, leaf of g, leaf of h, times) of the pairs of rows (g[k], h[k]): two trees at once from the roots, a pair of nodes that comes up again being counted only."""
        pair, a, b, times = np.arange(len(g)), self.roots[g], self.roots[h], np.ones(len(g), np.int64)
        for left, right in reversed(self.children):
            below = len(self.counts) if left is self.children[0][0] else int(max(left.max(), right.max())) + 1
            key = np.concatenate([(pair * below + side[a]) * below + side[b] for side in (left, right)])
            key, times = _sums(key, np.concatenate([times, times]))
            pair, a, b = key // (below * below), key // below % below, key % below
        return pair, a, b, times


def _sides(counts: np.ndarray, totals: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    return _share(counts[leaf], totals[row])


PRICED = "lang string, g int, h int, term string, value long"


def _segment(key: tuple, t: pa.Table, block: int) -> pa.Table:
    """Partial sums of all pairs of two blocks' groups over one segment, and, where both blocks are one, each group's best terms."""
    lang, _, first, second = (k.as_py() for k in key)
    of = {c: t.column(c).combine_chunks() for c in ("g", "term", "n", "whole", "terms", "total")}
    head = of["term"].is_null().to_numpy(zero_copy_only=False)
    g, n = of["g"].to_numpy(), of["n"].to_numpy()
    groups, by = np.unique(g[head]), np.argsort(g[head])
    terms, total = (int(of[c].filter(pa.array(head))[0].as_py()) for c in ("terms", "total"))
    sums = n[head][by] + terms
    words = of["term"].filter(pa.array(~head)).dictionary_encode()
    at, row = words.indices.to_numpy(), np.searchsorted(groups, g[~head])
    width = 1 << max(0, int(len(words.dictionary) - 1).bit_length())
    counts = np.full((len(groups) + 1, width), -1, np.int64)
    counts[:, : len(words.dictionary)] = 0
    counts[row, at] = n[~head]
    counts[-1, at] = of["whole"].to_numpy()[~head]
    sums = np.append(sums, total + terms)
    if counts.max() >= WIDE:
        sums = sums.astype(object)
    forest = Forest(counts)
    leaf = forest.counts.astype(sums.dtype)

    def column(x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64)

    found = []
    blocks = (groups // block == first, groups // block == second)
    a, b = (np.flatnonzero(x) for x in blocks)
    i, j = (x.reshape(-1) for x in np.meshgrid(a, b, indexing="ij"))
    once = i < j
    i, j = i[once], j[once]
    step = max(1, WALK // width)
    for k in range(0, len(i), step):
        gi, hj = i[k : k + step], j[k : k + step]
        pair, x, y, times = forest.walk(gi, hj)
        real = forest.counts[x] >= 0
        pair, x, y, times = pair[real], x[real], y[real], times[real]
        p, q = _sides(leaf, sums, gi[pair], x), _sides(leaf, sums, hj[pair], y)
        for one, other, of_p, of_q in ((gi, hj, p, q), (hj, gi, q, p)):
            value = np.zeros(len(gi), sums.dtype)
            np.add.at(value, pair, _price(of_p, of_q) * times)
            found.append((groups[one], groups[other], column(value)))
    pairs = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ()))]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    names = ["lang", "g", "h", "term", "value"]
    none = len(pairs[0])
    out = [pa.Table.from_arrays([pa.array([lang] * none, kinds[0]), pa.array(pairs[0], kinds[1]), pa.array(pairs[1], kinds[2]), pa.nulls(none, kinds[3]), pa.array(pairs[2], kinds[4])], names=names)]
    if first == second and len(words.dictionary):
        # The walk of a group's tree with the language's, where the group has the term: each pair of leaves is priced once.
        r, c = np.nonzero(counts[:-1, : len(words.dictionary)] > 0)
        size = len(forest.counts)
        code, back = np.unique((r * size + forest.leaves[r, c]) * size + forest.leaves[-1, c], return_inverse=True)
        p, q = _sides(leaf, sums, code // (size * size), code // size % size), _share(leaf[code % size], sums[-1])
        value, more = _price(p, q)[back.reshape(-1)], (p > q)[back.reshape(-1)]
        r, c, value = r[more], c[more], column(value[more])
        # A term beyond the best TOP_TERMS of its segment is beyond those of all; ties stay for the order by term.
        order = np.lexsort((-value, r))
        r, c, value = r[order], c[order], value[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        last = np.searchsorted(r, r) + TOP_TERMS - 1
        tie = value == value[np.minimum(last, len(r) - 1)]
        keep = (rank < TOP_TERMS) | (tie & (r == r[np.minimum(last, len(r) - 1)]))
        r, c, value = r[keep], c[keep], value[keep]
        out.append(pa.Table.from_arrays([pa.array([lang] * len(r), kinds[0]), pa.array(groups[r], kinds[1]), pa.nulls(len(r), kinds[2]), words.dictionary.take(pa.array(c)), pa.array(value, kinds[4])], names=names))
    return pa.concat_tables(out)


def source_divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", segment: int = SEGMENT, block: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence from each other source of its language, and its most telling terms.

    Nulls read as ''; repeated rows are documents of their own; a group without
    terms has zero counts, and a language without kept terms gives zeros; the
    only source of a language has no pairs; an empty table gives none.
    """
    text_batches(df.sparkSession, 2000, 16)
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(df, text, lang, source)
    counts = counts.withColumn("in_docs", F.sum("docs").over(by_term)).withColumn("whole", F.sum("n").over(by_term))
    first = F.row_number().over(by_term.orderBy("source")) == 1
    kept = stash(counts.withColumn("first", first).where((F.col("in_docs") >= MIN_DOCUMENTS) | F.col("term").isNull()).drop("docs", "in_docs"), "term-counts")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("firsts"))
    w = Window.partitionBy("lang")
    groups = groups.withColumn("g", (F.row_number().over(w.orderBy("source")) - 1).cast("int")).withColumn("terms", F.sum("firsts").over(w)).withColumn("total", F.sum("sum").over(w)).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(w) / block).cast("int"))
    groups = stash(groups.withColumn("segments", F.greatest(F.lit(1), F.ceil(F.col("terms") / segment)).cast("int")).drop("firsts"), "term-groups")
    own = ["lang", "g", "blocks", "segments", "terms", "total"]
    rows = kept.where("term is not null").join(groups.select("source", *own), ["lang", "source"])
    rows = rows.select(*own, "term", "n", "whole", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int").alias("segment"))
    heads = groups.select(*own, F.lit(None).cast("string").alias("term"), F.col("sum").alias("n"), F.lit(0).cast("long").alias("whole"), F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"))
    every = rows.unionByName(heads).withColumn("block", F.floor(F.col("g") / block).cast("int"))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.select("lang", "segment", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "g", "term", "n", "whole", "terms", "total")
    priced = stash(every.groupBy("lang", "segment", "b1", "b2").applyInArrow(lambda key, t: _segment(key, t, block), PRICED), "term-prices")
    names = groups.select("lang", "g", "source")
    pairs = priced.where("term is null").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pairs = pairs.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    terms = priced.where("term is not null").join(names, ["lang", "g"])
    unstash(kept)

    def ranks(rows: DataFrame, part: str, item: str) -> DataFrame:
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
        return rows.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", F.row_number().over(best).alias("rank"))

    return ranks(pairs, "pair", "item").unionByName(ranks(terms, "term", "term").where(F.col("rank") <= TOP_TERMS))
