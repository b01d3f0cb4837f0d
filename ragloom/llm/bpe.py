"""BPE encoding and decoding through a minimal acyclic transducer.

The corpus' most frequent words are counted by Spark, encoded once, and compiled
into a minimal acyclic automaton over their UTF-8 bytes: equal suffixes share
their states, and numbers on the edges add up to a word's rank, which indexes
one flat table of ids.  The image (a few MB, bounded by ``lexicon_size``) is
broadcast, each Python worker maps it from a file, and words outside it are
merged exactly by rank.  A task remembers the strings of recent words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.arrays import batch, chunks, ranges, tidy
from ragloom.llm.frequent import frequent
from ragloom.session import stash, text_batches, unstash

LEXICON_SIZE = 1 << 16
#: Characters of ids and tokens that a process remembers in a generation; two generations are held.
MEMO_CHARS = 10 << 20
_NEVER = 1 << 40
#: Words of more bytes are merged by a heap each; shorter ones in step, which costs the square of their length.
LONG = 512

#: White space of the tokenizer's ``\\s`` (Unicode White_Space).
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE_CLASS = "".join(f"\\u{ord(c):04x}" for c in _SPACES)


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """A word-end BPE tokenizer file: normalisation, splitting, merges and strings of ids."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.tokens}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        pattern = next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", _SPACE_CLASS), regex.V0)
        self.space = regex.compile(f"[{_SPACE_CLASS}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of the raw text, and whether each is a special token."""
        if not self.cut or not any(s in text for s in self.special):
            yield text, False
            return
        for piece in self.cut.split(text):
            if piece:
                yield piece, piece in self.special

    def runs(self, text: str) -> list[str]:
        """Runs without white space of the normalised text: NFC, and lower case letter by letter (no final sigma)."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        # str.split() also breaks at four separators that the tokenizer takes for ordinary characters.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [r for r in self.space.sub(" ", text).lower().split(" ") if r]
        return text.lower().split()

    def words(self, run: str) -> list[str]:
        """The words of a run without white space; letters alone, or with one mark behind, need no pattern."""
        if run.isalpha():
            return [run]
        if run[-1] in ".,;:!?" and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.pattern.findall(run)

    def _tables(self) -> None:
        """Merges as sorted (left id, right id) numbers with rank and merged id; the id of each byte, within and at the end of a word."""
        pairs = sorted((self.ids[a] * len(self.ids) + self.ids[b], r, self.ids[a + b]) for (a, b), r in self.rank.items())
        self.pair, self.pair_rank, self.pair_id = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))
        self.inner = np.array([self.ids[x] for x in self.letters], dtype=np.int64)
        self.final = np.array([self.ids[x + self.end] for x in self.letters], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = left * len(self.ids) + right
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        hit = (self.pair[at] == want) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], _NEVER), self.pair_id[at]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of words: merge the pair of lowest rank, the leftmost of equals, until none is left."""
        order, ids, n = self.merged(words)
        cuts = np.cumsum(n)[:-1]
        out: list[list[int]] = [[] for _ in words]
        for i, own in zip(order.tolist(), np.split(ids, cuts) if len(words) else [], strict=True):
            out[i] = own.tolist()
        return out

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as an order of the words, their ids in that order, and the number of each word's ids.

        Words of similar length take their merges in step, one merge each a turn;
        those beyond ``LONG`` bytes are merged one by one, in n log n.
        """
        raw = [w.encode() for w in words]
        length = np.array([len(w) for w in raw], dtype=np.int64)
        order = np.argsort(length, kind="stable")
        done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = 0
        while at < len(order):
            wide = int(length[order[at]])
            if wide > LONG:
                own = self._merge_long(raw[order[at]])
                done.append((own, np.array([len(own)])))
                at += 1
                continue
            top = int(np.searchsorted(length[order], min(LONG, max(wide + 2, wide * 5 // 4)), side="right"))
            part = order[at : min(top, at + max(1, (1 << 19) // max(length[order[min(top, len(order)) - 1]], 1)))]
            done.append(self._merge_block([raw[i] for i in part]))
            at += len(part)
        return order, np.concatenate([ids for ids, _ in done]), np.concatenate([n for _, n in done])

    def _merge_block(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "pair"):
            self._tables()
        n = np.array([len(w) for w in raw], dtype=np.int64)
        rows, wide = np.arange(len(raw)), int(n.max()) + 1
        x = np.full((len(raw), wide), -1, dtype=np.int64)
        x[np.arange(wide) < n[:, None]] = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        x[rows, n - 1] = self.final[np.array([w[-1] for w in raw])]
        rank, made = self._ranks(x[:, :-1], x[:, 1:])
        todo = rows
        while len(todo) and wide > 1:
            m = rank[todo].argmin(axis=1)
            going = rank[todo, m] < _NEVER
            todo, m = todo[going], m[going]
            if not len(todo):
                break
            token = made[todo, m]
            columns = np.arange(wide - 1)
            shift = np.minimum(columns + (columns > m[:, None]), wide - 1)
            x[todo, :-1] = np.take_along_axis(x[todo], shift, axis=1)
            x[todo, -1] = -1
            shift = np.minimum(columns + (columns >= m[:, None]), wide - 2)
            rank[todo] = np.take_along_axis(rank[todo], shift, axis=1)
            made[todo] = np.take_along_axis(made[todo], shift, axis=1)
            rank[todo, -1] = _NEVER
            x[todo, m] = token
            rank[todo, m], made[todo, m] = self._ranks(token, x[todo, np.minimum(m + 1, wide - 1)])
            left = m > 0
            t, k = todo[left], m[left]
            rank[t, k - 1], made[t, k - 1] = self._ranks(x[t, k - 1], token[left])
        # Ids stand at the left of their rows.
        return x[x >= 0], (x >= 0).sum(axis=1)

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """The same for one long word: a heap of (rank, place) over linked tokens, where a pair that is no longer there is passed over."""
        if not hasattr(self, "pair"):
            self._tables()
        if not hasattr(self, "by_pair"):
            self.by_pair = dict(zip(self.pair.tolist(), zip(self.pair_rank.tolist(), self.pair_id.tolist(), strict=True), strict=True))
        ids = self.inner[np.frombuffer(raw, np.uint8)]
        ids[-1] = self.final[raw[-1]]
        n, size, never = len(ids), len(self.ids), (int(_NEVER), -1)
        rank, made = (x.tolist() for x in self._ranks(ids[:-1], ids[1:]))
        ids, right, left = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [r << 32 | i for i, r in enumerate(rank) if r < _NEVER]
        heapq.heapify(heap)
        rank.append(never[0])
        made.append(-1)
        while heap:
            r, i = divmod(heapq.heappop(heap), 1 << 32)
            if rank[i] != r:
                continue
            gone = right[i]
            ids[i], ids[gone], rank[gone] = made[i], -1, never[0]
            right[i] = after = right[gone]
            if after >= 0:
                left[after] = i
            for a, b in ((i, after), (left[i], i)):
                if a >= 0:
                    rank[a], made[a] = self.by_pair.get(ids[a] * size + ids[b], never) if b >= 0 else never
                    if rank[a] < never[0]:
                        heapq.heappush(heap, rank[a] << 32 | a)
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def strings(self, ids: np.ndarray, n: np.ndarray) -> tuple[list[str], list[str]]:
        """Numbers and tokens of lists of ids, each list as one string joined by blanks."""
        if not hasattr(self, "by_id"):
            known = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
            self.by_id = (pa.array(map(str, range(len(known)))), pa.array(known))
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        joined = (pc.binary_join(pa.ListArray.from_arrays(at, names.take(pa.array(ids))), " ").to_pylist() for names in self.by_id)
        return tuple(joined)


class Transducer(NamedTuple):
    """A minimal acyclic automaton in flat arrays.

    Edges of state s lie in ``first[s]:first[s+1]``, sorted by byte; ``skip`` is
    how many words come before those behind the edge.  The sum of skips along a
    word, plus one for each accepting state passed, is its rank, which tells
    where its ids are.
    """

    first: np.ndarray
    accepts: np.ndarray
    label: np.ndarray
    target: np.ndarray
    skip: np.ndarray
    id_at: np.ndarray
    ids: np.ndarray
    root: int

    def edges(self) -> np.ndarray:
        """(state, byte) of every edge as one sorted number."""
        state = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return state * 256 + self.label

    def ranks(self, words: list[bytes], edges: np.ndarray | None = None) -> np.ndarray:
        """Rank of each word in the lexicon, or -1; all words walk in step, a byte at a time."""
        edges = self.edges() if edges is None else edges
        length = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(length) - length
        state = np.full(len(words), self.root, dtype=np.int64)
        rank = np.zeros(len(words), dtype=np.int64)
        going = np.flatnonzero(length > 0)
        step = 0
        while len(going) and len(edges):
            own = state[going]
            want = own * 256 + flat[at[going] + step]
            e = np.minimum(np.searchsorted(edges, want), len(edges) - 1)
            hit = edges[e] == want
            rank[going[~hit]] = -1
            state[going[~hit]] = -1
            going, own, e = going[hit], own[hit], e[hit]
            rank[going] += self.skip[e] + self.accepts[own]
            state[going] = self.target[e]
            step += 1
            going = going[length[going] > step]
        rank[(state < 0) | ~self.accepts[state].astype(bool)] = -1
        return rank

    def output(self, rank: int) -> list[int]:
        return self.ids[self.id_at[rank] : self.id_at[rank + 1]].tolist()


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of some words as one block of 32-bit numbers.

    Words come sorted; when a word leaves a branch, the branch's states are
    final, and each is replaced by an equal earlier one (same acceptance, same
    edges), which makes the automaton minimal as it grows.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    below: list[int] = []

    def settle(accepts: bool, edges: list[tuple[int, int]]) -> int:
        key = (accepts, tuple(edges))
        if key not in known:
            known[key] = len(states)
            states.append(key)
            below.append(accepts + sum(below[t] for _, t in edges))
        return known[key]

    #: The branch of the latest word: [accepts, settled edges, byte that leads on].
    path: list[list] = [[False, [], 0]]
    before = b""
    order = sorted(entries)
    for word in order:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            accepts, edges, _ = path.pop()
            path[-1][1].append((path[-1][2], settle(accepts, edges)))
        for b in word[same:]:
            path[-1][2] = b
            path.append([False, [], 0])
        path[-1][0] = True
        before = word
    while len(path) > 1:
        accepts, edges, _ = path.pop()
        path[-1][1].append((path[-1][2], settle(accepts, edges)))
    root = settle(path[0][0], path[0][1])
    first, label, target, skip = [0], [], [], []
    for _, edges in states:
        n = 0
        for b, t in edges:
            label.append(b)
            target.append(t)
            skip.append(n)
            n += below[t]
        first.append(len(label))
    ids = [entries[w] for w in order]
    columns = [first, [a for a, _ in states], label, target, skip, np.cumsum([0, *map(len, ids)]), [i for own in ids for i in own]]
    columns = [np.asarray(c, dtype=np.int32) for c in columns]
    return np.concatenate([np.array([root, *map(len, columns)], dtype=np.int32), *columns]).tobytes()


def map_lexicon(image: bytes) -> Transducer:
    """Write the image to a file of this process, map it, and unlink the name (the mapping stays)."""
    handle, path = tempfile.mkstemp(suffix=".lexicon")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(image)
        flat = np.memmap(path, dtype=np.int32, mode="r").view(np.ndarray)
    finally:
        os.unlink(path)
    sizes = flat[1:8]
    cuts = 8 + np.concatenate([[0], np.cumsum(sizes)])
    return Transducer(*(flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), root=int(flat[0]))


class Encoder:
    """A vocabulary, a mapped lexicon, and the results of recent runs of text without white space."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.v, self.lexicon = vocabulary, lexicon
        self.edges = lexicon.edges()
        self._forget()
        self.older = (self.ids, self.tokens)

    def _forget(self) -> None:
        #: Ids and tokens of each run, as strings joined by blanks.
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.chars = 0
        #: Whether a run is known that gives no token at all.
        self.blank = False

    def learn(self, runs: set[str]) -> None:
        """Ids and tokens of runs; words go through the lexicon together, the rest is merged."""
        split = {run: self.v.words(run) for run in runs}
        words = list({w for own in split.values() for w in own})
        rank = self.lexicon.ranks([w.encode() for w in words], self.edges)
        hit = np.flatnonzero(rank >= 0)
        unseen = [words[i] for i in np.flatnonzero(rank < 0)]
        order, ids, n = self.v.merged(unseen)
        first, size = self.lexicon.id_at[rank[hit]].astype(np.int64), np.diff(self.lexicon.id_at)[rank[hit]]
        ids = np.concatenate([ids, self.lexicon.ids[np.repeat(first, size) + ranges(size)]])
        named = [unseen[i] for i in order.tolist()] + [words[i] for i in hit.tolist()]
        numbers, tokens = (dict(zip(named, x, strict=True)) for x in self.v.strings(ids, np.concatenate([n, size])))
        for text, keep in ((numbers, self.ids), (tokens, self.tokens)):
            new = {run: text[own[0]] if len(own) == 1 else " ".join([text[w] for w in own]) for run, own in split.items()}
            keep |= new
            self.chars += sum(map(len, new.values()))
            self.blank |= "" in new.values()

    def prepare(self, wanted: set[str]) -> None:
        """Have all wanted runs at hand; runs not used since the last change of generation are forgotten."""
        if self.chars > MEMO_CHARS:
            self.older = (self.ids, self.tokens)
            self._forget()
        missing = wanted - self.ids.keys()
        old_ids, old_tokens = self.older
        again = missing & old_ids.keys()
        for old, keep in ((old_ids, self.ids), (old_tokens, self.tokens)):
            new = {run: old[run] for run in again}
            keep |= new
            self.chars += sum(map(len, new.values()))
            self.blank |= "" in new.values()
        self.learn(missing - again)

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids and decoded text of each whole text, each as one string joined by blanks."""
        v = self.v
        cut = [[(piece, True) if special else (v.runs(piece), False) for piece, special in v.parts(t)] for t in texts]
        self.prepare(set().union(*(runs for own in cut for runs, special in own if not special)))
        out = []
        for own in cut:
            ids: list[str] = []
            tokens: list[str] = []
            for runs, special in own:
                ids += [v.digits[v.special[runs]]] if special else map(self.ids.__getitem__, runs)
                tokens += [runs] if special else map(self.tokens.__getitem__, runs)
            if self.blank:
                ids, tokens = [x for x in ids if x], [x for x in tokens if x]
            out.append((" ".join(ids), " ".join(tokens)))
        return out


@lru_cache(maxsize=1)
def vocabulary(spec: str) -> Vocabulary:
    """The vocabulary of a tokenizer file, kept by the process for its next task."""
    return Vocabulary(spec)


@lru_cache(maxsize=1)
def encoder(spec: str, image: bytes) -> Encoder:
    """The encoder for a vocabulary and a lexicon, kept with what it remembers for the process' next task."""
    return Encoder(vocabulary(spec), map_lexicon(image))


def frequent_words(df: DataFrame, spec: str, text: str = "text", size: int = LEXICON_SIZE) -> list[str]:
    """At most ``size`` of the most frequent words of all texts, sorted; of words with equal counts all or none.

    Tasks send one row per word and batch, so a hot word costs no more than
    others.  Words seen once are merged where they are met.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(spec)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches:
            runs: Counter[str] = Counter()
            for t in b.column(0):
                for piece, special in v.parts(t.as_py() or ""):
                    if not special:
                        runs.update(v.runs(piece))
            words: Counter[str] = Counter()
            for run, n in runs.items():
                for w in v.words(run):
                    words[w] += n
            yield batch(schema, list(words.keys()), list(words.values()))

    counts = df.select(text).mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stash(counts, "words")
    words = [r.word for r in frequent(counts, size).select("word").orderBy("word").collect()]
    unstash(counts)
    return words


def bpe(df: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", lexicon_size: int = LEXICON_SIZE, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns key, n_tokens, ids_sha256, decoded_sha256 per row, in any order, and
    with ``keep_ids`` also ids (array), with ``keep_text`` also decoded.  Null and empty texts give
    0 tokens; repeated rows stay; other columns are not carried.  The tokenizer
    file is read here and travels by broadcast, as executors may not have it.
    """
    text_batches(df.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    v = vocabulary(spec)
    words = frequent_words(df, spec, text, lexicon_size)
    shared = df.sparkSession.sparkContext.broadcast((spec, compile_lexicon({w.encode(): i for w, i in zip(words, v.merge_all(words), strict=True)})))
    kind = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(*shared.value)
        for b in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for c in chunks(b.column(1)):
                for ids, decoded in known.encode([x or "" for x in b.column(1).slice(c.first, c.rows).to_pylist()]):
                    n.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        all_ids.append(np.fromstring(ids, dtype=np.int32, sep=" "))
                    if keep_text:
                        all_text.append(decoded)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                columns.append(pa.array(all_text, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(encode), schema).withColumnRenamed("key", key)
