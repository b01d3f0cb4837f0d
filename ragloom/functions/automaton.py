"""Which of many terms a text holds: one automaton with failure links, walked by all pieces of many texts in step."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a text that one lane walks, besides those before it that a term may begin in.
PIECE = 512
#: Lanes at most that walk together.
LANES = 1 << 15


class Automaton:
    """States are beginnings of terms; ``onward[state, byte]`` follows failure links already, ``held[state]`` has a bit for each term that ends there."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms) - {""})
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        for k, term in enumerate(self.terms):
            at = 0
            for byte in term.encode():
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                at = children[at][byte]
            ends.setdefault(at, []).append(k)
        self.longest = max((len(t.encode()) for t in self.terms), default=0)
        self.onward = np.zeros((len(children), 256), np.int32)
        self.held = np.zeros((len(children), -(-max(1, len(self.terms)) // 64)), np.uint64)
        for at, own in ends.items():
            for k in own:
                self.held[at, k // 64] |= np.uint64(1 << (k % 64))
        failure, queue = [0] * len(children), deque([0])
        while queue:
            at = queue.popleft()
            # A state goes where its failure goes, unless a term goes on; it holds what its failure holds.
            self.onward[at] = self.onward[failure[at]] if at else 0
            self.held[at] |= self.held[failure[at]] if at else 0
            for byte, child in children[at].items():
                failure[child] = int(self.onward[failure[at], byte]) if at else 0
                self.onward[at, byte] = child
                queue.append(child)
        self.step = self.onward.reshape(-1)

    def walk(self, texts: list[bytes]) -> np.ndarray:
        """A row of bits for each text.

        A text is cut into pieces; each lane begins as far before its piece as a
        term can reach, so no term is lost at a cut, and one found twice is the
        same bit.
        """
        out = np.zeros((len(texts), self.held.shape[1]), np.uint64)
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        base = (np.cumsum(sizes) - sizes)[text]
        start = base + np.maximum(number * PIECE - max(0, self.longest - 1), 0)
        length = base + np.minimum((number + 1) * PIECE, sizes[text]) - start
        for at in range(0, len(text), LANES):
            lanes = np.argsort(-length[at : at + LANES], kind="stable") + at
            place, left = start[lanes], length[lanes]
            state, found = np.zeros(len(lanes), np.int64), np.zeros((len(lanes), out.shape[1]), np.uint64)
            for k in range(int(left[0])):
                n = int(np.searchsorted(-left, -k, side="left"))
                state[:n] = self.step[(state[:n] << 8) + data[place[:n] + k]]
                hit = np.flatnonzero(self.held[state[:n], 0] if found.shape[1] == 1 else self.held[state[:n]].any(axis=1))
                found[hit] |= self.held[state[hit]]
            np.bitwise_or.at(out, text[lanes], found)
        return out

    def lists(self, bits: np.ndarray) -> list[list[str]]:
        flags = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
        return [[self.terms[k] for k in np.flatnonzero(row)] for row in flags]


def terms_held(text: Column, terms: list[str]) -> Column:
    """Those of some terms that a text holds anywhere, in order of the terms; null for a null text.  The vocabulary may be of any size that a task can hold."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Automaton(terms)
        for texts in batches:
            known = texts.notna().to_numpy()
            lists = machine.lists(machine.walk([t.encode() for t in texts[known]]))
            out = pd.Series([None] * len(texts), dtype=object)
            out[np.flatnonzero(known)] = pd.Series(lists, index=np.flatnonzero(known), dtype=object)
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found: Callable[..., Column] = F.pandas_udf(run, T.ArrayType(T.StringType()))
    return found(text)
