"""Periodic runs of words, found over a run-length grammar.

A run is a maximal stretch of words with smallest period q that is at least
``max(min_words, 2 * q)`` long. Recompression turns the words of a chunk of
texts into a grammar: *block compression* replaces every maximal block a^k by one
symbol, *pair compression* deals the symbols into left and right ones and
replaces every adjacent left-right pair; the two alternate. Both look only at
neighbouring symbols, so equal stretches are parsed alike but at their ends.

Candidates come from a harmonic grid: a run of period q holds a multiple i of
``max(q, min_words - q)`` with i and i + q both inside, so n log n pairs (i, i + q)
of equal words cover all runs of a text. How far a pair's match extends either
way is an LCE query on the grammar, exact and without a suffix array: climb while
the symbols agree and both stand at their parents' edge, stepping over the rest
of a block at once; where they differ, go down to the words again. All queries
of a chunk climb together, one array operation a level, and levels are only
made while a query still needs them.

A unique mark parts the texts, so no match crosses them. Spark deals out the
texts; nothing is shuffled. A task holds a chunk of ``CHUNK_WORDS`` words (a longer
text alone) with about ten integers for each word and at most ``CHUNK_PAIRS``
candidates at a time.

Defined results: null and blank texts have no words and no runs, and an empty
collapsed text; very long texts are searched whole; repeated rows each get
their result; an empty table gives an empty one. All other columns are kept, and
new names are lengthened by ``_`` where the table has them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import free_name, or_empty

CHUNK_WORDS = 300_000
CHUNK_PAIRS = 1_000_000
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _names(key: np.ndarray) -> np.ndarray:
    return pd.factorize(key)[0].astype(np.int64)


class Grammar:
    """Levels of symbols. ``first[h]`` has the first child in level ``h`` of each
    symbol of level ``h + 1`` (and the level's length at its end), ``parent[h]``
    the symbol above. Rules of even levels are blocks, of odd ones pairs."""

    def __init__(self, symbols: np.ndarray):
        self.level = [symbols]
        self.first: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []

    def grow(self) -> None:
        s, h = self.level[-1], len(self.first)
        starts = np.ones(len(s), dtype=bool)
        if h % 2 == 0:
            starts[1:] = s[1:] != s[:-1]
            first = np.flatnonzero(starts)
            size = np.diff(first, append=len(s))
            above = _names(s[first] * (int(size.max()) + 1) + size)
        else:
            side = ((s * 0x9E3779B1 + h * 0x85EBCA77) >> 15) & 1  # 0: left, 1: right
            if np.count_nonzero(side[:-1] > side[1:]) > np.count_nonzero(side[:-1] < side[1:]):
                side = 1 - side  # the way that replaces more pairs
            starts[1:] = side[:-1] >= side[1:]
            first = np.flatnonzero(starts)
            size = np.diff(first, append=len(s))
            second = np.where(size == 2, s[np.minimum(first + 1, len(s) - 1)] + 1, 0)
            above = _names(s[first] * (int(s.max()) + 2) + second)
        self.first.append(np.append(first, len(s)))
        self.parent.append(np.cumsum(starts) - 1)
        self.level.append(above)

    def _move(self, h: int, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """Symbols that two equal positions can be stepped on by."""
        if h % 2 or h == len(self.first):
            return np.full(len(x), way)
        up, first = self.parent[h], self.first[h]
        if way > 0:
            return np.minimum(first[up[x] + 1] - x, first[up[y] + 1] - y)
        return -np.minimum(x - first[up[x]], y - first[up[y]]) - 1

    def _at_edge(self, h: int, x: np.ndarray, way: int) -> np.ndarray:
        up, first = self.parent[h], self.first[h]
        return first[up[x]] == x if way > 0 else first[up[x] + 1] == x + 1

    def extension(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """How many symbols agree from ``x`` and ``y`` on (``way`` 1) or back (-1)."""
        begin, x, y = x, x.copy(), y.copy()
        stopped: list[np.ndarray] = []
        climbing = np.arange(len(x))
        h = 0
        while len(climbing):
            s, differ, risen, todo = self.level[h], [], [], climbing
            if h == len(self.first) and (s[x[todo]] == s[y[todo]]).any():
                self.grow()
            while len(todo):
                same = s[x[todo]] == s[y[todo]]
                differ.append(todo[~same])
                todo = todo[same]
                if not len(todo):
                    break
                edge = self._at_edge(h, x[todo], way) & self._at_edge(h, y[todo], way)
                risen.append(todo[edge])
                todo = todo[~edge]
                move = self._move(h, x[todo], y[todo], way)
                x[todo] += move
                y[todo] += move
            stopped.append(np.concatenate(differ))
            climbing = np.concatenate(risen) if risen else climbing[:0]
            if len(climbing):
                x[climbing] = self.parent[h][x[climbing]]
                y[climbing] = self.parent[h][y[climbing]]
            h += 1
        down = np.zeros(0, dtype=np.int64)
        for h in range(len(stopped) - 1, 0, -1):
            down = np.concatenate([down, stopped[h]])
            first, s = self.first[h - 1], self.level[h - 1]
            for p in (x, y):
                p[down] = first[p[down]] if way > 0 else first[p[down] + 1] - 1
            todo = down
            while len(todo):
                todo = todo[s[x[todo]] == s[y[todo]]]
                move = self._move(h - 1, x[todo], y[todo], way)
                x[todo] += move
                y[todo] += move
        return (x - begin) * way


def grid(sizes: np.ndarray, begins: np.ndarray, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (position, period) of the harmonic grids of texts of ``sizes`` words
    that begin at ``begins``, some at a time."""
    periods = np.where(sizes >= min_words, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(q, min_words - q)
    count = (sizes[text] - q + step - 1) // step  # positions below size - q
    upto = np.cumsum(count)
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_PAIRS)))
        n = count[at:to]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(begins[text[at:to]], n) + k * np.repeat(step[at:to], n), np.repeat(q[at:to], n)
        at = to


def find_runs(codes: list[np.ndarray], min_words: int = 12) -> list[np.ndarray]:
    """Runs (start, length, period) of each text, by start, then period."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes  # a mark before each text, and one at the end
    words = np.concatenate([np.append([-1], c) for c in codes] + [[-1]]).astype(np.int64)
    marks = np.flatnonzero(words < 0)
    words[marks] = int(words.max(initial=0)) + 1 + np.arange(len(marks))
    grammar, found = Grammar(words), []
    for i, q in grid(sizes, begins, min_words):
        equal = np.flatnonzero(words[i] == words[i + q])
        i, q = i[equal], q[equal]
        ahead = grammar.extension(i, i + q, 1)
        back = grammar.extension(i - 1, i + q - 1, -1)
        length = back + ahead + q
        is_run = length >= np.maximum(min_words, 2 * q)
        found.append(np.stack([(i - back)[is_run], length[is_run], q[is_run]], axis=1))
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    # the same stretch found with a multiple of its period, or from several grid positions
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cuts = np.searchsorted(runs[:, 0], begins)
    return [r - [b, 0, 0] for r, b in zip(np.split(runs, cuts[1:]), begins)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if len(runs):
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def _chunks(texts: list[str]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for t in texts:
        held.append(t.encode().split())  # bytes are split at ASCII white space only
        size += len(held[-1])
        if size >= CHUNK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: list[list[bytes]], min_words: int = 12) -> list[np.ndarray]:
    flat = [w for d in docs for w in d]
    codes = _names(np.array(flat, dtype=object)) if flat else np.zeros(0, dtype=np.int64)
    return find_runs(np.split(codes, np.cumsum([len(d) for d in docs])[:-1]), min_words)


def periodic_runs(docs: DataFrame, min_words: int = 12, text_col: str = "text", runs: str = "runs",
                  rest: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each text and the text without their repeats."""
    ship_package(docs.sparkSession)
    runs = free_name(docs, runs)
    rest = free_name(docs.withColumn(runs, F.lit(0)), rest)
    text = free_name(docs, "__text")
    schema = T.StructType([*docs.schema.fields, T.StructField(runs, RUNS), T.StructField(rest, T.StringType())])

    columns, names = docs.columns, schema.names

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            at = 0
            for words in _chunks(b.column(text).to_pylist()):
                got = search(words, min_words)
                part = b.slice(at, len(words))
                cols = [part.column(c) for c in columns]
                cols.append(pa.array([[dict(zip(("start", "length", "period"), x)) for x in r.tolist()] for r in got], kind))
                cols.append(pa.array([collapsed(w, r).decode() for w, r in zip(words, got)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(words)

    return docs.select("*", or_empty(f"`{text_col}`").alias(text)).mapInArrow(run, schema)
