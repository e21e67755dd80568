"""BPE encoding and decoding over a trie of distinct words.

The last token of a BPE encoding tells the rest: what stands before it is the
encoding of the shorter prefix. So one *last token* for each prefix is a whole
encoding, and words that begin alike share those of their common prefix.

A task inserts the distinct words of its texts into a trie, in sorted order, so
that new nodes come up depth first. A new node's last token is found from the
states above it: among the tokens that end there (an Aho-Corasick walk over the
vocabulary's prefixes names them), exactly one stays apart from the last token
of the node where it begins. Whether two neighbours stay apart is read off the
merges in reverse: undo the later merge of the two edges at their border again
and again; they don't if a pair across the border would have merged earlier.
A shared prefix is computed once, and a word's ids are read back along its path.

Texts are cut into words at white space, which no piece holds, and the
words into the tokenizer's pieces (lower case; letters, one digit, other signs
apart): by one pattern where all characters are Latin-1, by the tokenizer's own
normalizer and splitter elsewhere. Markers such as <|endoftext|> are one id.

Spark deals out the texts; nothing is shuffled. A task holds its trie and the
words' ids, both bounded (``max_nodes``, ``max_words``: a full trie is begun
anew, a full store keeps its words), one batch of texts, and one text's ids.

Defined results: null text counts as empty and has no ids and an empty decoded
text; very long texts and words are coded whole; repeated rows each get their
result; an empty table gives an empty one. All other columns are kept, and the
two new names are lengthened by ``_`` where the table has them.
"""
from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import byte_symbols, free_name, or_empty, split_words
from .packing import default_tokenizer

#: what the tokenizer's splitter cuts, for characters below U+0100
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                    "|[^\\x09-\\x0d\\x20\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
_CLOSE = 1 << 9  # added to the code of a piece's last symbol
_NEVER = 1 << 60
_VOCABULARIES: dict[str, Vocabulary] = {}


class Vocabulary:
    """Tokens and merges of a tokenizer file, as symbol strings.

    A piece is a string of byte symbols whose last one is raised by ``_CLOSE``,
    since the end of a word is part of that symbol.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not end or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("needs a plain BPE vocabulary with word ends")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = max(ids.values()) + 1
        self.born = [-1] * n                      # rank of the merge that makes the token; -1: a symbol
        self.left, self.right = [0] * n, [0] * n  # what it merges
        self.rank: dict[int, int] = {}            # of a pair of tokens, as left << 20 | right
        for r, (a, b) in enumerate(pairs):
            t, a, b = ids[a + b], ids[a], ids[b]
            if self.born[t] >= 0:
                raise ValueError("a token with two merges")
            self.born[t], self.left[t], self.right[t], self.rank[a << 20 | b] = r, a, b, r
        self.text = [""] * n                      # symbol string of a token
        for s, t in ids.items():
            if self.born[t] < 0:
                closed = s.endswith(end) and len(s) > len(end)
                self.text[t] = chr(ord(s[:-len(end)]) + _CLOSE) if closed else s
        for a, b in pairs:
            self.text[ids[a + b]] = self.text[ids[a]] + self.text[ids[b]]
        self.length = [len(s) for s in self.text]
        self.id = {s: t for t, s in enumerate(self.text) if s}
        self.found: dict[str, list[tuple[int, int]] | None] = {s[:k]: None for s in self.id for k in range(1, len(s) + 1)}
        self.neighbours: dict[int, bool] = {}     # apart(), as looked up so far
        self.bytes = byte_symbols()
        self.close = {c: chr(ord(c) + _CLOSE) for c in self.bytes.values()}
        self.marker = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.marker)) + ")") if self.marker else None
        self.shown = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]

    def apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether tokens ``a`` and ``b`` side by side are never merged across
        their border before the merge of rank ``until``."""
        gone_a = gone_b = until
        while True:
            m = self.rank.get(a << 20 | b)
            # of equal ranks the merge further left comes first
            if m is not None and m != until and m < gone_a and m <= gone_b:
                return False
            x, y = self.born[a], self.born[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                gone_a, a = x, self.right[a]
            else:
                gone_b, b = y, self.left[b]

    def beside(self, side: int) -> bool:
        """``apart`` of a last token (negative: none) and the next, as before << 20 | next."""
        ok = self.neighbours[side] = side < 0 or self.apart(side >> 20, side & 0xFFFFF)
        return ok

    def ends(self, state: str) -> list[tuple[int, int]]:
        """Tokens that end a prefix, with their lengths, longest first; ``state`` is
        the prefix's longest end that begins a token."""
        out = self.found[state]
        if out is None:
            out = []
            for k in range(len(state)):
                t = self.id.get(state[k:])
                if t is not None and (self.born[t] < 0 or self.apart(self.left[t], self.right[t], self.born[t])):
                    out.append((t, len(state) - k))
            self.found[state] = out
        return out

    def symbols(self, piece: str) -> str:
        """Symbol string of a piece, given as text."""
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.bytes)
        return piece[:-1] + self.close[piece[-1]]


def vocabulary(path: str | None) -> Vocabulary:
    path = path or default_tokenizer()
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Trie:
    """Nodes with the last token of their prefix; node 0 is the empty prefix."""

    def __init__(self, words: Vocabulary):
        self.v = words
        self.child: dict[int, int] = {}  # node << 10 | symbol
        self.last = array("i", [-1])
        self.reach = array("H", [0])     # length of the prefix's longest end that begins a token

    def __len__(self) -> int:
        return len(self.last)

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """Ids of symbol strings. Given in sorted order, a word goes on from the
        path of the one before it, below the prefix that they share."""
        v, child, last, reach = self.v, self.child, self.last, self.reach
        found, length, known = v.found, v.length, v.neighbours
        path, before = [0], ""
        for w in words:
            k, n = min(len(before), len(w)), len(w)
            while not w.startswith(before[:k]):
                k -= 1
            del path[k + 1:]
            node, j = path[k], k
            for c in map(ord, w[k:]):
                j += 1
                key = node << 10 | c
                below = child.get(key)
                if below is None:
                    k = reach[node] + 1
                    state = w[j - k:j]
                    while state not in found:
                        k -= 1
                        state = w[j - k:j]
                    for t, m in found[state] or v.ends(state):
                        side = last[path[j - m]] << 20 | t
                        if (known[side] if side in known else v.beside(side)):
                            break
                    else:
                        raise ValueError(f"no token ends {state!r}")
                    below = child[key] = len(last)
                    reach.append(k)
                    last.append(t)
                path.append(below)
                node = below
            before, j, out = w, n, []
            while j:
                t = last[path[j]]
                out.append(t)
                j -= length[t]
            out.reverse()
            yield array("I", out).tobytes()


class Coder:
    """Encodes and decodes texts; holds the trie and the ids of words."""

    def __init__(self, path: str | None = None, max_nodes: int = 700_000, max_words: int = 400_000):
        self.v = vocabulary(path)
        self.trie, self.max_nodes, self.max_words = Trie(self.v), max_nodes, max_words
        self.known: dict[str, bytes] = {}

    def pieces(self, word: str) -> list[str | int]:
        """A word's pieces as text, and ids of markers in it."""
        v = self.v
        if v.marks and v.marks.search(word):
            return [x for s in v.marks.split(word) if s for x in ([v.marker[s]] if s in v.marker else self.pieces(s))]
        if max(word) < "\u0100":
            return _PIECE.findall(word.lower())
        whole = v.tokenizer.normalizer.normalize_str(word)
        return [whole[i:j] for _, (i, j) in v.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]

    def _new(self, words: set[str]) -> dict[str, bytes]:
        simple = {w: w.lower() for w in words if w.isascii() and w.isalpha()}
        cut = {w: self.pieces(w) for w in words if w not in simple}
        pieces = {p for x in cut.values() for p in x if isinstance(p, str)}
        pieces.update(simple.values())
        ordered, symbols = sorted(pieces), self.v.symbols
        done: dict[str | int, bytes] = {i: array("I", [i]).tobytes() for i in self.v.marker.values()}
        for at in range(0, len(ordered), 50_000):
            if len(self.trie) > self.max_nodes:
                self.trie = Trie(self.v)
            some = ordered[at:at + 50_000]
            done.update(zip(some, self.trie.encode(map(symbols, some))))
        out = {w: done[p] for w, p in simple.items()}
        out.update((w, b"".join([done[p] for p in x])) for w, x in cut.items())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        docs, known = [split_words(t) for t in texts], self.known
        new = self._new(set().union(*docs).difference(known))
        room = self.max_words - len(known)
        if len(new) <= room:
            known.update(new)
            return [b"".join(map(known.__getitem__, d)) for d in docs]
        known.update(list(new.items())[:room])
        return [b"".join([known[w] if w in known else new[w] for w in d]) for d in docs]

    def decode(self, ids: bytes) -> str:
        """The tokens' texts; this kind of tokenizer joins them by a blank."""
        return " ".join(map(self.v.shown.__getitem__, array("I", ids)))


def _chunks(texts: list[str], chars: int = 1 << 22) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def bpe_coded(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", ids: str = "ids",
              decoded: str = "decoded", max_nodes: int = 700_000, max_words: int = 400_000) -> DataFrame:
    """``docs`` with the ids of each text (little-endian 32-bit) and the text decoded from them."""
    ship_package(docs.sparkSession)
    ids = free_name(docs, ids)
    decoded = free_name(docs.withColumn(ids, F.lit(0)), decoded)
    text = free_name(docs, "__text")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns], or_empty(f"`{text_col}`").alias(text))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    columns, names = docs.columns, schema.names

    def run(batches):
        import pyarrow as pa
        coder = Coder(tokenizer, max_nodes, max_words)
        for b in batches:
            texts = b.column(text).to_pylist()
            for i, j in _chunks(texts):
                coded = coder.encode(texts[i:j])
                part = b.slice(i, j - i)
                cols = [part.column(c) for c in columns]
                cols += [pa.array(coded, pa.binary()), pa.array(list(map(coder.decode, coded)), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return kept.mapInArrow(run, schema)
