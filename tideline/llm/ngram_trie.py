"""Language-model scores from an Elias-Fano n-gram trie (order 2).

Level 1 holds the distinct training words as sorted 64-bit hashes in Elias-Fano
code with their counts; a word's place is its number. Level 2 holds, for each
context word, its successors: monotone pointers (Elias-Fano) say where a
context's run begins, the successors' numbers are coded relative to the run's
start, and a byte holds the quantised log10 of the smoothed probability. Both
levels are cut into shards by range, written to the shared folder and
memory-mapped by the scoring tasks; a lookup reads two pointers and searches
the successor within the context's run.

Probabilities interpolate discounted bigram counts with the unigram base
``(c + 0.1) / (N + 0.1 (V + 1))``; three discounts (for counts 1, 2, and more)
come from the counts of counts. A text is its words and one end token; the
first word's context is the start of the text. All counts cover all training
documents. Counting runs as sorted, merged blobs per range, so a frequent
context is cut by successor ranges and lands in several tasks.

Words are told apart by a 64-bit hash, of which two training words share one
with probability V**2 / 2**65.

Defined results: null text counts as empty (one token, the end); repeated rows
get equal scores; without training rows every token has the unknown word's
probability; an empty table gives an empty result. Only id and text are read.
"""
from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import free_name, mounted, or_empty, own_columns, shared_path, stored
from .elias_fano import EliasFano

START, END, FIRST_WORD = 0, 1, 2
STEP = 0.05  # log10 units of one quantisation step
CACHE_WORDS = 450_000
PARTS = 64
_NONE = np.int64(-1)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


# ------------------------------------------------------------ level 1
@dataclass
class Vocabulary:
    """Level 1: where its shards are, and the totals."""
    bits: int = 0
    folders: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # number of the first word of each shard
    tokens: int = 0
    kinds: int = 0
    ends: int = 0

    def open(self) -> OpenVocabulary:
        return OpenVocabulary(self)


class OpenVocabulary:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.hashes = [EliasFano.mapped(f, "hash") for f in v.folders]
        self.counts = [np.load(os.path.join(f, "count.npy"), mmap_mode="r") for f in v.folders]
        self.starts = np.array(v.starts, dtype=np.int64)
        self.known: dict[bytes, int] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashes (-1: no training word)."""
        out = np.full(len(hashes), _NONE)
        shard = (hashes >> np.uint64(64 - self.v.bits)).astype(np.int64) if self.v.bits else np.zeros(len(hashes), dtype=np.int64)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            ef = self.hashes[s]
            if not ef.n:
                continue
            t = hashes[at] - (np.uint64(s) << np.uint64(64 - self.v.bits) if self.v.bits else np.uint64(0))
            i = ef.successor(t)
            ok = i < ef.n
            ok[ok] = ef.access(i[ok]) == t[ok]
            out[at[ok]] = self.starts[s] + i[ok]
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            new = [w for w in set(words) if w not in self.known]
            got = dict(zip(new, self.find(np.array([word_hash(w) for w in new], dtype=np.uint64)).tolist()))
            if len(self.known) + len(got) <= CACHE_WORDS:  # a full store keeps its frequent words
                self.known.update(got)
                return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            known = self.known
            return np.fromiter((known[w] if w in known else got[w] for w in words), dtype=np.int64, count=len(words))

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training counts by number (0 for unknown words)."""
        out = np.zeros(len(ids), dtype=np.int64)
        out[ids == END] = self.v.ends
        word = np.flatnonzero(ids >= FIRST_WORD)
        shard = np.searchsorted(self.starts, ids[word], side="right") - 1
        for s in np.unique(shard):
            at = word[shard == s]
            out[at] = self.counts[s][ids[at] - self.starts[s]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.v.tokens + 0.1 * (self.v.kinds + 1))


def narrowest(most: int) -> type:
    """The smallest unsigned type that holds counts up to ``most``."""
    return np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64


def _folder(root: str, name: str) -> str:
    """A new folder for one attempt of a task; only those in its result count."""
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def count_words(train: DataFrame, most: int = 400_000) -> DataFrame:
    """(h, n): training counts by word hash, merged within tasks first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(c: Counter) -> pd.DataFrame:
            h = np.fromiter(map(word_hash, c), dtype=np.uint64, count=len(c))
            return pd.DataFrame({"h": h.view(np.int64), "n": np.fromiter(c.values(), dtype=np.int64, count=len(c))})

        c: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                c.update(words_of(t))
                if len(c) > most:
                    yield flush(c)
                    c = Counter()
        if c:
            yield flush(c)

    return train.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def build_vocabulary(train: DataFrame, root: str, shard_words: int = 400_000, hot_share: float = 1 / 4096) -> tuple[Vocabulary, list[tuple[int, int]], list[tuple[int, int]]]:
    """Level 1, the token mass of equal runs of word numbers, and the frequent words' counts."""
    counts = stored(count_words(train), "lm-words")
    kinds, tokens = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    ends = train.count()
    v = Vocabulary(tokens=int(tokens or 0) + ends, kinds=int(kinds) + (ends > 0), ends=ends)
    v.bits = max(0, (max(1, int(kinds)) // shard_words).bit_length())
    hot = max(2, int(v.tokens * hot_share))

    def write(g: pd.DataFrame) -> pd.DataFrame:
        shard = int(g["shard"].iloc[0])
        h = g["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, n = h[order], g["n"].to_numpy()[order]
        path = _folder(root, f"words-{shard}")
        low = np.uint64(shard) << np.uint64(64 - v.bits) if v.bits else np.uint64(0)
        EliasFano.of(h - low).save(path, "hash")
        np.save(os.path.join(path, "count.npy"), n.astype(narrowest(int(n.max()))))
        big = np.flatnonzero(n >= hot)
        calm = np.where(n < hot, n, 0)
        edge = np.linspace(0, len(n), PARTS + 1).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(calm)])
        return pd.DataFrame({"shard": [shard], "folder": [path], "n": [len(n)], "edges": [edge[:-1].tolist()],
                             "mass": [np.diff(total[edge]).tolist()], "hot": [big.tolist()], "hot_n": [n[big].tolist()]})

    shard = F.shiftrightunsigned("h", 64 - v.bits).cast("int") if v.bits else F.lit(0)
    got = counts.withColumn("shard", shard).groupBy("shard").applyInPandas(
        write, "shard int, folder string, n long, edges array<long>, mass array<long>, hot array<long>, hot_n array<long>")
    rows = {r["shard"]: r for r in got.collect()}  # one row a shard; at most 1 / hot_share frequent words
    at, mass, frequent = FIRST_WORD, [], []
    for s in range(1 << v.bits):
        v.starts.append(at)
        if s not in rows:
            path = _folder(root, f"words-{s}")
            EliasFano.of(np.zeros(0, dtype=np.uint64)).save(path, "hash")
            np.save(os.path.join(path, "count.npy"), np.zeros(0, dtype=np.uint32))
            v.folders.append(path)
            continue
        r = rows[s]
        v.folders.append(r["folder"])
        mass += [(at + e, m) for e, m in zip(r["edges"], r["mass"])]
        frequent += [(at + i, n) for i, n in zip(r["hot"], r["hot_n"])]
        at += r["n"]
    if at >= 1 << 32:
        raise ValueError("the vocabulary has more than 2**32 words")
    return v, mass, frequent


# ------------------------------------------------------------ level 2
def range_bounds(mass: list[tuple[int, int]], frequent: list[tuple[int, int]], shard_tokens: int, numbers: int) -> list[int]:
    """First keys (context << 32 | successor) of level-2 shards of about equal
    mass; successors are below ``numbers``."""
    units = [(i << 32, m) for i, m in mass]
    for i, n in frequent:  # cut at even successor numbers: these follow a hash, so the ranges hold about as many pairs
        k = min(max(1, -(-n // shard_tokens)), numbers)
        units += [((i << 32) + j * numbers // k, n // k) for j in range(k)]
        units.append(((i + 1) << 32, 0))
    bounds, held = [0], 0
    for key, m in sorted(units):
        if held and held + m > shard_tokens and key > bounds[-1]:
            bounds.append(key)
            held = 0
        held += m
    return bounds


def _split(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    cut = np.append(np.searchsorted(keys, bounds), len(keys))
    return pd.DataFrame([(s, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes())
                         for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a], columns=["shard", "keys", "counts"])


def pair_keys(texts: list[str], vocabulary: OpenVocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, document ends) of texts put one after the other."""
    docs = [words_of(t) for t in texts]
    n = np.array([len(w) + 1 for w in docs], dtype=np.int64)
    ids = vocabulary.ids([w for d in docs for w in d])
    stop = np.cumsum(n)
    token = np.empty(int(stop[-1]) if len(n) else 0, dtype=np.int64)
    is_end = np.zeros(len(token), dtype=bool)
    is_end[stop - 1] = True
    token[is_end], token[~is_end] = END, ids
    context = np.concatenate([[START], token[:-1]])
    context[stop[:-1]] = START
    return context, token, stop


def count_pairs(train: DataFrame, v: Vocabulary, bounds: list[int], chunk: int = 2_500_000) -> DataFrame:
    """(shard, keys, counts): sorted distinct pairs of each task as blobs by range."""
    limits = np.array(bounds, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, held, size = v.open(), [], 0

        def flush() -> pd.DataFrame:
            return _split(*np.unique(np.concatenate(held), return_counts=True), limits)

        for b in batches:
            texts = b["t"].tolist()
            for at in range(0, len(texts), 512):
                c, w, _ = pair_keys(texts[at:at + 512], vocabulary)
                held.append(c.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64))
                size += len(c)
                if size > chunk:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return train.mapInPandas(run, "shard int, keys binary, counts binary")


def _tallies(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _kinds(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts (sorted), and how many successors with count 1, 2, more each has."""
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, dtype=np.int64)
    kind = np.stack([np.add.reduceat((counts == 1).astype(np.int64), first), np.add.reduceat((counts == 2).astype(np.int64), first),
                     np.add.reduceat((counts > 2).astype(np.int64), first)], axis=1) if len(first) else np.zeros((0, 3), dtype=np.int64)
    return context[first], kind


@dataclass
class Trie:
    vocabulary: Vocabulary
    bounds: list[int] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    cut: dict[int, int] = field(default_factory=dict)  # quantised backoff of each context cut by successor ranges

    def open(self) -> OpenTrie:
        return OpenTrie(self)


def build_trie(docs: DataFrame, text_col: str = "text", shard_tokens: int = 4_000_000, shard_words: int = 400_000) -> Trie:
    """The trie over all rows of ``docs``, in the shared folder."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    root = mounted(shared_path(spark, "lm-trie"))
    os.makedirs(root, exist_ok=True)
    train = docs.select(or_empty(text_col).alias("t"))
    v, mass, frequent = build_vocabulary(train, root, shard_words)
    trie = Trie(v)
    if not v.tokens:
        return trie
    often = [(START, v.ends), *frequent]
    bounds = range_bounds(mass, often, shard_tokens, FIRST_WORD + v.kinds)
    limits = bounds + [1 << 64]
    edge_contexts = {b >> 32 for b in bounds}

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        shard = int(g["shard"].iloc[0])
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in g["keys"]])
        counts = np.concatenate([np.frombuffer(x, dtype="<u4") for x in g["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        context, token = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        c0, c1 = limits[shard] >> 32, int(context[-1])
        pointer = np.searchsorted(context, np.arange(c0, c1 + 2))
        run = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        last = token[np.append(run[1:], len(token)) - 1]
        base = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(last)[:-1]])
        relative = token + np.repeat(base, np.diff(np.append(run, len(token))))
        path = _folder(root, f"pairs-{shard}")
        EliasFano.of(pointer.astype(np.uint64)).save(path, "pointer")
        EliasFano.of(relative).save(path, "successor")
        np.save(os.path.join(path, "count.npy"), counts.astype(narrowest(int(counts.max()))))
        at, kind = _kinds(context, counts)
        edge = [(int(c), *map(int, k)) for c, k in zip(at[[0, -1]], kind[[0, -1]]) if int(c) in edge_contexts]
        return pd.DataFrame({"shard": [shard], "folder": [path], "tally": [_tallies(counts)],
                             "edge": [[x for e in sorted(set(edge)) for x in e]]})

    done = stored(count_pairs(train, v, bounds).groupBy("shard").applyInPandas(
        merge, "shard int, folder string, tally array<long>, edge array<long>"), "lm-pairs")
    rows = {r["shard"]: r for r in done.collect()}  # one row a shard
    n1, n2, n3, n4 = np.sum([r["tally"] for r in rows.values()], axis=0).tolist()
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    discount = [float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) if a else 0.5 * k
                for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    shared: dict[int, np.ndarray] = {c: np.zeros(3, dtype=np.int64) for c in edge_contexts}
    for r in rows.values():
        for c, *k in np.reshape(r["edge"], (-1, 4)).tolist():
            shared[c] += k
    inner, seen_of = {b >> 32 for b in bounds if b & 0xFFFFFFFF}, dict(often)
    trie.cut = {c: int(quantised(shared[c] @ np.array(discount) / seen_of[c])) for c in sorted(inner) if shared[c].sum()}

    def price(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Quantised probabilities of one shard's pairs, and its contexts' backoff weights."""
        vocabulary = v.open()
        for b in batches:
            for shard, folder in zip(b["shard"], b["folder"]):
                pointer, successor = EliasFano.mapped(folder, "pointer"), EliasFano.mapped(folder, "successor")
                counts = np.asarray(np.load(os.path.join(folder, "count.npy"))).astype(np.int64)
                p = pointer.access(np.arange(pointer.n)).astype(np.int64)
                c0 = limits[shard] >> 32
                context = np.repeat(np.arange(c0, c0 + len(p) - 1), np.diff(p))
                relative = successor.access(np.arange(successor.n))
                start = p[context - c0]
                base = np.where(start > 0, relative[np.maximum(start - 1, 0)], np.uint64(0))
                token = (relative - base).astype(np.int64)
                at, kind = _kinds(context, counts)
                for i in np.flatnonzero([int(c) in shared for c in at]):
                    kind[i] = shared[int(at[i])]
                seen = vocabulary.count(at)
                seen[at == START] = v.ends
                back = kind @ np.array(discount) / seen
                weight = np.ones(len(p) - 1)
                weight[at - c0] = back
                for c, k in shared.items():  # a cut context may have no successor in this range
                    if c0 <= c < c0 + len(weight) and k.sum():
                        n = v.ends if c == START else int(vocabulary.count(np.array([c]))[0])
                        weight[c - c0] = float(k @ np.array(discount)) / n
                i = context - c0
                total = np.zeros(len(p) - 1)
                total[at - c0] = seen
                off = np.array(discount)[np.minimum(counts, 3) - 1]
                prob = (counts - off) / total[i] + weight[i] * vocabulary.base(vocabulary.count(token))
                out = _folder(root, f"prices-{shard}")
                np.save(os.path.join(out, "pair.npy"), quantised(prob))
                np.save(os.path.join(out, "back.npy"), quantised(weight))
                yield pd.DataFrame({"shard": [shard], "folder": [folder], "prices": [out]})

    todo = spark.createDataFrame([(s, r["folder"]) for s, r in rows.items()], "shard int, folder string")
    priced = stored(todo.repartition(max(1, len(rows)), "shard").mapInPandas(price, "shard int, folder string, prices string"), "lm-prices")
    where = {r["shard"]: f"{r['folder']}|{r['prices']}" for r in priced.collect()}
    trie.bounds, trie.folders = bounds, [where.get(s, "") for s in range(len(bounds))]
    return trie


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 255).astype(np.uint8)


class OpenTrie:
    """Memory-mapped levels and their search."""

    def __init__(self, t: Trie):
        self.vocabulary = t.vocabulary.open()
        self.bounds = np.array(t.bounds, dtype=np.uint64)
        self.folders = t.folders
        self.cut = np.array(list(t.cut), dtype=np.int64)  # sorted
        self.cut_back = np.array(list(t.cut.values()), dtype=np.float64)
        self.shards: dict[int, tuple] = {}

    def shard(self, s: int):
        if s not in self.shards:
            a, _, b = self.folders[s].partition("|")
            self.shards[s] = (EliasFano.mapped(a, "pointer"), EliasFano.mapped(a, "successor"),
                              np.load(os.path.join(b, "pair.npy"), mmap_mode="r"), np.load(os.path.join(b, "back.npy"), mmap_mode="r")) if a else None
        return self.shards[s]

    def log10(self, context: np.ndarray, token: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 P(token | context) by successor search within each context's run."""
        out = base.copy()
        known = np.flatnonzero((context >= 0) & (len(self.folders) > 0))
        key = context[known].astype(np.uint64) << np.uint64(32) | np.maximum(token[known], 0).astype(np.uint64)
        # an unknown token has no place; its context's weight is found where token 0 would be
        distinct, inverse = np.unique(key, return_inverse=True)
        price, weight = np.full(len(distinct), np.nan), np.zeros(len(distinct))
        cut = np.append(np.searchsorted(distinct, self.bounds), len(distinct))
        for s in np.flatnonzero(np.diff(cut)):
            got = self.shard(int(s))
            if got is None:
                continue
            pointer, successor, pair, back = got
            k = distinct[cut[s]:cut[s + 1]]
            i = (k >> np.uint64(32)).astype(np.int64) - int(self.bounds[s] >> np.uint64(32))
            inside = np.flatnonzero(i < pointer.n - 1)
            i, want = i[inside], (k & np.uint64(0xFFFFFFFF))[inside]
            lo, hi = pointer.access(i).astype(np.int64), pointer.access(i + 1).astype(np.int64)
            start = np.where(lo > 0, successor.access(np.maximum(lo - 1, 0)), np.uint64(0))
            at = np.maximum(successor.successor(start + want), lo)
            hit = np.flatnonzero(at < hi)
            hit = hit[successor.access(at[hit]) == (start + want)[hit]]
            place = cut[s] + inside
            weight[place] = -STEP * back[i].astype(np.float64)
            price[place[hit]] = -STEP * pair[at[hit]].astype(np.float64)
        if len(self.cut):  # such a context has one weight, also where a range holds none of its pairs
            c = (distinct >> np.uint64(32)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.cut, c), len(self.cut) - 1)
            same = self.cut[at] == c
            weight[same] = -STEP * self.cut_back[at[same]]
        price, weight = price[inverse], weight[inverse]
        miss = np.isnan(price) | (token[known] < 0)
        out[known] = np.where(miss, weight + base[known], price)
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        context, token, stop = pair_keys(texts, self.vocabulary)
        doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], stop])))
        counts = self.vocabulary.count(token)
        base = np.log10(self.vocabulary.base(counts))
        price = self.log10(context, token, base)
        n = len(texts)
        return (np.bincount(doc, minlength=n), np.bincount(doc, weights=counts > 0, minlength=n).astype(np.int64),
                np.bincount(doc, weights=base, minlength=n), np.bincount(doc, weights=price, minlength=n))


def scored(docs: DataFrame, trie: Trie, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    ship_package(docs.sparkSession)
    state: dict[str, OpenTrie] = {}

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def run(b: pd.Series) -> pd.DataFrame:
        if "t" not in state:
            state["t"] = trie.open()
        texts, out = b.tolist(), []
        for at in range(0, len(texts), 512):
            out.append(np.stack([x.astype(np.float64) for x in state["t"].scores(texts[at:at + 512])], axis=1))
        f = pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 4)), columns=["n_tokens", "n_known", "base_score", "score"])
        return f.astype({"n_tokens": "int64", "n_known": "int64"})

    got = free_name(docs, "__s")
    out = docs.withColumn(got, run(or_empty(text_col)))
    return out.select(*own_columns(docs), f"{got}.n_tokens", f"{got}.n_known", F.lit(trie.vocabulary.tokens).cast("long").alias("train_tokens"),
                      f"{got}.base_score", f"{got}.score")


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a trie over those that are not ``held_out``."""
    trie = build_trie(docs.filter(~held_out), text_col)
    return scored(docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")), trie).drop("text")
