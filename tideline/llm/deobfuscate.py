"""Toxicity by noisy-channel deobfuscation.

Writers hide words by leetspeak, spacing and repetition. Each suspicious token
becomes a lattice: a symbol may be the letter it looks like or itself, a
separator inside a word (and the gap in a run of single letters) may be dropped
or kept, a run of three or more equal letters stands for one or two. A symbol at
the edge of a token (or alone in a run of single letters) may be a letter or
punctuation, which is dropped. Viterbi
search finds the reading that is likeliest under a character trigram model of
the whole corpus and the channel's costs; plain tokens have one reading and
pass as they are. The restored text is then scored.

The score comes from labels: over a bounded sample of labelled documents
(``sample_rows``), words and word beginnings that stand out in toxic documents
(signed G2 test on document counts, near copies counted once) get log-odds
weights by their token rates; a document's log-likelihood ratio weighs these
against the words that are none; a logistic model turns it into a probability.
The character model counts all documents.

Defined results: null and empty texts are scored like any text without words
(the model's base rate, below 0.5); repeated rows get equal scores; without
any label of both classes every score is 0; an empty table gives an empty
result. Labels, languages, sources and ids are never inputs of a score.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import or_empty, stored

# fixed values: what a symbol can stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "+": "t"}
SEPARATORS = ".-_*~'’"
EDGES = ".,;:!?\"'()[]{}<>#%&*~^`-_=+|/\\$@€’"
SIGNS = frozenset(LEET) & frozenset(EDGES)  # letters or punctuation, at the edge of a word
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
GAP, OTHER = 0, 1
K = len(LETTERS) + 2
_CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x250, dtype=np.int64)
for _c in range(0x250):
    _TABLE[_c] = _CODE.get(chr(_c), OTHER if chr(_c).isalnum() else GAP)
LEET_COST, KEEP_COST, DROP_COST, RUN_COST = 1.0, 2.0, 0.7, 0.7

_WORD = re.compile("[^ \t-\r]+")
_ODD = re.compile(r"[0-9@$!|€+]|(.)\1\1|[^\W\d_][.\-_*~'’][^\W\d_]")
_LETTER = re.compile(r"[^\W\d_]")
_SIGN, _PART = "[" + re.escape("".join(sorted(SIGNS))) + "]", "[" + re.escape(SEPARATORS) + "]?"
_BEFORE, _AFTER = re.compile(f"(?:{_SIGN}{_PART})+\\Z"), re.compile(f"(?:{_PART}{_SIGN})+")
CACHE_WORDS = 800_000


# ------------------------------------------------------------ character model
def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): counts of character trigrams of all texts, gaps merged."""
    ship_package(docs.sparkSession)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(K ** 3, dtype=np.int64)
        for b in batches:
            texts = b["t"].to_numpy()
            for at in range(0, len(texts), 256):
                u = np.frombuffer(f" {' '.join(texts[at:at + 256]).lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
                x = np.where(u < 0x250, _TABLE[np.minimum(u, 0x24F)], OTHER)
                x = np.concatenate([[GAP], x[1:][(x[1:] != GAP) | (x[:-1] != GAP)]])
                if len(x) > 2:
                    total += np.bincount(x[:-2] * K * K + x[1:-1] * K + x[2:], minlength=K ** 3)
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code, "n": total[code]})

    return docs.select(or_empty(text_col).alias("t")).mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame, weight: float = 5.0) -> np.ndarray:
    """log p(c | a, b), interpolated with shorter contexts (at most K**3 counts)."""
    c3 = np.zeros(K ** 3)
    for r in counts.collect():
        c3[r[0]] = r[1]
    c3 = c3.reshape(K, K, K)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + K)
    p2 = (c2 + weight * p1) / (c2.sum(axis=1, keepdims=True) + weight)
    p3 = (c3 + weight * p2[None]) / (c3.sum(axis=2, keepdims=True) + weight)
    return np.log(p3).astype(np.float32)


# ------------------------------------------------------------ lattices
def lattice(core: str) -> list[list[tuple[str, float]]]:
    """Readings (text, cost) for each place of a lower-case token."""
    out: list[list[tuple[str, float]]] = []
    body = core.rstrip(EDGES)
    first, last = len(body) - len(body.lstrip(EDGES)), len(body)  # signs before and after are at the edge
    for m in re.finditer(r"(.)\1*", core, re.S):
        c, n = m[1], len(m[0])
        if c in SIGNS and not first <= m.start() < last:
            out += [[(x, LEET_COST) for x in LEET[c]] + [("", KEEP_COST)]] * n
            continue
        if n >= 3 and c in _CODE:
            out.append([(c, RUN_COST), (c * 2, RUN_COST)])
            continue
        for _ in range(n):
            reads = [(x, LEET_COST) for x in LEET.get(c, "")]
            if c in SEPARATORS:
                reads.append(("", DROP_COST))
                reads.append((" ", DROP_COST))
            else:
                reads.append((c, KEEP_COST if reads else 0.0))
            out.append(reads)
    return out


def spaced(letters: list[str]) -> list[list[tuple[str, float]]]:
    """The lattice of a run of single letters: each gap is dropped or kept."""
    out: list[list[tuple[str, float]]] = []
    for i, x in enumerate(letters):
        out += ([[("", DROP_COST), (" ", DROP_COST)]] if i else []) + lattice(x)
    return out


def viterbi(places: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading of a lattice."""
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(GAP, GAP): (0.0, ())}
    for reads in places:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (s, back) in beam.items():
            for text, cost in reads:
                s2, x, y = s - cost, a, b
                for ch in text:
                    k = _CODE.get(ch, GAP if ch == " " else OTHER)
                    if k == GAP and y == GAP:
                        continue
                    s2, x, y = s2 + float(model[x, y, k]), y, k
                if (x, y) not in new or s2 > new[x, y][0]:
                    new[x, y] = (s2, (back, text))
        beam = new
    s, back = max(((s + (float(model[a, b, GAP]) if b != GAP else 0.0), back) for (a, b), (s, back) in beam.items()), key=lambda z: z[0])
    out = []
    while back:
        back, text = back
        out.append(text)
    return "".join(reversed(out))


def core_of(token: str) -> str:
    """Lower case, without punctuation at the edges, but with the signs there
    that can be letters (a separator may part two of them)."""
    t = token.lower()
    r = t.rstrip(EDGES)
    c = r.lstrip(EDGES)
    if not c:  # signs only
        return "".join(x for x in t if x in SIGNS)
    if len(c) == len(t):
        return c
    before, after = _BEFORE.search(t[:len(r) - len(c)]), _AFTER.match(t[len(r):])
    return (before[0] if before else "") + c + (after[0] if after else "")


def hides(core: str) -> bool:
    """Whether a core may hide a word: odd places beside a letter, or several signs."""
    if _LETTER.search(core):
        return bool(_ODD.search(core))
    return SIGNS.issuperset(core) and len(set(core)) > 1


def bare(core: str) -> str:
    """A core that hides nothing, without signs at its edges."""
    return core if len(core) == 1 else core.strip(EDGES)


def units_of(word: str) -> list[str]:
    """The word itself and its beginnings of 3 to 8 letters, marked by ^."""
    return [word] + ["^" + word[:n] for n in range(3, min(8, len(word)) + 1)]


class Restorer:
    """Restored words of texts; tokens once seen are kept (bounded)."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, tuple[str, ...] | None] = {}
        self.signed: set[str] = set()  # tokens of one letter and signs at its edges: words, or part of a run

    def token(self, token: str) -> tuple[str, ...]:
        """Restored words of one token; a single letter or sign comes back as itself."""
        c = core_of(token)
        if len(c) > 1 and len(c.strip(EDGES)) == 1 and len(self.signed) < CACHE_WORDS:
            self.signed.add(token)
        if len(c) > 1 and hides(c):
            return tuple(viterbi(lattice(c), self.model).split())
        c = bare(c)
        return (c,) if c else ()

    def runs(self, tokens: list[str], single: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(start, end, restored words) of runs of three or more single letters
        or signs, not all one sign; a letter may have signs at its edges.
        ``single`` are the places that may be such."""
        run: list[tuple[int, str]] = []
        for i in [*single, len(tokens) + 1]:
            c = core_of(tokens[i]) if i < len(tokens) else ""
            one = len(c) == 1 or len(c.strip(EDGES)) == 1
            if run and (not one or i != run[-1][0] + 1):
                letters = [x for _, x in run]
                if len(run) >= 3 and (len(set(letters)) > 1 or letters[0] not in SIGNS):
                    yield run[0][0], run[-1][0] + 1, tuple(viterbi(spaced(letters), self.model).split())
                run = []
            if one:
                run.append((i, c))

    def places(self, tokens: list[str], single: list[int]) -> list[int]:
        """``single`` and the places of single letters with signs."""
        if self.signed.isdisjoint(tokens):
            return single
        return sorted({*single, *(i for i, t in enumerate(tokens) if t in self.signed)})

    def words(self, text: str) -> list[str]:
        tokens = _WORD.findall(text)
        known = self.known
        new = {t: self.token(t) for t in set(tokens) if t not in known}
        if len(known) + len(new) <= CACHE_WORDS:
            known.update(new)
        parts = [known[t] if t in known else new[t] for t in tokens]
        single = self.places(tokens, [i for i, p in enumerate(parts) if len(p) == 1 and len(p[0]) == 1])
        if len(single) >= 3:
            for i, j, got in self.runs(tokens, single):
                parts[i:j] = [got] + [()] * (j - i - 1)
        return [w for p in parts for w in p if w not in SIGNS]


# ------------------------------------------------------------ scoring
@dataclass
class ToxicityModel:
    characters: np.ndarray | None = None
    weights: dict[str, float] = field(default_factory=dict)  # unit -> log odds of its tokens
    evidence: dict[str, float] = field(default_factory=dict)  # unit -> G2
    other: float = 0.0  # log odds of a token that is no unit
    slope: float = 0.0
    base: float = -50.0


class Scorer(Restorer):
    def __init__(self, model: ToxicityModel):
        super().__init__(model.characters)
        self.m = model
        self.value: dict[str, float] = {}

    def weight(self, words: tuple[str, ...]) -> float:
        """The weight of the words' best-proved unit (0: none)."""
        best = max((u for w in words for u in units_of(w) if u in self.m.weights), key=self.m.evidence.__getitem__, default=None)
        return self.m.weights[best] if best else 0.0

    def learn(self, tokens: set[str]) -> dict[str, float]:
        """Weights of ``tokens``; nan marks a single letter, which may belong
        to a spaced word. A full store takes no more, so it keeps the frequent ones."""
        new = {}
        for t in tokens:
            if t not in self.value:
                got = self.token(t)
                new[t] = math.nan if len(got) == 1 and len(got[0]) == 1 else self.weight(got)
        if len(self.value) + len(new) <= CACHE_WORDS:
            self.value.update(new)
            return self.value
        return {t: new[t] if t in new else self.value[t] for t in tokens}

    def figures(self, text: str) -> tuple[int, int, float]:
        """(words, hits, sum of the hits' weights) of one text."""
        tokens = _WORD.findall(text)
        try:
            w = np.fromiter(map(self.value.__getitem__, tokens), dtype=np.float64, count=len(tokens))
        except KeyError:
            w = np.fromiter(map(self.learn(set(tokens)).__getitem__, tokens), dtype=np.float64, count=len(tokens))
        single = np.isnan(w)
        n = len(tokens)
        w[single] = 0.0
        places = self.places(tokens, np.flatnonzero(single).tolist())
        if len(places) >= 3:
            for i, j, got in self.runs(tokens, places):
                w[i:j] = 0.0
                w[i] = self.weight(got)
                n -= j - i - len(got)
        hit = w != 0.0
        return n, int(hit.sum()), float(w.sum())

    def ratio(self, text: str) -> float:
        n, hits, s = self.figures(text)
        return min(8.0, max(-8.0, s + (n - hits) * self.m.other))

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, self.m.base + self.m.slope * self.ratio(text)))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, least_evidence: float = 25.0,
          least_ratio: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from the labelled rows of ``labels`` (id, ``toxic``) and their texts
    in ``docs``; ``sample_rows`` bounds how many labelled rows are used."""
    model = ToxicityModel(character_model(character_counts(docs, text_col)))
    use = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    total = use.count()
    if total > sample_rows:  # by a hash of the id, so reruns agree
        use = use.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))
    texts = docs.select(F.col(id_col).alias("__id"), or_empty(text_col).alias("t")).join(F.broadcast(use), "__id")
    texts = stored(texts.select("toxic", "t"), "labelled-texts")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(model.characters)
        for b in batches:
            bag = [Counter(r.words(t)) for t in b["t"]]
            # near copies share their longest words, whatever a few edits did
            alike = [" ".join(sorted(x, key=lambda w: (-len(w), w))[:3]) for x in bag]
            yield pd.DataFrame({"toxic": b["toxic"].to_numpy(), "alike": alike, "words": [list(x) for x in bag],
                                "n": [list(x.values()) for x in bag]})

    seen = texts.mapInPandas(bags, "toxic int, alike string, words array<string>, n array<long>")
    seen = stored(seen.dropDuplicates(["alike", "toxic"]), "labelled-bags")
    docs_by = {r[0]: (r[1], r[2]) for r in seen.groupBy("toxic").agg(
        F.count(F.lit(1)), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)"))).collect()}
    if len(docs_by) < 2 or not docs_by[0][1] or not docs_by[1][1]:
        return model
    (d0, n0), (d1, n1) = docs_by[0], docs_by[1]
    # a document counts once for a unit: its words that share a beginning are summed first within the row
    units = seen.select("toxic", F.monotonically_increasing_id().alias("d"), F.explode(F.arrays_zip("words", "n")).alias("x")).select(
        "toxic", "d", "x.words", "x.n").filter("length(words) > 0")
    units = units.select("toxic", "d", "n", F.explode(F.expr(
        "concat(array(words), transform(filter(array(3, 4, 5, 6, 7, 8), k -> k <= length(words)), k -> concat('^', substring(words, 1, k))))"
    )).alias("unit"))
    per = units.groupBy("unit", "toxic", "d").agg(F.sum("n").alias("n")).groupBy("unit").agg(
        F.sum("toxic").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("m"),
        F.sum(F.expr("case when toxic = 1 then n else 0 end")).alias("t1"), F.sum(F.expr("case when toxic = 0 then n else 0 end")).alias("t0"))
    p = d1 / (d0 + d1)
    g2 = f"2 * (k * ln(k / (m * {p!r}D)) + case when m > k then (m - k) * ln((m - k) / (m * {1 - p!r}D)) else 0 end)"
    found = per.filter(f"k > m * {p!r}D").withColumn("g2", F.expr(g2)).withColumn(
        "w", F.expr(f"ln((t1 + 0.5D) / {n1 + 1}) - ln((t0 + 0.5D) / {n0 + 1})")).filter(
        f"g2 >= {least_evidence!r}D and w >= {math.log(least_ratio)!r}D")
    for r in found.select("unit", "w", "g2").collect():  # bounded by the sample
        model.weights[r[0]], model.evidence[r[0]] = float(r[1]), float(r[2])

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(model)
        for b in batches:
            f = [s.figures(t) for t in b["t"]]
            yield pd.DataFrame({"toxic": b["toxic"].to_numpy(), "n": [x[0] for x in f], "hits": [x[1] for x in f], "s": [x[2] for x in f]})

    got = stored(texts.mapInPandas(figures, "toxic int, n long, hits long, s double"), "labelled-figures")
    rate = {r[0]: (r[1] + 0.5) / (r[2] + 1.0) for r in got.groupBy("toxic").agg(F.sum("hits"), F.sum("n")).collect()}
    model.other = min(0.0, math.log((1 - rate[1]) / (1 - rate[0])))
    ratio = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("s") + (F.col("n") - F.col("hits")) * F.lit(model.other)))
    rows = np.array(got.select("toxic", ratio.alias("x")).collect(), dtype=float)  # bounded by the sample
    model.base, model.slope = _logistic(rows[:, 1], rows[:, 0])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(base, slope) of a one-variable logistic model by Newton steps."""
    order = np.lexsort((y, x))
    x, y, beta = x[order], y[order], np.zeros(2)
    a = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # K**3 floats and the units, both bounded
    state: dict[str, Scorer] = {}

    @F.pandas_udf("double")
    def score(b: pd.Series) -> pd.Series:
        if "s" not in state:
            state["s"] = Scorer(shared.value)
        return pd.Series([state["s"].score(t) for t in b], dtype="float64")

    return docs.withColumn(name, score(or_empty(text_col)))


def restored_text(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "restored") -> DataFrame:
    """``docs`` with the decoded words of every text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.characters)
    state: dict[str, Restorer] = {}

    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        if "r" not in state:
            state["r"] = Restorer(shared.value)
        return pd.Series([" ".join(state["r"].words(t)) for t in b], dtype="object")

    return docs.withColumn(name, run(or_empty(text_col)))
