"""BPE over a trie, periodic runs by recompression, importance resampling."""
import collections
import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm import bpe_trie, catalog, importance, recompression
from tideline.llm.packing import default_tokenizer

LIBRARY = Tokenizer.from_file(default_tokenizer())
HARD = ["Hello <|endoftext|> World's  Straße ½ 12 ΟΔΟΣ x!? İSTANBUL ﬁ é é ́x aaa'S a b\u0085c \x00\x1c\x7f<|ENDOFTEXT|>z<|startoftext|>'ll",
        "", " \t\r\n", "日本語 テスト 🎉🎉", "a" * 3000, "ab" * 1000 + "'t" * 50, "�", "\xa0x\xa0  y ", "they'll we're I'd IT'S 'tis don''t", "1½2 x²y _a_ a_b",
        "antidisestablishmentarianism internationalization", "Ǆ ŉ ẞ ϴ Ω K"]


# ------------------------------------------------------------ BPE
def same_as_library(texts, **how):
    coder = bpe_trie.Coder(**how)
    for t, ids in zip(texts, coder.encode(texts)):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert array("I", ids).tolist() == want, t[:80]
        assert coder.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_bpe_equals_the_library():
    rng = random.Random(7)
    texts = HARD + ["".join(rng.choice("abcdeghinorstu'0.,é “\x1d") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    same_as_library(texts)
    same_as_library(texts, max_nodes=50, max_words=20)  # full trie and full store


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(t):
    same_as_library([t, t + " " + t])


def test_neighbours_that_would_merge_are_not_apart():
    v = bpe_trie.vocabulary(None)
    for pair in list(v.rank)[:2000]:
        assert not v.apart(pair >> 20, pair & 0xFFFFF)


def test_bpe_shares_prefixes():
    trie = bpe_trie.Trie(bpe_trie.vocabulary(None))
    words = sorted(trie.v.symbols(w) for w in ("nation", "nations", "national", "nationality"))
    assert len(list(trie.encode(words))) == 4
    # one node for each distinct prefix: letters of the longest word, a closing one for each word, the root
    assert len(trie) == len({w[:k] for w in words for k in range(len(w) + 1)}) == 15


def test_bpe_of_messy_rows(spark, messy):
    got = bpe_trie.bpe_coded(messy.withColumnRenamed("size", "ids"))
    assert set(messy.columns) - {"size"} < set(got.columns) and {"ids", "ids_", "decoded"} < set(got.columns)
    rows = got.collect()
    assert len(rows) == messy.count() == 14
    for r in rows:
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert array("I", r["ids_"]).tolist() == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
        assert r.ids == 1
    assert bpe_trie.bpe_coded(messy.limit(0)).count() == 0


def test_bpe_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in catalog.op11_bpe_trie(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ------------------------------------------------------------ runs
def brute_runs(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                best.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, kinds = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 30])
    w = [rng.randrange(kinds) for _ in range(n)]
    if n > 3 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return [b"%d" % x for x in w]


@pytest.mark.parametrize("pairs,least", [(1_000_000, 12), (60, 12), (1_000_000, 2)])
def test_runs_equal_brute_force(monkeypatch, pairs, least):
    monkeypatch.setattr(recompression, "CHUNK_PAIRS", pairs)
    rng = random.Random(pairs + least)
    docs = [some_words(rng) for _ in range(600)] + [[b"a"] * 500, [b"a", b"b"] * 300, []]
    for at in range(0, len(docs), 67):
        some = docs[at:at + 67]
        for d, r in zip(some, recompression.search(some, least)):
            assert [tuple(x) for x in r.tolist()] == brute_runs(d, least)


def test_grammar_derives_its_words_and_answers_extensions():
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.integers(0, 3, 300), np.tile(rng.integers(0, 3, 7), 40), np.zeros(100, np.int64), [3]])
    g = recompression.Grammar(s)
    while len(g.level[-1]) > 1:
        g.grow()
    for h, first in enumerate(g.first):  # equal symbols have equal children
        kids = collections.defaultdict(set)
        for k, name in enumerate(g.level[h + 1].tolist()):
            kids[name].add(tuple(g.level[h][first[k]:first[k + 1]].tolist()))
        assert all(len(v) == 1 for v in kids.values())
    x = rng.integers(0, len(s) - 1, 2000)
    y = rng.integers(0, len(s) - 1, 2000)
    x, y = x[x < y], y[x < y]
    got = g.extension(x, y, 1)
    for i, j, n in zip(x, y, got):
        k = 0
        while j + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        assert n == k


def test_runs_of_messy_rows(spark, messy):
    got = recompression.periodic_runs(messy.withColumnRenamed("size", "collapsed")).collect()
    assert len(got) == 14 and got[0].collapsed == 1
    for r in got:
        assert r.collapsed_ == " ".join((r.text or "").split()) if r.text and r.text.isascii() else True
        assert r.runs == []
    t = "x y " + "a b c " * 5 + "z"
    (r,) = recompression.periodic_runs(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(2, 15, 3)] and r.collapsed == "x y a b c z"
    assert recompression.periodic_runs(messy.limit(0)).count() == 0


def test_runs_query_makes_periods(spark):
    words = [f"w{i}" for i in range(50)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0] + [None, 1]
    d = spark.createDataFrame([(i, " ".join(words)) for i in ids], "doc_id long, text string")
    for r in catalog.with_periods(d).collect():
        h = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"")
        g, w = h // 10, words
        if h % 10 == 0:
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            w = [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
        assert r.text == " ".join(w)


# ------------------------------------------------------------ importance
def plain_words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_buckets(t, k):
    w = plain_words(t)
    return [zlib.crc32(x.encode()) % k for x in w + [a + " " + b for a, b in zip(w, w[1:])]]


def test_crc_columns():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 300):
        rows = rng.integers(0, 256, (20, n), dtype=np.uint8)
        assert importance.crc_columns(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


@pytest.mark.parametrize("chunk", [400_000, 5])
def test_features_by_hand(monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK_WORDS", chunk)
    texts = ["", "a", "A b", "É日本 x-1 ..", "z" * 9000 + " q " + "y" * 5000, "ab cd " * 20, "...", "the The THE", "a b c d e f g h i j k l m"]
    for t, (n, found) in zip(texts, importance._hashed(texts, 1000), strict=True):
        assert n == len(plain_words(t)) and sorted(found.tolist()) == sorted(plain_buckets(t, 1000))


def plain_resample(docs, target, k, seed, percent, least):
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(plain_buckets(x, k))
    for x in target:
        t.update(plain_buckets(x, k))
    S, N = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        f = plain_buckets(x, k)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (N * 0 + S + k) / ((s[b] + 1) * (N + k)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(x))))
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = may[:len(may) * percent // 100]
    ranks = {id(r): n + 1 for n, r in enumerate(drawn)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def resampled(spark, docs, target, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' as part", "1 as score")
    b = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in importance.resampled(d, b, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_a_plain_one(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary[i % 3 * 10:], k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (None, " ".join(vocabulary)), (1002, "x" * 5000 + " y" * 30)]
    target = [" ".join(rng.choices(vocabulary[20:30], k=25)) for _ in range(20)] + [None]
    how = dict(buckets=500, seed=7, percent=25, min_words=20)
    got = resampled(spark, docs, target, **how)
    assert got == plain_resample(docs, target, 500, 7, 25, 20)
    drawn = [r for r in got if r[4]]
    assert sorted(r[4] for r in drawn) == list(range(1, len(drawn) + 1))
    # no target, no documents
    assert resampled(spark, docs[:30], [], **how) == plain_resample(docs[:30], [], 500, 7, 25, 20)
    assert resampled(spark, [], target, **how) == []


def test_hashed_features_wait_in_no_queue(spark):
    """Counts and weights read Arrow batches, a slice at a time, beside a plain sum."""
    rng = np.random.default_rng(5)
    rows = [(i, 3, n, rng.integers(0, 90, n).astype("<u2").tobytes()) for i, n in enumerate([0, 1, 700, 2, 0, 0, 65, 64, 5000, 0])]
    features = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, buckets binary").coalesce(1)
    gain = rng.integers(-2000, 2000, 90)
    found = [np.frombuffer(r[3], "<u2") for r in rows]
    assert importance.bucket_counts(features, 90).tolist() == np.bincount(np.concatenate(found), minlength=90).tolist()
    out = importance.weighted(features, gain)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight"]
    assert sorted(tuple(r) for r in out.collect()) == [(*r[:3], int(gain[x].sum()) // len(x) if len(x) else 0) for r, x in zip(rows, found)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("kind", ["binary", "large_binary"])
def test_slices_of_hashed_features(monkeypatch, kind):
    monkeypatch.setattr(importance, "CHUNK_FEATURES", 6)
    rows = [[], [1, 2], [3, 4, 5, 6], [], [7] * 9, [8], [], [9, 9]]
    column = pa.array([np.array(r, "<u2").tobytes() for r in rows], getattr(pa, kind)())
    for from_row in range(len(rows) + 1):
        got = [(x.tolist(), ends.tolist()) for x, ends in importance._slices(column.slice(from_row), "<u2")]
        assert [x[i:j] for x, ends in got for i, j in zip(ends, ends[1:])] == rows[from_row:]
        assert all(len(x) <= 6 or len(ends) == 2 for x, ends in got)


def test_repeated_rows_are_drawn_each(spark):
    text = " ".join(f"q{i}" for i in range(25))
    got = resampled(spark, [(5, text)] * 4 + [(6, text)] * 4, ["q1 q2"], buckets=100, percent=50)
    assert len(got) == 8 and sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4]
