"""Quality rules, language ID, toxicity and language-model scoring."""
import collections
import math
import re
import zlib

import numpy as np
import pytest

from tideline.llm import deobfuscate, langid, ngram_trie, quality_rules
from tideline.llm.elias_fano import EliasFano

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(t):
    """The base figures of one text, straight from their definition."""
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_by_hand(spark, messy):
    texts = ["a b c d e f a b c d e f a b c d e", "q w e r t y " * 3, "one two three four five six seven eight nine ten",
             "a a a a a a a a", "x\ny\nx\n \nx", "# $5 | <b> &amp; *"]
    d = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = quality_rules.quality_rules(d).join(d.withColumnRenamed("text", "t").dropDuplicates(["doc_id"]).filter("doc_id is not null"), "doc_id").collect()
    assert len(got) == 12 + len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(r.t), r.t[:60]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_rule_table(spark):
    good = "The old town is by the sea and it has a hill that looks over the bay with a small light on top of it"
    rows = [(1, good), (2, " ".join(w + "###" for w in good.split())), (3, " ".join("zork" + w[::-1] for w in good.split())),
            (4, "\n".join(["same line of the text"] + ["a"] * 12 + [good]))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[1].failed_rules
    assert "symbols_per_word" in got[2].failed_rules and "stop_word_share" in got[3].failed_rules and not got[4].kept
    plan = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_tables(spark, messy):
    none = messy.limit(0)
    assert quality_rules.quality_rules(none).count() == 0
    model = langid.train(none)
    assert langid.predicted(none, model).count() == 0
    assert {r.lang_pred for r in langid.predicted(messy.select("doc_id", "text"), model).collect()} == {"und"}
    tox = deobfuscate.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in deobfuscate.scored(messy.select("text"), tox).collect()} == {0.0}


def test_language_of_messy_rows(spark, messy):
    train = spark.createDataFrame(
        [(t, code) for code, words in (("en", "the and with this that which their"), ("de", "der und mit diese dass welche ihre"),
                                       ("fr", "le et avec cette que leur dans"), ("es", "el y con esta que sus para"))
         for k in range(20) for t in [" ".join(words.split()[(k + j) % 7] for j in range(5 + k % 7))]], "text string, lang string")
    model = langid.train(train)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = langid.predicted(messy, model).collect()
    assert len(got) == 14 and set(messy.columns) < set(got[0].asDict())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["lang_pred"] == "und") == (not letters)
    assert langid.LanguageModel.predict(model, "this and that with the")[0] == "en"
    assert langid.LanguageModel.predict(model, "que leur dans cette")[0] == "fr"
    steps = langid.features("abc " * 100)
    assert abs(np.linalg.norm(steps) - 1) < 1e-9


@pytest.mark.parametrize("text", ["der Fluss und die Stadt mit dem Berg", "die Stadt ist nicht weit von der Küste"])
def test_copies_of_one_text_are_learned_once(spark, text):
    many = [(text, "de")] * 3000 + [(f"der Hund und die Katze {i} nicht mit dem Fluss", "de") for i in range(60)] + [(f"the town and the hill number {i} of this river", "en") for i in range(1500)] + [
        (f"le chat et la ville {i} dans la vallée", "fr") for i in range(40)]
    model = langid.train(spark.createDataFrame(many, "text string, lang string"), rows_per_language=100)
    assert sorted(x for v in model.members.values() for x in v) == ["de", "en", "fr"]
    assert model.predict(text)[0] == "de" and model.predict("the river of this town")[0] == "en"


def test_restores_hidden_words(spark):
    plain = ["stupid idiot clown moron", "the idiot and the clown", "a stupid clown", "morons"] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "doc_id long, text string")
    r = deobfuscate.Restorer(deobfuscate.character_model(deobfuscate.character_counts(docs)))
    assert r.words("1d10t cl0wn") == ["idiot", "clown"]
    assert r.words("an i d i o t !") [1] == "idiot"
    assert r.words("stuuuupid m.o.r.o.n") == ["stupid", "moron"]
    assert r.words("The Clown, 42") == ["the", "clown", "42"]
    got = deobfuscate.restored_text(docs.limit(1), deobfuscate.ToxicityModel(r.model)).first()
    assert got.restored == "stupid idiot clown moron"


def test_restores_signs_at_the_edges(spark):
    plain = ["stupid idiot clown moron", "the idiot and the clown", "a stupid clown", "morons", "shit and ass", "what an ass", "hello town", "see a b and c"] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "doc_id long, text string")
    r = deobfuscate.Restorer(deobfuscate.character_model(deobfuscate.character_counts(docs)))
    for hidden, want in (("!diot", "idiot"), ("|diot", "idiot"), ('"!d1o+."', "idiot"), ("sh!+", "shit"), ("a$$", "ass"), ("@$$", "ass"),
                         ("idio+", "idiot"), ("! d i o t", "idiot"), ("@ s s", "ass"), ("s h i +", "shit"), ("i-d-i-o-+", "idiot"), ("i d i o t!", "idiot"), ("! d! i o t!", "idiot")):
        assert r.words(hidden) == [want], (hidden, r.words(hidden))
    for text, want in (("Hello!", "hello"), ("clown!!!", "clown"), ("the + idiot | clown!", "the idiot clown"), ("town?!", "town"), ("! ! !", ""),
                       ("$42 +7 $$$", "42 7"), ("an idiot!", "an idiot"), ("(clown|)", "clown")):
        assert " ".join(r.words(text)) == want, (text, r.words(text))
    s = deobfuscate.Scorer(deobfuscate.ToxicityModel(r.model, {"idiot": 2.0, "ass": 1.0}, {"idiot": 50.0, "ass": 40.0}))
    for text, weight in (("an !diot", 2.0), ("what an a$$", 1.0), ("the ! d i o t!", 2.0), ("the @ s s and a$$", 2.0), ("Hello! a town!", 0.0)):
        assert s.figures(text)[2] == weight, (text, s.figures(text))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    model = deobfuscate.train(docs, labels.filter(~labels.doc_id.isin(list(held))))
    s = {r.doc_id: r.score for r in deobfuscate.scored(docs.select("doc_id", "text"), model).collect()}
    pos, neg = [s[k] for k, v in held.items() if v == 1], [s[k] for k, v in held.items() if v == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.9
    odd = spark.createDataFrame([(None,), ("",), ("x" * 300_000,)], "text string")
    assert all(0 <= r.score < 0.5 for r in deobfuscate.scored(odd, model).collect())


def test_elias_fano_against_sorted_arrays():
    rng = np.random.default_rng(5)
    for n, u in ((0, 9), (1, 1), (7, 3), (500, 100), (4000, 1 << 40), (12, 2 ** 64 - 1)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = EliasFano.of(v)
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, u, 100, dtype=np.uint64), v[:5] + np.uint64(1)])
        assert (e.successor(q) == np.searchsorted(v, q)).all()


def brute_scores(texts, train):
    """Base and model scores with plain dictionaries (no quantisation)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [WORD.findall((t or "").translate(lower)) + [None] for t in texts]
    c = collections.Counter(w for t, k in zip(toks, train) if k for w in t)
    big = collections.Counter(p for t, k in zip(toks, train) if k for p in zip([()] + t[:-1], t))
    total, kinds = sum(c.values()), len(c)
    n = collections.Counter(big.values())
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    off = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.5 * k for k in (1, 2, 3)]
    # the third tally counts pairs seen exactly three times, the discount serves all of three and more
    seen, back = collections.Counter(), collections.Counter()
    for (h, _), k in big.items():
        seen[h] += k
        back[h] += off[min(k, 3) - 1]
    out = []
    for t in toks:
        base = model = 0.0
        for h, w in zip([()] + t[:-1], t):
            u = (c[w] + 0.1) / (total + 0.1 * (kinds + 1))
            base += math.log10(u)
            k = big[h, w]
            model += math.log10(((k - off[min(k, 3) - 1]) / seen[h] if k else 0) + back[h] / seen[h] * u if seen[h] else u)
        out.append((len(t), sum(c[w] > 0 for w in t), base, model))
    return out


@pytest.mark.parametrize("shard_tokens", [4_000_000, 3000])
def test_trie_scores_against_brute_force(spark, messy, shard_tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        messy.select((messy.doc_id + 10_000).alias("doc_id"), "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    trie = ngram_trie.build_trie(docs.filter("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 10 != 0"),
                                 shard_tokens=shard_tokens, shard_words=shard_tokens // 3)
    assert (len(trie.bounds) > 5) == (shard_tokens == 3000)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_trie.scored(docs, trie).collect())
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_scores([t for _, t in rows], train)))
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[4] - b[4]) <= 0.5 * ngram_trie.STEP * 2 * a[1] + 1e-6
    assert abs(sum(a[4] for a in got) - sum(b[4] for b in want)) / sum(a[1] for a in got) < 0.01


def test_trie_cuts_a_hot_context(spark):
    """A third of all tokens is one word: its successors fill several shards, and no score changes."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"the {a} {b}" for a, b in rng.choice([f"w{k}" for k in range(400)], (40, 2)))) for i in range(100)]
    rows += [(500 + i, "so " * 300) for i in range(10)]  # one successor only, so most of its ranges are empty
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trie = ngram_trie.build_trie(docs, shard_tokens=500)
    o = trie.open()
    for word, least in ((b"the", 8), (b"so", 1)):
        c = int(o.vocabulary.ids([word])[0])
        ranges = [s for s, b in enumerate(trie.bounds) if b >> 32 == c]
        assert len([s for s in ranges if trie.folders[s]]) >= least and c in trie.cut
    sizes = [o.shard(s)[1].n for s, f in enumerate(trie.folders) if f]
    assert max(sizes) <= 500
    new = spark.createDataFrame(rows + [(900, "so the w1 so w2 the unseen so unseen the the so so")], "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_trie.scored(new, trie).drop("text").collect())
    whole = ngram_trie.build_trie(docs)
    assert not whole.cut
    want = sorted(tuple(r) for r in ngram_trie.scored(new, whole).drop("text").collect())
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and math.isclose(a[5], b[5], abs_tol=1e-9), (a, b)


def test_counts_never_wrap():
    for most in (1, 65_535, 65_536, 2**32 - 1, 2**32, 2**40):
        assert int(np.array([most]).astype(ngram_trie.narrowest(most))[0]) == most


def test_places_in_words():
    rng = np.random.default_rng(8)
    words = rng.integers(0, 2**64, 500, dtype=np.uint64) & rng.integers(0, 2**64, 500, dtype=np.uint64)
    words[:3] = [2**64 - 1, 1, 2**63]
    for w, n in zip(words.tolist(), np.bitwise_count(words).tolist()):
        want = [i for i in range(64) if w >> i & 1]
        assert EliasFano._in_word(np.full(n, w, dtype=np.uint64), np.arange(n)).tolist() == want
