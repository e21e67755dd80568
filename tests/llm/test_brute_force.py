"""op4, op6 and op7 against plain versions: loops over characters, rows and readings."""
import itertools
import math
import os
import random
import re
import struct
import subprocess
import sys

import numpy as np
import pytest
import xxhash

from tideline.llm import deobfuscate, langid, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
U64 = (1 << 64) - 1


def signed(x):
    x &= U64
    return x - (1 << 64) if x >> 63 else x


# ------------------------------------------------------------ op4
def plain_features(text, dimensions):
    """Square roots of hashed pair and triple counts, at length 1; one character at a time."""
    chars, letter = [], False
    for c in " " + text.lower() + " ":
        letter |= c.isalpha()
        c = c if c.isalpha() else " "
        if c != " " or not chars or chars[-1] != " ":
            chars.append(c)
    if not letter:
        return None
    n = [0] * dimensions
    u = [ord(c) for c in chars]
    for i in range(len(u) - 1):
        pair = u[i] * 0x9E3779B1 + u[i + 1] * 0x85EBCA77
        codes = [pair] + ([pair + u[i + 2] * 0xC2B2AE3D + 0x27D4EB2F] if i + 2 < len(u) else [])
        for x in codes:
            n[(signed((x ^ x >> 15) * 0x2545F491) >> 13) % dimensions] += 1
    length = math.sqrt(sum(n))
    return [math.sqrt(x) / length for x in n]


def plain_prediction(model, text):
    x = plain_features(text, model.dimensions) if text else None
    if x is None:
        return "und", 0.0

    def dot(w, k):
        return sum(a * float(b) for a, b in zip(x, w[:-1, k]) if a) + float(w[-1, k])

    z = [dot(model.family_weights, k) for k in range(len(model.families))]
    odds = [math.exp(v - max(z)) for v in z]
    k = max(range(len(z)), key=lambda i: (odds[i], -i))
    family, p = model.families[k], odds[k] / sum(odds)
    langs = model.members[family]
    if len(langs) == 1:
        return langs[0], p
    votes, share = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
    for at, (a, b) in enumerate(itertools.combinations(langs, 2)):  # every two languages of the family meet once
        q = 1 / (1 + math.exp(-2 * dot(model.pair_weights[family], at)))
        votes[b if q > 0.5 else a] += 1
        share[a] += 1 - q
        share[b] += q
    best = max(langs, key=lambda c: (votes[c], share[c], -langs.index(c)))
    return best, p * share[best] / (len(langs) - 1)


def test_language_votes_against_plain_loops(spark):
    words = {"en": "the of and to in that was his he it with is for as had you not be her on", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine",
             "nl": "de van het een en in te dat op voor met zijn niet aan er om ook als dan maar", "fr": "le de un et être à il avoir ne je son que se qui ce dans en du elle au",
             "es": "el la de que y a en un ser se no haber por con su para como estar tener le", "ru": "и в не на я быть он с что а по это она этот к но они мы весь который"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[c].split(), k=rng.randint(5, 30))), c) for i in range(30) for c in words]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dimensions=512)
    assert {len(model.members[f]) for f in ("germanic", "romance", "slavic")} == {3, 2, 1}
    mixed = [" ".join(rng.choices([w for v in words.values() for w in v.split()], k=rng.randint(1, 40))) for _ in range(40)]
    tests = [t for _, t, _ in rows[:30]] + mixed + [None, "", " 12 !?", "x", "Ä", "𝒳 and 日本 and ٣", "THE  the\n\nThe", "le-chat's 3rd dé", "İstanbul ß ﬁ"]
    got = [(r["lang_pred"], r["score"]) for r in langid.predicted(spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "doc_id long, text string"), model)
           .orderBy("doc_id").collect()]
    for t, (lang, score) in zip(tests, got):
        want, s = plain_prediction(model, t)
        assert (lang, round(score, 9)) == (want, round(s, 9)), t
    assert len({lang for lang, _ in got}) == 7


def test_features_of_a_long_text_in_steps(monkeypatch):
    text = "".join(random.Random(1).choices("abcé  .ИЯ日𝒳", k=5000))
    whole = plain_features(text, 256)
    assert np.allclose(langid.features(text, 256), whole)


# ------------------------------------------------------------ op6
def spark_hash(*values):
    """Spark's xxhash64 of ints (4 bytes) and longs (given as a 1-tuple); null changes nothing."""
    h = 42
    for v in values:
        if v != (None,):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v), seed=h)
    return signed(h)


def scatter(x):
    """The order of blocks: a 64-bit finaliser."""
    x &= U64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & U64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & U64
    return x ^ x >> 31


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """min(most * size, rate * weight), the rate found by halving."""
    w = [weights[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, most * sum(sizes) + 1
    for _ in range(200):
        rate = (lo + hi) / 2
        if sum(min(most * s, rate * x) for s, x in zip(sizes, w)) < share * sum(sizes):
            lo = rate
        else:
            hi = rate
    return [min(most * s, rate * x) for s, x in zip(sizes, w)]


def plain_mix(docs, blocks, shards, seed):
    """{doc_id: (size, source size, target, taken, places)} by loops over rows and draws."""
    size = {i: len(WORD.findall(t or "")) for i, _, t in docs}
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    total = [sum(size[i] for i, s, _ in docs if s == n) for n in names]
    goal = plain_targets(total)
    block = {i: spark_hash(seed, (i,)) % blocks for i, _, _ in docs}
    draws = []  # per source: (block, pass) in drawing order
    for n, all_words, target in zip(names, total, goal):
        words = {}
        for i, s, _ in docs:
            if s == n:
                words[block[i]] = words.get(block[i], 0) + size[i]
        got, passes = [], int(target // all_words) if all_words else 0
        for e in range(passes + 1):
            order = sorted(words, key=lambda b: (scatter(b + e * 1_000_003 + seed), b))
            if e == passes:
                gap, take = target - passes * all_words, set()
                for b in order:
                    if all_words and 0 < words[b] <= gap:
                        take.add(b)
                        gap -= words[b]
                spare = [(words[b], k, b) for k, b in enumerate(order) if b not in take and 0 < words[b] < 2 * gap]
                order = [b for b in order if b in take or (spare and b == min(spare)[2])]
            got += [(b, e) for b in order]
        draws.append(got)
    quotas = mixing.split_quotas([len(d) for d in draws], shards, seed)  # its sums are tested by themselves
    dealt = {k: [] for k in range(shards)}
    for j, n in enumerate(names):
        at = 0
        for k in range(shards):
            for b, e in draws[j][at:at + int(quotas[k, j])]:
                dealt[k] += [(spark_hash(seed, k, e, (i,)), i) for i, s, _ in docs if s == n and block[i] == b]
            at += int(quotas[k, j])
        assert at == len(draws[j])
    places = {i: [] for i in size}
    for k in range(shards):
        for at, (_, i) in enumerate(sorted(dealt[k])):
            places[i].append((k, at))
    where = {n: j for j, n in enumerate(names)}
    return {i: (size[i], total[where[s]], goal[where[s]], size[i] * len(places[i]), " ".join(f"{k}:{at}" for k, at in sorted(places[i]))) for i, s, _ in docs}


@pytest.mark.parametrize("blocks,shards,seed,names", [(4096, 32, 7, 3), (5, 3, 1, 2), (1, 4, 9, 1), (40, 1, 3, 7)])
def test_mix_against_plain_draws(spark, blocks, shards, seed, names):
    rng = random.Random(seed)
    source = [None, "a", "z", "Z", "é", "b c", ""][:names]
    docs = [(i * 977 - 40, rng.choice([source[0], *source]), rng.choice([None, "", " \t", "w " * rng.randint(1, 90), "x\x0by z"])) for i in range(150)]
    got = mixing.taken_words(spark.createDataFrame(docs, "doc_id long, source string, text string"), seed=seed, blocks=blocks, shards=shards).collect()
    want = plain_mix(docs, blocks, shards, seed)
    assert len(got) == len(want)
    for r in got:
        size, total, target, taken, places = want[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"], r["places"]) == (size, total, taken, places)
        assert r["target"] == pytest.approx(target, abs=1e-6)


# ------------------------------------------------------------ op7
def best_reading(places, model):
    """(score, readings that reach it) over every combination of readings."""
    best, texts = -math.inf, set()
    for choice in itertools.product(*places):
        score, a, b = 0.0, deobfuscate.GAP, deobfuscate.GAP
        for text, cost in choice:
            score -= cost
            for ch in text:
                k = deobfuscate._CODE.get(ch, deobfuscate.GAP if ch == " " else deobfuscate.OTHER)
                if not (k == b == deobfuscate.GAP):  # gaps merge
                    score, a, b = score + float(model[a, b, k]), b, k
        if b != deobfuscate.GAP:
            score += float(model[a, b, deobfuscate.GAP])
        text = "".join(t for t, _ in choice)
        if score > best + 1e-6:
            best, texts = score, {text}
        elif score > best - 1e-6:
            texts.add(text)
    return best, texts


def test_viterbi_against_all_readings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(3)
    learned = deobfuscate.character_model(deobfuscate.character_counts(docs))
    noise = np.log(np.random.default_rng(3).dirichlet(np.ones(deobfuscate.K), (deobfuscate.K,) * 2)).astype(np.float32)
    tried = 0
    for model in (learned, noise):
        for _ in range(150):
            word = "".join(rng.choices("idtbestahlo", k=rng.randint(1, 5)))
            core = "".join(rng.choice([c, c, c * 3, c + rng.choice("._-"), rng.choice("013457@$!|+")]) for c in word)
            for places in (deobfuscate.lattice(core), deobfuscate.spaced(list(word))):
                if 0 < math.prod(map(len, places)) <= 3000:
                    assert deobfuscate.viterbi(places, model) in best_reading(places, model)[1], (core, word)
                    tried += 1
    assert tried > 400


# ------------------------------------------------------------ workers without the package
def test_operators_as_a_library_from_another_folder(tmp_path):
    """Workers that were not started from the repository's folder get the package from the operator."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from tideline.session import build_session
from tideline.llm import importance, langid, simhash_vp
spark = build_session(master="local[2]", shuffle_partitions=2)
docs = spark.createDataFrame([(i, "the old town by the sea " * 3 if i % 2 else "der alte Fluss und das Tal " * 3, "en" if i % 2 else "de") for i in range(20)],
                             "doc_id long, text string, lang string")
step = sys.argv[1]
if step == "langid":
    print(langid.predicted(docs, langid.train(docs)).filter("lang = lang_pred").count())
elif step == "simhash":
    print(simhash_vp.fingerprints(docs).select("fp").distinct().count() * 10)
else:
    print(importance.hashed_features(docs).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for step in ("langid", "simhash", "importance"):
        done = subprocess.run([sys.executable, "-c", code, step], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
        assert done.stdout.split()[-1:] == ["20"], done.stderr[-2000:]
