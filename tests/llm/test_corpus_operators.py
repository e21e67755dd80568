"""WARC, SimHash, sharding, mixing, block naming and packing."""
import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
import xxhash

from tideline.llm import block_naming, mixing, packing, sharding, simhash_vp, warc
from tideline.llm.common import shared_path, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------ WARC
def test_warc_round_trip_and_revisits(spark):
    h = "<p>" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\n é"
    rows = [(5, "u5", h), (3, "u3", h), (3, "u3", h), (9, None, None), (10, "u", "short"), (11, "u", "short"),
            (None, "n", h), (12, "z", h + "!"), (13, "z", h + "!"), (14, "q", ""), (15, "big", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.archive_pages(pages).collect()
    assert sorted((r.payload_digest, r.payload_bytes) for r in got) == sorted(
        (hashlib.sha256((x or "").encode()).hexdigest(), len((x or "").encode())) for _, _, x in rows)
    kind = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kind[3, "response", None] == 1 and kind[3, "revisit", 3] == 1
    assert kind[5, "revisit", 3] == 1 and kind[None, "revisit", 3] == 1 and kind[13, "revisit", 12] == 1
    assert kind[10, "response", None] == kind[11, "response", None] == kind[14, "response", None] == 1
    assert warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", None])
def test_warc_payloads_come_back(spark, compression):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = shared_path(spark, "t")
    warc.write_warc(warc.records(pages), path, compression=compression, records_per_file=7)
    back = {r.page_id: (r.url, r.payload) for r in warc.read_warc(spark, path).collect()}
    assert back == {r.page_id: (r.url, r.html) for r in pages.collect()}


def test_warc_copies_across_files_without_a_payload_in_the_shuffle(spark):
    ids = [*range(40), (1 << 53) + 1]
    text = {i: "hot " * 50 if i % 3 == 0 else f"page {i % 7} " * 30 for i in ids}
    pages = spark.createDataFrame([(i, f"u{i}", t) for i, t in text.items()], "page_id long, url string, html string").repartition(5)
    raw, final = shared_path(spark, "t"), shared_path(spark, "t")
    warc.write_warc(warc.records(pages), raw, records_per_file=3)
    todo = warc.decided_files(spark, raw)
    assert todo.columns == ["file", "copies"] and todo.count() >= 14
    assert todo.filter("size(copies) > 3").count() == 0
    warc.dedup_archive(spark, raw, final, records_per_file=3)
    back = {r.page_id: r for r in warc.read_warc(spark, final).collect()}
    first = {}
    for i in ids:
        first.setdefault(text[i], i)
    assert set(back) == set(ids)
    for i in ids:
        own = first[text[i]]
        assert (back[i].refers_to, back[i].refers_url) == ((None, None) if own == i else (own, f"u{own}"))
        assert back[i].payload == (text[i] if own == i else None) and back[i].url == f"u{i}"
        assert back[i].payload_digest == hashlib.sha256(text[i].encode()).hexdigest()


def test_warc_damage_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"HTTP/1.1 200\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


# ------------------------------------------------------------ SimHash
def brute_print(t, k=4):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_of_messy_rows(spark, messy):
    docs = messy.select("doc_id", "text", "size").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "1 as size"))
    rows = docs.collect()
    prints = [brute_print(r.text) if len(r.text or "") < 50_000 else simhash_vp.fingerprint(r.text) for r in rows]
    root = brute_components(prints, 4)
    first = {k: min((r.doc_id for r, x in zip(rows, root) if x == k and r.doc_id is not None), default=None) for k in set(root)}
    want = sorted((str(r.doc_id), f"{p:016x}", first[k]) for r, p, k in zip(rows, prints, root))
    got = simhash_vp.simhash_near_dedup(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash_vp.one_of_each(stored(docs, "t")).collect()
    assert len(kept) == len(set(root)) and simhash_vp.simhash_near_dedup(docs.limit(0)).count() == 0


def test_simhash_long_text_in_chunks(monkeypatch):
    t = " ".join(f"w{i % 31} v{i % 7}" for i in range(900))
    monkeypatch.setattr(simhash_vp, "CHUNK", 100)
    assert simhash_vp.fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("parts,shard_rows,bits", [(5, 40, 4), (2, 4096, 4), (1, 300, 2), (4, 4096, 4)])
def test_trees_lose_no_link(spark, parts, shard_rows, bits):
    """Boundary-overlapping shards, chunked shards, and inner trees find all that brute force finds."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for s in seeds for _ in range(12)]
    x = np.unique(np.array(near, dtype=np.uint64))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = simhash_vp.links(fps, bits, parts=parts, leaf_rows=60, shard_rows=shard_rows).collect()
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    assert all((int(x[at[r.a]]) ^ int(x[at[r.b]])).bit_count() >= 0 for r in got)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        a, b = find(at[r.a]), find(at[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(x))] == brute_components([int(v) for v in x], bits)


def test_inner_tree_against_brute_force():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 1 << 63, 700, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64), np.zeros(400, dtype=np.uint64)])
    got = set()
    for i, j in simhash_vp.linked_pairs(x, x, 4):
        got.update(zip(i.tolist(), j.tolist()))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert got == set(zip(i.tolist(), j.tolist()))


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash_vp.components(e).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


# ------------------------------------------------------------ sharding
def brute_capacity(sizes, shards):
    best = None
    for c in range(max(sizes), sum(sizes) + 1):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        if n <= shards:
            best = c
            break
    return best


@pytest.mark.parametrize("seed,shards,digits", [(1, 4, 1), (2, 7, 1), (3, 5, 4), (4, 3, 2)])
def test_minimax_capacity_is_the_smallest(spark, monkeypatch, seed, shards, digits):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    monkeypatch.setattr(sharding, "MOST_PREFIXES", 300)
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, 120).tolist()
    groups = [(hashlib.sha256(str((seed, i)).encode()).hexdigest(), s) for i, s in enumerate(sizes)]
    cuts = sharding.find_cuts(spark.createDataFrame(groups, "group_key string, size long"), shards)
    ordered = [s for _, s in sorted(groups)]
    assert not cuts.alone and cuts.capacity == brute_capacity(ordered, shards)
    per = collections.Counter()
    for k, s in groups:
        per[sum(k >= c for c in cuts.starts)] += s
    assert len(per) == shards and max(per.values()) == cuts.capacity


def test_shards_of_messy_rows(spark, messy):
    hot = spark.createDataFrame([(1000 + i, "hot text") for i in range(300)], "doc_id long, text string")
    docs = messy.select("doc_id", "text", "shard").unionByName(hot.selectExpr("doc_id", "text", "9 as shard"))
    got = sharding.minimax_shards(docs, shards=6).collect()
    assert len(got) == docs.count()
    by_text, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        by_text[r.group_key].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(v) == 1 for v in by_text.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) < 6
    want = collections.Counter((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert sharding.minimax_shards(docs.limit(0)).count() == 0


# ------------------------------------------------------------ mixing
def test_targets_and_quotas():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    t = mixing.targets([10, 1000, 0, 50])
    assert t[0] == 20 and t[2] == 0 and abs(sum(t) - 1.5 * 1060) < 1e-6 and all(x <= 2 * s for x, s in zip(t, [10, 1000, 0, 50]))
    parts = mixing.split_quotas([7, 0, 1000, 33], 5, seed=1)
    assert parts.sum(axis=0).tolist() == [7, 0, 1000, 33] and np.ptp(parts.sum(axis=1)) <= 5
    assert (parts == mixing.split_quotas([7, 0, 1000, 33], 5, seed=1)).all()


def test_mix_of_messy_rows(spark, messy):
    docs = stored(messy.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "doc_id + 100 as doc_id", "text", "lang", "source", "n_chars", "'x' as __row", "1 as size", "1 as shard", "1D as score")), "t")
    got = mixing.taken_words(docs).collect()
    again = mixing.taken_words(docs).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken, r.target)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == docs.count()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    longest = collections.Counter()
    for r in got:
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    full = mixing.mixed(docs.drop("size"), with_place=True, shards=4).collect()
    assert sum(len(WORD.findall(r.text or "")) for r in full) == sum(taken.values())
    assert {r.mix_shard for r in full} == {0, 1, 2, 3}
    assert mixing.taken_words(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_taken_words_come_from_the_shuffled_shards(spark, messy):
    more = spark.range(2000).selectExpr("id + 100 doc_id", "repeat('w ', cast(id % 9 as int)) text", "concat('s', id % 4) source")
    docs = stored(messy.select("doc_id", "text", "source").unionByName(more), "mix-test")
    got = mixing.taken_words(docs, shards=5).collect()
    assert len(got) == docs.count()
    lists = collections.defaultdict(dict)  # shard -> place -> id
    for r in got:
        at = [tuple(map(int, x.split(":"))) for x in r.places.split()]
        assert r.taken == r["size"] * len(at)
        for s, p in at:
            assert p not in lists[s]
            lists[s][p] = r.doc_id
    assert sorted(lists) == list(range(5)) and all(sorted(x) == list(range(len(x))) for x in lists.values())
    by_key = collections.defaultdict(list)
    for r in mixing.mixed(docs, shards=5, with_place=True).collect():
        by_key[r.mix_shard].append((r.mix_key, r.doc_id))
    want = {s: [d for _, d in sorted(x, key=lambda y: y[0])] for s, x in by_key.items()}
    assert {s: [x[p] for p in sorted(x)] for s, x in lists.items()} == want
    out = mixing.shuffled(docs, shards=5, cuts=3)  # the same order, in 15 partitions
    assert out.columns == docs.columns and out.rdd.getNumPartitions() == 15
    assert [r.doc_id for r in out.collect()] == [d for s in range(5) for d in want[s]]


# ------------------------------------------------------------ block naming
@pytest.mark.parametrize("hash_of", [None, "length"])
def test_block_naming_equals_text_equality(spark, messy, hash_of):
    """Also where the hash says next to nothing: names follow the content."""
    from pyspark.sql import functions as F
    how = {} if hash_of is None else {"hash_of": lambda c: F.octet_length(c).cast("long")}
    more = [(50 + i, t) for i, t in enumerate(["abcdabcd", "abcdabce", "abcdabcd", "abcd", "abcdabcdx", "abcdabcdx", "zbcdabcdx" * 5, "zbcdabcdx" * 5])]
    docs = stored(messy.select("doc_id", "text", "size").unionByName(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "0 as size")), "t")
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = block_naming.exact_dedup(docs, block_bytes=4, **how).collect() if hash_of else block_naming.exact_dedup(docs, block_bytes=1000).collect()
    want = collections.Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want.update((str(i), str(top), len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert collections.Counter((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text or "" for r in block_naming.without_copies(docs).collect()) == sorted(groups)
    assert block_naming.exact_dedup(docs.limit(0)).count() == 0


# ------------------------------------------------------------ packing
def fewest(lengths, capacity):
    """The fewest sequences, by trying everything (tiny inputs)."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= order[i] and rooms[k] not in rooms[:k]:
                place(i + 1, rooms[:k] + [rooms[k] - order[i]] + rooms[k + 1:])
        place(i + 1, rooms + [capacity - order[i]])

    place(0, [])
    return best[0]


def laid_out(plan):
    """Pieces by sequence; checks offsets."""
    seqs = collections.defaultdict(list)
    for length, _, n, first, each, at in plan.runs:
        for i in range(n):
            seqs[first + i // each].append((at + i % each * length, length))
    for pieces in seqs.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= plan.capacity
    return seqs


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(11)
    for _ in range(400):
        c = int(rng.integers(6, 20))
        lengths = rng.integers(1, c + 1, int(rng.integers(1, 9))).tolist()
        counts = collections.Counter(lengths)
        p = packing.Plan(counts, c)
        p.reduce()
        rest = [x for x in range(c + 1) for _ in range(int(p.left[x]))]
        assert p.fixed + fewest(rest, c) == fewest(lengths, c), (lengths, c)
        p.best_fit()
        seqs = laid_out(p)
        assert sorted(x for s in seqs.values() for _, x in s) == sorted(lengths) and len(seqs) == p.sequences


def test_plan_is_bounded_by_the_capacity():
    rng = np.random.default_rng(12)
    counts = {x: int(n) for x, n in zip(range(1, 257), rng.integers(0, 10 ** 9, 256))}
    p = packing.plan_packing(counts, 256)
    total = sum(k * n for k, n in counts.items())
    assert len(p.runs) < 5000 and total <= 256 * p.sequences <= 1.1 * total


@pytest.mark.parametrize("counts,least", [({1500: 10 ** 9, 500: 10 ** 9}, 10 ** 9), ({1000: 10 ** 9}, 5 * 10 ** 8),
                                          ({1000: 10 ** 9 + 1, 24: 10 ** 9}, 5 * 10 ** 8), ({700: 10 ** 9, 600: 10 ** 9, 60: 10 ** 8}, 6 * 10 ** 8)])
def test_many_equal_lengths_are_few_runs(counts, least):
    p = packing.plan_packing(counts, 2048)
    assert len(p.runs) < 50 and least <= p.sequences <= 1.2 * least
    for length, n in counts.items():
        mine = sorted((r[1], r[2]) for r in p.runs if r[0] == length)
        assert sum(k for _, k in mine) == n and all(a + k == b for (a, k), (b, _) in zip(mine, mine[1:]))


def test_packing_of_messy_rows(spark, messy):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    got = packing.pack(messy, capacity=64, keep_ids=True).collect()
    want = collections.Counter()
    for r in messy.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.update((str(r.doc_id), p, at, len(ids[at:at + 64]), zlib.crc32(ids[at:at + 64].tobytes())) for p, at in enumerate(range(0, len(ids), 64)))
    assert collections.Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 64
    assert packing.pack(messy.limit(0)).count() == 0
    small = packing.WordEncoder(None)
    packing._CACHE_WORDS, keep = 3, packing._CACHE_WORDS
    try:
        assert small.encode("a bb ccc dddd eeeee a bb") == np.array(tok.encode("a bb ccc dddd eeeee a bb", add_special_tokens=False).ids, dtype="<u4").tobytes()
    finally:
        packing._CACHE_WORDS = keep


def test_markers_in_a_text_are_one_id():
    from tokenizers import Tokenizer
    plain, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(None)
    for t in ("Hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|> (<|endoftext|>)", "<|endoftext|><|endoftext|> <| endoftext |>",
              "it's '<|endoftext|>'\n<b>x</b>", ""):
        ids = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == ids
    assert np.frombuffer(own.encode("Hello <|endoftext|> world"), dtype="<u4").tolist() == [3306, 49407, 1002]


def test_words_are_looked_up_once_for_all_texts():
    """Whatever the number of words, Python asks for each distinct run once."""
    class Asked(dict):
        times = 0

        def get(self, key, default=None):
            Asked.times += 1
            return super().get(key, default)

    from tokenizers import Tokenizer
    plain, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(None)
    own.runs, own.marks, own.odd = Asked(own.runs), Asked(own.marks), Asked(own.odd)
    texts = ["One two, (two) x-1 " * 2000, "two two one. " * 3000, ""]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert Asked.times < 20
    assert own.encode_all([]) == [] and own.encode_all(["", ""]) == [b"", b""]


def test_letters_and_signs_below_256_as_the_library():
    """All characters below U+0100 alone, in words, and between punctuation, and some above."""
    from tokenizers import Tokenizer
    plain, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(None)
    signs = [chr(i) for i in range(256)] + list("ŸßẞİıſΣς\u0301\u2028\u3000日") + ["'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = [f"{c} a{c} {c}a x{c}y ({c}) '{c}, {c}'. {c}{c}! ab{c}'s .{c}a" for c in signs]
    texts += ["é" * 3000 + "!" * 3000, "a\u0085b \xa0c\u3000d \x1c\x1d e\x00", " \t\r\n lead trail \x0b\x0c "]
    assert own.quick
    for cache in (packing._CACHE_WORDS, 5):
        packing._CACHE_WORDS, keep = cache, packing._CACHE_WORDS
        try:
            for t, x in zip(texts * 2, packing.WordEncoder(None).encode_all(texts * 2), strict=True):
                assert np.frombuffer(x, dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
        finally:
            packing._CACHE_WORDS = keep
    own.quick = False  # as with another kind of tokenizer
    assert own.encode_all(texts) == packing.WordEncoder(None).encode_all(texts)


def test_slices_by_bytes(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(packing, "_TEXT_BYTES", 10)
    rows = ["a" * 4, "b" * 6, "c" * 30, "", "", "d" * 10, "e"]
    b = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["t"])
    for k in range(len(rows) + 1):
        got = [p.column("t").to_pylist() for p in packing._slices(b.slice(k))]
        assert sum(got, []) == rows[k:] and all(len(p) == 1 or sum(map(len, p)) <= 10 for p in got)
