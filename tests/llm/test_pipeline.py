"""The corpus pipeline, stage by stage, against plain Python over the same rows."""
import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import deobfuscate, mixing, packing
from tideline.llm.common import stored

from .test_corpus_operators import brute_components, brute_print

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def documents(spark):
    """The given table, and rows with nulls, repeated rows and a clashing extra column."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(900_001, None, "en", None, 0), (900_002, "", None, "src", 0), (900_003, "tie here", "en", "src", 8),
            (900_003, "tie here", "en", "src", 8), (None, "no id at all", "en", "src", 12), (900_004, "w " * 9000, "en", "src", 18_000)]
    d = d.unionByName(spark.createDataFrame(more, d.schema)).withColumn("__row", F.lit("clash"))
    return stored(d, "pipeline-test")


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What each stage reads, and the last one's rows."""
    got = [documents]
    for name, stage in corpus_pipeline.STAGES:
        got.append(stored(stage(spark, got[-1], SF), name.replace(" ", "-")))
    return got


def test_stages_keep_the_columns(stages, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    assert all(s.columns == documents.columns for s in stages[:-1])
    assert all(s.count() for s in stages)


def test_toxicity_rejects_what_it_scores(spark, stages):
    before, after = stages[0], stages[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = deobfuscate.train(before, labels)
    scores = deobfuscate.scored(before, model, name="tox").collect()
    assert all(0 <= r.tox <= 1 for r in scores)
    want = collections.Counter(tuple(r)[:-1] for r in scores if r.tox < 0.5)
    assert rows_of(after) == want


def test_toxicity_leaves_clean_documents(spark):
    """On the larger table: eleven toxic labels of the small one are too few to learn from."""
    sf = "/root/testdata/sf0.01"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, before, sf).select("doc_id").collect()}
    have = {r.doc_id for r in before.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()
    toxic, clean = ({r.doc_id for r in labels if r.toxic == k} & have for k in (1, 0))
    assert len(toxic & left) <= 0.2 * len(toxic) and len(clean & left) >= 0.95 * len(clean), (len(toxic & left), len(toxic), len(clean - left))


def test_exact_dedup_keeps_the_largest_id(stages):
    best = {}
    for r in stages[1].collect():
        t = r.text or ""
        if t not in best or (r.doc_id is not None and (best[t].doc_id is None or r.doc_id > best[t].doc_id)):
            best[t] = r
    assert rows_of(stages[2]) == collections.Counter(tuple(r) for r in best.values())


def test_simhash_keeps_the_smallest_id(stages):
    rows = stages[2].collect()
    root = brute_components([brute_print(r.text) for r in rows], 4)
    groups = collections.defaultdict(list)
    for r, k in zip(rows, root):
        groups[k].append(r)
    want = collections.Counter(tuple(min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0))) for g in groups.values())
    assert rows_of(stages[3]) == want


def test_mix_follows_its_targets(stages):
    rows, mix = stages[3].collect(), stages[4].collect()
    size, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        size[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in mix:
        taken[r.source] += len(WORD.findall(r.text or ""))
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(sources, mixing.targets([size[s] for s in sources])):
        assert abs(taken[s] - t) <= longest[s]
    have, used = collections.Counter(map(tuple, rows)), collections.Counter(map(tuple, mix))
    assert all(n <= 2 * have[r] for r, n in used.items())


def test_packing_places_every_piece(stages):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    want = collections.Counter()
    for r in stages[4].collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.update((r.doc_id, p, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048)))
    got, seqs = collections.Counter(), collections.defaultdict(list)
    for r in stages[5].collect():
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        seqs[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for v in seqs.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(n for v in seqs.values() for _, n in v)
    assert len(seqs) <= 1.1 * total / 2048 + 1


def test_run_repeats_itself_and_takes_empty_tables(spark, tmp_path):
    a, b = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(a.select(key)) == rows_of(b.select(key))
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
