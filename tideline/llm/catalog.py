"""Queries of the training-data operators over the given tables, with DuckDB
SQL where SQL can express them. Each reads its whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import block_naming as op8
from . import bpe_trie as op11
from . import deobfuscate as op7
from . import importance as op13
from . import langid as op4
from . import mixing as op6
from . import ngram_trie as op5
from . import packing as op10
from . import quality_rules as op9
from . import recompression as op12
from . import sharding as op3
from . import simhash_vp as op2
from . import warc as op1
from .common import WORD_GAP, id_bucket, or_empty, table


def op1_warc_revisits(spark, sf_dir):
    """All pages written as WARC records, deduplicated, and read back."""
    d = op1.archive_pages(table(spark, sf_dir, "pages"), min_bytes=100)
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_vp(spark, sf_dir):
    """SimHash components of all documents: 4-word shingles, at most 4 bits."""
    return op2.simhash_near_dedup(table(spark, sf_dir, "documents"), words_in_shingle=4, max_bits=4)


def op3_minimax_sharding(spark, sf_dir):
    """All documents in 40 contiguous minimax shards (law ``bytes``)."""
    d = op3.minimax_shards(table(spark, sf_dir, "documents"), shards=40)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def op4_language_id(spark, sf_dir):
    """Language of all documents; ids outside bucket 2 of 4 are learned."""
    docs = table(spark, sf_dir, "documents")
    held = id_bucket(F.col("doc_id"), 4) == 2
    model = op4.train(docs.filter(~held).select("text", "lang"))
    return op4.predicted(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_ngram_trie(spark, sf_dir):
    """LM scores of all documents; ids outside bucket 0 of 10 are counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op5.lm_scores(docs, id_bucket(F.col("doc_id"), 10) == 0)


def op6_mixing(spark, sf_dir):
    """All documents mixed to weights 3, 1, 2 over sources, 150 % of all words, dealt to 32 shuffled shards."""
    d = op6.taken_words(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken", "places")


def op7_toxicity(spark, sf_dir):
    """Toxicity of all documents; labels of ids outside bucket 0 of 5 are learned."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = op7.train(docs, labels.filter(id_bucket(F.col("doc_id"), 5) != 0))
    d = op7.scored(docs.select("doc_id", "text"), model)
    return d.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_block_naming(spark, sf_dir):
    """Exact dedup of all documents; the largest doc_id of equal texts stays."""
    return op8.exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    """Quality rules over all documents."""
    d = op9.quality_rules(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return op10.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op11_bpe_trie(spark, sf_dir):
    """Every text of documents as token ids, and back: digests of both."""
    d = op11.bpe_coded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def with_periods(docs):
    """Texts of a tenth of the ids made periodic from a word on, both given by the id's CRC-32."""
    d = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split(or_empty("text"), WORD_GAP), "")))
    d = d.select("doc_id", "text", "w", F.size("w").alias("n"), F.expr("h div 10").alias("g"))
    d = d.withColumn("a", F.expr("case when n > 0 then cast(g % n as int) end"))
    d = d.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    words = "slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p + 1 as int)))), 1, n)"
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.expr(words), " ")).otherwise(or_empty("text")).alias("text"))


def op12_recompression(spark, sf_dir):
    """Runs of words of all documents, the longest, and digests of all runs and of the collapsed text."""
    d = op12.periodic_runs(with_periods(table(spark, sf_dir, "documents")), min_words=12)
    lines = F.array_join(F.expr(r"transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                 F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", "b.start", (-F.col("b.length")).alias("length"), "b.period",
                    F.expr("1000 * -b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_importance(spark, sf_dir):
    """All documents weighed towards the benchmark's texts; a quarter of those with 20 words drawn."""
    d = op13.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, seed=7, percent=25, min_words=20)
    return d.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_simhash_vp, op3_minimax_sharding, op4_language_id, op5_ngram_trie, op6_mixing, op7_toxicity, op8_block_naming, op9_quality_rules,
                                    op10_best_fit_packing, op11_bpe_trie, op12_recompression, op13_importance)}

_STOPS = ", ".join("'" + w + "'" for w in sorted({w for v in op9.STOP_WORDS.values() for w in v.split()}))

#: CRC-32 in SQL: a table of 256 entries, then one step a byte of a hex string
_CRC_TABLE = """c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc_table)"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
        list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)),
        lambda x, y: xor(crc_table[(xor(x, y) & 255) + 1], x >> 8)))"""


ORACLE = {
    "op1_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN o ON p.h = o.h""",
    "op8_block_naming": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], chr(10)) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, i - coalesce(b, i - 5)))::BIGINT AS n FROM r GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOPS}))) AS n_stop_words
      FROM s LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1
       AND (n_words < 20 OR n_stop_words / n_words >= 0.04) AND n_dup_lines / n_lines <= 0.4 AS kept
FROM f""",
    "op12_recompression": rf"""
WITH {_CRC_TABLE},
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0, {_crc("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, c),
a AS (SELECT doc_id, w0, len(w0) AS n, h % 10 = 0 AND len(w0) > 0 AS made, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a, 3 + (h // 10) % 8 AS k FROM h),
t AS (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1])
             ELSE w0 END AS w FROM a),
p AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM t),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM p l JOIN p r ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i AND 2 * (r.i - l.i) <= l.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m) GROUP BY doc_id, q, g),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, min([-length, start, period]) AS b,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
z AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN z ON p.doc_id = z.doc_id AND p.i = z.i GROUP BY p.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b[2]::BIGINT AS start, -b[1]::BIGINT AS length, b[3]::BIGINT AS period,
       (1000 * -b[1] // b[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN o ON t.doc_id = o.doc_id LEFT JOIN k ON t.doc_id = k.doc_id""",
    "op13_importance": rf"""
WITH {_CRC_TABLE},
w AS (SELECT false AS target, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
      UNION ALL SELECT true, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT target, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
n AS (SELECT target, id, f, count(*) AS n FROM f GROUP BY target, id, f),
d AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM n), c),
b AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM n JOIN d USING (f) GROUP BY bucket),
u AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM b),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM b, u),
x AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
      FROM n JOIN d USING (f) JOIN g USING (bucket) WHERE NOT target GROUP BY id),
y AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w.w) >= 20 AS may,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN x ON w.id = x.id WHERE NOT target),
z AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) FILTER (may) OVER () AS all_n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * all_n // 100 THEN place END AS rank FROM z""",
}
