"""Target-distribution importance resampling over hashed word features.

A text's features are its words and pairs of neighbouring words; a feature's
bucket is the CRC-32 of its bytes modulo the number of buckets. A bucket that is
commoner in the target than in the corpus has a gain; a document's weight is its
mean gain, and documents are drawn by weight plus seeded Gumbel noise.

Hashing runs on matrices: a chunk of texts becomes one byte string of words
parted by single blanks, in which each feature is a slice. The distinct features
are grouped by equal length into two-dimensional uint8 arrays; the CRCs of all
rows of an array are brought forward column by column from one table of 256
entries; the results are scattered back to the occurrences. (A slice above
``LONGEST`` bytes, a word of that length, is hashed alone: its array would be
one row.)

What goes where: the hashed rows are written once, two bytes a feature, and read
by the count of buckets and by the weights. Spark sums bucket counts from one
row per bucket and chunk of tasks; the driver holds ``buckets`` gains, whatever
the corpus. A task turns a slice of its batch at a time into Python's strings and
arrays (``CHUNK_ROWS`` texts, ``CHUNK_WORDS`` words, ``CHUNK_FEATURES`` hashed
features or one longer document), and rows go to Python and come back as Arrow
batches, so that no queue of Spark's holds the hashed features. Drawn rows are ordered by ranges of (score, id), so no task holds
more than its range; places follow from the ranges' counts.

Defined results: null text counts as empty; a document without words has no
features and weight 0; a null id is the empty string to the seed's hash, and
comes last in ties; repeated rows are scored and drawn each; an empty table,
corpus or target, counts nothing and gives zero gains (and an empty result for
an empty corpus). Only the id and the text are read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import or_empty, stored

#: bytes of a slice above which an array would have hardly a row and thousands of columns
LONGEST = 4096
#: words hashed at once
CHUNK_WORDS = 100_000
#: texts of a batch that are Python strings at once, and rows of a result's batch
CHUNK_ROWS = 512
#: hashed features counted or weighed at once, and of a result's batch
CHUNK_FEATURES = 1 << 20


def _crc_table() -> np.ndarray:
    """CRC-32 of single bytes, reflected polynomial EDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()
#: A-Z to a-z, digits, a-z and bytes above 7F kept, all else a blank
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix."""
    crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def crc_slices(text: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of slices of ``text``, through one matrix for each length."""
    out = np.zeros(len(start), dtype=np.uint32)
    whole = np.frombuffer(text, dtype=np.uint8)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for rows in np.split(order, cuts):
        if not len(rows):
            continue
        n = int(length[rows[0]])
        if n > LONGEST:
            out[rows] = [zlib.crc32(text[s:s + n]) for s in start[rows].tolist()]
        elif n:
            out[rows] = crc_columns(np.lib.stride_tricks.sliding_window_view(whole, n)[start[rows]])
    return out


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_CLEAN).split()


def feature_buckets(docs: list[list[bytes]], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bucket of each word of each document, and of each pair of neighbours."""
    flat = [w for d in docs for w in d]
    if not flat:
        return [np.zeros(0, np.int64)] * len(docs), [np.zeros(0, np.int64)] * len(docs)
    text = b" ".join(flat)
    size = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    start = np.cumsum(size + 1) - size - 1
    ends = np.cumsum([len(d) for d in docs])
    code, names = pd.factorize(np.array(flat, dtype=object))
    first = np.zeros(len(names), dtype=np.int64)
    first[code[::-1]] = np.arange(len(flat) - 1, -1, -1)
    ones = (crc_slices(text, start[first], size[first]) % buckets)[code]
    follows = np.ones(len(flat) - 1, dtype=bool)  # the next word is of the same document
    inner = ends[(ends > 0) & (ends < len(flat))] - 1
    follows[inner] = False
    at = np.flatnonzero(follows)
    pair, kinds = pd.factorize(code[at].astype(np.int64) * len(names) + code[at + 1])
    first = np.zeros(len(kinds), dtype=np.int64)
    first[pair[::-1]] = at[::-1]
    twos = (crc_slices(text, start[first], size[first] + 1 + size[first + 1]) % buckets)[pair] if len(at) else np.zeros(0, np.int64)
    pairs = np.concatenate([[0], np.cumsum(follows)])  # pairs before each word
    begins = ends - [len(d) for d in docs]
    # a document's pairs begin at those of its words but the last
    return ([ones[i:j] for i, j in zip(begins, ends)],
            [twos[pairs[i]:pairs[j - 1]] if j - i > 1 else twos[:0] for i, j in zip(begins, ends)])


def _hashed(texts: Iterable[str], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of all features) of each text, in order."""
    docs: list[list[bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        for d, one, two in zip(docs, *feature_buckets(docs, buckets)):
            yield len(d), np.concatenate([one, two])

    for t in texts:
        words = words_of(t)
        if len(words) > CHUNK_WORDS:  # by itself, in pieces that share a word
            yield from flush()
            docs, held = [], 0
            found = []
            for at in range(0, len(words), CHUNK_WORDS):
                (one,), (two,) = feature_buckets([words[at:at + CHUNK_WORDS + 1]], buckets)
                found += [one[:CHUNK_WORDS], two]
            yield len(words), np.concatenate(found)
            continue
        docs.append(words)
        held += len(words)
        if held >= CHUNK_WORDS:
            yield from flush()
            docs, held = [], 0
    yield from flush()


def hashed_features(docs: DataFrame, buckets: int = 10_000, text_col: str = "text", id_col: str | None = "doc_id") -> DataFrame:
    """(id, n_words, n_features, buckets of the features as 16- or 32-bit integers)."""
    ship_package(docs.sparkSession)
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    ids = [F.col(id_col).cast("long").alias("doc_id")] if id_col else []
    names = ["doc_id"] * len(ids) + ["n_words", "n_features", "buckets"]
    schema = "doc_id long, " * len(ids) + "n_words long, n_features long, buckets binary"

    def run(batches):
        import pyarrow as pa
        for b in batches:
            t, at = b.column("t"), 0
            texts = (x for k in range(0, len(t), CHUNK_ROWS) for x in t.slice(k, CHUNK_ROWS).to_pylist())
            words, sizes, data = [], [], []

            def part(n: int) -> pa.RecordBatch:
                cols = [b.column("doc_id").slice(at, n)] if id_col else []
                cols += [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())]
                return pa.RecordBatch.from_arrays(cols, names=names)

            held = 0
            for n, found in _hashed(texts, buckets):
                words.append(n)
                sizes.append(len(found))
                data.append(found.astype(width).tobytes())
                held += len(found)
                if len(words) == CHUNK_ROWS or held >= CHUNK_FEATURES:
                    yield part(len(words))
                    at += len(words)
                    words, sizes, data, held = [], [], [], 0
            if words:
                yield part(len(words))

    return docs.select(*ids, or_empty(text_col).alias("t")).mapInArrow(run, schema)


def _slices(column, width: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of some rows in a line, where each row's begin and the last ends) of
    an Arrow array, ``CHUNK_FEATURES`` or one row at once; nothing is copied."""
    import pyarrow as pa
    _, ends, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(ends, dtype="<i8" if pa.types.is_large_binary(column.type) else "<i4")
    ends = ends[column.offset:column.offset + len(column) + 1] // np.dtype(width).itemsize
    data = np.frombuffer(data, dtype=width, count=int(ends[-1])) if ends[-1] else np.zeros(0, width)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK_FEATURES, side="right")) - 1)
        yield data[ends[i]:ends[j]], ends[i:j + 1] - ends[i]
        i = j


def bucket_counts(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features each bucket holds: summed in each task, then by Spark."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        import pyarrow as pa
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for found, _ in _slices(b.column("buckets"), width):
                total += np.bincount(found, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(total[has], pa.int64())], names=["bucket", "n"])

    rows = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to corpus frequency, by bucket."""
    k = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + k) / ((s + 1.0) * (t.sum() + k)))).astype(np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Seeded Gumbel noise of an id, times 1000, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Add ``weight``: the floored mean gain of a row's features (none: 0)."""
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"
    cols = [c for c in features.columns if c != "buckets"]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            weights = [np.zeros(0, np.int64)]
            for found, ends in _slices(b.column("buckets"), width):
                sums, n = np.concatenate([[0], np.cumsum(gain[found])])[ends], np.diff(ends)
                weights.append(np.where(n > 0, np.diff(sums) // np.maximum(n, 1), 0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(np.concatenate(weights), pa.int64())], names=[*cols, "weight"])

    schema = T.StructType([features.schema[c] for c in cols] + [T.StructField("weight", T.LongType())])
    return features.mapInArrow(run, schema)


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 7, percent: int = 25, min_words: int = 20,
              id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Every document with its weight, score and, if drawn, its rank from 1 on.

    ``percent`` of the documents with ``min_words`` words or more are drawn.
    """
    spark = docs.sparkSession
    rows = stored(hashed_features(docs, buckets, text_col, id_col), "features")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(hashed_features(target, buckets, target_text, None), buckets))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    may = F.col("n_words") >= min_words
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    scored = stored(scored.select(*cols), "scored")
    # ranges of the order are written with their number, so that a later loss can't deal them anew
    ranged = stored(scored.filter(may).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = dict(ranged.groupBy("part").count().collect())  # one row a range
    total, before, first = sum(sizes.values()), 0, {}
    for p in sorted(sizes):
        first[p] = before
        before += sizes[p]
    drawn = total * percent // 100
    offsets = spark.createDataFrame(list(first.items()), "part int, first long")
    place = F.expr("row_number() over (partition by part order by score desc, doc_id asc nulls last)")
    ranked = ranged.withColumn("place", place).join(F.broadcast(offsets), "part")  # as many rows as shuffle partitions
    rank = F.col("first") + F.col("place")
    out = ranked.select(*cols, F.when(rank <= drawn, rank).cast("long").alias("rank"))
    return out.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("long")))
