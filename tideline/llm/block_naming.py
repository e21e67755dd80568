"""Exact dedup by deterministic block naming.

Texts are cut into blocks of fixed size. Distinct blocks are sorted and get
integers as names; then the names of adjacent blocks form pairs, distinct
pairs are sorted and named, and so on until each document has one name. Equal
names mean equal texts: a name stands for the content, not for a hash of it.

Blocks are compared once, in the shuffle that finds the distinct ones (with
copies merged before it). Beyond that only a 64-bit hash of a block travels:
the sort order is (hash, content), and where all blocks with one hash turned
out to be one content, the hash finds the name. Hashes that stand for several
contents are looked up by content. A level of n names leaves n / 2, so a
document of b blocks takes log2(b) levels, and only documents with more than
one name go on.

Defined results: null text counts as empty; among rows of one text that also
share the largest id, one stays; rows with null id are smallest; an empty table
gives an empty result. Only the id and the text are read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered_rows, or_empty, own_columns, stored

BLOCK_BYTES = 8192
NO_NAME = -1
ROW = "__row"


def _blocks(rows: DataFrame, block_bytes: int, hash_of) -> DataFrame:
    n = f"greatest(1, cast(ceil(octet_length(__bin) / {block_bytes}) as int))"
    d = rows.withColumn("n", F.expr(n)).select(
        ROW, "n", F.expr(f"posexplode(transform(sequence(0, n - 1), i -> substring(__bin, i * {block_bytes} + 1, {block_bytes})))")
        .alias("pos", "part"))
    return d.withColumn("h", hash_of(F.col("part")))


def _named(keys: DataFrame, by: list[str], tag: str) -> DataFrame:
    """Distinct keys in global sort order, each with an integer that follows it."""
    d = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(d.withColumn("name", F.monotonically_increasing_id()), tag)


def text_names(rows: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64) -> DataFrame:
    """(row, level, name) for ``rows``, which carry a unique ``__row``: texts
    are equal if and only if level and name are."""
    rows = rows.select(ROW, or_empty(text_col).cast("binary").alias("__bin"))
    blocks = _blocks(rows, block_bytes, hash_of)
    kinds = blocks.select("h", "part").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("contents"))
    names = _named(kinds, ["h"], "block-names")
    places = stored(blocks.select(ROW, "n", "pos", "h"), "block-places")
    single = names.filter("contents = 1").select("h", "name")
    named = places.join(single, "h").select(ROW, "n", "pos", "name")
    if names.filter("contents > 1").head(1):
        several = blocks.join(names.filter("contents > 1").select("h"), "h", "left_semi")
        last = names.agg(F.max("name")).first()[0] + 1
        own = _named(several.select("h", "part").distinct(), ["h", "part"], "block-names-by-content")
        named = named.unionByName(several.join(own, ["h", "part"]).select(
            ROW, "n", "pos", (F.col("name") + F.lit(last)).alias("name")))
    named = stored(named, "named-blocks")
    done, level = named.filter("n = 1").select(ROW, F.lit(0).alias("level"), "name"), 0
    most, rest = places.agg(F.max("n")).first()[0] or 1, named.filter("n > 1")
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = stored(rest.groupBy(ROW, "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.expr("case when pos % 2 = 0 then name end")).alias("a"),
            F.coalesce(F.max(F.expr("case when pos % 2 = 1 then name end")), F.lit(NO_NAME)).alias("b")), "name-pairs")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        named = stored(pairs.join(names, ["a", "b"]).select(ROW, F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "name"), "named-pairs")
        done = done.unionByName(named.filter("n = 1").select(ROW, F.lit(level).alias("level"), "name"))
        rest = named.filter("n > 1")
    return done


def exact_groups(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                 hash_of=F.xxhash64) -> DataFrame:
    """For each row of ``rows`` (from ``numbered_rows``): its id, its group's
    ``keep_id`` and size, whether it stays, and the SHA-256 of its text."""
    names = text_names(rows, text_col, block_bytes, hash_of)
    info = stored(rows.select(ROW, F.col(id_col).alias("doc_id"), F.sha2(or_empty(text_col), 256).alias("text_sha256"))
                  .join(names, ROW), "named-texts")
    lowest = F.lit(-(1 << 63))
    # stored, so that the join below deals its rows itself and can split a large group
    groups = stored(info.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.max_by(ROW, F.coalesce(F.col("doc_id"), lowest)).alias("__keep")), "text-groups")
    return info.join(groups, ["level", "name"]).select(
        ROW, "doc_id", "keep_id", "group_size", (F.col(ROW) == F.col("__keep")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document, dropped ones too."""
    rows = numbered_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ROW)
    return exact_groups(rows, "id", "text", **how).drop(ROW)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each text."""
    row = free_name(docs, ROW)
    rows = numbered_rows(docs, row)
    groups = exact_groups(rows.select(F.col(row).alias(ROW), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **how)
    dropped = groups.filter("not kept").select(F.col(ROW).alias("__dropped"))
    return rows.join(dropped, rows[row] == dropped["__dropped"], "left_anti").select(*own_columns(docs))
