"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into at most ``blocks`` blocks by a hash of
the id. The words that a source gives to the mix fix a whole number of block
draws (its quota): full passes over its blocks, then blocks of one more pass in
permuted order as long as they fit. A binary tree splits the vector of quotas
among the output shards: a node that holds ``n`` shards sends to its left half
a multivariate-hypergeometric draw of its blocks, so every shard gets a random
but exact part and the parts add up. Each shard then takes the next disjoint
run of its sources' permuted draws and is shuffled by a hash of its own.

The driver holds one row per source and one quota per source and shard; the
documents, their blocks and the draws stay in Spark. All randomness comes from
hashes and a seeded generator over sorted sources, so reruns agree.

Defined results: null text has no words; null is a source of its own, last in
order; rows with one id share a block, so repeated rows are taken equally
often; a source without words has target 0; an empty table gives an empty
result. Only id, source and text are read to plan the mix.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import WORD_GAP, free_name, numbered_rows, or_empty, own_columns, stored


def word_count(col: Column) -> Column:
    return F.size(F.array_remove(F.split(col, WORD_GAP), "")).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source (in order): ``share`` of all words by repeating
    weights; who would pass ``most`` times the own size stops there and the
    rest is shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    stopped = [s == 0 for s in sizes]
    goal = share * sum(sizes)
    while True:
        open_w = sum(x for x, s in zip(w, stopped) if not s)
        if not open_w:
            return [most * s for s in sizes]
        rate = (goal - most * sum(s for s, x in zip(sizes, stopped) if x)) / open_w
        over = [not x and rate * b > most * s for s, x, b in zip(sizes, stopped, w)]
        if not any(over):
            return [most * s if x else rate * b for s, x, b in zip(sizes, stopped, w)]
        stopped = [a or b for a, b in zip(stopped, over)]


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """``[shard, source]`` block counts: exact in every column, near equal in total by shard."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(first: int, n: int, q: np.ndarray) -> None:
        if n == 1:
            out[first] = q
            return
        left = n // 2
        rng = np.random.Generator(np.random.PCG64([seed, first, n]))
        part = rng.multivariate_hypergeometric(q, int(q.sum()) * left // n, method="marginals") if q.sum() else q
        node(first, left, part)
        node(first + left, n - left, q - part)

    node(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _draws(seed: int):
    """Block draws of one source (at most ``blocks`` rows): full passes, then what fits."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        size, target = int(b["words"].sum()), float(b["target"].iloc[0])
        passes = int(target // size) if size else 0
        got = []
        for e in range(passes + 1):
            o = b.assign(order=pd.util.hash_array((b["block"].to_numpy() + np.int64(e) * 1_000_003 + seed).astype(np.uint64)))
            o = o.sort_values(["order", "block"])
            if e == passes:
                gap, take = target - passes * size, []
                words = o["words"].to_numpy()
                for w in words:
                    take.append(bool(size) and 0 < w <= gap)
                    gap -= w if take[-1] else 0
                # one more block if that brings the sum nearer to the target
                spare = [i for i, t in enumerate(take) if not t and 0 < words[i] < 2 * gap]
                if spare:
                    take[min(spare, key=lambda i: (words[i], i))] = True
                o = o[take]
            got.append(o.assign(epoch=e))
        out = pd.concat(got)
        return out.assign(pos=np.arange(len(out)))[["source", "block", "epoch", "pos"]]
    return run


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
             blocks: int = 4096, shards: int = 32, seed: int = 7, id_col: str = "doc_id",
             source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, draws): every document with its size and block; every
    source with its size and target; every block draw with its output shard."""
    ship_package(docs.sparkSession)
    rows = numbered_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                     word_count(or_empty(text_col)).alias("size"), block_of(id_col, blocks, seed).alias("block")), "row")
    cells = stored(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    found = sorted(((r[0], int(r[1])) for r in cells.groupBy("source").agg(F.sum("words")).collect()),
                   key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([s for _, s in found], weights, share, most)
    spark = docs.sparkSession
    sources = spark.createDataFrame([(n, s, float(t)) for (n, s), t in zip(found, goal)],
                                    "source string, source_size long, target double")
    b = cells.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.*", "s.target")
    draws = stored(b.groupBy("source").applyInPandas(_draws(seed), "source string, block int, epoch int, pos long"), "mix-draws")
    quota = {r[0]: int(r[1]) for r in draws.groupBy("source").count().collect()}
    parts = split_quotas([quota.get(n, 0) for n, _ in found], shards, seed).cumsum(axis=0)
    ends = spark.createDataFrame([(n, parts[:, i].tolist()) for i, (n, _) in enumerate(found)], "source string, ends array<long>")
    draws = draws.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))).select(
        "d.*", F.expr("size(filter(e.ends, x -> x <= d.pos))").alias("shard"))
    return rows, sources, draws


def block_of(id_col: str, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(blocks)).cast("int")


def mix_key(seed: int, shard: Column, epoch: Column, doc_id: Column) -> Column:
    """The key that shuffles a shard."""
    return F.xxhash64(F.lit(seed), shard, epoch, doc_id)


def dealt_rows(rows: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """(row, size, shard, place): each row in each output shard that draws its
    block, and its place in the shuffled shard. A shard's places are counted
    by runs of keys, so no shard is one task; equal keys (rows with one id) go
    by row number."""
    on = F.col("r.source").eqNullSafe(F.col("w.source")) & (F.col("r.block") == F.col("w.block"))
    d = rows.alias("r").join(draws.alias("w"), on).select(
        "r.row", "r.size", "w.shard", mix_key(seed, F.col("w.shard"), F.col("w.epoch"), F.col("r.doc_id")).alias("key"))
    d = stored(d.withColumn("cell", F.shiftright("key", 56).cast("int")), "mix-dealt")  # 256 runs of keys a shard
    first = d.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "first", F.expr("sum(n) over (partition by shard order by cell) - n")).drop("n")
    rank = d.withColumn("rank", F.expr("row_number() over (partition by shard, cell order by key, row) - 1"))
    return rank.join(F.broadcast(first), ["shard", "cell"]).select(  # at most 256 rows a shard
        "row", "size", "shard", (F.col("first") + F.col("rank")).cast("long").alias("place"))


def taken_words(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """One row per document: its words, its source's words and target, the words
    that the output shards take of it, and where its copies lie in the shuffled
    shards (``shard:place``, parted by spaces; empty if it is not taken)."""
    rows, sources, draws = plan_mix(docs, seed=seed, **how)
    got = dealt_rows(rows, draws, seed).groupBy("row").agg(
        F.sum("size").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "place"))).alias("at"))  # at most ``most`` copies and one
    out = rows.join(got, "row", "left").alias("r")
    return out.join(F.broadcast(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.doc_id", "r.source", "r.size", "s.source_size", "s.target", F.coalesce(F.col("r.taken"), F.lit(0)).cast("long").alias("taken"),
        F.coalesce(F.expr("concat_ws(' ', transform(r.at, x -> concat(x.shard, ':', x.place)))"), F.lit("")).alias("places"))


def mixed(docs: DataFrame, blocks: int = 4096, seed: int = 7, id_col: str = "doc_id", source_col: str = "source",
          with_place: bool = False, place: tuple[str, str] = ("mix_shard", "mix_key"), **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw of its block.

    ``with_place`` adds the output shard and the key that shuffles it, named by ``place`` (names that ``docs`` must
    not have); sorting each shard by its key is its local shuffle (``shuffled``, ``write_mix``).
    """
    _, _, draws = plan_mix(docs, blocks=blocks, seed=seed, id_col=id_col, source_col=source_col, **how)
    own = free_name(docs, "__block")
    d = docs.withColumn(own, block_of(id_col, blocks, seed)).alias("d")
    out = d.join(draws.alias("w"), F.col(f"d.{source_col}").eqNullSafe(F.col("w.source")) & (F.col(f"d.{own}") == F.col("w.block")))
    more = [F.col("w.shard").alias(place[0]),
            mix_key(seed, F.col("w.shard"), F.col("w.epoch"), F.col(f"d.{id_col}")).alias(place[1])] if with_place else []
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns], *more)


def shuffled(docs: DataFrame, shards: int = 32, cuts: int | None = None, **how) -> DataFrame:
    """The mix in the order of its output shards, each shuffled by its own key.

    Partition ``cuts * s + c`` holds the c-th run of the keys of shard s, sorted; so a shard is ``cuts`` partitions
    (and files, once written) in a row. Without ``cuts`` there are as many as fill Spark's shuffle partitions; they
    don't change the order.
    """
    cuts = cuts or -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    shard, key = free_name(docs, "__mix_shard"), free_name(docs, "__mix_key")
    m = mixed(docs, with_place=True, place=(shard, key), shards=shards, **how)
    run = F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * F.lit(cuts) / F.lit(1 << 32)).cast("int")
    m = m.repartitionById(shards * cuts, F.col(shard) * F.lit(cuts) + run)
    return m.sortWithinPartitions(shard, key).select(*own_columns(docs))


def write_mix(docs: DataFrame, path: str, **how) -> None:
    """One folder per output shard, each shuffled by its own key."""
    m = mixed(docs, with_place=True, **how)
    m.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_key").write.partitionBy("mix_shard").parquet(path)
