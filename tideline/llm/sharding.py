"""Minimax contiguous sharding of atomic groups.

Rows with equal texts form an atomic group; groups are ordered by the SHA-256
of their text and cut into contiguous shards so that the largest shard is as
small as any contiguous cut can make it. The smallest feasible capacity is
found by binary search; a capacity is checked greedily (fill a shard up to the
capacity, cut at the last group boundary, go on). The cuts are then set within
that capacity, each as near to an even share as the groups behind it allow.

The ordered group sizes stay in Spark. The driver sees sums over key prefixes:
first the 4-digit prefixes, then longer ones, and only of those prefixes where
a cut can fall. Two bounds steer that: cutting only at prefix borders is never
better than the real optimum, and cutting inside a prefix at any byte is never
worse. Once every prefix that a cut can touch holds one group, the greedy check
on the sums is the check on the groups. Groups above an even share (fewer than
the number of shards) are put first in the order, one shard each, as otherwise
they would set the capacity of all others.

Defined results: null text counts as empty and as equal to the empty text;
repeated rows stay together; with fewer groups than shards the last shards
stay empty; an empty table gives an empty result. Columns other than the id
and the text are not read, so clashing names do no harm.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, or_empty, stored

FIRST_DIGITS = 4
MOST_PREFIXES = 1 << 20


@dataclass
class Cuts:
    """Where the shards begin: oversize group keys own shards 0.., then shard
    ``len(alone) + i`` begins at the key prefix ``starts[i - 1]`` (the first at '')."""
    alone: list[str] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)
    capacity: int = 0


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    t = or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"),
                       (F.octet_length(t) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"),
                       F.sha2(t, 256).alias("group_key"))


def _greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Greedy cuts (indices into ``ends``, exclusive) with whole units only;
    empty if ``shards`` shards of that capacity don't hold all."""
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        nxt = int(np.searchsorted(ends, done + capacity, side="right"))
        if nxt == at and at < len(ends):
            return []
        at = nxt
        cuts.append(at)
        if at == len(ends):
            return cuts
        done = int(ends[at - 1])
    return []


def _smallest(low: int, high: int, feasible) -> int:
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    return low


def _even(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each as near to an even share as the rest allows."""
    total, at, cuts = int(ends[-1]), 0, []
    for k in range(1, shards):
        done = int(ends[at - 1]) if at else 0
        if at == len(ends):
            break
        far = max(at + 1, int(np.searchsorted(ends, done + capacity, side="right")))
        goal = total * k // shards
        near = int(np.searchsorted(ends, goal, side="right"))
        if near < len(ends) and ends[near] - goal < goal - (ends[near - 1] if near else 0):
            near += 1
        near = min(max(near, at + 1), far)
        if near < len(ends):  # the smallest cut from here on whose rest still fits
            near = _smallest(near, far, lambda i: i == far or bool(_greedy(ends[i:] - ends[i - 1], capacity, shards - k)))
        cuts.append(near)
        at = near
    return cuts


def _reach(ends: np.ndarray, whole: np.ndarray, capacity: int, shards: int, loose: bool) -> list[int]:
    """Furthest byte that each shard can reach: ``loose`` lets a unit of
    several groups be cut at any byte, else only at its borders."""
    out, done, total = [], 0, int(ends[-1])
    for _ in range(shards):
        i = int(np.searchsorted(ends, done + capacity, side="right"))
        if i == len(ends):
            done = total
        elif loose and not whole[i]:
            done = done + capacity
        else:
            done = max(done, int(ends[i - 1]) if i else 0)
        out.append(done)
    return out


def find_cuts(groups: DataFrame, shards: int, key: str = "group_key", size: str = "size") -> Cuts:
    """The minimax cuts of ``groups`` (one row per group: hex key, size)."""
    total = groups.agg(F.sum(size)).first()[0]
    if not total:
        return Cuts()
    cuts, left = Cuts(), shards
    while left > 1:  # at most shards - 1 groups can exceed an even share
        share = -(-total // left)
        more = [(r[0], r[1]) for r in groups.filter((F.col(size) > share) & ~F.col(key).isin(cuts.alone))
                .select(key, size).orderBy(F.desc(size), key).limit(left - 1).collect()]
        if not more:
            break
        cuts.alone += [k for k, _ in more]
        total, left = total - sum(s for _, s in more), left - len(more)
    rest = groups.filter(~F.col(key).isin(cuts.alone)) if cuts.alone else groups
    if not total:
        return cuts

    def sums(digits: int, within: list[str] | None = None) -> list[tuple[str, int, int]]:
        d = rest
        if within is not None:  # at most MOST_PREFIXES short strings
            n = len(within[0])
            want = d.sparkSession.createDataFrame([(x,) for x in within], "__want string")
            d = d.join(F.broadcast(want), F.substring(key, 1, n) == F.col("__want"), "left_semi")
        d = d.groupBy(F.substring(key, 1, digits).alias("p")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n"))
        return [(r["p"], int(r["s"]), int(r["n"])) for r in d.collect()]

    units = sorted(sums(FIRST_DIGITS))
    largest = rest.agg(F.max(size)).first()[0]
    while True:
        ends = np.cumsum([u[1] for u in units], dtype=np.int64)
        whole = np.array([u[2] == 1 for u in units])
        least = max(-(-total // left), largest)
        low = _smallest(least, total, lambda c: _reach(ends, whole, c, left, True)[-1] >= total)
        high = _smallest(low, total, lambda c: bool(_greedy(ends, c, left)))
        first, last = _reach(ends, whole, low, left, False), _reach(ends, whole, high, left, True)
        split = set()
        for a, b in zip(first, last):
            i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="right"))
            split.update(k for k in range(i, min(j + 1, len(units))) if not whole[k])
        if not split:
            break
        by_len: dict[int, list[str]] = {}
        for k in split:
            by_len.setdefault(len(units[k][0]), []).append(units[k][0])
        more = 1
        while more < 8 and len(split) * 16 ** (more + 1) <= MOST_PREFIXES:
            more += 1
        units = [u for k, u in enumerate(units) if k not in split]
        for n, prefixes in by_len.items():
            units += sums(min(n + more, 64), sorted(prefixes))
        units.sort()
    cuts.capacity = high
    cuts.starts = [units[i][0] for i in _even(ends, high, left) if i < len(units)]
    return cuts


def shard_of(key, cuts: Cuts):
    """The shard of a key, as one expression over at most ``shards`` literals."""
    out = F.lit(len(cuts.alone))
    for s in cuts.starts:
        out = out + (key >= F.lit(s)).cast("int")
    for i, k in enumerate(cuts.alone):
        out = F.when(key == F.lit(k), F.lit(i)).otherwise(out)
    return out.cast("int")


def minimax_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 16) -> DataFrame:
    """One row per document: its size, CRC-32, group key, shard and slot."""
    rows = stored(sized(docs, id_col, text_col, overhead), "shard-sizes")
    groups = stored(rows.groupBy("group_key").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = find_cuts(groups, shards)
    rows = rows.withColumn("shard", shard_of(F.col("group_key"), cuts))
    return numbered(rows, ["shard"], "slot", ["doc_id", "group_key"], cells=256)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents in one folder per shard, for ids that are unique."""
    a = assigned.select(F.col("doc_id").alias("__id"), "shard", "slot")
    docs.join(a, docs[id_col] == a["__id"]).drop("__id").write.partitionBy("shard").parquet(path)
