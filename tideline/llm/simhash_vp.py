"""SimHash near-dedup: exact Hamming search with vantage-point trees.

A text's 64-bit fingerprint takes the majority of its shingles' XXH64 bits.
Distinct fingerprints that differ in at most ``max_bits`` bits are linked.

Shards come from vantage-point trees. Over all 64 bits such a tree would hardly
prune: unrelated fingerprints lie 32 +- 4 bits from any vantage point, so a
radius of 4 crosses most boundaries. Therefore the bits are cut into ``parts``
slices with one tree over each. Two fingerprints within ``max_bits`` differ in
at most ``max_bits // parts`` bits on some slice (pigeonhole), and that is the
query radius in the slice's tree. A node sends a fingerprint to the inner
branch if d(x, v) <= mu, else to the outer one; a query also enters the other
branch if d(x, v) lies within the radius of mu (triangle bound), so it meets
the shards whose boundary it overlaps. With the default of ``max_bits + 1``
slices the radius is 0 and no fingerprint is copied to a second shard of a tree.

Inside a shard all 64 bits count: a vantage-point tree over the shard's
fingerprints, with the full radius, ends in small leaves that are compared
exactly. Shards above ``shard_rows`` are cut into chunks and every pair of
chunks is a task of its own, so a large group of near copies is no hot spot.
A task returns links to local representatives only (at most one per row), so
links never grow with the square of a group. Components follow from
alternating large-star and small-star joins in Spark.

Vantage points and radii come from a bounded sample of distinct fingerprints
(``sample``); any sample gives the same links, only shard sizes differ. The
driver holds the trees (``parts * 2**depth`` nodes) and the sizes of oversized
shards.

Defined results: null text counts as empty; a text without words has
fingerprint 0; a null id never names a component unless all its ids are null;
repeated rows share fingerprint and component; an empty table gives an empty
result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import free_name, numbered_rows, or_empty, own_columns, stored

CHUNK = 1 << 16
LEAF = 256


# ------------------------------------------------------------ fingerprints
def fingerprint(text: str, words_in_shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text (repeated shingles count repeatedly)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    k, n = words_in_shingle, max(1, len(words) - words_in_shingle + 1)
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[k - 1:].tolist() if len(words) >= k else [len(norm)]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(norm[a:b], seed) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) with ``fp`` the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    @F.pandas_udf("long")
    def fp(b: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words_in_shingle, seed) for t in b], dtype=np.uint64).view(np.int64))

    return docs.select(*[F.col(c) for c in keep or []], F.col(id_col).alias("doc_id"), fp(or_empty(text_col)).alias("fp"))


# ------------------------------------------------------------ trees
def slices(parts: int) -> list[np.uint64]:
    """Bit masks of ``parts`` near-equal runs of the 64 bits."""
    edge = [64 * i // parts for i in range(parts + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(edge, edge[1:])]


class RouteTree:
    """A complete vantage-point tree of a given depth over one slice."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int, seed: int):
        self.mask, self.depth = mask, depth
        rng = np.random.default_rng([seed, int(mask) % (1 << 31)])
        self.point = np.zeros((1 << depth) - 1, dtype=np.uint64)
        self.radius = np.zeros((1 << depth) - 1, dtype=np.uint8)
        inside = {0: sample & mask}
        for node in range((1 << depth) - 1):
            x = inside.pop(node, np.zeros(0, dtype=np.uint64))
            self.point[node] = (rng.choice(x) if len(x) else rng.integers(0, 1 << 63, dtype=np.uint64)) & mask
            d = np.bitwise_count(x ^ self.point[node])
            if len(x):  # the radius that halves the sample best
                r = np.arange(int(d.max()) + 1)
                self.radius[node] = r[np.abs((d[None, :] <= r[:, None]).sum(1) - len(x) / 2).argmin()]
            else:
                self.radius[node] = int(mask).bit_count() // 2
            inside[2 * node + 1], inside[2 * node + 2] = x[d <= self.radius[node]], x[d > self.radius[node]]

    def route(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): the leaf of each row, and the leaves its ball overlaps."""
        row, node, home = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
        x = x & self.mask
        for _ in range(self.depth):
            d = np.bitwise_count(x[row] ^ self.point[node]).astype(np.int64)
            mu = self.radius[node].astype(np.int64)
            inner = d <= mu
            guest = np.where(inner, d + radius > mu, d - radius <= mu)
            row, home = np.concatenate([row, row[guest]]), np.concatenate([home, np.zeros(int(guest.sum()), dtype=bool)])
            node = np.concatenate([2 * node + np.where(inner, 1, 2), (2 * node + np.where(inner, 2, 1))[guest]])
        return row, node - ((1 << self.depth) - 1), home


def linked_pairs(x: np.ndarray, q: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (index in x, index in q) within ``radius``, in bounded batches, by a
    vantage-point tree over ``x`` that the queries descend together."""
    stack = [(np.arange(len(x)), np.arange(len(q)))]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) <= LEAF or len(b) <= 4:
            step = max(1, (1 << 20) // len(a))
            for at in range(0, len(b), step):
                near = np.bitwise_count(x[a][:, None] ^ q[b[at:at + step]][None, :]) <= radius
                i, j = np.nonzero(near)
                if len(i):
                    yield a[i], b[at:at + step][j]
            continue
        v = x[a[len(a) // 2]]
        da, db = np.bitwise_count(x[a] ^ v).astype(np.int16), np.bitwise_count(q[b] ^ v).astype(np.int16)
        mu = int(np.median(da))
        if (da > mu).all() or (da <= mu).all():
            mu = int(da.min())
            if (da <= mu).all():  # one distance: nothing to split by this point; cut by position
                h = len(a) // 2
                near = b[np.abs(db - mu) <= radius]
                stack += [(a[:h], near), (a[h:], near)]
                continue
        # triangle bounds: a query at distance d reaches inner points if d - r <= mu, outer ones if d + r > mu
        stack += [(a[da <= mu], b[db - radius <= mu]), (a[da > mu], b[db + radius > mu])]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index linked with each of ``n`` rows, by union-find over batches."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            if (lo == hi).all():
                break
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root = root[root]
    return root


def links(fps: DataFrame, max_bits: int = 4, parts: int | None = None, sample: int = 16384, leaf_rows: int = 256,
          shard_rows: int = 4096, max_depth: int = 12, seed: int = 42) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints of ``fps`` (column
    ``fp``): enough of them to connect all that differ in <= ``max_bits`` bits."""
    ship_package(fps.sparkSession)
    parts = parts or max_bits + 1
    radius, masks = max_bits // parts, slices(parts)
    n = fps.count()
    some = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(-(-n // sample))) == 0) if n > sample else fps
    got = np.array(sorted(r[0] for r in some.collect()), dtype=np.int64).view(np.uint64)  # about ``sample`` rows at most
    depth = int(np.clip(np.ceil(np.log2(max(1, n / leaf_rows))), 0, max_depth))
    trees = [RouteTree(got, m, depth, seed) for m in masks]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                row, leaf, home = tree.route(x, radius)
                yield pd.DataFrame({"shard": (t << max_depth) + leaf, "fp": x[row].view(np.int64), "home": home})

    placed = stored(fps.mapInPandas(route, "shard long, fp long, home boolean"), "vp-placed")
    big = placed.groupBy("shard").count().filter(F.col("count") > shard_rows)
    chunks = {int(r[0]): -(-int(r[1]) // shard_rows) for r in big.collect()}  # at most parts * 2**depth rows

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row of an oversized shard goes to each pair of chunks that has its own."""
        for b in batches:
            m = b["shard"].map(chunks).fillna(1).astype(np.int64).to_numpy()
            yield b[m == 1].assign(lo=0, hi=0, mine=0)
            for shard, g in b[m > 1].groupby("shard"):
                c = chunks[shard]
                own = pd.util.hash_array(g["fp"].to_numpy()) % c
                for other in range(c):
                    yield g.assign(lo=np.minimum(own, other), hi=np.maximum(own, other), mine=own).astype(
                        {"lo": "int32", "hi": "int32", "mine": "int32"})

    def search(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("fp")
        x, home, mine = g["fp"].to_numpy().view(np.uint64), g["home"].to_numpy(), g["mine"].to_numpy()
        left = np.flatnonzero(home & (mine == g["lo"].iloc[0]))
        right = np.flatnonzero(mine == g["hi"].iloc[0])
        pairs = ((left[i], right[j]) for i, j in linked_pairs(x[left], x[right], max_bits))
        root = _roots(len(x), pairs)
        if g["lo"].iloc[0] != g["hi"].iloc[0] and not home.all():  # home rows of the other chunk against guests of this one
            left, right = np.flatnonzero(home & (mine == g["hi"].iloc[0])), np.flatnonzero(~home & (mine == g["lo"].iloc[0]))
            more = ((left[i], right[j]) for i, j in linked_pairs(x[left], x[right], max_bits))
            other = _roots(len(x), more)
            a = np.concatenate([x[root], x[other]])
            b = np.concatenate([x, x])
        else:
            a, b = x[root], x
        a, b = a.view(np.int64), b.view(np.int64)
        a, b = np.minimum(a, b), np.maximum(a, b)
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    tasks = placed.mapInPandas(cut, "shard long, fp long, home boolean, lo int, hi int, mine int")
    return tasks.groupBy("shard", "lo", "hi").applyInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node that it reaches. Large-star and small-star take turns; each round is
    written to the shared folder."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # neighbours above a node move to the smallest of its neighbourhood
            half = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:  # neighbours below a node, and the node, move to the smallest below it
            half = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = half.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = half.join(low, "u")
        if large:
            out = moved.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = moved.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
                low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a != b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = stored(edges, "links")
    before = mark(e)
    while True:
        e = stored(star(star(e, True), False), "stars")
        now = mark(e)
        if now == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now


def grouped(prints: DataFrame, max_bits: int = 4, **how) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with ``component_id``, the smallest id reachable."""
    by_fp = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = components(links(by_fp.select("fp"), max_bits, **how))
    known = stored(by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select(
        by_fp["fp"], "first", F.coalesce("root", by_fp["fp"]).alias("root")), "print-roots")
    first = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(known.join(first, "root").select("fp", "root", "component_id"), "fp")


def simhash_near_dedup(docs: DataFrame, words_in_shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                       text_col: str = "text", seed: int = 42, **how) -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and component."""
    prints = stored(fingerprints(docs, words_in_shingle, seed, id_col, text_col), "prints")
    return grouped(prints, max_bits, **how).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words_in_shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                text_col: str = "text", seed: int = 42, **how) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id."""
    row = free_name(docs, "__row")
    rows = numbered_rows(docs, row)
    own = rows.select(F.col(row).alias("__row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(own, words_in_shingle, seed, "id", "text", keep=["__row"]), "prints")
    g = grouped(prints, max_bits, **how)
    # of rows that share the component's smallest id (or have none), the first row stays
    stays = g.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("__row").alias("__row"))
    dropped = g.select("__row").join(stays.select("__row"), "__row", "left_anti").select(F.col("__row").alias("__dropped"))
    return rows.join(dropped, rows[row] == dropped["__dropped"], "left_anti").select(*own_columns(docs))
