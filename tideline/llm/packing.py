"""Best-fit packing after a Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens, and packing only sees
how many pieces there are of each length: at most ``capacity`` counts, however
large the corpus. On these counts

1. the reduction fixes small sets that provably dominate every other set for
   their sequence: a piece with which nothing fits stays alone; a pair that
   fills a sequence exactly; a piece with the largest partner that fits, where
   no two pieces fit beside it, or no two that together are longer than that
   partner (and no three at all). Fixing such a set never costs a sequence;
2. best fit in decreasing length packs the rest.

Both work on runs of equal pieces, so the plan is a list of runs (length, ranks,
sequences, offset); it is bounded by the capacity, not by the data. Spark
numbers the pieces of each length and looks up their run.

Defined results: null text counts as empty, and an empty text is the one end
token; repeated rows are separate documents; an empty table gives an empty
result. Only the id and the text are read.
"""
from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import byte_symbols, numbered, or_empty, stored

#: letters below U+0100 with ASCII punctuation around, as RE2 reads it
_PLAIN = r"^(?P<head>[!-/:-@\[-`{-~]*)(?P<run>[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
_TOKENIZERS: dict[str, object] = {}
_CACHE_WORDS = 800_000
#: bytes of texts coded at once (or one longer text)
_TEXT_BYTES = 4 << 20


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _strung(table: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a table (one after the other, each of its size) by number, and
    where each of these begins and the last ends."""
    sizes = size[numbers]
    until = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat((np.cumsum(size) - size)[numbers] - until[:-1], sizes)
    at += np.arange(len(at))
    return table[at], until


class WordEncoder:
    """Ids of texts, 32 bits each.

    This tokenizer lower-cases, never joins characters across white space, and
    parts letters from punctuation. So the ids of a text are those of its words in
    turn, and those of a word of letters with ASCII punctuation around are the ids
    of the punctuation and of the lower-case letters, whose merges the tokenizer's
    model finds without the steps before it. A marker such as <|endoftext|> in a
    text is its one id, as in a plain ``encode``.

    Arrow cuts the texts into words (at ASCII white space: a word with another kind
    inside goes to the tokenizer whole), numbers the distinct ones and cuts these
    into runs of letters and punctuation, numbered again; so Python looks up each
    distinct run once for all texts given, and ids are gathered by number. Runs,
    punctuation and other words are kept once encoded (a full store takes no more,
    so it keeps the frequent ones). All words of another kind of tokenizer, told by
    a probe, go to it as they are.
    """

    def __init__(self, path: str | None):
        self.tokenizer = _tokenizer(path or default_tokenizer())
        self.model, self.bytes = self.tokenizer.model, byte_symbols()
        self.runs: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}
        self.odd: dict[str, bytes] = {}
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marker = "|".join(map(re.escape, added))
        probe = ["Straße", "ÉTÉS", "Nations", "(it,", "x."]
        self.quick = True
        self.quick = self.encode_all(probe) == self._direct(probe)

    def _direct(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of lower-case letters."""
        merged, table = self.model.tokenize, self.bytes
        return [array("I", [x.id for x in merged(r if r.isascii() else r.encode().decode("latin-1").translate(table))]).tobytes() for r in runs]

    def _ids(self, store: dict[str, bytes], words: pa.Array, code: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        words = words.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(store.get, words))
        new = [w for w, x in zip(words, ids) if x is None]
        if new:
            found = code(new)
            if len(store) + len(new) <= _CACHE_WORDS:
                store.update(zip(new, found))
            fresh = iter(found)
            ids = [next(fresh) if x is None else x for x in ids]
        return ids

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a line, and how many each has."""
        cut = pc.extract_regex(words, _PLAIN)
        plain = pc.and_(cut.is_valid(), self.quick)
        head, run, tail = (pc.fill_null(pc.struct_field(cut, k), "") for k in range(3))
        plain = pc.and_not(plain, pc.match_substring(head, "'"))
        if self.marker:
            plain = pc.and_not(plain, pc.match_substring_regex(pc.utf8_lower(words), self.marker))
        head, run, tail = (pc.if_else(plain, x, "").dictionary_encode() for x in (head, pc.utf8_lower(run), tail))
        odd = pc.invert(plain).to_numpy(zero_copy_only=False)
        ids = self._ids(self.odd, words.filter(pc.invert(plain)), self._direct)
        at, numbers = len(ids), []
        for x, store, code in ((head, self.marks, self._direct), (run, self.runs, self._letters), (tail, self.marks, self._direct)):
            numbers.append(x.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(ids))
            ids += self._ids(store, x.dictionary, code)
        numbers[1][odd] = np.arange(at)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        found, until = _strung(np.frombuffer(b"".join(ids), dtype="<u4"), size, np.stack(numbers, axis=1).ravel())
        return found, np.diff(until[::3])

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a line, and where each text's begin and the last end."""
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        ids, until = _strung(*self._table(words.dictionary), words.indices.to_numpy(zero_copy_only=False))
        return ids, until[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.coded(pa.array(texts, pa.string()))
        data, at = ids.tobytes(), (4 * ends).tolist()
        return [data[i:j] for i, j in zip(at, at[1:])]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, as many at once as ``_TEXT_BYTES`` of text hold, one at least."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("t")).to_numpy(zero_copy_only=False))])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _TEXT_BYTES, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None,
                 keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens and one end token, cut only where longer than ``capacity``."""
    ship_package(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer)
        for b in (part for whole in batches for part in _slices(whole)):
            ids, ends = enc.coded(b.column("t"))
            size = np.diff(ends) + 1
            data = memoryview(np.insert(ids, ends[1:], end_id).astype("<u4", copy=False)).cast("B")
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            at = 4 * ((np.cumsum(size) - size)[doc] + start)
            held = [data[i:j] for i, j in zip(at.tolist(), (at + 4 * length).tolist())]
            cols = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(list(map(zlib.crc32, held)), pa.int64())] + ([pa.array(list(map(bytes, held)), pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), or_empty(text_col).alias("t")).mapInArrow(run, schema)


class Plan:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, dtype=np.int64)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.fixed = 0

    def put(self, length: int, n: int, sequence: int, offset: int, each: int = 1) -> None:
        self.runs.append((length, int(self.rank[length]), n, sequence, each, offset))
        self.rank[length] += n
        self.left[length] -= n

    def fix(self, lengths: tuple[int, ...], n: int) -> None:
        """``n`` sequences with one piece of each length (a length may repeat)."""
        at = 0
        for x in lengths:
            self.put(x, n, self.sequences, at)
            at += x
        self.sequences += n
        self.fixed += n

    def smallest(self, n: int, but: int) -> list[int]:
        """The ``n`` shortest pieces left when one of length ``but`` is taken away."""
        out = []
        for x in np.flatnonzero(self.left):
            out += [int(x)] * min(n - len(out), int(self.left[x]) - (x == but))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int, but: int) -> int:
        """The largest sum of two pieces within ``room``."""
        have = [int(x) for x in np.flatnonzero(self.left)]
        free = {x: int(self.left[x]) - (x == but) for x in have}
        have, best = [x for x in have if free[x] and x <= room], 0
        i, j = 0, len(have) - 1
        while i <= j:
            s = have[i] + have[j]
            if s > room:
                j -= 1
                continue
            if i < j or free[have[i]] > 1:
                best = max(best, s)
            i += 1
        return best

    def reduce(self) -> None:
        c = self.capacity
        self.fix((c,), int(self.left[c])) if self.left[c] else None
        for x in range(c - 1, (c - 1) // 2, -1):  # pairs that fill a sequence
            y = c - x
            n = int(self.left[x]) // 2 if x == y else int(min(self.left[x], self.left[y]))
            if n:
                self.fix((x, y), n)
        for x in range(c - 1, 0, -1):
            while self.left[x]:
                room, few = c - x, self.smallest(3, x)
                if not few or few[0] > room:
                    self.fix((x,), int(self.left[x]))  # two of them don't fit either
                    continue
                fits = [int(y) for y in np.flatnonzero(self.left[:room + 1]) if self.left[y] - (y == x)]
                y = fits[-1]
                alone = len(few) < 2 or few[0] + few[1] > room
                if not alone:
                    no_three = len(few) < 3 or sum(few) > room
                    alone = no_three and y >= self.best_pair(room, x)
                if not alone:
                    break
                # taking pieces away never breaks the rule, so it holds until x or y run out
                self.fix((x, y), int(self.left[x]) // 2 if x == y else int(min(self.left[x], self.left[y])))

    def best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = {}
        sizes: list[int] = []

        def add(size: int, first: int, n: int) -> None:
            if size not in room:
                room[size] = []
                bisect.insort(sizes, size)
            room[size].append((first, n))

        for x in range(self.capacity, 0, -1):
            while self.left[x]:
                n, k = int(self.left[x]), bisect.bisect_left(sizes, x)
                if k < len(sizes):
                    size = sizes[k]
                    first, m = room[size].pop()
                    if not room[size]:
                        del room[size]
                        sizes.pop(k)
                    use = min(m, n)
                    self.put(x, use, first, self.capacity - size)
                    if use < m:
                        add(size, first + use, m - use)
                    if size > x:
                        add(size - x, first, use)
                    continue
                each = self.capacity // x
                full = n // each
                first = self.sequences
                if full:
                    self.put(x, full * each, first, 0, each)
                    self.sequences += full
                    if self.capacity - each * x:
                        add(self.capacity - each * x, first, full)
                if n % each:
                    self.put(x, n % each, self.sequences, 0, each)
                    add(self.capacity - (n % each) * x, self.sequences, 1)
                    self.sequences += 1


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    p = Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return p


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None,
         keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its offset there (and its ids)."""
    pieces = stored(token_pieces(docs, capacity, end_id, tokenizer, keep_ids, id_col, text_col), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan_packing(counts, capacity).runs
    ranked = numbered(pieces, ["length"], "rank", ["doc_id", "piece"])
    plan = docs.sparkSession.createDataFrame(runs, "length long, rank_from long, n long, seq_from long, each long, at long")
    r, p = ranked.alias("r"), F.broadcast(plan).alias("p")  # runs are bounded by the capacity
    nth = F.col("r.rank") - F.col("p.rank_from")
    return r.join(p, (F.col("r.length") == F.col("p.length")) & (nth >= 0) & (nth < F.col("p.n"))).select(
        *[F.col(f"r.{c}") for c in pieces.columns],
        (F.col("p.seq_from") + F.floor(nth / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.at") + F.pmod(nth, F.col("p.each")) * F.col("r.length")).cast("long").alias("offset"))
