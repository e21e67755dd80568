"""Dense grid rows from the sparse segments of a block, as arrays [block, bin].

``dense_rows`` reads the segments of ``timeline._segments`` sorted by (series,
block) and lays a few blocks at a time into NumPy arrays, halo included. Neither
a dense row is sorted, nor hashed, nor kept: a task holds the arrays of about
``CELLS`` bins, whatever the number of its rows, and a block with very many
events is summed up batch by batch.

With a ``folder`` the tasks write the rows there themselves, as Parquet from the
arrays, and only a row a block comes out of them: the dense rows then go neither
through a socket nor through Spark's rows and its writer.
"""
from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship_package

#: bins laid out at once (arrays of this size stay in a core's cache)
CELLS = 1 << 15
MICROS_PER_MINUTE = 60_000_000
#: rows of a row group that a task writes
ROW_GROUP = 1 << 17
#: sums and largest values of a bin, by segment column
SUMS, FLAGS = ("g_sum", "g_cnt", "t_sum", "t_cnt", "bolus_sum", "carbs_sum"), ("susp", "ciq")


class Blocks:
    """The bins of ``n`` blocks with ``lookback`` and ``lookahead`` bins of halo.

    Values come with a mask of those that are missing (None: none is)."""

    def __init__(self, n: int, bins_per_block: int, lookback: int, lookahead: int, freq_minutes: int, tau_min: float,
                 digits: int | None = None):
        self.n, self.size, self.lookback, self.freq, self.tau = n, bins_per_block, lookback, freq_minutes, tau_min
        self.digits = digits
        self.width = lookback + bins_per_block + lookahead
        self.first = np.zeros(n, np.int64)  # the bin of column 0
        self.lo, self.hi = np.full(n, self.width, np.int64), np.full(n, -1, np.int64)
        self.reported = np.zeros(n, bool)
        self.since, self.upto = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)  # bins that are settled
        shape = (n, self.width)
        self.sum = {c: np.zeros(shape) for c in SUMS}
        self.flag = {c: np.zeros(shape, bool) for c in FLAGS}
        self.decayed = np.zeros(shape)
        self.iob, self.has_iob = np.full(shape, -np.inf), np.zeros(shape, bool)
        self.basal, self.has_basal, self.no_basal = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        self.seed_iob, self.has_seed_iob = np.zeros(n), np.zeros(n, bool)
        self.seed_basal, self.has_seed, self.no_seed = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)

    def _arrays(self) -> list[np.ndarray]:
        own = [v for v in vars(self).values() if isinstance(v, np.ndarray)]
        return own + [*self.sum.values(), *self.flag.values()]

    def put(self, at: int, other: Blocks, i: int) -> None:
        """Block ``i`` of ``other`` becomes block ``at``."""
        for mine, theirs in zip(self._arrays(), other._arrays()):
            mine[at] = theirs[i]

    def add(self, seg: dict, block: np.ndarray) -> None:
        """Segments, a dict of (values, given) by column, to the blocks of their numbers."""
        lo, hi = (seg[c][0] - self.first[block] for c in ("_s0", "_s1"))
        cell = block * self.width + lo

        def rows(c):
            """Rows that have the column, their values."""
            v, given = seg.get(c, (None, None))
            at = np.flatnonzero(given) if v is not None else np.empty(0, np.int64)
            return at, v[at] if len(at) else at

        at, _ = rows("_grid")
        np.minimum.at(self.lo, block[at], lo[at])
        np.maximum.at(self.hi, block[at], hi[at])
        at, v = rows("has_real_iob")
        np.logical_or.at(self.reported, block[at], v.astype(bool))
        at, v = rows("_since")
        self.since[block[at]] = v
        at, v = rows("_upto")
        self.upto[block[at]] = v
        for c in SUMS:
            at, v = rows(c)
            np.add.at(self.sum[c].reshape(-1), cell[at], v.astype(np.float64))
        at, v = rows("iob_max")
        np.maximum.at(self.iob.reshape(-1), cell[at], v)
        self.has_iob.reshape(-1)[cell[at]] = True
        at, v = rows("_dose")
        if len(at):
            n = hi[at] - lo[at] + 1
            of = np.repeat(np.arange(len(at)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            minute = (seg["_s0"][0][at][of] + step) * self.freq - seg["_tmin"][0][at][of]
            np.add.at(self.decayed.reshape(-1), cell[at][of] + step, v[of] * np.exp(-minute / self.tau))
        for c in FLAGS:
            at, _ = rows(c)
            if len(at):
                edge = np.zeros((self.n, self.width + 1), np.int32)
                np.add.at(edge, (block[at], lo[at]), 1)
                np.add.at(edge, (block[at], hi[at] + 1), -1)
                self.flag[c] |= np.cumsum(edge[:, :-1], axis=1) > 0
        at, _ = rows("basal_p")
        if len(at):  # one a bin
            v, given = seg["basal_v"]
            self.basal.reshape(-1)[cell[at]], self.no_basal.reshape(-1)[cell[at]] = v[at], ~given[at]
            self.has_basal.reshape(-1)[cell[at]] = True
        at, _ = rows("seed_p")
        if len(at):  # one a block
            v, given = seg["seed_v"]
            self.seed_basal[block[at]], self.no_seed[block[at]], self.has_seed[block[at]] = v[at], ~given[at], True
        at, v = rows("seed_i")
        self.seed_iob[block[at]], self.has_seed_iob[block[at]] = v, True

    # ------------------------------------------------------------ what the bins hold
    def shown(self, a: np.ndarray) -> np.ndarray:
        """Values as they are put out: as they are, or rounded to ``digits`` places,
        halves away from zero, -0.0 as 0.0 (the arithmetic of ``plans.output``)."""
        if self.digits is None:
            return a
        m = float(10 ** self.digits)
        off = a * m
        r = np.rint(off)
        off -= r
        np.abs(off, out=off)
        half = off == 0.5
        if half.any():
            y = a[half] * m
            r[half] = y + np.copysign(0.5, y)
        r /= m
        r += 0.0
        return r

    def own(self, a: np.ndarray, shift: int = 0) -> np.ndarray:
        """The blocks' own bins, or those ``shift`` bins later."""
        return a[:, self.lookback + shift:self.lookback + shift + self.size]

    @cached_property
    def grid(self) -> np.ndarray:
        x = np.arange(self.width)
        return (x >= self.lo[:, None]) & (x <= self.hi[:, None])

    def mean(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the readings of each bin, halo included."""
        n = self.sum[f"{name}_cnt"]
        none = ~(self.grid & (n > 0))
        return np.divide(self.sum[f"{name}_sum"], n, out=np.zeros_like(n), where=~none), none

    def total(self, name: str) -> np.ndarray:
        """Sum of each bin, halo included."""
        return np.where(self.grid, self.sum[name], 0.0)

    def _filled(self, values, has, seed, has_seed) -> tuple[np.ndarray, np.ndarray]:
        """Own bins' last value so far, and where there is none; ``seed`` holds before the first."""
        values, has = self.own(values), self.own(has)
        last = np.maximum.accumulate(np.where(has, np.arange(self.size), -1), axis=1)
        out = np.where(last >= 0, np.take_along_axis(values, np.maximum(last, 0), axis=1), seed[:, None])
        return out, (last < 0) & ~has_seed[:, None]

    def basal_rate(self):
        v, none = self._filled(self.basal, self.has_basal, self.seed_basal, self.has_seed)
        unknown, _ = self._filled(self.no_basal, self.has_basal, self.no_seed, self.has_seed)
        return v, none | unknown

    def iob_units(self):
        v, none = self._filled(self.iob, self.has_iob, self.seed_iob, self.has_seed_iob)
        return np.where(self.reported[:, None], np.where(none, 0.0, v), self.own(self.decayed)), None

    def flagged(self, name: str):
        return self.own(self.flag[name]), None

    def settled(self):
        return (self.bins() >= self.since[:, None]) & (self.bins() <= self.upto[:, None]), None

    def bins(self) -> np.ndarray:
        """Own bins' numbers."""
        return (self.first + self.lookback)[:, None] + np.arange(self.size)


def timeline_values(b: Blocks) -> dict[str, Callable]:
    """The timeline's columns on the blocks' own bins, each computed when called."""
    def mean(name):
        v, none = b.mean(name)
        return b.shown(b.own(v)), b.own(none)

    def shown(of):
        v, none = of()
        return b.shown(v), none

    return {"timestamp": lambda: (b.bins() * (b.freq * MICROS_PER_MINUTE), None),
            "glucose_mg_dl": lambda: mean("g"), "trend_arrow_encoded": lambda: mean("t"),
            "iob_units": lambda: shown(b.iob_units), "bolus_units": lambda: (b.shown(b.own(b.total("bolus_sum"))), None),
            "basal_rate": lambda: shown(b.basal_rate), "is_suspended": lambda: b.flagged("susp"),
            "control_iq_active": lambda: b.flagged("ciq"), "settled": b.settled, "carbs_g": lambda: (b.shown(b.own(b.total("carbs_sum"))), None)}


def _runs(given: np.ndarray) -> list[slice]:
    """The runs of set values of a flat mask."""
    edge = np.flatnonzero(np.diff(given, prepend=False, append=False))
    return [slice(a, z) for a, z in zip(edge[::2], edge[1::2])]


def _column(values: np.ndarray, missing: np.ndarray | None, kind: pa.DataType, runs: list[slice]) -> pa.Array:
    """The cells of the runs; few of them, since a grid has no gap."""
    def cells(a):
        flat = a.reshape(-1)
        return flat[runs[0]] if len(runs) == 1 else np.concatenate([flat[r] for r in runs])

    values = cells(values)
    if pa.types.is_boolean(kind):
        return pa.array(values.astype(bool, copy=False), kind)
    given = None
    if missing is not None:
        given = pa.py_buffer(np.packbits(~cells(missing), bitorder="little"))
    plain = np.int64 if pa.types.is_timestamp(kind) else kind.to_pandas_dtype()
    return pa.Array.from_buffers(kind, len(values), [given, pa.py_buffer(np.ascontiguousarray(values, plain))])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path on it."""
    if re.match(r"(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


class _PartFile:
    """The Parquet file of one task. It gets its name, the same for every attempt
    at the task, when it is whole; until then Spark doesn't see it."""

    def __init__(self, folder: str):
        task = TaskContext.get()
        self.store, root = _store(folder)
        name = f"part-{task.partitionId():06d}.parquet"
        self.path, self.part = os.path.join(root, name), os.path.join(root, f".{name}-{task.taskAttemptId()}")
        self.writer, self.held, self.rows = None, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows >= ROW_GROUP:
            self._flush()

    def _flush(self) -> None:
        if not self.rows:
            return
        table = pa.Table.from_batches(self.held)
        if self.writer is None:  # statistics only where a scan can use them
            self.writer = pq.ParquetWriter(self.part, table.schema, filesystem=self.store, compression="zstd", use_dictionary=False,
                                           store_schema=False, write_statistics=[c for c in table.schema.names if c in ("timestamp", "settled")])
        self.writer.write_table(table, row_group_size=self.rows)
        self.held, self.rows = [], 0

    def close(self) -> None:
        self._flush()
        if self.writer is not None:
            self.writer.close()
            if self.store.get_file_info(self.path).type != fs.FileType.NotFound:  # of an earlier attempt
                self.store.delete_file(self.path)
            self.store.move(self.part, self.path)


def dense_rows(segments: DataFrame, series_cols: Sequence[str], block_col: str, fields: Sequence[T.StructField],
               values: Callable[[Blocks], dict[str, Callable]], *, tasks: int, bins_per_block: int, lookback: int,
               lookahead: int, freq_minutes: int, tau_min: float, folder: str | None = None,
               digits: int | None = None) -> DataFrame:
    """series..., ``fields`` for every grid bin of every block, from its segments.

    ``values`` gives the fields by name, on own bins. The segments are dealt to
    ``tasks`` tasks by (series, block). With ``digits`` doubles are rounded. With ``folder`` (an empty one that driver and
    executors share) the rows go there when the result is computed; that holds
    series..., _start, _end: the first and last settled time of each block."""
    ship_package(segments.sparkSession)
    s, shape = list(series_cols), (bins_per_block, lookback, lookahead, freq_minutes, tau_min, digits)
    width = lookback + bins_per_block + lookahead
    kinds = {"timestamp": pa.timestamp("us", tz="UTC"), "timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "boolean": pa.bool_(),
             "tinyint": pa.int8(), "bigint": pa.int64()}
    wanted = [(f.name, kinds[f.dataType.simpleString()]) for f in fields]

    def rows_of(b: Blocks, keys: list[pa.Array]) -> pa.RecordBatch | None:
        given = b.own(b.grid)
        of = np.arange(b.n).repeat(given.sum(axis=1))
        if not len(of):
            return None
        cells, runs = values(b), _runs(given.reshape(-1))
        with np.errstate(all="ignore"):
            out = [_column(*cells[c](), kind, runs) for c, kind in wanted]
        return pa.RecordBatch.from_arrays([k.take(pa.array(of)) for k in keys] + out, names=s + [c for c, _ in wanted])

    def stretches_of(b: Blocks, keys: list[pa.Array]) -> pa.RecordBatch:
        settled = b.settled()[0] & b.own(b.grid)
        of = np.flatnonzero(settled.any(axis=1))
        first, last = settled.argmax(axis=1), b.size - 1 - settled[:, ::-1].argmax(axis=1)
        at = [pa.array(b.bins()[of, x[of]] * (freq_minutes * MICROS_PER_MINUTE)).cast(kinds["timestamp"]) for x in (first, last)]
        return pa.RecordBatch.from_arrays([k.take(pa.array(of)) for k in keys] + at, names=s + ["_start", "_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, keys in laid_out(batches):
            out = rows_of(b, keys)
            if out is not None:
                yield out

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _PartFile(folder)
        for b, keys in laid_out(batches):
            out = rows_of(b, keys)
            if out is not None:
                file.add(out)
                yield stretches_of(b, keys)
        file.close()

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Blocks, list[pa.Array]]]:
        """A few blocks at a time and their keys."""
        held = None  # the last block so far, which may go on: its key columns and arrays
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = dict(zip(batch.schema.names, batch.columns))
            keys = [cols.pop(c) for c in s]
            blk = cols[block_col].to_numpy(zero_copy_only=False)
            new = np.ones(batch.num_rows, bool)
            new[1:] = blk[1:] != blk[:-1]
            for k in keys:
                code = pc.dictionary_encode(k, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            seg = {c: (pc.fill_null(v, False if pa.types.is_boolean(v.type) else 0).to_numpy(zero_copy_only=False),
                       v.is_valid().to_numpy(zero_copy_only=False)) for c, v in cols.items()}
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            name = [repr((blk[0], *[k[0].as_py() for k in keys])), repr((blk[-1], *[k[-1].as_py() for k in keys]))]
            step = max(1, CELLS // width)
            for g0 in range(0, len(start), step):
                g1 = min(g0 + step, len(start))
                a, z = start[g0], start[g1] if g1 < len(start) else batch.num_rows
                at = start[g0:g1]
                before = 0
                if held is not None:  # only before a batch's first blocks
                    before = int(held[0] != name[0])
                b = Blocks(g1 - g0 + before, *shape)
                b.first[before:] = blk[at] * bins_per_block - lookback
                part = [k.take(pa.array(at)) for k in keys]
                if held is not None:
                    b.put(0, held[2], held[2].n - 1)
                    part = [pa.concat_arrays([h, p.slice(1 - before)]) for h, p in zip(held[1], part)]
                    held = None
                b.add({c: (v[a:z], given[a:z]) for c, (v, given) in seg.items()}, group[a:z] - g0 + before)
                if g1 == len(start):  # the last block waits for the next batch
                    held = (name[1], [k.slice(b.n - 1) for k in part], Blocks(1, *shape))
                    held[2].put(0, b, b.n - 1)
                    b.hi[-1] = -1
                yield b, part
        if held is not None:
            yield held[2], held[1]

    dealt = segments.repartition(tasks, *s, block_col).sortWithinPartitions(*s, block_col)
    keys = [segments.schema[c] for c in s]
    if folder is None:
        return dealt.mapInArrow(run, T.StructType(keys + list(fields)))
    return dealt.mapInArrow(write, T.StructType(keys + [T.StructField(c, T.TimestampType()) for c in ("_start", "_end")]))
