"""Skew-safe per-series window machinery.

A series is never one window partition: rows are keyed by
``(series, block)`` where a block is a fixed run of grid bins.

* ``with_halo`` copies the last ``lookback`` bins of each block into the
  next block and the first ``lookahead`` bins into the previous one, so
  bounded frames (lag, lead, rolling, capped recency) are exact inside a
  block. Copies are flagged and dropped after the window.
* unbounded "last non-null so far" fills use a carry-in per block: last
  value per block (a small table) -> running last over blocks -> in-block
  running last seeded with it (see ``timeline._grid_segments``).
* ``previous_in_series`` and ``series_positions`` give the previous row
  and the row position of irregular rows with the same block trick.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import block_of

HALO_COL = "_halo"
FBLK_COL = "_fblk"


def with_halo(df: DataFrame, bin_col: str, bins_per_block: int,
              lookback: int, lookahead: int) -> DataFrame:
    """Assign each row to its block and, as a flagged copy, to neighbours."""
    if lookback > bins_per_block or lookahead > bins_per_block:
        raise ValueError("block must be at least as long as the halo")
    b = F.col(bin_col)
    blk = block_of(b, bins_per_block)
    off = b - blk * F.lit(bins_per_block)
    parts = [F.struct(blk.alias(FBLK_COL), F.lit(False).alias(HALO_COL))]
    if lookback > 0:
        parts.append(F.when(off >= bins_per_block - lookback,
                            F.struct((blk + 1).alias(FBLK_COL), F.lit(True).alias(HALO_COL))))
    if lookahead > 0:
        parts.append(F.when(off < lookahead,
                            F.struct((blk - 1).alias(FBLK_COL), F.lit(True).alias(HALO_COL))))
    return df.select("*", F.inline(F.array_compact(F.array(*parts))))


def block_window(series_cols: Sequence[str], bin_col: str) -> Window:
    return Window.partitionBy(*series_cols, FBLK_COL).orderBy(bin_col)


def previous_in_series(df: DataFrame, series_cols: Sequence[str], ts_col: str,
                       block_minutes: int = 1440, payload: Sequence[str] = ()) -> DataFrame:
    """Previous row (by ``ts_col``) of the same series for irregular rows,
    block-parallel: in-block ``lag`` seeded by the last row of the nearest
    earlier non-empty block (a one-row-per-block table). Adds ``prev_<ts>``
    and ``prev_<col>`` for each payload column."""
    s = list(series_cols)
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    step = int(block_minutes) * 60_000_000
    d = df.select("*", ((us - F.pmod(us, F.lit(step))) / F.lit(step)).cast("long").alias("_pblk"),
                  us.alias("_pus"))
    last_in_blk = d.groupBy(*s, "_pblk").agg(
        F.max(F.struct(F.col("_pus").alias("u"), *[F.col(c).alias(c) for c in payload],
                       F.col(ts_col).alias("t"))).alias("_lst"))
    wb = Window.partitionBy(*s).orderBy("_pblk")
    seed = last_in_blk.select(*s, "_pblk", F.lag("_lst").over(wb).alias("_seed"))
    w = Window.partitionBy(*s, "_pblk").orderBy("_pus")
    prev = F.lag(F.struct(F.col("_pus").alias("u"), *[F.col(c).alias(c) for c in payload],
                          F.col(ts_col).alias("t"))).over(w)
    x = d.select("*", prev.alias("_prv")).join(seed, s + ["_pblk"], "left")
    p = F.coalesce(F.col("_prv"), F.col("_seed"))
    return x.select(*df.columns, p.getField("t").alias(f"prev_{ts_col}"),
                    *[p.getField(c).alias(f"prev_{c}") for c in payload])


def series_positions(df: DataFrame, series_cols: Sequence[str], ts_col: str,
                     block_minutes: int = 1440, tie_cols: Sequence[str] = ()) -> DataFrame:
    """0-based row position and row count per series, block-parallel:
    counts per (series, block) -> running offset over blocks -> in-block
    ``row_number``. Adds ``_pos`` and ``_len``."""
    s = list(series_cols)
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    step = int(block_minutes) * 60_000_000
    d = df.select("*", ((us - F.pmod(us, F.lit(step))) / F.lit(step)).cast("long").alias("_sblk"),
                  us.alias("_sus"))
    cnt = d.groupBy(*s, "_sblk").agg(F.count("*").alias("_c"))
    wb = Window.partitionBy(*s).orderBy("_sblk").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(*s, "_sblk", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"),
                     F.sum("_c").over(Window.partitionBy(*s)).alias("_len"))
    w = Window.partitionBy(*s, "_sblk").orderBy("_sus", *tie_cols)
    x = d.join(off, s + ["_sblk"], "inner")
    return x.select(*df.columns, (F.row_number().over(w) - 1 + F.col("_off")).alias("_pos"), "_len")
