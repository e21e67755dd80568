"""Gapless grid and unified timeline: J1-J6, A1-A6, W10, P8, P12, P17.

Plan shape (per call):

1. readings and carbs are summed per (series, bin) with map-side partial
   aggregation, so a high-rate series-day is small before it is dealt out;
   these sums, pump events, intervals, decay horizons and the grid extent
   (A6) become block-level segments (sparse: they grow with events).
2. ONE repartition by (series, block) into ``grid_tasks`` tasks, counted by
   grid bins (the segments' size says nothing of the rows that come of them),
   and a sort of the segments.
3. a few blocks at a time are laid out as arrays (``dense``): the dense rows
   are neither sorted, hashed nor joined. Unbounded forward fills (J3, A4/W10)
   run inside a block and are seeded by the last value of earlier blocks, which
   travels as one more segment at the block's first own bin.

No theta join and no per-series task: as-of (J3), interval stab (J4/J5)
and decay projection (J6) are bin ranges inside a block.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import (IOB_HORIZON_MIN, IOB_TAU_MIN, MICROS_PER_MINUTE,
                                bin_ceil_of_micros, bin_to_ts, block_of, ceil_bin, floor_bin,
                                micros, null_if_nan)
from .dense import dense_rows, timeline_values

BIN, BLK = "_bin", "_blk"
FBLK = "_fblk"


def grid_extent(readings: DataFrame, pump: DataFrame | None, series_cols: Sequence[str],
                ts_col: str = "timestamp") -> DataFrame:
    """Per series min/max event time over readings and pump events,
    plus the A5 flag "some bolus reports IOB". A series with pump events only
    has a grid too; its glucose is missing."""
    s = list(series_cols)
    parts = [readings.select(*s, F.col(ts_col).alias("_ts"), F.lit(False).alias("_riob"))]
    if pump is not None:
        parts.append(pump.select(*s, F.col(ts_col).alias("_ts"),
                                 ((F.col("event_type") == "bolus") & F.col("iob_units").isNotNull())
                                 .alias("_riob")))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (u.groupBy(*s)
            .agg(F.min("_ts").alias("lo_ts"), F.max("_ts").alias("hi_ts"),
                 F.bool_or("_riob").alias("has_real_iob")).filter("lo_ts is not null"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def grid_blocks(extent: DataFrame, series_cols: Sequence[str], freq_minutes: int,
                bins_per_block: int) -> DataFrame:
    """(series, blk, lo_bin, hi_bin) for every block a series' grid touches."""
    lo = floor_bin("lo_ts", freq_minutes)
    hi = ceil_bin("hi_ts", freq_minutes)
    e = extent.select(*series_cols, "has_real_iob", lo.alias("_lo"), hi.alias("_hi"))
    blocks = e.select("*", F.explode(F.sequence(block_of("_lo", bins_per_block),
                                                block_of("_hi", bins_per_block))).alias(BLK))
    return blocks.repartition(_tasks(blocks), *series_cols, BLK)


def grid_from_blocks(blocks: DataFrame, series_cols: Sequence[str], bins_per_block: int) -> DataFrame:
    """Gapless bins, floor(min) .. ceil(max), exploded per block."""
    start = F.greatest(F.col("_lo"), F.col(BLK) * F.lit(bins_per_block))
    stop = F.least(F.col("_hi"), F.col(BLK) * F.lit(bins_per_block) + F.lit(bins_per_block - 1))
    return blocks.select(*series_cols, BLK, "has_real_iob", F.explode(F.sequence(start, stop)).alias(BIN))


def gapless_grid(readings: DataFrame, pump: DataFrame | None = None, *,
                 series_cols: Sequence[str] = ("series_id",), freq_minutes: int = 5,
                 block_minutes: int = 1440, ts_col: str = "timestamp") -> DataFrame:
    """J1 as a public operator: (series..., timestamp) every ``freq_minutes``."""
    bpb = max(1, block_minutes // freq_minutes)
    g = grid_from_blocks(grid_blocks(grid_extent(readings, pump, series_cols, ts_col),
                                     series_cols, freq_minutes, bpb), series_cols, bpb)
    return g.select(*series_cols, bin_to_ts(BIN, freq_minutes).alias("timestamp"))


def _segments(df: DataFrame, series_cols, lo: Column, hi: Column, bins_per_block: int,
              lookback: int, lookahead: int, payload: dict[str, Column]) -> DataFrame:
    """Block-level rows for bins lo..hi (inclusive; none when hi < lo).

    A bin x is needed by block f when f*B - lookback <= x <= f*B + B - 1 +
    lookahead (its own block plus the halos of its neighbours), so one
    input row becomes one row per such block, clipped to that range. Rows
    stay sparse: bins are generated only after the shuffle.
    """
    B = bins_per_block
    d = df.select(*series_cols, lo.alias("_ilo"), hi.alias("_ihi"),
                  *[c.alias(n) for n, c in payload.items()]).filter("_ihi >= _ilo")
    d = d.select("*", F.explode(F.sequence(block_of(F.col("_ilo") - F.lit(lookahead), B),
                                           block_of(F.col("_ihi") + F.lit(lookback), B))).alias(FBLK))
    start = F.greatest(F.col("_ilo"), F.col(FBLK) * F.lit(B) - F.lit(lookback))
    stop = F.least(F.col("_ihi"), F.col(FBLK) * F.lit(B) + F.lit(B - 1 + lookahead))
    return d.select(*series_cols, FBLK, start.alias("_s0"), stop.alias("_s1"), *payload) \
        .filter(F.col("_s0") <= F.col("_s1"))


def _basal_points(pump: DataFrame, series_cols, freq_minutes: int, seq_col, ts_col) -> DataFrame:
    """Newest basal sample per (series, ceil bin); ties by ``seq``. A
    NULL-valued newest sample stays NULL (struct max keeps the row)."""
    ts = F.col(ts_col)
    seq = F.col(seq_col) if seq_col and seq_col in pump.columns else F.lit(0).cast("long")
    bas = pump.filter(F.col("event_type") == "basal").select(
        *series_cols, ceil_bin(ts, freq_minutes).alias(BIN),
        F.struct(micros(ts).alias("us"), seq.alias("seq"), F.col("value").alias("v")).alias("_m"))
    return bas.groupBy(*series_cols, BIN).agg(F.max("_m").alias("_m")) \
        .select(*series_cols, BIN, F.col("_m.v").alias("basal_v"), F.lit(True).alias("basal_p"))


#: grid bins that one task lays out
BINS_PER_TASK = 1 << 21
#: the timeline's columns and their types
TIMELINE = {"glucose_mg_dl": "double", "trend_arrow_encoded": "double", "iob_units": "double", "bolus_units": "double",
            "basal_rate": "double", "is_suspended": "boolean", "control_iq_active": "boolean", "carbs_g": "double"}


def grid_tasks(readings: DataFrame, pump: DataFrame | None, series_cols: Sequence[str], freq_minutes: int,
               ts_col: str = "timestamp") -> int:
    """Tasks for the dense rows: the shuffle's number, more where a task would
    lay out over ``BINS_PER_TASK`` bins (one count over the series' extents)."""
    e = grid_extent(readings, pump, series_cols, ts_col)
    n = e.agg(F.sum(ceil_bin("hi_ts", freq_minutes) - floor_bin("lo_ts", freq_minutes) + 1)).first()[0] or 0
    return max(_tasks(e), -(-n // BINS_PER_TASK))


def timeline_blocks(readings: DataFrame, pump: DataFrame | None = None,
                    treatments: DataFrame | None = None, *, fields: Sequence[T.StructField],
                    values: Callable, needs: Sequence[str] = tuple(TIMELINE),
                    series_cols: Sequence[str] = ("series_id",), freq_minutes: int = 5,
                    block_minutes: int = 1440, bin_mode: str = "floor",
                    tau_min: float = IOB_TAU_MIN, horizon_min: int = IOB_HORIZON_MIN,
                    seq_col: str | None = "seq", ts_col: str = "timestamp",
                    lookback: int = 0, lookahead: int = 0, reported: DataFrame | None = None,
                    settled: DataFrame | None = None, tasks: int | None = None, folder: str | None = None,
                    digits: int | None = None) -> DataFrame:
    """series..., ``fields`` for every bin of the unified timeline.

    Only sparse rows are shuffled: grid extents, events and intervals as
    block-level segments go through ONE repartition by (series, block) into
    ``tasks`` tasks (default: ``grid_tasks``); the bins are laid out, aggregated
    and forward filled block by block as arrays (``dense.dense_rows``), from which
    ``values`` takes the fields. ``needs`` names the timeline columns it reads:
    segments of the others are not made.

    ``reported`` (series..., has_real_iob) tells which series report IOB where
    ``pump`` is only a part of their events. ``settled`` (series..., since, upto;
    null: to the end) gives the times that a boolean field ``settled`` tells apart.
    With ``folder`` the rows are written there, with ``digits`` doubles are rounded
    (see ``dense_rows``).
    """
    s, needs = list(series_cols), set(needs)
    B = max(1, block_minutes // freq_minutes)
    L, H = int(lookback), int(lookahead)
    fb = floor_bin if bin_mode == "floor" else ceil_bin
    ts = F.col(ts_col)

    def seg(df, lo, hi, payload):
        return _segments(df, s, lo, hi, B, L, H, payload)

    def point(df, b, payload):
        return seg(df, b, b, payload)

    # The grid of each block, and what earlier blocks leave for it
    parts = [_grid_segments(readings, pump, reported, settled, s, B, L, H, freq_minutes, fb, seq_col, ts_col)]
    # A1 readings (mean = sum / count, NULLs skipped)
    if needs & {"glucose_mg_dl", "trend_arrow_encoded"}:
        g, t = null_if_nan(F.col("glucose_mg_dl").cast("double")), null_if_nan(F.col("trend_arrow_encoded").cast("double"))
        binned = readings.groupBy(*s, fb(ts, freq_minutes).alias(BIN)).agg(
            F.sum(g).alias("g_sum"), F.count(g).alias("g_cnt"), F.sum(t).alias("t_sum"), F.count(t).alias("t_cnt"))
        parts.append(point(binned, F.col(BIN), {c: F.col(c) for c in ("g_sum", "g_cnt", "t_sum", "t_cnt")}))
    if pump is not None:
        et = F.col("event_type")
        # One pass over the pump table: every event becomes 0-2 segments
        # (an array of same-typed structs, exploded), instead of one scan
        # per event kind.
        #  A2 bolus units (NULL dose counts 0) and A4 reported IOB max: floor bin
        #  J6 decay projection: bins with 0 <= bin - floor_minute(ts) <= horizon
        #  J4 / J5 interval flags: grid time in [start, start + dur);
        #          dur <= 0 or NULL -> 5 min
        ts_min = F.floor(micros(ts) / F.lit(MICROS_PER_MINUTE)).cast("long")
        dose = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
        dur = F.col("duration_minutes")
        dur = F.when(dur.isNull() | (dur <= 0), F.lit(5.0)).otherwise(dur)
        start_us = micros(ts)
        end_us = start_us + (dur * F.lit(float(MICROS_PER_MINUTE))).cast("long")
        nul_d, nul_l, nul_b = (F.lit(None).cast(t) for t in ("double", "long", "boolean"))

        def item(lo, hi, bolus_sum=nul_d, iob_max=nul_d, d=nul_d, tmin=nul_l, susp=nul_b, ciq=nul_b):
            return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"),
                            bolus_sum.alias("bolus_sum"), iob_max.cast("double").alias("iob_max"), d.alias("_dose"),
                            tmin.alias("_tmin"), susp.alias("susp"), ciq.alias("ciq"))

        fbin = fb(ts, freq_minutes)
        kinds = {("bolus_units", "iob_units"): ("bolus", F.when(et == "bolus", item(
                     fbin, fbin, bolus_sum=dose, iob_max=F.col("iob_units")))),
                 ("iob_units",): ("bolus", F.when((et == "bolus") & (dose > 0), item(
                     bin_ceil_of_micros(ts_min * F.lit(MICROS_PER_MINUTE), freq_minutes),
                     F.floor((ts_min + F.lit(horizon_min)) / F.lit(freq_minutes)), d=dose, tmin=ts_min))),
                 ("is_suspended",): ("suspend", F.when(et == "suspend", item(
                     bin_ceil_of_micros(start_us, freq_minutes),
                     bin_ceil_of_micros(end_us, freq_minutes) - 1, susp=F.lit(True)))),
                 ("control_iq_active",): ("control_iq_action", F.when(et == "control_iq_action", item(
                     bin_ceil_of_micros(start_us, freq_minutes),
                     bin_ceil_of_micros(end_us, freq_minutes) - 1, ciq=F.lit(True))))}
        kinds = [k for cols, k in kinds.items() if needs & set(cols)]
        if kinds:
            ev = pump.filter(et.isin(*sorted({name for name, _ in kinds}))) \
                .select(*s, F.explode(F.array_compact(F.array(*[k for _, k in kinds]))).alias("_it")).select(*s, "_it.*")
            parts.append(seg(ev, F.col("lo"), F.col("hi"),
                             {c: F.col(c) for c in ("bolus_sum", "iob_max", "_dose", "_tmin", "susp", "ciq")}))
        # J3 basal samples (ceil bin: grid time >= sample time)
        if "basal_rate" in needs:
            bas = _basal_points(pump, s, freq_minutes, seq_col, ts_col)
            parts.append(point(bas, F.col(BIN), {"basal_v": F.col("basal_v").cast("double"), "basal_p": F.col("basal_p")}))
    if treatments is not None and "carbs_g" in needs:
        eaten = treatments.groupBy(*s, fb(ts, freq_minutes).alias(BIN)).agg(
            F.sum(F.coalesce(F.col("carbs_g"), F.lit(0.0))).alias("carbs_sum"))
        parts.append(point(eaten, F.col(BIN), {"carbs_sum": F.col("carbs_sum").cast("double")}))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return dense_rows(u, s, FBLK, fields, values, tasks=tasks or grid_tasks(readings, pump, s, freq_minutes, ts_col),
                      bins_per_block=B, lookback=L, lookahead=H, freq_minutes=freq_minutes, tau_min=tau_min, folder=folder, digits=digits)


def _grid_segments(readings: DataFrame, pump: DataFrame | None, reported: DataFrame | None,
                   settled: DataFrame | None, s, B, L, H, freq_minutes, fb, seq_col, ts_col) -> DataFrame:
    """One segment of grid bins for every block that a series' extent
    touches, halo included, and for every block with an earlier basal sample
    or IOB report one segment on its first own bin that holds the last of
    each (``seed_*``).

    The pump events are read once, down to a row per series-block (extent,
    newest basal sample, last reported IOB: of several in a bin the largest);
    a window over these rows gives each the state it leaves to the blocks up
    to the series' next one with events.
    """
    ts = F.col(ts_col)
    known = readings.filter(ts.isNotNull()).groupBy(*s).agg(F.min(ts).alias("lo_ts"), F.max(ts).alias("hi_ts"))
    lo, hi = floor_bin("lo_ts", freq_minutes), ceil_bin("hi_ts", freq_minutes)
    if pump is None:
        e = known.select(*s, lo.alias("_lo"), hi.alias("_hi"), F.lit(False).alias("_riob"))
        spans = [F.struct(block_of("_lo", B).alias("f0"), block_of("_hi", B).alias("f1"), F.lit(True).alias("_grid"))]
    else:
        et = F.col("event_type")
        basal, tells = et == "basal", (et == "bolus") & F.col("iob_units").isNotNull()
        seq = F.col(seq_col) if seq_col and seq_col in pump.columns else F.lit(0).cast("long")
        b = F.when(basal, ceil_bin(ts, freq_minutes)).otherwise(fb(ts, freq_minutes))
        days = pump.filter(ts.isNotNull()).groupBy(*s, block_of(b, B).alias("_b")).agg(
            F.min(ts).alias("lo_ts"), F.max(ts).alias("hi_ts"), F.bool_or(tells).alias("_riob"),
            F.max(F.when(basal, F.struct(micros(ts).alias("us"), seq.alias("seq"), F.col("value").alias("v")))).alias("_bv"),
            F.max(F.when(tells, F.struct(b.alias("b"), F.col("iob_units").alias("x")))).alias("_iv"))
        d = days.unionByName(known, allowMissingColumns=True)
        whole = Window.partitionBy(*s)
        w = whole.orderBy("_b")  # the readings' row has no block and comes first
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        e = d.select(*s, "_b", F.lead("_b").over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_first"),
                     F.last("_bv", True).over(run).alias("_bv"), F.last("_iv", True).over(run).alias("_iv"),
                     F.min("lo_ts").over(whole).alias("lo_ts"), F.max("hi_ts").over(whole).alias("hi_ts"),
                     F.coalesce(F.bool_or("_riob").over(whole), F.lit(False)).alias("_riob"))
        e = e.select("*", lo.alias("_lo"), hi.alias("_hi"))
        last = block_of("_hi", B)
        spans = [F.when(F.col("_first"), F.struct(block_of("_lo", B).alias("f0"), last.alias("f1"),
                                                  F.lit(True).alias("_grid"))),
                 F.when(F.col("_bv").isNotNull() | F.col("_iv").isNotNull(),
                        F.struct((F.col("_b") + F.lit(1)).alias("f0"), F.coalesce("_next", last).alias("f1"),
                                 F.lit(False).alias("_grid")))]
    if reported is not None:
        e = e.drop("_riob").join(reported.select(*s, F.col("has_real_iob").alias("_riob")), s, "left")
    if settled is not None:
        e = e.join(settled.select(*s, ceil_bin("since", freq_minutes).alias("_since"),
                                  floor_bin("upto", freq_minutes).alias("_upto")), s, "left")
    e = e.select("*", F.inline(F.array_compact(F.array(*spans)))).filter("f1 >= f0")
    e = e.select("*", F.explode(F.sequence("f0", "f1")).alias(FBLK))
    grid, first = F.col("_grid"), F.col(FBLK) * F.lit(B)
    cols = [F.when(grid, F.greatest(F.col("_lo"), first - F.lit(L))).otherwise(first).alias("_s0"),
            F.when(grid, F.least(F.col("_hi"), first + F.lit(B - 1 + H))).otherwise(first).alias("_s1"),
            F.when(grid, F.lit(True)).alias("_grid"),
            F.when(grid, F.coalesce("_riob", F.lit(False))).alias("has_real_iob")]
    if settled is not None:
        cols += [F.when(grid, F.col(c)).alias(c) for c in ("_since", "_upto")]
    if pump is not None:
        cols += [F.when(~grid, F.col("_bv.v")).alias("seed_v"),
                 F.when(~grid & F.col("_bv").isNotNull(), F.lit(True)).alias("seed_p"),
                 F.when(~grid, F.col("_iv.x")).alias("seed_i")]
    return e.select(*s, FBLK, *cols)


def timeline_fields(names: Sequence[str]) -> list[T.StructField]:
    """The timestamp and the given columns of the timeline."""
    return [T.StructField("timestamp", T.TimestampType())] + [
        T.StructField(c, T.BooleanType() if TIMELINE[c] == "boolean" else T.DoubleType()) for c in names]


def unified_timeline(readings: DataFrame, pump: DataFrame | None = None,
                     treatments: DataFrame | None = None, *,
                     series_cols: Sequence[str] = ("series_id",), freq_minutes: int = 5,
                     block_minutes: int = 1440, bin_mode: str = "floor",
                     tau_min: float = IOB_TAU_MIN, horizon_min: int = IOB_HORIZON_MIN,
                     seq_col: str | None = "seq", ts_col: str = "timestamp",
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Readings + pump events + carb treatments on one gapless grid per series.

    Output: series..., timestamp, glucose_mg_dl, trend_arrow_encoded,
    iob_units, bolus_units, basal_rate, is_suspended, control_iq_active,
    carbs_g, or those of them in ``columns``. Glucose gaps stay NULL; basal and
    reported IOB persist to the grid end; carbs outside the grid are dropped.
    ``bin_mode='ceil'`` bins sums/means at the first grid time at or after the
    event (leak-free) instead of the default floor.
    """
    names = [c for c in TIMELINE if columns is None or c in columns]
    return timeline_blocks(readings, pump, treatments, fields=timeline_fields(names), values=timeline_values, needs=names,
                           series_cols=series_cols, freq_minutes=freq_minutes, block_minutes=block_minutes,
                           bin_mode=bin_mode, tau_min=tau_min, horizon_min=horizon_min, seq_col=seq_col, ts_col=ts_col)


def tumbling_mean(readings: DataFrame, *, series_cols=("series_id",), freq_minutes: int = 5,
                  value_cols=("glucose_mg_dl",), ts_col: str = "timestamp") -> DataFrame:
    """A1 alone: left-closed, left-labelled bin mean per series (no grid)."""
    b = floor_bin(ts_col, freq_minutes)
    return (readings.groupBy(*series_cols, b.alias(BIN))
            .agg(*[F.avg(c).alias(c) for c in value_cols])
            .select(*series_cols, bin_to_ts(BIN, freq_minutes).alias("timestamp"), *value_cols))
