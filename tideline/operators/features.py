"""Feature table: W1-W9, W11, W13, P10-P14, T1.

``timeline_features`` makes them from sparse events, as lagged slices of the
arrays of a few blocks at a time. ``build_features`` takes any gapless timeline:
all its window features share ONE window spec (partition (series, block),
order by bin), so the plan holds one Exchange, one Sort and one Window. In
both, blocks carry halo bins (see
``blocked.with_halo``): 96 bins of look-back (the 480-min recency cap;
lags need 48, rolling frames 23) and 12 bins of look-ahead (labels).
Row frames equal time frames because the timeline is a gapless grid.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import calendar_columns, floor_bin
from .blocked import FBLK_COL, HALO_COL, block_window, with_halo
from .dense import Blocks, timeline_values
from .timeline import timeline_blocks

# Fixed values of the feature set (minutes on a 5-minute grid).
LAG_MINUTES = (5, 10, 15, 30, 60, 120, 240)
DELTA_MINUTES = (5, 15, 30)
ROLLING_MINUTES = (15, 30, 60, 120)
SUM_MINUTES = (15, 30, 60, 120)
RECENCY_CAP_MIN = 480.0
RECENCY_NONE_MIN = 9999.0
HORIZONS_MIN = (30, 60)
GRID_MINUTES = 5

INPUT_COLS = ("glucose_mg_dl", "trend_arrow_encoded", "iob_units", "bolus_units", "basal_rate",
              "is_suspended", "control_iq_active", "carbs_g")
NON_FEATURE_COLS = ("timestamp", "target_30m", "target_60m")


LAG_STEPS = tuple(m // GRID_MINUTES for m in LAG_MINUTES)
DELTA_STEPS = tuple(m // GRID_MINUTES for m in DELTA_MINUTES)
ROLLING_STEPS = tuple(m // GRID_MINUTES for m in ROLLING_MINUTES)
SUM_STEPS = tuple(m // GRID_MINUTES for m in SUM_MINUTES)
HORIZON_STEPS = tuple(m // GRID_MINUTES for m in HORIZONS_MIN)


def feature_names(grid_minutes: int = GRID_MINUTES) -> list[str]:
    """The 44 model inputs in table order (P14). Windows are defined in grid
    steps; names show steps x ``grid_minutes`` (the reference grid is 5)."""
    g = grid_minutes
    names = list(INPUT_COLS)
    names += [f"glucose_lag_{k * g}m" for k in LAG_STEPS]
    names += [f"glucose_delta_{k * g}m" for k in DELTA_STEPS]
    for k in ROLLING_STEPS:
        names += [f"glucose_mean_{k * g}m", f"glucose_std_{k * g}m", f"glucose_slope_{k * g}m"]
    names += [f"carbs_sum_{k * g}m" for k in SUM_STEPS] + ["minutes_since_carbs"]
    names += [f"bolus_sum_{k * g}m" for k in SUM_STEPS] + ["minutes_since_bolus"]
    names += ["hour_sin", "hour_cos", "dow", "is_weekend"]
    return names


def label_names(grid_minutes: int = GRID_MINUTES) -> list[str]:
    return [f"target_{k * grid_minutes}m" for k in HORIZON_STEPS]


def feature_columns(df: DataFrame, series_cols: Sequence[str] = ()) -> list[str]:
    """Every column except timestamp, labels and the series key."""
    return [c for c in df.columns
            if c not in NON_FEATURE_COLS and not c.startswith("target_") and c not in series_cols]


def halo_sizes(grid_minutes: int) -> tuple[int, int]:
    recency = -(-int(RECENCY_CAP_MIN) // grid_minutes)
    lookback = max(max(LAG_STEPS), max(ROLLING_STEPS) - 1, max(SUM_STEPS) - 1, recency)
    return lookback, max(HORIZON_STEPS)


def build_features(timeline: DataFrame, *, series_cols: Sequence[str] = ("series_id",),
                   ts_col: str = "timestamp", block_bins: int = 864,
                   with_labels: bool = True, grid_minutes: int = GRID_MINUTES) -> DataFrame:
    """Any gapless timeline -> series..., timestamp, 44 features, labels
    (label names scale with ``grid_minutes``). One shuffle: rows are
    copied into neighbouring blocks as halo, then one windowed select."""
    s = list(series_cols)
    lookback, lookahead = halo_sizes(grid_minutes)
    block_bins = max(block_bins, lookback, lookahead)
    b = "_fbin"
    d = timeline.select(*s, ts_col, *INPUT_COLS, floor_bin(ts_col, grid_minutes).alias(b))
    d = with_halo(d, b, block_bins, lookback, lookahead)
    return feature_select(d, s, b, ts_col=ts_col, with_labels=with_labels, grid_minutes=grid_minutes)


def feature_fields(grid_minutes: int = GRID_MINUTES, with_labels: bool = True) -> list[T.StructField]:
    """The timestamp, the 44 features and the labels with their types. Only those
    of readings and basal samples can be missing: Spark checks no others."""
    byte = ("is_suspended", "control_iq_active", "dow", "is_weekend")
    names = feature_names(grid_minutes) + (label_names(grid_minutes) if with_labels else [])
    missing = ("glucose_", "trend_", "basal_", "target_")
    return [T.StructField("timestamp", T.TimestampType(), False)] + [
        T.StructField(c, T.ByteType() if c in byte else T.DoubleType(), c.startswith(missing)) for c in names]


def feature_needs(names: Sequence[str]) -> list[str]:
    """The timeline columns that the features ``names`` are made of."""
    made = {"glucose_mg_dl": ("glucose_", "target_"), "carbs_g": ("carbs_sum_", "minutes_since_carbs"),
            "bolus_units": ("bolus_sum_", "minutes_since_bolus")}
    return [c for c in INPUT_COLS if c in names or any(n.startswith(made.get(c, ())) for n in names)]


def timeline_features(readings: DataFrame, pump: DataFrame | None = None, treatments: DataFrame | None = None, *,
                      series_cols: Sequence[str] = ("series_id",), grid_minutes: int = GRID_MINUTES,
                      block_minutes: int = 4320, with_labels: bool = True, columns: Sequence[str] | None = None,
                      settled: DataFrame | None = None, digits: int | None = None, **timeline_kw) -> DataFrame:
    """Timeline and features fused: the timeline is laid out per block with
    its halo already in place (see ``timeline_blocks``) and the features are
    lagged slices of these arrays, so the dense grid is never shuffled or
    sorted; only sparse event rows cross the network. Blocks of 3 days keep the
    halo copies (96 + 12 bins) near 12 % of the rows while still splitting any
    long or hot series into many tasks. Only the features in ``columns`` are
    made, if given; with ``settled`` (see ``timeline_blocks``) a boolean column
    of that name is the last; with ``folder`` the tasks write the rows there. With
    ``digits`` they come as queries put them out (``plans.output.finish``): doubles
    rounded in the arrays, times without a zone, whole numbers as BIGINT; the series
    columns stay as they are."""
    lookback, lookahead = halo_sizes(grid_minutes)
    fields = [f for f in feature_fields(grid_minutes, with_labels)
              if columns is None or f.name in columns or f.name == "timestamp"]
    if settled is not None:
        fields.append(T.StructField("settled", T.BooleanType()))
    if digits is not None:
        out = {T.TimestampType(): T.TimestampNTZType(), T.ByteType(): T.LongType()}
        fields = [T.StructField(f.name, out.get(f.dataType, f.dataType), f.nullable) for f in fields]
    return timeline_blocks(readings, pump, treatments, fields=fields, values=feature_values,
                           needs=feature_needs([f.name for f in fields]), series_cols=series_cols,
                           freq_minutes=grid_minutes, block_minutes=block_minutes, lookback=lookback,
                           lookahead=lookahead, settled=settled, digits=digits, **timeline_kw)


def feature_values(b: Blocks) -> dict:
    """The features of the blocks' own bins by name, each computed when called:
    (values, mask of missing ones). The rules are those of ``feature_select``."""
    out = dict(timeline_values(b))
    g_min, unit = b.freq, min(ROLLING_STEPS)

    @cache
    def level():
        """Mean readings and where there is none, halo included."""
        return b.mean("g")

    @cache
    def shown_level():
        v, none = level()
        return b.shown(v), none

    def lagged(k):
        v, none = shown_level()
        return b.own(v, -k), b.own(none, -k)

    def change(k, per=1.0):
        v, none = level()
        return b.shown((b.own(v) - b.own(v, -k)) / per), b.own(none) | b.own(none, -k)

    @cache
    def runs():
        """Of the run of ``unit`` bins that ends at a bin: number, sum, mean, squares about it."""
        v, none = level()
        end = slice(unit - 1, None)
        part = [(~none[:, unit - 1 - k:b.width - k], v[:, unit - 1 - k:b.width - k]) for k in range(unit)]
        n = sum(has.astype(np.float64) for has, _ in part)
        s = sum(x for _, x in part)  # a missing value is 0 there
        m = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        q = sum(np.where(has, (x - m) * (x - m), 0.0) for has, x in part)
        whole = [np.zeros((b.n, b.width)) for _ in range(4)]
        for a, x in zip(whole, (n, s, m, q)):
            a[:, end] = x
        return whole

    @cache
    def rolled(width):
        """Number, mean and whether it is missing, of the frame of ``width`` bins."""
        n, s, _, _ = runs()
        at = range(0, width, unit)
        count = sum(b.own(n, -k) for k in at)
        none = count < max(2, width // 2)
        return count, np.divide(sum(b.own(s, -k) for k in at), count, out=np.zeros_like(count), where=~none), none

    def average(width):
        _, mean, none = rolled(width)
        return b.shown(mean), none

    def deviation(width):
        n, _, m, q = runs()
        count, mean, none = rolled(width)
        squares = b.own(q)  # of one run: about its own mean
        if width > unit:
            squares = 0.0
            for k in range(0, width, unit):  # an empty run adds 0
                off = b.own(m, -k) - mean
                squares = squares + (b.own(q, -k) + b.own(n, -k) * off * off)
        return b.shown(np.sqrt(squares / np.maximum(count - 1, 1))), none

    @cache
    def amounts(name):
        return b.total(name)

    @cache
    def frames(name, width):
        """Sums of the ``width`` bins that end at a bin, from the second half of the lookback on."""
        if width == unit:
            x = amounts(name)
            whole = np.zeros_like(x)
            whole[:, unit - 1:] = sum(x[:, unit - 1 - k:b.width - k] for k in range(unit))
            return whole
        half = frames(name, width // 2)
        whole = half.copy()
        whole[:, width // 2:] += half[:, :b.width - width // 2]
        return whole

    def summed(name, width):
        return b.shown(b.own(frames(name, width))), None

    def since(name):
        had = ~(amounts(name) <= 0)
        at = np.arange(b.width)
        last = b.own(np.maximum.accumulate(np.where(had, at, -1), axis=1))
        return np.minimum(RECENCY_CAP_MIN, np.where(last >= 0, (b.own(at[None, :]) - last) * float(g_min), RECENCY_NONE_MIN)), None

    def clock(of):
        minute = np.arange(1440)
        return b.shown(of(2 * np.pi * (minute // 60 + minute % 60 / 60.0) / 24.0))[b.bins() * g_min % 1440], None

    def weekday():
        return (b.bins() * g_min // 1440 + 3) % 7  # Monday = 0; day 0 was a Thursday

    def add(name, of, *args):
        out[name] = lambda: of(*args)

    for k in LAG_STEPS:
        add(f"glucose_lag_{k * g_min}m", lagged, k)
    for k in DELTA_STEPS:
        add(f"glucose_delta_{k * g_min}m", change, k)
    for w in ROLLING_STEPS:
        add(f"glucose_mean_{w * g_min}m", average, w)
        add(f"glucose_std_{w * g_min}m", deviation, w)
        add(f"glucose_slope_{w * g_min}m", change, w - 1, float(max(w - 1, 1)))
    for what, name in (("carbs", "carbs_sum"), ("bolus", "bolus_sum")):
        for w in SUM_STEPS:
            add(f"{what}_sum_{w * g_min}m", summed, name, w)
        add(f"minutes_since_{what}", since, name)
    for k, name in zip(HORIZON_STEPS, label_names(g_min)):
        add(name, lagged, -k)
    add("hour_sin", clock, np.sin)
    add("hour_cos", clock, np.cos)
    out["dow"] = lambda: (weekday(), None)
    out["is_weekend"] = lambda: (weekday() >= 5, None)
    return out


def feature_select(d: DataFrame, s: list[str], b: str, *, ts_col: str = "timestamp", with_labels: bool = True,
                   grid_minutes: int = GRID_MINUTES) -> DataFrame:
    """All window features over (series, block) ordered by bin, halo rows dropped.

    Spark re-aggregates a sliding frame for every row (O(rows x width)), so
    two windowed selects over the same spec (one sort) replace the frames.
    Rolling sums of carbs and boluses are prefix-sum differences
    (``run(t) - lag(run, n)``). Means and sample stds come from lagged runs of
    the narrowest width: a frame's squares about its mean are those of its
    runs about theirs plus ``n_i * (mean_i - mean)^2``, all non-negative, so
    nothing cancels.
    """
    g_min = grid_minutes
    w = block_window(s, b)
    run_w = w.rowsBetween(Window.unboundedPreceding, 0)
    g = F.col("glucose_mg_dl")
    carbs = F.coalesce(F.col("carbs_g"), F.lit(0.0))
    bolus = F.coalesce(F.col("bolus_units"), F.lit(0.0))

    first = {
        "_cc": F.sum(carbs).over(run_w),
        "_cb": F.sum(bolus).over(run_w),
        "_lc": F.last(F.when(carbs > 0, F.col(b)), True).over(run_w),
        "_lb": F.last(F.when(bolus > 0, F.col(b)), True).over(run_w),
    }
    unit = min(ROLLING_STEPS)
    if any(n % unit for n in ROLLING_STEPS):
        raise ValueError("rolling widths must be multiples of the narrowest")
    for k in sorted(set(LAG_STEPS) | set(DELTA_STEPS) | {n - 1 for n in ROLLING_STEPS} | set(range(1, unit))):
        first[f"_lag{k}"] = F.lag(g, k).over(w)
    if with_labels:
        for k in HORIZON_STEPS:
            first[f"_lead{k}"] = F.lead(g, k).over(w)
    p1 = d.select(*d.columns, *[c.alias(n) for n, c in first.items()])
    p1 = p1.select(*s, FBLK_COL, ts_col, HALO_COL, b, *INPUT_COLS, *first)
    # the run of `unit` bins that ends here: how many values, their sum, squares about their mean
    run = [g] + [F.col(f"_lag{k}") for k in range(1, unit)]

    def total(terms):
        return reduce(lambda a, c: a + c, terms)

    p1 = p1.withColumn("_n", total([F.when(v.isNotNull(), 1).otherwise(0) for v in run]))
    p1 = p1.withColumn("_s", total([F.coalesce(v, F.lit(0.0)) for v in run]))
    p1 = p1.withColumn("_m", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")))
    p1 = p1.withColumn("_q", total([F.coalesce((v - F.col("_m")) * (v - F.col("_m")), F.lit(0.0)) for v in run]))
    runs = {c: [F.col(c)] + [F.lag(c, k).over(w) for k in range(unit, max(ROLLING_STEPS), unit)]
            for c in ("_n", "_s", "_q")}

    def window_sum(col: str, n: int):
        return F.col(col) - F.coalesce(F.lag(col, n).over(w), F.lit(0))

    cols, p2 = {}, {}
    for k in LAG_STEPS:
        cols[f"glucose_lag_{k * g_min}m"] = F.col(f"_lag{k}")
    for k in DELTA_STEPS:
        cols[f"glucose_delta_{k * g_min}m"] = g - F.col(f"_lag{k}")
    for n in ROLLING_STEPS:
        off = [F.col(f"_s{i}") / F.col(f"_n{i}") - F.col(f"_mean{n}") for i in range(n // unit)]
        squares = total([F.when(F.col(f"_n{i}") > 0, F.col(f"_q{i}") + F.col(f"_n{i}") * d * d).otherwise(0.0)
                         for i, d in enumerate(off)])
        cols[f"glucose_mean_{n * g_min}m"] = F.col(f"_mean{n}")
        cols[f"glucose_std_{n * g_min}m"] = F.sqrt(squares / F.when(F.col(f"_mean{n}").isNotNull(), F.col(f"_cnt{n}") - 1))
        cols[f"glucose_slope_{n * g_min}m"] = (g - F.col(f"_lag{n - 1}")) / F.lit(float(max(n - 1, 1)))
    p2 |= {f"{c}{i}": v for c, lags in runs.items() for i, v in enumerate(lags)}
    for src, pfx, last in (("_cc", "carbs", "_lc"), ("_cb", "bolus", "_lb")):
        for n in SUM_STEPS:
            p2[f"{src}{n}"] = window_sum(src, n)
            cols[f"{pfx}_sum_{n * g_min}m"] = F.col(f"{src}{n}")
        cols[f"minutes_since_{pfx}"] = F.least(
            F.lit(RECENCY_CAP_MIN),
            F.coalesce(((F.col(b) - F.col(last)) * F.lit(g_min)).cast("double"), F.lit(RECENCY_NONE_MIN)))
    cal = calendar_columns(F.col(ts_col))
    labels = {}
    if with_labels:
        for k, name in zip(HORIZON_STEPS, label_names(g_min)):
            labels[name] = F.col(f"_lead{k}")
    out = p1.select("*", *[c.alias(n) for n, c in p2.items()]).filter(~F.col(HALO_COL))
    parts = {n: range(n // unit) for n in ROLLING_STEPS}
    out = out.select("*", *[total([F.coalesce(f"_n{i}", F.lit(0)) for i in of]).alias(f"_cnt{n}") for n, of in parts.items()])
    out = out.select("*", *[F.when(F.col(f"_cnt{n}") >= max(2, n // 2), total(
        [F.coalesce(f"_s{i}", F.lit(0.0)) for i in of]) / F.col(f"_cnt{n}")).alias(f"_mean{n}") for n, of in parts.items()])
    return out.select(
        *s, ts_col,
        g, "trend_arrow_encoded", "iob_units", "bolus_units", "basal_rate",
        F.col("is_suspended").cast("byte").alias("is_suspended"),
        F.col("control_iq_active").cast("byte").alias("control_iq_active"),
        "carbs_g",
        *[c.alias(n) for n, c in cols.items()],
        *[c.alias(n) for n, c in cal.items()],
        *[c.alias(n) for n, c in labels.items()],
    )
