"""Data-quality and summary operators: A7-A10, A19, W12, W13, W16, T3,
T5, P15, P16.

Aggregates are plain group-bys with map-side partial aggregation, so a
hot series is combined before the shuffle. Consecutive-row logic (W12,
W13) uses ``previous_in_series`` (block-parallel), never one task per
series.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import minutes_between
from .blocked import previous_in_series, series_positions


def find_gaps(df: DataFrame, *, series_cols: Sequence[str] = ("series_id",), ts_col: str = "timestamp",
              value_col: str = "glucose_mg_dl", threshold_minutes: float = 30.0,
              block_minutes: int = 1440) -> DataFrame:
    """Gaps between consecutive non-null readings longer than the
    threshold (strict): gap_start, gap_end, duration_minutes."""
    g = df.filter(F.col(value_col).isNotNull()).select(*series_cols, ts_col)
    p = previous_in_series(g, series_cols, ts_col, block_minutes)
    dur = minutes_between(F.col(ts_col), F.col(f"prev_{ts_col}"))
    return (p.filter(dur > F.lit(float(threshold_minutes)))
            .select(*series_cols, F.col(f"prev_{ts_col}").alias("gap_start"),
                    F.col(ts_col).alias("gap_end"), dur.alias("duration_minutes")))


def grid_regularity(df: DataFrame, *, series_cols: Sequence[str] = ("series_id",),
                    ts_col: str = "timestamp", freq_minutes: int = 5,
                    block_minutes: int = 1440) -> DataFrame:
    """Per series, rows, max step (minutes) and whether every step
    equals the grid step; a quality-report row instead of a log line."""
    p = previous_in_series(df.select(*series_cols, ts_col), series_cols, ts_col, block_minutes)
    step = minutes_between(F.col(ts_col), F.col(f"prev_{ts_col}"))
    return p.groupBy(*series_cols).agg(
        F.count("*").alias("n_rows"),
        F.max(step).alias("max_step_minutes"),
        F.coalesce(F.bool_and(step == F.lit(float(freq_minutes))), F.lit(True)).alias("is_regular"))


def time_in_range(df: DataFrame, *, series_cols: Sequence[str] = ("series_id",),
                  value_col: str = "glucose_mg_dl", low: float = 70.0, high: float = 180.0) -> DataFrame:
    """Percent below ``low``, in [low, high], above ``high`` of non-null
    readings, and their count; all 0 for an empty series."""
    g = F.col(value_col)
    n = F.count(g)

    def pct(cond):
        return F.coalesce(F.try_divide(F.count_if(cond) * F.lit(100.0), n), F.lit(0.0))

    return df.groupBy(*series_cols).agg(
        pct(g < low).alias("low_pct"), pct((g >= low) & (g <= high)).alias("in_range_pct"),
        pct(g > high).alias("high_pct"), n.alias("n_readings"))


def profile(df: DataFrame, *, series_cols: Sequence[str] = (), ts_col: str = "timestamp") -> DataFrame:
    """Per column null / non-null counts in long form, with row count,
    column count and time range, in one aggregation pass."""
    cols = [c for c in df.columns if c not in series_cols]
    aggs = [F.count("*").alias("_rows"), F.min(ts_col).alias("_min_ts"), F.max(ts_col).alias("_max_ts")]
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"_nn{i}"))
    a = df.groupBy(*series_cols).agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_nn{i}").alias("non_null"))
                                for i, c in enumerate(cols)]))
    return a.select(*series_cols, F.col("_rows").alias("n_rows"), F.lit(len(cols)).cast("long").alias("n_columns"),
                    F.col("_min_ts").alias("min_ts"), F.col("_max_ts").alias("max_ts"), stack.alias("_c")) \
        .select(*series_cols, "n_rows", "n_columns", "min_ts", "max_ts", "_c.column_name",
                (F.col("n_rows") - F.col("_c.non_null")).alias("null_count"), F.col("_c.non_null").alias("non_null"))


def activity_summary(timeline: DataFrame, *, series_cols: Sequence[str] = ("series_id",)) -> DataFrame:
    """Total bolus, max IOB, suspended bins, loop-action bins."""
    return timeline.groupBy(*series_cols).agg(
        F.sum("bolus_units").alias("total_bolus_units"), F.max("iob_units").alias("max_iob_units"),
        F.count_if("is_suspended").alias("suspended_bins"),
        F.count_if("control_iq_active").alias("control_iq_bins"))


def value_counts(df: DataFrame, col: str, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """A10: rows per value, the most frequent first (ties by value)."""
    return df.groupBy(*series_cols, col).agg(F.count("*").alias("n")).orderBy(*series_cols, F.desc("n"), col)


def stage_counters(df: DataFrame, *, name: str, ts_col: str = "timestamp",
                   extra: dict | None = None) -> tuple[DataFrame, Observation]:
    """Attach row count, time range and extra counters to a stage
    without an extra pass (read ``obs.get`` after the action)."""
    obs = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows"), F.min(ts_col).alias("min_ts"), F.max(ts_col).alias("max_ts")]
    exprs += [c.alias(k) for k, c in (extra or {}).items()]
    return df.observe(obs, *exprs), obs


def observed_stages(df: DataFrame, stages: dict[str, tuple[Column, Column]], *, name: str,
                    ts_col: str = "timestamp") -> tuple[DataFrame, Observation]:
    """A19 for all stages that are told apart by a condition on one input's rows:
    ``stages`` has a row's condition and that of a carb-tagged row. The counters ride
    on whatever action runs next; read them with ``stage_table`` after it."""
    us = F.unix_micros(F.col(ts_col))
    obs = Observation(name)
    counts = [c.alias(f"{k}:{what}") for k, (row, tagged) in stages.items() for what, c in (
        ("rows", F.count_if(row)), ("min", F.min(F.when(row, us))), ("max", F.max(F.when(row, us))), ("tagged", F.count_if(row & tagged)))]
    return df.observe(obs, *counts), obs


def stage_table(spark: SparkSession, obs: Observation, stages: Sequence[str]) -> DataFrame:
    """The counters of ``observed_stages``: one row per stage."""
    got = obs.get
    rows = [(k, *[got[f"{k}:{what}"] for what in ("rows", "min", "max", "tagged")]) for k in stages]
    d = spark.createDataFrame(rows, "stage string, rows long, lo long, hi long, carb_tagged long")
    return d.select("stage", "rows", F.timestamp_micros("lo").alias("min_ts"), F.timestamp_micros("hi").alias("max_ts"), "carb_tagged")


def date_filter(df: DataFrame, start_date: str, end_date: str, ts_col: str = "timestamp") -> DataFrame:
    """Both ends inclusive by UTC date: a range on ``ts_col`` that reaches
    the scan, and on a table with K1's ``date`` column also a range on that, so
    other dates' folders are not opened."""
    lo = F.to_timestamp(F.lit(start_date))
    hi = F.to_timestamp(F.lit(end_date)) + F.expr("INTERVAL 1 DAY")
    if "date" in df.columns:
        df = df.filter(F.col("date").between(F.to_date(F.lit(start_date)), F.to_date(F.lit(end_date))))
    return df.filter((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))


def event_markers(timeline: DataFrame) -> DataFrame:
    """Rows with a bolus (> 0) or a suspension."""
    return timeline.filter((F.col("bolus_units") > 0) | F.col("is_suspended"))


def decimate(df: DataFrame, n: int = 2000, *, series_cols: Sequence[str] = ("series_id",),
             ts_col: str = "timestamp") -> DataFrame:
    """Per series keep rows 0, step, 2*step ... with
    step = max(1, len // n) (all rows when len <= n). Row positions come
    from per-block counts + a running sum over blocks, not a per-series
    row_number."""
    x = series_positions(df, series_cols, ts_col)
    stride = F.greatest(F.lit(1), F.floor(F.col("_len") / F.lit(n)).cast("long"))
    return x.filter(F.pmod(F.col("_pos"), stride) == 0).select(*df.columns)


def top_recent(df: DataFrame, n: int, *, ts_col: str = "timestamp", tie_cols: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` rows (TakeOrderedAndProject: a per-task top-n
    then one merge of n * tasks rows)."""
    return df.orderBy(F.col(ts_col).desc(), *[F.col(c).desc() for c in tie_cols]).limit(n)


def top_per_series(df: DataFrame, n: int, *, series_cols: Sequence[str] = ("series_id",),
                   ts_col: str = "timestamp", tie_cols: Sequence[str] = ()) -> DataFrame:
    """T3 per series: newest ``n`` rows of each series (ties by ``tie_cols``,
    the greatest first). Only days that can hold one of them are ranked: counts
    per (series, day), summed from the newest day on, say where ``n`` rows are
    reached, so a series' ranking sees at most ``n`` rows and one day more."""
    s = list(series_cols)
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    day = 86_400_000_000
    d = df.select("*", ((us - F.pmod(us, F.lit(day))) / F.lit(day)).cast("long").alias("_dblk"))
    newer = Window.partitionBy(*s).orderBy(F.col("_dblk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = d.groupBy(*s, "_dblk").agg(F.count(F.lit(1)).alias("_n"))
    days = days.select(*s, "_dblk", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_newer")).filter(F.col("_newer") < n)
    order = [F.col(ts_col).desc(), *[F.col(c).desc() for c in tie_cols]]
    w1 = Window.partitionBy(*s, "_dblk").orderBy(*order)
    pre = d.join(days, [*s, "_dblk"]).select("*", F.row_number().over(w1).alias("_r1")) \
        .withColumn("rank", (F.col("_newer") + F.col("_r1")).cast("int")).filter(F.col("rank") <= n)
    return pre.select(*df.columns, "rank")
