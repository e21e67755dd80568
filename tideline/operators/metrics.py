"""Forecast metrics: A11 regression metrics, A12 hypo recall, A14 backtest
MAE, A18 split summary.

The exact median (A11) is an order statistic found by histogram
refinement: each pass is one distributed aggregation into at most
``buckets`` counts; only those counts reach the driver, never the values.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kth_smallest(base: DataFrame, ks: Sequence[int], lo: float, hi: float, buckets: int = 4096) -> dict[int, float]:
    """Exact k-th smallest values (0-based) of the non-null double column ``x``
    between ``lo`` and ``hi``. Each pass counts, for all ranks still open, at
    most ``buckets`` cells of the range that holds the rank; a range of one
    value ends it. The path is the same at every size."""
    todo = {k: (lo, hi, 0) for k in ks}  # rank -> (low, high, rows below low)
    done: dict[int, float] = {}
    while todo:
        done |= {k: a for k, (a, b, _) in todo.items() if a == b}
        ranges = sorted({r for k, r in todo.items() if k not in done})
        todo = {k: r for k, r in todo.items() if k not in done}
        if not todo:
            break
        x, cells = F.col("x"), []
        for i, (a, b, _) in enumerate(ranges):
            width = (b - a) / buckets
            cell = F.least(F.floor((x - F.lit(a)) / F.lit(width)).cast("long"), F.lit(buckets - 1)) if width > 0 else \
                F.when(x == a, F.lit(0)).otherwise(F.lit(1)).cast("long")
            cells.append(F.when((x >= a) & (x <= b), F.struct(F.lit(i).alias("r"), cell.alias("c"))))
        hist = (base.select("x", F.explode(F.array_compact(F.array(*cells))).alias("k"))
                .groupBy("k.r", "k.c").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                .orderBy("r", "c").collect())  # at most two ranges of ``buckets`` cells
        for k, found in list(todo.items()):
            below = found[2]
            for row in hist:
                if row["r"] != ranges.index(found):
                    continue
                if below + row["n"] > k:
                    todo[k] = (row["mn"], row["mx"], below)
                    break
                below += row["n"]
    return done


def exact_median(df: DataFrame, col: str) -> float | None:
    """The exact median; the column is computed once and kept while it is found."""
    base = df.select(F.col(col).cast("double").alias("x")).filter("x is not null").persist()
    try:
        n, lo, hi = base.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
        if not n:
            return None
        a, b = (n - 1) // 2, n // 2
        got = _kth_smallest(base, sorted({a, b}), lo, hi)
        return (got[a] + got[b]) / 2.0
    finally:
        base.unpersist()


def regression_metrics(df: DataFrame, *, y_col: str, pred_col: str, with_median: bool = True) -> DataFrame:
    """A11 + A12 over rows with a label: n, mae, rmse, median_abs_err,
    pct_within_20, pct_within_30, hypo_recall (NULL when no y < 70)."""
    d = df.filter(F.col(y_col).isNotNull() & F.col(pred_col).isNotNull()) \
        .select((F.col(pred_col) - F.col(y_col)).alias("err"), F.col(y_col).alias("y"), F.col(pred_col).alias("p"))
    ae = F.abs("err")
    agg = d.agg(
        F.count("*").alias("n"), F.avg(ae).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        (F.avg((ae <= 20).cast("double")) * F.lit(100.0)).alias("pct_within_20"),
        (F.avg((ae <= 30).cast("double")) * F.lit(100.0)).alias("pct_within_30"),
        F.try_divide(F.count_if((F.col("y") < 70) & (F.col("p") < 80)).cast("double"),
                     F.count_if(F.col("y") < 70).cast("double")).alias("hypo_recall"))
    if with_median:
        med = exact_median(d.select(ae.alias("ae")), "ae")
        agg = agg.withColumn("median_abs_err", F.lit(med).cast("double"))
    return agg


def hypo_recall(df: DataFrame, *, y_col: str, pred_col: str, series_cols: Sequence[str] = (),
                low: float = 70.0, flag: float = 80.0) -> DataFrame:
    """A12 per group: share of y < low predicted below ``flag``."""
    y, p = F.col(y_col), F.col(pred_col)
    return df.filter(y.isNotNull() & p.isNotNull()).groupBy(*series_cols).agg(
        F.count_if(y < low).alias("n_low"),
        F.try_divide(F.count_if((y < low) & (p < flag)).cast("double"),
                     F.count_if(y < low).cast("double")).alias("hypo_recall"))


def backtest_mae(scored: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error over rows with truth."""
    return scored.filter(F.col("abs_error").isNotNull()).groupBy(*series_cols).agg(
        F.count("*").alias("n"), F.avg("abs_error").alias("mae"))


def split_summary(split_df: DataFrame, *, target_col: str = "target_30m", series_cols: Sequence[str] = (),
                  ts_col: str = "timestamp") -> DataFrame:
    """Labelled rows per part and the time span of each part."""
    return split_df.groupBy(*series_cols, "split").agg(
        F.count(target_col).alias("labelled_rows"), F.count("*").alias("rows"),
        F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"),
        F.lit(target_col).alias("target"))
