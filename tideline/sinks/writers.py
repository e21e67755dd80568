"""Sinks: K1 parquet overwrite (dynamic partition overwrite by date),
K2-K4 append-only logs with latest-per-key views and retention compaction,
K5 validated treatment append, K6 CSV export, K7 one-row JSON metrics.

Writes never overwrite the path they read from; a batch overwrites only its
own folder.
"""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import keep_last, validate_treatments


def with_date(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    return df.withColumn("date", F.to_date(F.col(ts_col)))


def write_parquet(df: DataFrame, path: str, *, ts_col: str = "timestamp", partition_by_date: bool = True,
                  mode: str = "overwrite") -> None:
    """K1: partitioned by UTC date; overwrite replaces only touched dates.
    Rows are dealt by date first (``rebalance`` lets Spark split a large date
    and merge small ones), so a date has few files."""
    w = with_date(df, ts_col).hint("rebalance", F.col("date")) if partition_by_date else df
    wr = w.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by_date:
        wr = wr.partitionBy("date")
    wr.parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, *, partition_cols: Sequence[str] = ()) -> None:
    """K2-K4 append: the rows of one batch in their own ``batch=<id>`` folder,
    overwritten as a whole, so a replayed batch leaves one copy."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(os.path.join(path, f"batch={int(batch_id)}"))


def latest_per_key(log: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """K2/K3 view: newest row per key."""
    return keep_last(log, key_cols, order_cols)


def retain_last(df: DataFrame, n: int = 1000, *, series_cols: Sequence[str] = ("series_id",),
                order_cols: Sequence[str] = ("timestamp",)) -> DataFrame:
    """K4 retention: the newest ``n`` rows per series by ``order_cols``: a time,
    then what tells rows of one time apart (batch, ``alert_ix``)."""
    from ..operators.quality import top_per_series
    return top_per_series(df, n, series_cols=series_cols, ts_col=order_cols[0], tie_cols=order_cols[1:]).drop("rank")


def append_treatments(df: DataFrame, path: str, now=None) -> DataFrame:
    """K5: append the valid rows; return the quarantined ones with a reason."""
    ok, bad = validate_treatments(df, now)
    ok.write.mode("append").parquet(path)
    return bad


def write_csv(df: DataFrame, path: str) -> None:
    """K6: CSV with header (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_row(df: DataFrame, path: str) -> None:
    """K7: metrics / explanation rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def to_storage_types(df: DataFrame) -> DataFrame:
    """Compute in DOUBLE, store FLOAT (halves the bytes written)."""
    from pyspark.sql import types as T
    return df.select(*[F.col(f"`{f.name}`").cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])
