"""Cleaning, dedupe and union operators: P6, P7, P9, A16, A17, U1, U2, K2, K5.

Keep-first / keep-last dedupes rank the rows of a key by an explicit ingest
order (``seq``; the other columns break ties) and keep rank 1. Spark plans the
filter as a group limit below the exchange, so each task sends at most one
row of a key and a hot key is small before it is shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TREATMENT_KINDS


def _first_ranked(df: DataFrame, key_cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key_cols).orderBy(*order)
    return df.select("*", F.row_number().over(w).alias("_rank")).filter("_rank = 1").drop("_rank")


def _by_order_then_rest(df: DataFrame, key_cols, order_cols) -> list[str]:
    return list(order_cols) + [c for c in df.columns if c not in key_cols and c not in order_cols]


def keep_last(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order_cols``."""
    by = _by_order_then_rest(df, key_cols, order_cols)
    return _first_ranked(df, key_cols, [F.col(c).desc_nulls_last() for c in by])


def keep_first(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order_cols``.

    Key columns may be NULL (NULLs group together, as in pandas)."""
    by = _by_order_then_rest(df, key_cols, order_cols)
    return _first_ranked(df, key_cols, [F.col(c).asc_nulls_first() for c in by])


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P7."""
    return df.dropna(subset=list(cols))


def derive_treatments(pump: DataFrame, series_cols: Sequence[str] = ("series_id",),
                      seq_col: str | None = "seq") -> DataFrame:
    """Bolus rows with carbs > 0 become ``meal`` treatments from ``tandem_bolus``."""
    extra = [F.col(seq_col)] if seq_col and seq_col in pump.columns else []
    return (pump.filter((F.col("event_type") == "bolus") & F.col("carbs_g").isNotNull()
                        & (F.col("carbs_g") > 0))
            .select(*series_cols, "timestamp", F.lit("meal").alias("kind"),
                    F.col("carbs_g").cast("double").alias("carbs_g"), F.lit("").alias("notes"),
                    F.lit("tandem_bolus").alias("source"), *extra))


def union_treatments(*frames: DataFrame, series_cols: Sequence[str] = ("series_id",),
                     seq_col: str = "seq") -> DataFrame:
    """Union sources (None skipped), keep the first row per
    (series, timestamp, source, kind, carbs_g). Input order = argument
    order, then ``seq`` inside each frame."""
    fr = [f for f in frames if f is not None]
    if not fr:
        raise ValueError("no treatment frames")
    tagged = []
    for i, f in enumerate(fr):
        seq = F.col(seq_col) if seq_col in f.columns else F.lit(0).cast("long")
        tagged.append(f.select(*series_cols, "timestamp", "kind", F.col("carbs_g").cast("double"),
                               "notes", "source", F.lit(i).alias("_src_ix"), seq.cast("long").alias("_seq")))
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    key = list(series_cols) + ["timestamp", "source", "kind", "carbs_g"]
    out = keep_first(u, key, ["_src_ix", "_seq"])
    return out.select(*series_cols, "timestamp", "kind", "carbs_g", "notes", "source",
                      (F.col("_src_ix") * F.lit(1 << 40) + F.col("_seq")).alias(seq_col))


def upsert_latest(existing: DataFrame, new: DataFrame, key_cols: Sequence[str],
                  seq_col: str = "seq") -> DataFrame:
    """K2: union old and new, newest source wins per key, then by ``seq``."""
    cols = existing.columns
    u = (existing.select(*cols, F.lit(0).alias("_prio"))
         .unionByName(new.select(*cols, F.lit(1).alias("_prio"))))
    order = ["_prio"] + ([seq_col] if seq_col in cols else [])
    return keep_last(u, key_cols, order).select(*cols)


def validate_treatments(df: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """K5: split into (valid, quarantine with ``reason``): kind in the fixed
    list, carbs >= 0. A missing time becomes ``now``, missing carbs 0."""
    df = df.withColumns({"timestamp": F.coalesce("timestamp", F.current_timestamp() if now is None else now),
                         "carbs_g": F.coalesce("carbs_g", F.lit(0.0))})
    reason = (F.when(~F.col("kind").isin(*TREATMENT_KINDS) | F.col("kind").isNull(), F.lit("bad_kind"))
              .when(F.col("carbs_g") < 0, F.lit("negative_carbs")))
    tagged = df.withColumn("reason", reason)
    return tagged.filter("reason IS NULL").drop("reason"), tagged.filter("reason IS NOT NULL")


def union_pump_streams(*streams: DataFrame | None) -> DataFrame:
    """Union heterogeneous streams, missing columns as NULL."""
    fr = [f for f in streams if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fr)
