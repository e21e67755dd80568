"""J7 live: logged forecasts meet the truth as both arrive.

A left outer stream-stream join on (series, target time), bounded by watermarks on
both sides: a forecast waits until its truth comes or until the truth's watermark
has passed the target, and then leaves the state, without truth. State holds the
forecasts and truths of the last ``delay``. Rows later than ``delay`` are dropped
by the join; ``forecast_truth_view`` still shows such forecasts, as unscored.
"""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sinks.writers import write_batch


def stream_forecast_truth(log: DataFrame, truth: DataFrame, *, series_cols: Sequence[str] = ("series_id",), delay: str = "2 hours",
                          ts_col: str = "timestamp", value_col: str = "glucose_mg_dl") -> DataFrame:
    """Stream of log rows with ``actual_30m`` and ``abs_error``."""
    s = list(series_cols)
    l = log.withWatermark("target_timestamp", delay)
    t = truth.select(*[F.col(c).alias(f"_t_{c}") for c in s], F.col(ts_col).alias("_truth_at"), F.col(value_col).alias("actual_30m")
                     ).withWatermark("_truth_at", delay)
    on = F.col("target_timestamp") == F.col("_truth_at")
    for c in s:
        on = on & (F.col(c) == F.col(f"_t_{c}"))
    j = l.join(t, on, "leftOuter").select(*log.columns, "actual_30m")
    return j.withColumn("abs_error", F.abs(F.col("prediction_30m") - F.col("actual_30m")))


def start_forecast_truth(spark: SparkSession, log: DataFrame, truth: DataFrame, store: str, *, name: str,
                         series_cols: Sequence[str] = ("series_id",), delay: str = "2 hours", available_now: bool = False):
    """Write the joined rows of each micro-batch to its own folder of ``store``."""
    j = stream_forecast_truth(log, truth, series_cols=series_cols, delay=delay)
    w = j.writeStream.foreachBatch(lambda df, i: write_batch(df, store, i)).option(
        "checkpointLocation", os.path.join(checkpoint_dir(spark), "streams", name))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")).start()


def forecast_truth_view(log: DataFrame, store: str, *, series_cols: Sequence[str] = ("series_id",)) -> DataFrame:
    """Joined rows, and those of ``log`` that still wait, without truth."""
    done = log.sparkSession.read.parquet(store).drop("batch")
    none = F.lit(None).cast("double")
    waiting = log.join(done.select(*series_cols, "predicted_at"), [*series_cols, "predicted_at"], "left_anti")
    return done.unionByName(waiting.withColumns({"actual_30m": none, "abs_error": none}))
