"""Live accuracy and drift: K3 log upkeep, J7 forecast/truth join, A13
trailing metrics, W14 rolling time-window MAE, C4 drift decision.

``now`` is always a parameter. The rolling MAE uses time blocks with a
6-hour halo, so a hot series is spread over many tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fmt_fixed, micros
from .blocked import FBLK_COL, HALO_COL, with_halo
from .clean import keep_last

# Drift threshold and recommendation texts.
DRIFT_RATIO_THRESHOLD = 1.5
MSG_RETRAIN = ("Live 24h MAE (", ") is ", "× the trained-test MAE (", "). Consider retraining.")
MSG_OK = ("Live accuracy in line with training (24h MAE ", " vs trained ", ", ratio ", ").")
MSG_WAIT = ("Scored ", " predictions. Need a trained model + more time to assess drift.")


def dedupe_log(log: DataFrame, *, series_cols: Sequence[str] = ("series_id",), seq_col: str = "seq") -> DataFrame:
    """K3: unique on (series, predicted_at), the last appended wins."""
    order = [seq_col] if seq_col in log.columns else []
    return keep_last(log, list(series_cols) + ["predicted_at"], order)


def join_with_actuals(log: DataFrame, truth: DataFrame, *, series_cols: Sequence[str] = ("series_id",),
                      ts_col: str = "timestamp", value_col: str = "glucose_mg_dl") -> DataFrame:
    """Left equi-join on target time; ``actual_30m`` and ``abs_error``
    are NULL when no truth exists (yet)."""
    t = truth.select(*series_cols, F.col(ts_col).alias("target_timestamp"), F.col(value_col).alias("actual_30m"))
    j = log.join(t, list(series_cols) + ["target_timestamp"], "left")
    return j.withColumn("abs_error", F.abs(F.col("prediction_30m") - F.col("actual_30m")))


def trailing_metrics(scored: DataFrame, now: Column | str, *, series_cols: Sequence[str] = ("series_id",)) -> DataFrame:
    """N scored, MAE/RMSE over the last 24 h and 7 d (by target time,
    ``>= now - window``) and all-time MAE, in one pass."""
    now_c = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    t = F.col("target_timestamp")
    e = F.col("prediction_30m") - F.col("actual_30m")
    ok = F.col("actual_30m").isNotNull()
    c24 = ok & (t >= now_c - F.expr("INTERVAL 24 HOURS"))
    c7 = ok & (t >= now_c - F.expr("INTERVAL 7 DAYS"))
    return scored.groupBy(*series_cols).agg(
        F.count_if(ok).alias("n_scored"),
        F.avg(F.when(c24, F.abs(e))).alias("mae_24h"), F.sqrt(F.avg(F.when(c24, e * e))).alias("rmse_24h"),
        F.avg(F.when(c7, F.abs(e))).alias("mae_7d"), F.sqrt(F.avg(F.when(c7, e * e))).alias("rmse_7d"),
        F.avg(F.when(ok, F.abs(e))).alias("mae_all"))


def drift_status(metrics: DataFrame, trained_mae: Column | float | None,
                 threshold: float = DRIFT_RATIO_THRESHOLD) -> DataFrame:
    """C4: ratio = 24h MAE / trained MAE, retrain when ratio >= threshold.
    Missing or zero trained MAE, or no 24h MAE -> ratio NULL, no advice."""
    tm = trained_mae if isinstance(trained_mae, Column) else F.lit(trained_mae).cast("double")
    usable = tm.isNotNull() & (tm != 0) & F.col("mae_24h").isNotNull()
    ratio = F.when(usable, F.col("mae_24h") / tm)
    rec = F.coalesce(ratio >= F.lit(threshold), F.lit(False))
    msg = (F.when(rec, F.concat(F.lit(MSG_RETRAIN[0]), fmt_fixed(F.col("mae_24h"), 1), F.lit(MSG_RETRAIN[1]),
                                fmt_fixed(ratio, 2), F.lit(MSG_RETRAIN[2]), fmt_fixed(tm, 1), F.lit(MSG_RETRAIN[3])))
           .when(usable, F.concat(F.lit(MSG_OK[0]), fmt_fixed(F.col("mae_24h"), 1), F.lit(MSG_OK[1]),
                                  fmt_fixed(tm, 1), F.lit(MSG_OK[2]), fmt_fixed(ratio, 2), F.lit(MSG_OK[3])))
           .otherwise(F.concat(F.lit(MSG_WAIT[0]), F.col("n_scored").cast("string"), F.lit(MSG_WAIT[1]))))
    return metrics.select("*", F.when(tm.isNotNull() & (tm != 0), tm).alias("trained_mae"),
                          ratio.alias("drift_ratio"), rec.alias("recommend_retrain"), msg.alias("recommendation"))


def rolling_mae(scored: DataFrame, *, series_cols: Sequence[str] = ("series_id",), window_minutes: int = 360,
                block_minutes: int = 1440) -> DataFrame:
    """Mean abs error over target times in (t - window, t] for every
    scored row (rows without truth dropped)."""
    s = list(series_cols)
    d = scored.filter(F.col("actual_30m").isNotNull()).select(
        *s, "target_timestamp", "abs_error", micros("target_timestamp").alias("_us"))
    d = d.withColumn("_min", F.floor(F.col("_us") / F.lit(60_000_000)).cast("long"))
    d = with_halo(d, "_min", block_minutes, window_minutes, 0)
    wus = window_minutes * 60_000_000
    w = Window.partitionBy(*s, FBLK_COL).orderBy("_us").rangeBetween(-(wus - 1), 0)
    return (d.select(*s, "target_timestamp", HALO_COL, F.avg("abs_error").over(w).alias("rolling_mae"))
            .filter(~F.col(HALO_COL)).drop(HALO_COL))
