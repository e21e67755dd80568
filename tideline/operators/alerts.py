"""Rule engine (R1-R5): 0-4 alerts per forecast row, as a narrow,
shuffle-free projection + explode.

Input columns: current_glucose, current_timestamp, prediction_30m and a
reference time (``now`` column or literal). Output: one row per alert with
``alert_ix`` (output order), type, severity, message, detail (JSON).
Missing inputs are NULL, and a NULL comparison raises nothing (as NaN in
the reference).
"""
from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fmt_0f, micros

# ---- fixed values (thresholds and message texts) ------------------------------
DEFAULT_THRESHOLDS = {
    "low_mg_dl": 70.0,
    "high_mg_dl": 250.0,
    "drop_mg_dl_30m": 50.0,
    "rise_mg_dl_30m": 60.0,
    "stale_minutes": 15.0,
    "low_sentinel": 39.0,
    "high_sentinel": 401.0,
}
MSG_SENSOR_LOW = "Sensor reads LOW (≤{low_sentinel} mg/dL). Confirm with a fingerstick."
MSG_SENSOR_HIGH = "Sensor reads HIGH (≥{high_sentinel} mg/dL). Confirm with a fingerstick."
MSG_STALE = ("No CGM reading in ", " min — predictions are based on outdated data.")
MSG_PRED_LOW = ("Predicted ", " mg/dL in 30 min (below {low_mg_dl}). Consider pre-treating.")
MSG_PRED_HIGH = ("Predicted ", " mg/dL in 30 min (above {high_mg_dl}). Possible correction window.")
MSG_DROP = ("Predicted drop of ", " mg/dL in the next 30 min. Watch for an oncoming low.")
MSG_RISE = ("Predicted rise of ", " mg/dL in the next 30 min. Likely a carb-driven spike.")
# -------------------------------------------------------------------------------

ALERT_COLS = ("alert_ix", "type", "severity", "message", "detail")


def json_obj(**fields: Column) -> Column:
    """A JSON object with every field, at full precision (a missing one is null)."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def ts_text(ts: Column) -> Column:
    """``str(pd.Timestamp)`` of a UTC instant: 'YYYY-MM-DD HH:MM:SS[.ffffff]+00:00'."""
    frac = F.pmod(micros(ts), F.lit(1_000_000))
    base = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.concat(base, F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
                    .otherwise(F.lit("")), F.lit("+00:00"))


def _struct(t: str, sev: str, msg: Column, detail: Column) -> Column:
    return F.struct(F.lit(t).alias("type"), F.lit(sev).alias("severity"), msg.alias("message"),
                    detail.alias("detail"))


def _filled(template: str, limits: dict[str, Column]) -> Column:
    """A message text with thresholds in it, shown truncated to int."""
    parts = [(F.lit(text), limits[name].cast("long").cast("string") if name else None) for text, name, _, _ in Formatter().parse(template)]
    return F.concat(*[x for pair in parts for x in pair if x is not None])


def detect(df: DataFrame, *, keep_cols: Sequence[str] = (), now: Column | str | None = None,
           thresholds: dict | None = None, series_thresholds: DataFrame | None = None,
           series_cols: Sequence[str] = ("series_id",), current_col: str = "current_glucose",
           current_ts_col: str = "current_timestamp", pred_col: str = "prediction_30m") -> DataFrame:
    """R1-R4. ``thresholds`` is merged over the defaults (R2). ``series_thresholds``
    has a row per series with any of the threshold columns; a field that is missing
    or null there, or a series without a row, keeps the merged value."""
    merged = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    th = {k: F.lit(float(v)) for k, v in merged.items()}
    if series_thresholds is not None:
        own = [k for k in th if k in series_thresholds.columns]
        df = df.join(series_thresholds.select(*series_cols, *[F.col(k).cast("double").alias(f"_th_{k}") for k in own]), list(series_cols), "left")
        th |= {k: F.coalesce(f"_th_{k}", th[k]) for k in own}
    cur = F.col(current_col).cast("double")
    pred = F.col(pred_col).cast("double")
    cts = F.col(current_ts_col).cast("timestamp")
    now_c = F.current_timestamp() if now is None else (F.col(now) if isinstance(now, str) else now)
    age = (micros(now_c) - micros(cts)) / F.lit(60_000_000.0)
    delta = pred - cur
    d_cur = json_obj(current_glucose=cur)
    d_pred = json_obj(prediction_30m=pred, delta=delta)
    d_delta = json_obj(delta=delta, prediction_30m=pred)
    g1 = (F.when(cur <= th["low_sentinel"], _struct("sensor_extreme", "critical",
                                                     _filled(MSG_SENSOR_LOW, th), d_cur))
          .when(cur >= th["high_sentinel"], _struct("sensor_extreme", "critical",
                                                     _filled(MSG_SENSOR_HIGH, th), d_cur)))
    g2 = F.when(age > th["stale_minutes"], _struct(
        "stale_data", "warn", F.concat(F.lit(MSG_STALE[0]), fmt_0f(age), F.lit(MSG_STALE[1])),
        json_obj(age_minutes=age, last_seen=ts_text(cts))))
    g3 = (F.when(pred < th["low_mg_dl"], _struct(
        "predicted_low", "critical",
        F.concat(F.lit(MSG_PRED_LOW[0]), fmt_0f(pred), _filled(MSG_PRED_LOW[1], th)), d_pred))
          .when(pred > th["high_mg_dl"], _struct(
              "predicted_high", "warn",
              F.concat(F.lit(MSG_PRED_HIGH[0]), fmt_0f(pred), _filled(MSG_PRED_HIGH[1], th)), d_pred)))
    g4 = (F.when(delta <= -th["drop_mg_dl_30m"], _struct(
        "predicted_drop", "warn", F.concat(F.lit(MSG_DROP[0]), fmt_0f(-delta), F.lit(MSG_DROP[1])), d_delta))
          .when(delta >= th["rise_mg_dl_30m"], _struct(
              "predicted_rise", "info", F.concat(F.lit(MSG_RISE[0]), fmt_0f(delta), F.lit(MSG_RISE[1])), d_delta)))
    arr = F.array_compact(F.array(g1, g2, g3, g4))
    x = df.select(*keep_cols, F.posexplode(arr).alias("alert_ix", "_a"))
    return x.select(*keep_cols, F.col("alert_ix").cast("long").alias("alert_ix"),
                    "_a.type", "_a.severity", "_a.message", "_a.detail")


def alerts_frame(spark, series_cols: Sequence[str] = ("series_id",)) -> DataFrame:
    """Empty alerts table with the fixed columns."""
    from ..schemas import ALERTS_LOG, empty
    return empty(spark, ALERTS_LOG, series_cols)


def summary_line(latest: DataFrame, alerts: DataFrame, series_cols: Sequence[str] = ("series_id",)) -> DataFrame:
    """One text line per series: as-of, current, forecast, change and
    the ``severity:type`` list in alert order."""
    s = list(series_cols)
    al = alerts.groupBy(*s).agg(F.sort_array(F.collect_list(
        F.struct("alert_ix", F.concat_ws(":", "severity", "type").alias("t")))).alias("_al"))
    j = latest.join(al, s, "left")
    change = F.col("prediction_30m") - F.col("current_glucose")
    sign = F.when(change >= 0, F.lit("+")).otherwise(F.lit(""))
    line = F.concat(F.lit("as_of="), ts_text(F.col("as_of")), F.lit("  current="), fmt_0f(F.col("current_glucose")),
                    F.lit("  predict_30m="), fmt_0f(F.col("prediction_30m")), F.lit("  Δ="), sign, fmt_0f(change),
                    F.when(F.size("_al") > 0, F.concat(F.lit("  alerts: "),
                                                       F.array_join(F.transform("_al", lambda x: x["t"]), ", ")))
                    .otherwise(F.lit("")))
    return j.select(*s, line.alias("summary"))
