"""Query catalogue: each entry takes (spark, sf_dir) and returns a DataFrame
computed by the library's operators over the driver's tables (whole
tables, no row caps except where a limit is the feature)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.features import build_features, feature_names, timeline_features
from ..operators.timeline import gapless_grid, tumbling_mean, unified_timeline
from . import standins as st
from .output import DIGITS, finish

S = ["user_id"]


def timeline_inputs(spark: SparkSession, sf: str):
    r = st.readings(spark, sf)
    p = st.pump_events(spark, sf)
    t = clean.union_treatments(clean.derive_treatments(p, S), st.manual_treatments(spark, sf),
                               series_cols=S)
    return r, p, t


def timeline(spark: SparkSession, sf: str, freq_minutes: int = 5, columns=None) -> DataFrame:
    r, p, t = timeline_inputs(spark, sf)
    return unified_timeline(r, p, t, series_cols=S, freq_minutes=freq_minutes, columns=columns)


def features(spark: SparkSession, sf: str, columns=None, digits=None) -> DataFrame:
    r, p, t = timeline_inputs(spark, sf)
    return timeline_features(r, p, t, series_cols=S, columns=columns, digits=digits)


# ---------------------------------------------------------------- queries
def q_unified_timeline_5m(spark, sf):
    return finish(timeline(spark, sf))


def q_unified_timeline_1h(spark, sf):
    return finish(timeline(spark, sf, freq_minutes=60))


def q_features(spark, sf):
    return features(spark, sf, digits=DIGITS)  # as ``finish`` puts rows out; user_id is a BIGINT


def q_resample_mean_5m(spark, sf):
    r = st.readings(spark, sf)
    return finish(tumbling_mean(r, series_cols=S, freq_minutes=5,
                                value_cols=("glucose_mg_dl", "trend_arrow_encoded")))


def q_grid_align_1h(spark, sf):
    r, p, _ = timeline_inputs(spark, sf)
    g = gapless_grid(r, p, series_cols=S, freq_minutes=60)
    m = tumbling_mean(r, series_cols=S, freq_minutes=60)
    return finish(g.join(m, S + ["timestamp"], "left"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "unified_timeline_5m": q_unified_timeline_5m,
    "unified_timeline_1h": q_unified_timeline_1h,
    "features": q_features,
    "resample_mean_5m": q_resample_mean_5m,
    "grid_align_1h": q_grid_align_1h,
}




# ============================================================ more queries
from ..functions import scalar as fx  # noqa: E402
from ..operators import alerts as al  # noqa: E402
from ..operators import drift as dr  # noqa: E402
from ..operators import metrics as mt  # noqa: E402
from ..operators import model as md  # noqa: E402
from ..operators import quality as qa  # noqa: E402
from ..operators import whatif as wi  # noqa: E402
from ..sinks import writers as wr  # noqa: E402
from ..sinks.compaction import AppendLog  # noqa: E402
from ..sources import readers as rd  # noqa: E402

NOW = "2024-01-30 00:00:00"
TRAINED_MAE = 25.0


def _tl_cols(spark, sf, freq, cols, where=None):
    t = timeline(spark, sf, freq_minutes=freq, columns=cols)
    if where is not None:
        t = t.filter(where)
    return finish(t.select(*S, "timestamp", *cols))


def q_bin_sum_1h(spark, sf):
    """A2, A3: bolus units and carbs summed per hour on the grid."""
    return _tl_cols(spark, sf, 60, ["bolus_units", "carbs_g"])


def q_bin_max_ffill_1h(spark, sf):
    """Reported IOB max per bin, forward filled (or decay)."""
    return _tl_cols(spark, sf, 60, ["iob_units"])


def q_asof_basal_1h(spark, sf):
    """Latest basal sample at or before each hour."""
    return _tl_cols(spark, sf, 60, ["basal_rate"])


def q_interval_flag_5m(spark, sf):
    """5-minute bins inside a suspend / loop-action interval."""
    return _tl_cols(spark, sf, 5, ["is_suspended", "control_iq_active"],
                    F.col("is_suspended") | F.col("control_iq_active"))


def q_decay_projection_1h(spark, sf):
    """Modelled IOB from boluses (reported IOB ignored)."""
    r, p, t = timeline_inputs(spark, sf)
    p = p.withColumn("iob_units", F.lit(None).cast("double"))
    tl = unified_timeline(r, p, t, series_cols=S, freq_minutes=60)
    return finish(tl.select(*S, "timestamp", "iob_units"))


def _feature_subset(cols):
    def q(spark, sf):
        return finish(features(spark, sf, cols).select(*S, "timestamp", *cols))
    return q


LAG_DELTA = [f"glucose_lag_{m}m" for m in (5, 10, 15, 30, 60, 120, 240)] + \
    [f"glucose_delta_{m}m" for m in (5, 15, 30)]
ROLLING = [x for m in (15, 30, 60, 120) for x in (f"glucose_mean_{m}m", f"glucose_std_{m}m", f"glucose_slope_{m}m")]
RECENCY = [f"carbs_sum_{m}m" for m in (15, 30, 60, 120)] + ["minutes_since_carbs"] + \
    [f"bolus_sum_{m}m" for m in (15, 30, 60, 120)] + ["minutes_since_bolus"]
CALENDAR = ["hour_sin", "hour_cos", "dow", "is_weekend"]
LABELS = ["target_30m", "target_60m"]


def q_gap_report(spark, sf):
    """Gaps over 12 h between consecutive readings."""
    r = st.readings(spark, sf)
    return finish(qa.find_gaps(r, series_cols=S, threshold_minutes=720.0))


def q_grid_regularity(spark, sf):
    """Step check over the 5-minute bins that hold readings."""
    m = tumbling_mean(st.readings(spark, sf), series_cols=S, freq_minutes=5)
    return finish(qa.grid_regularity(m, series_cols=S, freq_minutes=5))


def q_time_in_range(spark, sf):
    """A7 with thresholds scaled to the data (20-80)."""
    return finish(qa.time_in_range(st.readings(spark, sf), series_cols=S, low=20.0, high=80.0))


def q_profile_nulls(spark, sf):
    """Null profile of the hourly timeline."""
    return finish(qa.profile(timeline(spark, sf, freq_minutes=60).drop("user_id")))


def q_activity_summary(spark, sf):
    """A9 per series over the hourly timeline."""
    return finish(qa.activity_summary(timeline(spark, sf, freq_minutes=60), series_cols=S))


def q_value_counts(spark, sf):
    """A10: pump events by type and treatments by source, most frequent first in each."""
    r, p, t = timeline_inputs(spark, sf)
    a = qa.value_counts(p, "event_type").select(F.lit("event_type").alias("field"),
                                                F.col("event_type").alias("value"), "n")
    b = qa.value_counts(t, "source").select(F.lit("source").alias("field"), F.col("source").alias("value"), "n")
    return finish(a.unionByName(b))


def q_keep_last_dedupe(spark, sf):
    """Newest reading per (series, hour)."""
    r = st.readings(spark, sf).withColumn("hour", F.date_trunc("hour", "timestamp"))
    return finish(clean.keep_last(r, S + ["hour"], ["timestamp", "seq"]))


def q_keep_first_dedupe(spark, sf):
    """First event per (series, type, day) in ingest order."""
    ev = st.load_events(spark, sf).withColumn("day", F.to_date("ts"))
    return finish(clean.keep_first(ev.select("user_id", "event_type", "day", "ts", "value", "event_id"),
                                   ["user_id", "event_type", "day"], ["ts", "event_id"]))


def q_union_sources(spark, sf):
    """Pump-derived + manual treatments, deduped."""
    _, _, t = timeline_inputs(spark, sf)
    return finish(t.drop("seq"))


def q_upsert_readings(spark, sf):
    """K2: re-polled overlapping window (revised values) upserted, new wins."""
    r = st.readings(spark, sf)
    old = r.filter(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp"))
    new = r.filter(F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp")) \
        .withColumn("glucose_mg_dl", F.col("glucose_mg_dl") + F.lit(1.0))
    return finish(clean.upsert_latest(old, new, S + ["timestamp"]).drop("seq"))


def q_parse_readings(spark, sf):
    """P1, P2, P3, P5 over string fields."""
    x = st.raw_strings(spark, sf)
    return finish(x.select("user_id", "event_id", fx.parse_reading("reading_text").alias("glucose_mg_dl"),
                           fx.encode_trend("trend_text").alias("trend_from_label"),
                           fx.rate_to_trend("rate_text").alias("trend_from_rate"),
                           fx.to_utc("ts_text").alias("timestamp")))


def q_encode_trend(spark, sf):
    """Label encode on EGV-typed rows (case-insensitive type)."""
    x = st.raw_strings(spark, sf).withColumn(
        "event_type", F.when(F.col("event_id") % 3 == 0, "egv").when(F.col("event_id") % 3 == 1, "EGV")
        .otherwise("Calibration"))
    return finish(x.filter(F.upper("event_type") == "EGV")
                  .select("user_id", "event_id", "trend_text", fx.encode_trend("trend_text").alias("trend")))


def q_chrono_split(spark, sf):
    """W15 + A18: per series 70/15/15 split of readings; summary per part."""
    r = st.readings(spark, sf).withColumnRenamed("glucose_mg_dl", "target_30m")
    sp = md.time_split(r, series_cols=S)
    return finish(mt.split_summary(sp, series_cols=S))


def _persistence_pairs(spark, sf):
    r = st.readings(spark, sf).select(*S, "timestamp", "glucose_mg_dl")
    from ..operators.blocked import previous_in_series
    p = previous_in_series(r, S, "timestamp", payload=["glucose_mg_dl"])
    return p.select(*S, "timestamp", F.col("glucose_mg_dl").alias("y"), F.col("prev_glucose_mg_dl").alias("yhat"))


def q_regression_metrics(spark, sf):
    """A11 (+A12): persistence forecast (previous reading) vs reading."""
    return finish(mt.regression_metrics(_persistence_pairs(spark, sf), y_col="y", pred_col="yhat"))


def q_hypo_recall(spark, sf):
    """A12 per series."""
    return finish(mt.hypo_recall(_persistence_pairs(spark, sf), y_col="y", pred_col="yhat", series_cols=S))


def q_alerts(spark, sf):
    """R1-R4 on every forecast row."""
    f = st.forecast_rows(spark, sf)
    a = al.detect(f, keep_cols=["user_id", "event_id"], now="now")

    def number(field):
        return F.get_json_object("detail", f"$.{field}").cast("double")

    return finish(a.select("user_id", "event_id", "alert_ix", "type", "severity", "message",
                           number("current_glucose").alias("detail_current"), number("prediction_30m").alias("detail_prediction"),
                           number("delta").alias("detail_delta"), number("age_minutes").alias("detail_age"),
                           F.get_json_object("detail", "$.last_seen").alias("detail_last_seen")))


def q_alerts_by_series(spark, sf):
    """R2: a thresholds table with some fields for some series, defaults elsewhere."""
    f = st.forecast_rows(spark, sf)
    u = F.col("user_id")
    table = f.select(u).distinct().filter(u % 3 != 0).select(
        u, (F.lit(40.0) + u % 50).alias("low_mg_dl"), F.when(u % 2 == 0, F.lit(100.0) + u % 70).alias("high_mg_dl"),
        F.when(u % 5 == 0, F.lit(30)).alias("stale_minutes"), F.lit(20.0).alias("drop_mg_dl_30m"))
    a = al.detect(f, keep_cols=["user_id", "event_id"], now="now", series_thresholds=table, series_cols=S)
    return finish(a.select("user_id", "event_id", "alert_ix", "type", "severity", "message"))


def q_alerts_retained(spark, sf):
    """K4 + R2: alerts under an overridden threshold; the newest 10 of each
    series stay, alerts of one time ranked by event and alert number."""
    f = st.forecast_rows(spark, sf)
    a = al.detect(f, keep_cols=["user_id", "event_id", "current_timestamp"], now="now", thresholds={"low_mg_dl": 80.0})
    a = a.withColumn("timestamp", F.date_trunc("day", "current_timestamp"))  # one log time for many alerts
    return finish(wr.retain_last(a, 10, series_cols=S, order_cols=["timestamp", "event_id", "alert_ix"])
                  .select(*S, "event_id", "alert_ix", "type"))


def q_sensor_feed(spark, sf):
    """Landed sensor records, all of them (no look-back, no cap)."""
    ev = st.load_events(spark, sf).filter(F.col("event_type") == "view")
    rec = ev.select("user_id", st._iso(F.col("ts")).alias("datetime"), "value", (F.col("k") % 8).alias("trend"))
    return finish(rd.sensor_feed(rec, series_cols=S, require=True))


def q_grid_pump_only(spark, sf):
    """Hourly grid where odd series have pump events and no reading."""
    r = st.readings(spark, sf).filter(F.col("user_id") % 2 == 0)
    return finish(gapless_grid(r, st.pump_events(spark, sf), series_cols=S, freq_minutes=60))


def q_date_filter_partitioned(spark, sf):
    """K1 + P15: readings written by date, read back with the date range
    (the plan prunes the other dates' folders)."""
    path = _scratch(spark, "readings-by-date")
    wr.write_parquet(st.readings(spark, sf), path)
    return finish(qa.date_filter(spark.read.parquet(path), "2024-01-10", "2024-01-12").drop("seq", "date"))


def _scratch(spark, name):
    import os
    import uuid

    from ..session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "stores", f"{name}-{uuid.uuid4().hex}")


def _scored_log(spark, sf):
    log = dr.dedupe_log(st.prediction_log(spark, sf), series_cols=S)
    truth = tumbling_mean(st.readings(spark, sf), series_cols=S, freq_minutes=5)
    return dr.join_with_actuals(log, truth, series_cols=S)


def q_forecast_truth_join(spark, sf):
    """K3 + J7: deduped log joined to truth."""
    return finish(_scored_log(spark, sf).drop("seq"))


def q_trailing_metrics(spark, sf):
    """A13 at a fixed reference time."""
    return finish(dr.trailing_metrics(_scored_log(spark, sf), NOW, series_cols=S))


def q_rolling_mae_6h(spark, sf):
    """(t - 6h, t] mean abs error."""
    return finish(dr.rolling_mae(_scored_log(spark, sf), series_cols=S))


def q_drift_status(spark, sf):
    """C4 against a trained MAE of 25."""
    m = dr.trailing_metrics(_scored_log(spark, sf), NOW, series_cols=S)
    return finish(dr.drift_status(m, TRAINED_MAE))


def q_backtest_mae(spark, sf):
    """A14 per series over the scored log."""
    from ..operators.metrics import backtest_mae
    return finish(backtest_mae(_scored_log(spark, sf), series_cols=S))


SCENARIO_COLS = ["scenario_ix", "scenario", "iob_units", "basal_rate", "is_suspended",
                 "carbs_sum_15m", "carbs_sum_30m", "carbs_sum_60m", "carbs_sum_120m", "minutes_since_carbs",
                 "bolus_sum_15m", "bolus_sum_30m", "bolus_sum_60m", "bolus_sum_120m", "minutes_since_bolus"]


def q_scenario_rewrite(spark, sf):
    """Rows with a current reading x the standard action grid."""
    f = clean.drop_incomplete(features(spark, sf, ["glucose_mg_dl", *SCENARIO_COLS]), ["glucose_mg_dl"])
    x = wi.expand_scenarios(f, wi.standard_action_grid())
    return finish(x.select(*S, "timestamp", *SCENARIO_COLS))


COMPLETE_COLS = ["glucose_mg_dl", "iob_units", "basal_rate", "carbs_sum_120m", "minutes_since_bolus"]


def q_latest_complete_row(spark, sf):
    """Newest row per series complete in the given columns."""
    f = features(spark, sf, COMPLETE_COLS).select(*S, "timestamp", *COMPLETE_COLS)
    return finish(md.latest_complete(f, COMPLETE_COLS, series_cols=S))


def q_decimate(spark, sf):
    """Even stride to about 5 points per series."""
    return finish(qa.decimate(st.readings(spark, sf).drop("seq"), 5, series_cols=S))


def q_topk_recent(spark, sf):
    """Newest 50 readings overall."""
    r = st.readings(spark, sf)
    return finish(qa.top_recent(r, 50, tie_cols=["seq"]).drop("seq"))


def q_topk_recent_per_series(spark, sf):
    """T3 per series: newest 3 readings of each series."""
    return finish(qa.top_per_series(st.readings(spark, sf).drop("seq"), 3, series_cols=S))


def q_date_filter(spark, sf):
    """Readings from 2024-01-10 to 2024-01-12 inclusive."""
    return finish(qa.date_filter(st.readings(spark, sf), "2024-01-10", "2024-01-12").drop("seq"))


def q_event_markers(spark, sf):
    """Hours with a bolus or a suspension."""
    t = timeline(spark, sf, freq_minutes=60)
    return finish(qa.event_markers(t).select(*S, "timestamp", "bolus_units", "is_suspended"))


def q_derive_treatments(spark, sf):
    """Carb-bearing boluses as meal treatments."""
    return finish(clean.derive_treatments(st.pump_events(spark, sf), S).drop("seq"))


def q_union_pump_streams(spark, sf):
    """Three landed vendor streams normalised and unioned."""
    b, ba, e = st.pump_streams(spark, sf)
    return finish(rd.pump_feed(b, ba, e, series_cols=["user_id", "event_id"]))


def q_first_truthy(spark, sf):
    """Q16 alone: bolus dose and carbs by first non-zero candidate."""
    b, _, _ = st.pump_streams(spark, sf)
    return finish(b.select("user_id", "event_id",
                           rd.first_truthy(F.col("insulinDelivered"), F.col("requestedInsulin"), F.lit(0.0)).alias("dose"),
                           rd.first_truthy(F.col("carbsRequest"), F.col("carbAmount")).alias("carbs_g"),
                           rd.first_truthy(F.col("bgValue"), F.col("targetBG")).alias("bg")))


def q_stage_counters(spark, sf):
    """Counters of three stages, observed while the readings are written (one scan)."""
    et = F.col("event_type")
    stages = {"raw_events": (F.lit(True), et == "error"), "clean_readings": (et == "view", F.lit(False)),
              "pump_events": (et.isin("purchase", "click", "signup"), (et == "purchase") & (F.col("k") > 0))}
    ev, obs = qa.observed_stages(st.load_events(spark, sf), stages, name="stages", ts_col="ts")
    wr.write_parquet(ev.filter(et == "view"), _scratch(spark, "observed"), ts_col="ts")
    return finish(qa.stage_table(spark, obs, list(stages)))


QUERIES.update({
    "bin_sum_1h": q_bin_sum_1h,
    "bin_max_ffill_1h": q_bin_max_ffill_1h,
    "asof_basal_1h": q_asof_basal_1h,
    "interval_flag_5m": q_interval_flag_5m,
    "decay_projection_1h": q_decay_projection_1h,
    "lag_delta_features": _feature_subset(LAG_DELTA),
    "rolling_features": _feature_subset(ROLLING),
    "recency_features": _feature_subset(RECENCY),
    "calendar_features": _feature_subset(CALENDAR),
    "labels": _feature_subset(LABELS),
    "gap_report": q_gap_report,
    "grid_regularity": q_grid_regularity,
    "time_in_range": q_time_in_range,
    "profile_nulls": q_profile_nulls,
    "activity_summary": q_activity_summary,
    "value_counts": q_value_counts,
    "keep_last_dedupe": q_keep_last_dedupe,
    "keep_first_dedupe": q_keep_first_dedupe,
    "union_sources": q_union_sources,
    "upsert_readings": q_upsert_readings,
    "parse_readings": q_parse_readings,
    "encode_trend": q_encode_trend,
    "chrono_split": q_chrono_split,
    "regression_metrics": q_regression_metrics,
    "hypo_recall": q_hypo_recall,
    "alerts": q_alerts,
    "alerts_retained": q_alerts_retained,
    "sensor_feed": q_sensor_feed,
    "grid_pump_only": q_grid_pump_only,
    "date_filter_partitioned": q_date_filter_partitioned,
    "forecast_truth_join": q_forecast_truth_join,
    "trailing_metrics": q_trailing_metrics,
    "rolling_mae_6h": q_rolling_mae_6h,
    "drift_status": q_drift_status,
    "backtest_mae": q_backtest_mae,
    "scenario_rewrite": q_scenario_rewrite,
    "latest_complete_row": q_latest_complete_row,
    "decimate": q_decimate,
    "topk_recent": q_topk_recent,
    "topk_recent_per_series": q_topk_recent_per_series,
    "date_filter": q_date_filter,
    "event_markers": q_event_markers,
    "derive_treatments": q_derive_treatments,
    "union_pump_streams": q_union_pump_streams,
    "first_truthy": q_first_truthy,
    "stage_counters": q_stage_counters,
})


# ================================================================ model
from ..operators import explain as ex  # noqa: E402
from ..operators.features import feature_columns, label_names  # noqa: E402

MODEL_GRID = 360             # 6-hour grid: dense enough in the stand-in data for labelled test rows
MODEL_PARAMS = dict(maxIter=30, maxDepth=5)
_MODELS: dict = {}
_SPLITS: dict = {}


def model_features(spark, sf):
    """Timeline + features on a 6-hour grid over the dense stand-in."""
    r = st.dense_readings(spark, sf)
    p = st.pump_events(spark, sf)
    t = clean.union_treatments(clean.derive_treatments(p, S), st.manual_treatments(spark, sf), series_cols=S)
    return timeline_features(r, p, t, series_cols=S, grid_minutes=MODEL_GRID, block_minutes=MODEL_GRID * 112)


def fitted_model(spark, sf, horizon=0):
    """Model, feature columns and label of one horizon (0: 6 bins ahead, 1: 12 bins)."""
    key = (spark.sparkContext.applicationId, sf, horizon)
    if key not in _MODELS:
        f = _split_features(spark, sf)
        target = label_names(MODEL_GRID)[horizon]
        cols = feature_columns(f.drop("split", "row_pos"), S)
        model, _ = md.fit(f, cols, target_col=target, series_cols=S, params=MODEL_PARAMS)
        _MODELS[key] = (model, cols, target)
    return _MODELS[key]


def q_gbt_backtest(spark, sf):
    """M1, M2, M6: fit on the chronological split, score every row."""
    model, cols, target = fitted_model(spark, sf)
    f = model_features(spark, sf)
    return finish(md.predict(model, f, target_col=target, keep_cols=S + ["timestamp", "glucose_mg_dl"]))


def q_gbt_latest(spark, sf):
    """M3 + T2: score the newest complete row of each series."""
    model, cols, _ = fitted_model(spark, sf)
    f = model_features(spark, sf)
    return finish(md.predict_latest(model, f, ["glucose_mg_dl", "iob_units"], series_cols=S))


def q_contributions(spark, sf):
    """M5: per-row additive contributions for every row."""
    model, cols, _ = fitted_model(spark, sf)
    f = model_features(spark, sf)
    c = ex.contributions(spark, model, f, key_cols=S + ["timestamp"])
    return finish(c.select(*S, "timestamp", "bias", "prediction",
                           F.aggregate("contribs", F.lit(0.0), lambda a, x: a + x).alias("sum_contribs")))


def q_global_importance(spark, sf):
    """Mean |contribution| per feature over all rows."""
    model, cols, _ = fitted_model(spark, sf)
    f = model_features(spark, sf)
    c = ex.contributions(spark, model, f, key_cols=S + ["timestamp"])
    return finish(ex.global_importance(c, cols))


def q_local_explanation(spark, sf):
    """T4: top-8 contributions of each series' newest complete row."""
    model, cols, _ = fitted_model(spark, sf)
    f = model_features(spark, sf)
    last = md.latest_complete(f, ["glucose_mg_dl", "iob_units"], series_cols=S)
    c = ex.contributions(spark, model, last, key_cols=S + ["timestamp"])
    top = ex.top_k_contributions(c, cols, key_cols=S + ["timestamp"], k=8)
    return finish(top.select(*S, "timestamp", "bias", "prediction", F.inline("top")))


def q_explain_sample(spark, sf):
    """Deterministic 2,000-row sample of all rows, by time (sampling is the feature)."""
    f = model_features(spark, sf)
    return finish(ex.seeded_sample(f, 2000, key_cols=S + ["timestamp"]).select(*S, "timestamp", "glucose_mg_dl"))


def q_whatif_scores(spark, sf):
    """Baseline + 9 actions scored for each series' newest complete row."""
    model, cols, _ = fitted_model(spark, sf)
    f = model_features(spark, sf)
    last = md.latest_complete(f, ["glucose_mg_dl", "iob_units"], series_cols=S)
    return finish(wi.score_actions(model, last, wi.standard_action_grid(), key_cols=S + ["timestamp"]))


def q_latest_complete_all(spark, sf):
    """Newest row of each series that is complete in every feature; a
    series without one is reported with ``found`` = false."""
    f = model_features(spark, sf)
    cols = feature_columns(f, S)
    last = md.latest_complete(f.select(*S, "timestamp", *cols), cols, series_cols=S, report_missing=True)
    return finish(last.select(*S, "timestamp", F.col("timestamp").isNotNull().alias("found"), "glucose_mg_dl"))


def _split_features(spark, sf):
    """The model's features, computed and split once for both horizons, their scores and metrics."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SPLITS:
        _SPLITS[key] = md.stored_split(model_features(spark, sf), series_cols=S)
    return _SPLITS[key]


def q_model_split_counts(spark, sf):
    """Both horizons fitted and every row scored; rows, labels
    and scores of each part."""
    out = None
    for i, target in enumerate(label_names(MODEL_GRID)):
        model, _, _ = fitted_model(spark, sf, i)
        p = md.predict(model, _split_features(spark, sf), target_col=target, keep_cols=S + ["split"])
        g = p.groupBy("split").agg(F.count("*").alias("n_rows"), F.count("actual_30m").alias("n_labelled"),
                                   F.count("prediction_30m").alias("n_scored"))
        g = g.withColumn("target", F.lit(target))
        out = g if out is None else out.unionByName(g)
    return finish(out)


def q_latest_prediction_check(spark, sf):
    """M3: the latest prediction's row, and that the change is prediction minus current."""
    p = q_gbt_latest(spark, sf)
    same = F.abs(F.col("prediction_30m") - F.col("current_glucose") - F.col("predicted_change")) < 1e-5
    return p.select(*S, "as_of", "current_glucose", same.alias("change_adds_up"))


def q_contributions_check(spark, sf):
    """M5: rows of each series whose bias and contributions add up to Spark's own prediction."""
    model, _, _ = fitted_model(spark, sf)
    f = model.transform(model_features(spark, sf)).withColumnRenamed("prediction", "spark_prediction")
    c = ex.contributions(spark, model, f, key_cols=S + ["timestamp", "spark_prediction"])
    total = F.col("bias") + F.aggregate("contribs", F.lit(0.0), lambda a, x: a + x)
    return finish(c.groupBy(*S).agg(F.count("*").alias("n_rows"), F.max(F.size("contribs")).alias("n_features"),
                                    F.count_if(F.abs(total - F.col("spark_prediction")) < 1e-6).alias("n_additive")))


def q_importance_check(spark, sf):
    """Every feature has one importance, and none is negative."""
    g = q_global_importance(spark, sf)
    return g.select("feature", (F.col("mean_abs_contribution") >= 0).alias("nonnegative"))


def q_local_explanation_check(spark, sf):
    """T4: the explained row of each series, its number of features, and that
    they come in falling order of size."""
    model, cols, _ = fitted_model(spark, sf)
    last = md.latest_complete(model_features(spark, sf), ["glucose_mg_dl", "iob_units"], series_cols=S)
    c = ex.contributions(spark, model, last, key_cols=S + ["timestamp"])
    top = ex.top_k_contributions(c, cols, key_cols=S + ["timestamp"], k=8)
    size = F.transform("top", lambda x: F.abs(x["contribution"]))
    return finish(top.select(*S, "timestamp", F.size("top").alias("n_top"),
                             (F.sort_array(size, asc=False) == size).alias("in_order"),
                             F.size(F.array_distinct(F.transform("top", lambda x: x["feature"]))).alias("n_features")))


def q_whatif_check(spark, sf):
    """Scenarios of each series' newest row; the baseline differs by zero,
    and both suspend lengths score alike."""
    w = q_whatif_scores(spark, sf)
    suspend = F.when(F.col("scenario").startswith("suspend"), F.col("prediction_30m"))
    return finish(w.groupBy(*S, "timestamp").agg(
        F.count("*").alias("n_scenarios"), F.count("prediction_30m").alias("n_scored"),
        F.max(F.when(F.col("scenario_ix") == 0, F.col("delta_vs_baseline"))).alias("baseline_delta"),
        (F.max(suspend) == F.min(suspend)).alias("suspends_alike")))


def q_drift_from_metrics(spark, sf):
    """The model's metrics on its test part are written as a row
    and read back; the live log is judged by that MAE."""
    model, _, target = fitted_model(spark, sf)
    test = md.predict(model, _split_features(spark, sf).filter("split = 'test'"), target_col=target, keep_cols=S)
    path = _scratch(spark, "model-metrics")
    wr.write_json_row(mt.regression_metrics(test, y_col="actual_30m", pred_col="prediction_30m"), path)
    trained = spark.read.json(path).first()  # the one row
    m = dr.drift_status(dr.trailing_metrics(_scored_log(spark, sf), NOW, series_cols=S), trained["mae"])
    ratio = F.col("mae_24h") / F.lit(trained["mae"])
    return finish(m.select(*S, "n_scored", "mae_24h", F.lit(trained["n"]).alias("n_test"),
                           (F.col("trained_mae") > 0).alias("trained"),
                           (F.col("drift_ratio").eqNullSafe(ratio) & (F.col("recommend_retrain") == F.coalesce(ratio >= 1.5, F.lit(False))))
                           .alias("ratio_adds_up")))


QUERIES.update({
    "gbt_backtest": q_gbt_backtest,
    "gbt_latest": q_gbt_latest,
    "contributions": q_contributions,
    "global_importance": q_global_importance,
    "local_explanation": q_local_explanation,
    "explain_sample": q_explain_sample,
    "whatif_scores": q_whatif_scores,
    "latest_complete_all": q_latest_complete_all,
    "model_split_counts": q_model_split_counts,
    "latest_prediction_check": q_latest_prediction_check,
    "contributions_check": q_contributions_check,
    "importance_check": q_importance_check,
    "local_explanation_check": q_local_explanation_check,
    "whatif_check": q_whatif_check,
    "drift_from_metrics": q_drift_from_metrics,
})


# ============================================================ streaming
def q_stream_equals_batch(spark, sf):
    """The sensor stand-in streamed into 5-minute means (batch-id keyed
    upsert); the latest view must equal the batch ``resample_mean_5m``."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from ..streaming import refresh as rf

    ev_schema = spark.read.parquet(f"{sf}/events.parquet").schema
    run = uuid.uuid4().hex
    store = os.path.join(checkpoint_dir(spark), "stores", f"bins-{run}")
    raw = spark.readStream.schema(ev_schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = raw.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("glucose_mg_dl"),
        fx.rate_to_trend((F.get_json_object("props", "$.k").try_cast("int") - 50) / F.lit(25.0))
        .alias("trend_arrow_encoded"))
    q = rf.stream_bin_means(spark, stream, store, name=f"bins-{run}", series_cols=S)
    q.awaitTermination()
    return finish(rf.latest_bins(spark, store, S))


QUERIES["stream_equals_batch"] = q_stream_equals_batch


def refreshed(spark, sf, model=None, replay=True, late_pump=False):
    """The live path over the stand-ins: readings land in three folders (early,
    recent, and a late one with every seventeenth early reading), are streamed
    folder by folder into ``RefreshCycle``, and one batch is run again. Pump events
    and treatments land with the first folder or, with ``late_pump``, in four: early,
    recent, late with the late readings, and at last without any reading."""
    import uuid
    from datetime import datetime, timezone

    from ..streaming import refresh as rf

    base = _scratch(spark, "refresh")
    recent = F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp")

    def lands(late, later, last=F.lit(False)):
        """0: early, 1: recent, 2: late, 3: latest."""
        return F.when(last, 3).when(later, 2).when(late, 1).otherwise(0)

    r, p, t = st.readings(spark, sf), st.pump_events(spark, sf), st.manual_treatments(spark, sf)
    always = F.lit(False)
    parts = {"readings": (r, lands(recent, ~recent & (F.col("seq") % 17 == 0))),
             "pump": (p, lands(recent, F.col("seq") % 5 == 1, F.col("seq") % 11 == 3) if late_pump else lands(always, always)),
             "treatments": (t, lands(recent, F.col("seq") % 3 == 1, F.col("seq") % 7 == 3) if late_pump else lands(always, always))}
    for name, (d, folder) in parts.items():
        d.withColumn("lands", folder).write.partitionBy("lands").parquet(f"{base}/{name}")
        for i in range(4):  # a feed without a row in some folder
            d.limit(0).write.mode("append").parquet(f"{base}/{name}/lands={i}")
    cycle = rf.RefreshCycle(f"{base}/store", series_cols=S, model=model, clock=lambda: datetime(2024, 1, 31, tzinfo=timezone.utc))
    batches = range(4 if late_pump else 3)
    for i in batches:  # one micro-batch per landed folder, in landing order
        streams = [rf.readings_stream(spark, f"{base}/{name}/lands={i}", d.schema) for name, (d, _) in parts.items()]
        rf.start_refresh(spark, rf.feeds(*streams, series_cols=S), _as_batch(cycle, i), name=f"refresh-{i}-{uuid.uuid4().hex}",
                         available_now=True).awaitTermination()
    if replay:
        landed = [spark.read.schema(d.schema).parquet(f"{base}/{name}/lands=1") for name, (d, _) in parts.items()]
        cycle(rf.feeds(*landed, series_cols=S), 1)
    return cycle


def _as_batch(cycle, number):
    return lambda df, _: cycle(df, number)


def q_refresh_equals_batch(spark, sf):
    """Features after three refreshes (one with late readings) and a
    replay; they equal the batch features. The replay is that of batch 1, so
    rows of the late batch 2 stay the newest."""
    return finish(refreshed(spark, sf).features(spark))


QUERIES["refresh_equals_batch"] = q_refresh_equals_batch


def q_refresh_late_pump(spark, sf):
    """Features after four refreshes in which pump events and treatments land
    late too, the last without any reading; they equal the batch features."""
    return finish(refreshed(spark, sf, late_pump=True).features(spark))


QUERIES["refresh_late_pump"] = q_refresh_late_pump


def q_stream_forecast_truth(spark, sf):
    """The forecast log and the truth, each landed and streamed, joined as they
    arrive; with the forecasts that still wait they equal ``forecast_truth_join``."""
    import uuid

    from ..streaming import forecasts as fc

    base = _scratch(spark, "forecasts")
    dr.dedupe_log(st.prediction_log(spark, sf), series_cols=S).write.parquet(f"{base}/log")
    tumbling_mean(st.readings(spark, sf), series_cols=S, freq_minutes=5).write.parquet(f"{base}/truth")
    log, truth = spark.read.parquet(f"{base}/log"), spark.read.parquet(f"{base}/truth")
    streams = [spark.readStream.schema(d.schema).parquet(f"{base}/{k}") for k, d in (("log", log), ("truth", truth))]
    fc.start_forecast_truth(spark, *streams, f"{base}/joined", name=f"forecasts-{uuid.uuid4().hex}", series_cols=S,
                            available_now=True).awaitTermination()
    return finish(fc.forecast_truth_view(log, f"{base}/joined", series_cols=S).drop("seq"))


QUERIES["stream_forecast_truth"] = q_stream_forecast_truth
QUERIES["alerts_by_series"] = q_alerts_by_series


# ============================================================ CSV path
def q_export_csv_roundtrip(spark, sf):
    """K6 -> S1-S4 -> P1-P7 -> A16: readings written as a device-style CSV
    export (readings below 40 as 'Low', above 400 as 'High', metadata rows
    without an event type) into the shared folder, read back and cleaned."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from ..sinks.writers import write_csv

    ev = st.load_events(spark, sf).filter(F.col("event_type") == "view")
    v = F.col("value")
    text = F.when(v < 40, F.lit("Low")).when(v > 400, F.lit("High")).otherwise(v.cast("string"))
    data = ev.select(
        F.col("event_id").cast("string").alias("Index"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp (YYYY-MM-DDThh:mm:ss)"),
        F.lit("EGV").alias("Event Type"), F.col("user_id").cast("string").alias("Patient Info"),
        text.alias("Glucose Value (mg/dL)"),
        ((F.col("k") - 50) / F.lit(25.0)).cast("string").alias("Glucose Rate of Change (mg/dL/min)"))
    # every third reading was exported again with a corrected value and a longer, greater index
    again = data.filter(F.col("Index").cast("long") % 3 == 0).withColumns({
        "Glucose Value (mg/dL)": (F.lit(200.0) + F.col("Index").cast("long") % 7).cast("string"),
        "Index": F.concat(F.lit("1000000"), "Index")})
    meta = ev.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("Index"),
                     F.lit(None).cast("string").alias("Timestamp (YYYY-MM-DDThh:mm:ss)"),
                     F.lit(None).cast("string").alias("Event Type"),
                     F.col("user_id").cast("string").alias("Patient Info"),
                     F.lit(None).cast("string").alias("Glucose Value (mg/dL)"),
                     F.lit(None).cast("string").alias("Glucose Rate of Change (mg/dL/min)"))
    path = os.path.join(checkpoint_dir(spark), "exports", f"csv-{uuid.uuid4().hex}")
    write_csv(again.unionByName(data).unionByName(meta), path)
    raw = rd.read_export_csv(spark, path)
    clean_df = rd.clean_readings(raw, series_cols=["patient_info"], seq_col="index")
    return finish(clean_df.select(F.col("patient_info").cast("long").alias("user_id"), "timestamp",
                                  "glucose_mg_dl", "trend_arrow_encoded"))


QUERIES["export_csv_roundtrip"] = q_export_csv_roundtrip


def _compacted(spark, log, parts):
    """Batches landed in turn, folded after the third and the last, vacuumed; then the second, long folded, runs again."""
    for i, d in enumerate(parts):
        wr.write_batch(d, log.path, i)
        if i in (2, len(parts) - 1):
            log.compact(spark)
            log.vacuum(spark)
    wr.write_batch(parts[1], log.path, 1)
    return log


def q_compacted_upsert(spark, sf):
    """K2: five landed batches of revised readings, folded into dated generations
    in two runs; the newest batch's row of each (series, time)."""
    r = st.readings(spark, sf)
    seq, late = F.col("seq"), F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp")
    given = [F.col("timestamp") < F.lit("2024-01-20").cast("timestamp"), late, seq % 17 == 0, seq % 5 == 1, seq % 3 == 0]
    parts = [r.filter(c).withColumn("glucose_mg_dl", F.col("glucose_mg_dl") + F.lit(float(i))) for i, c in enumerate(given)]
    log = AppendLog(_scratch(spark, "readings-log"), key_cols=(*S, "timestamp"), order_cols=("batch", "seq"), series_cols=S)
    return finish(_compacted(spark, log, parts).view(spark).drop("date", "seq"))


def q_compacted_alerts(spark, sf):
    """K4: the alerts of ``alerts_retained`` landed in four batches; the log itself keeps the newest 10 of each series."""
    f = st.forecast_rows(spark, sf)
    a = al.detect(f, keep_cols=["user_id", "event_id", "current_timestamp"], now="now", thresholds={"low_mg_dl": 80.0})
    a = a.withColumn("timestamp", F.date_trunc("day", "current_timestamp"))
    log = AppendLog(_scratch(spark, "alerts-log"), keep=10, order_cols=("timestamp", "event_id", "alert_ix"), series_cols=S)
    parts = [a.filter(F.pmod("event_id", F.lit(4)) == i) for i in range(4)]
    return finish(_compacted(spark, log, parts).view(spark).select(*S, "event_id", "alert_ix", "type"))


QUERIES |= {"compacted_upsert": q_compacted_upsert, "compacted_alerts": q_compacted_alerts}


# ============================================================ five-minute quality, stored and live forms
ACTIVITY_COLS = ["bolus_units", "iob_units", "is_suspended", "control_iq_active"]
MARKER_COLS = ["bolus_units", "is_suspended"]


def q_profile_nulls_5m(spark, sf):
    """Null profile of the five-minute timeline."""
    return finish(qa.profile(timeline(spark, sf).drop("user_id")))


def q_activity_summary_5m(spark, sf):
    """A9 per series over the five-minute timeline."""
    return finish(qa.activity_summary(timeline(spark, sf, columns=ACTIVITY_COLS), series_cols=S))


def q_event_markers_5m(spark, sf):
    """Five-minute bins with a bolus or a suspension."""
    return finish(qa.event_markers(timeline(spark, sf, columns=MARKER_COLS)).select(*S, "timestamp", *MARKER_COLS))


def q_treatments_quarantine(spark, sf):
    """K5: treatments with bad kinds, negative or missing carbs and missing times;
    the valid ones come back from the table they were appended to."""
    t, n = st.manual_treatments(spark, sf), F.col("seq")
    t = t.withColumns({"timestamp": F.when(n % 11 != 0, F.col("timestamp")),
                       "kind": F.when(n % 5 == 0, "walk").when(n % 13 != 0, F.col("kind")),
                       "carbs_g": F.when(n % 7 == 0, -F.col("carbs_g")).when(n % 3 != 0, F.col("carbs_g"))})
    path = _scratch(spark, "treatments")
    bad = wr.append_treatments(t, path, now=F.lit("2024-02-01").cast("timestamp"))
    both = spark.read.parquet(path).unionByName(bad, allowMissingColumns=True)
    return finish(both.select(*S, "timestamp", "kind", "carbs_g", "reason", F.col("reason").isNull().alias("stored")))


def q_stored_window(spark, sf):
    """Readings stored as FLOAT, read back under their declared schema
    beside a table that isn't there, the ten days before 20 January."""
    from datetime import datetime

    path = _scratch(spark, "readings-float")
    small = wr.to_storage_types(st.readings(spark, sf))
    small.write.parquet(path)
    both = rd.read_parquet_or_empty(spark, path, small.schema).unionByName(
        rd.read_parquet_or_empty(spark, f"{path}-absent", small.schema))
    return finish(rd.in_window(both, *rd.window_bounds(end=datetime(2024, 1, 20), default_days=10)))


def q_summary_lines(spark, sf):
    """A text line for the newest forecast of each series, with its alerts."""
    f = clean.keep_last(st.forecast_rows(spark, sf), S, ["current_timestamp", "event_id"])
    a = al.detect(f, keep_cols=S, now="now")
    none = al.alerts_frame(spark, S).withColumns({"user_id": F.col("user_id").cast("long"), "alert_ix": F.lit(None).cast("long")})
    a = a.unionByName(none.select(*a.columns))
    return al.summary_line(f.withColumn("as_of", F.col("current_timestamp")), a, S)


def q_stream_stale_series(spark, sf):
    """The readings streamed past a timer for each series; the series that
    stopped more than 15 minutes before the newest reading of all."""
    from ..streaming import staleness

    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema) \
        .option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = raw.filter(F.col("event_type") == "view").select("user_id", F.col("ts").cast("timestamp").alias("timestamp"))
    out = _scratch(spark, "stale")
    alerts = staleness.watch(stream, series_cols=S, event_time=True)
    q = alerts.writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option(
        "checkpointLocation", _scratch(spark, "stale-log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(*S, "type", "severity", "message")


def q_model_reload_check(spark, sf):
    """M4: the saved and reloaded pipeline keeps the feature order and predicts every row alike."""
    model, cols, _ = fitted_model(spark, sf)
    path = _scratch(spark, "model")
    md.save(model, path)
    again = md.load(path)
    x = model.transform(model_features(spark, sf)).withColumnRenamed("prediction", "_before").drop(
        "features", *[f"_f_{c}" for c in cols])
    y = again.transform(x)
    return finish(y.groupBy(*S).agg(F.count("*").alias("n_rows"), F.count_if(F.col("prediction") == F.col("_before")).alias("n_same"),
                                    F.first(F.lit(md.model_feature_cols(again) == cols)).alias("same_features")))


QUERIES |= {"profile_nulls_5m": q_profile_nulls_5m, "activity_summary_5m": q_activity_summary_5m,
            "event_markers_5m": q_event_markers_5m, "treatments_quarantine": q_treatments_quarantine,
            "stored_window": q_stored_window, "summary_lines": q_summary_lines,
            "stream_stale_series": q_stream_stale_series, "model_reload_check": q_model_reload_check}
