"""Rule engine (R1-R5), drift (J7, A13, W14, C4), metrics."""
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import alerts as al
from tideline.operators import drift as dr
from tideline.operators import metrics as mt

NOW = datetime(2026, 4, 21, 12, 0, 0)


def rows(spark, data):
    return spark.createDataFrame(
        [("s", i, NOW - timedelta(minutes=age), cur, pred) for i, (cur, age, pred) in enumerate(data)],
        "series_id string, id long, current_timestamp timestamp, current_glucose double, prediction_30m double")


def detect(spark, data, **kw):
    df = al.detect(rows(spark, data), keep_cols=["id"], now=F.lit(NOW).cast("timestamp"), **kw)
    out = {}
    for r in df.orderBy("id", "alert_ix").collect():
        out.setdefault(r["id"], []).append(r)
    return out


def test_rule_groups_and_order(spark):
    out = detect(spark, [(39.0, 5, 30.0),     # low sentinel + predicted low (delta -9: no drop)
                         (401.0, 20, 300.0),  # high sentinel, stale, predicted high, drop -101
                         (120.0, 0, 185.0),   # rise 65
                         (120.0, 0, 120.0)])  # nothing
    assert [r["type"] for r in out[0]] == ["sensor_extreme", "predicted_low"]
    assert [r["type"] for r in out[1]] == ["sensor_extreme", "stale_data", "predicted_high", "predicted_drop"]
    assert [r["severity"] for r in out[1]] == ["critical", "warn", "warn", "warn"]
    assert [r["type"] for r in out[2]] == ["predicted_rise"]
    assert 3 not in out
    assert out[1][1]["message"] == "No CGM reading in 20 min — predictions are based on outdated data."
    assert out[0][0]["message"] == "Sensor reads LOW (≤39 mg/dL). Confirm with a fingerstick."
    assert out[1][3]["message"].startswith("Predicted drop of 101 mg/dL")
    d = json.loads(out[1][1]["detail"])
    assert d["age_minutes"] == 20.0 and d["last_seen"].endswith("+00:00")


def test_half_even_message_numbers_and_thresholds(spark):
    out = detect(spark, [(100.0, 0, 62.5)], thresholds={"low_mg_dl": 80})
    assert out[0][0]["message"] == "Predicted 62 mg/dL in 30 min (below 80). Consider pre-treating."


def test_null_forecast_raises_nothing(spark):
    df = spark.createDataFrame([("s", 0, NOW, 100.0, None)],
                               "series_id string, id long, current_timestamp timestamp, "
                               "current_glucose double, prediction_30m double")
    assert al.detect(df, keep_cols=["id"], now=F.lit(NOW).cast("timestamp")).count() == 0


def test_drift_join_metrics_and_status(spark):
    t0 = datetime(2026, 4, 20, 0, 0)
    log = spark.createDataFrame(
        [("s", t0 + timedelta(minutes=5 * i), t0 + timedelta(minutes=5 * i + 30), 100.0, 100.0 + i, i)
         for i in range(10)] + [("s", t0, t0 + timedelta(minutes=30), 100.0, 500.0, 99)],
        "series_id string, predicted_at timestamp, target_timestamp timestamp, current_glucose double, "
        "prediction_30m double, seq long")
    log = dr.dedupe_log(log)                              # last append wins for t0
    assert log.count() == 10
    truth = spark.createDataFrame([("s", t0 + timedelta(minutes=5 * i + 30), 100.0) for i in range(8)],
                                  "series_id string, timestamp timestamp, glucose_mg_dl double")
    sc = dr.join_with_actuals(log, truth)
    assert sc.filter("actual_30m IS NULL").count() == 2
    m = dr.trailing_metrics(sc, F.lit(t0 + timedelta(hours=2)).cast("timestamp")).first()
    assert m["n_scored"] == 8
    errs = [400.0] + list(range(1, 8))
    assert m["mae_all"] == pytest.approx(np.mean(errs))
    st = dr.drift_status(dr.trailing_metrics(sc, F.lit(t0 + timedelta(hours=2)).cast("timestamp")), 10.0).first()
    assert st["drift_ratio"] == pytest.approx(np.mean(errs) / 10.0)
    assert st["recommend_retrain"] is True and st["recommendation"].startswith("Live 24h MAE (")
    st0 = dr.drift_status(dr.trailing_metrics(sc, F.lit(t0).cast("timestamp")), None).first()
    assert st0["drift_ratio"] is None and st0["recommend_retrain"] is False
    assert st0["recommendation"] == "Scored 8 predictions. Need a trained model + more time to assess drift."


def test_rolling_mae_left_open_six_hours(spark):
    t0 = datetime(2026, 4, 20, 0, 0)
    sc = spark.createDataFrame([("s", t0, 1.0, 1.0), ("s", t0 + timedelta(hours=6), 3.0, 3.0),
                                ("s", t0 + timedelta(hours=6, seconds=1), 5.0, 5.0)],
                               "series_id string, target_timestamp timestamp, actual_30m double, abs_error double")
    got = {r["target_timestamp"]: r["rolling_mae"] for r in dr.rolling_mae(sc, block_minutes=360).collect()}
    assert got[t0 + timedelta(hours=6)] == 3.0            # t0 is exactly 6 h back: excluded
    assert got[t0 + timedelta(hours=6, seconds=1)] == 4.0


def test_regression_metrics_and_exact_median(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(100, 30, 3001)
    p = y + rng.normal(0, 15, 3001)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = mt.regression_metrics(df, y_col="y", pred_col="p").first()
    e = p - y
    assert m["n"] == 3001
    assert m["mae"] == pytest.approx(np.abs(e).mean())
    assert m["rmse"] == pytest.approx(np.sqrt((e ** 2).mean()))
    assert m["median_abs_err"] == pytest.approx(np.median(np.abs(e)))
    assert m["pct_within_20"] == pytest.approx((np.abs(e) <= 20).mean() * 100)
    lo = y < 70
    assert m["hypo_recall"] == pytest.approx((lo & (p < 80)).sum() / lo.sum())


def test_median_refinement_even_count(spark):
    vals = [float(x) for x in np.random.default_rng(1).integers(0, 50, 200_001)]
    df = spark.createDataFrame([(v,) for v in vals[:-1]], "x double")
    assert mt._kth_smallest(df, [0, 7], 0.0, 49.0, buckets=8) == {0: 0.0, 7: 0.0}
    assert mt.exact_median(df, "x") == pytest.approx(float(np.median(vals[:-1])))
