"""Sinks and remaining sources: K1, K4-K7, P13, S4, S5, S7, A19."""
import os
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.operators import quality as qa
from tideline.schemas import READINGS
from tideline.sinks import writers as wr
from tideline.sources import readers as rd

T0 = datetime(2026, 4, 21, 12, 0)


def frame(spark, n=10, series="a"):
    return spark.createDataFrame([(series, T0 + timedelta(hours=6 * i), float(i)) for i in range(n)],
                                 "series_id string, timestamp timestamp, glucose_mg_dl double")


def test_parquet_dynamic_overwrite_touches_only_written_dates(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="tl-k1-"), "t")
    wr.write_parquet(frame(spark, 8), d)
    first = spark.read.parquet(d).count()
    wr.write_parquet(frame(spark, 1).withColumn("glucose_mg_dl", F.lit(99.0)), d)   # rewrites one date only
    back = spark.read.parquet(d)
    assert first == 8 and back.count() == 8 - 2 + 1                          # day 0 held 2 rows
    assert back.filter("glucose_mg_dl = 99").count() == 1


def test_retention_keeps_newest_n_per_series(spark):
    df = frame(spark, 30).unionByName(frame(spark, 5, "b"))
    kept = wr.retain_last(df, 7)
    got = {r["series_id"]: r["n"] for r in kept.groupBy("series_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 7, "b": 5}
    assert kept.filter("series_id = 'a'").agg(F.min("timestamp")).first()[0] == T0 + timedelta(hours=6 * 23)


def test_treatment_append_quarantine_csv_json_and_storage_types(spark):
    base = tempfile.mkdtemp(prefix="tl-k5-")
    tr = spark.createDataFrame([("a", T0, "meal", 20.0, "", "manual"), ("a", T0, "lunch", 5.0, "", "manual"),
                                ("a", T0, "snack", -1.0, "", "manual"), ("a", None, "meal", None, "", "manual")],
                               "series_id string, timestamp timestamp, kind string, carbs_g double, notes string, "
                               "source string")
    bad = wr.append_treatments(tr, os.path.join(base, "treatments"))
    kept = spark.read.parquet(os.path.join(base, "treatments")).orderBy("carbs_g").collect()
    assert [r["carbs_g"] for r in kept] == [0.0, 20.0] and kept[0]["timestamp"] is not None
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_kind", "negative_carbs"]
    wr.write_csv(frame(spark, 3), os.path.join(base, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(base, "csv")).count() == 3
    wr.write_json_row(spark.createDataFrame([(12.5, 40)], "mae double, n long"), os.path.join(base, "m"))
    assert spark.read.json(os.path.join(base, "m")).first()["mae"] == 12.5
    st = wr.to_storage_types(frame(spark, 2))
    assert dict(st.dtypes)["glucose_mg_dl"] == "float"


def test_parquet_or_empty_and_window_bounds(spark):
    empty = rd.read_parquet_or_empty(spark, "/nonexistent/tl-path", READINGS)
    assert empty.count() == 0 and empty.columns == READINGS.fieldNames()
    s, e = rd.window_bounds(end=datetime(2026, 4, 21))
    assert e.tzinfo == timezone.utc and (e - s) == timedelta(days=30)
    assert rd.in_window(frame(spark, 10), T0, T0 + timedelta(hours=12)).count() == 3


def test_sensor_feed_trend_map_lookback_and_cap(spark):
    rec = spark.createDataFrame(
        [("a", (T0 - timedelta(minutes=5 * i)).isoformat() + "Z", 100.0 + i, t)
         for i, t in enumerate([0, 1, 2, 3, 4, 5, 6, 7, None] * 40)],
        "series_id string, datetime string, value double, trend int")
    out = rd.sensor_feed(rec, series_cols=["series_id"], now=F.lit(T0).cast("timestamp"), minutes=60, max_count=10)
    rows = out.orderBy(F.desc("timestamp")).collect()
    assert len(rows) == 10                                   # 13 inside the hour, capped to the newest 10
    assert [r["trend_arrow_encoded"] for r in rows[:9]] == [None, 2.0, 2.0, 1.0, 0.0, -1.0, -2.0, -2.0, None]


def test_sensor_feed_keeps_all_by_default_and_reports_an_empty_feed(spark):
    rec = spark.createDataFrame([("a", (T0 + timedelta(minutes=5 * i)).isoformat() + "Z", 100.0, 4) for i in range(1000)],
                                "series_id string, datetime string, value double, trend int")
    assert rd.sensor_feed(rec, series_cols=["series_id"]).count() == 1000
    with pytest.raises(rd.EmptyFeedError):
        rd.sensor_feed(rec.limit(0), require=True)
    with pytest.raises(rd.EmptyFeedError):
        rd.pump_feed(basal=rec.limit(0), require=True)


def test_date_filter_prunes_folders(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="tl-p15-"), "t")
    wr.write_parquet(frame(spark, 8), d)
    x = qa.date_filter(spark.read.parquet(d), "2026-04-22", "2026-04-22")
    assert x.count() == 4 and "PartitionFilters: [isnotnull(date" in x._jdf.queryExecution().toString()


def test_retention_breaks_ties_by_alert_order(spark):
    df = spark.createDataFrame([("a", T0, b, i) for b in range(3) for i in range(4)], "series_id string, timestamp timestamp, batch int, alert_ix int")
    kept = wr.retain_last(df, 5, order_cols=["timestamp", "batch", "alert_ix"])
    assert {(r["batch"], r["alert_ix"]) for r in kept.collect()} == {(2, 0), (2, 1), (2, 2), (2, 3), (1, 3)}


def test_stage_counters_observation(spark):
    df, obs = qa.stage_counters(frame(spark, 6), name="clean",
                                extra={"low": F.count_if(F.col("glucose_mg_dl") < 2)})
    df.write.format("noop").mode("overwrite").save()
    got = obs.get
    assert got["rows"] == 6 and got["low"] == 2 and got["min_ts"] == T0
