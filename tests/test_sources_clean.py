"""Sources, parsing and cleaning."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalar as fx
from tideline.operators import clean
from tideline.sources import readers as rd

CSV = """Index,Timestamp (YYYY-MM-DDThh:mm:ss),Event Type,Event Subtype,Patient Info,Device Info,Source Device ID,Glucose Value (mg/dL),Insulin Value (u),Carb Value (grams),Duration (hh:mm:ss),Glucose Rate of Change (mg/dL/min),Transmitter Time (Long Integer),Transmitter ID
1,,,,Jo,,,,,,,,,
2,,Device,,,G7,,,,,,,,
3,2026-04-21T00:00:00,EGV,,,,G7,132,,,,0.5,,ABC123
4,2026-04-21T00:05:00,EGV,,,,G7,Low,,,,1.5,,ABC123
5,2026-04-21T00:10:00,egv,,,,G7,High,,,,2.5,,ABC123
6,2026-04-21T00:10:00,EGV,,,,G7,150,,,,-3,,ABC123
7,not-a-time,EGV,,,,G7,140,,,,,,ABC123
8,2026-04-21T00:20:00+02:00,EGV,,,,G7,141,,,,,,ABC123
9,2026-04-21T00:25:00,EGV,,,,G7,abc,,,,,,ABC123
10,2026-04-21T00:30:00,Calibration,,,,G7,99,,,,,,ABC123
"""


def test_export_csv_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="tl-csv-")
    p = os.path.join(d, "export.csv")
    with open(p, "w") as f:
        f.write(CSV)
    raw = rd.read_export_csv(spark, p)
    assert "glucose_value_mg_dl" in raw.columns and raw.count() == 9      # row without event type dropped
    out = rd.clean_readings(raw, seq_col="index").orderBy("timestamp").collect()
    got = [(r["timestamp"].strftime("%H:%M"), r["glucose_mg_dl"], r["trend_arrow_encoded"]) for r in out]
    # 00:10 duplicate: the later row (150, -3 -> -2) wins; 00:20+02:00 -> 22:20 previous day
    assert got == [("22:20", 141.0, None), ("00:00", 132.0, 0.0), ("00:05", 39.0, 2.0), ("00:10", 150.0, -2.0)]


@pytest.mark.parametrize("text,want", [("Low", 39.0), (" high ", 401.0), ("", None), ("nan", None),
                                       ("None", None), ("12.5", 12.5), ("abc", None), (None, None)])
def test_parse_reading(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(fx.parse_reading("x")).first()[0] == want


@pytest.mark.parametrize("text,want", [("None", 0.0), ("none", None), ("NONE", None), ("Flat", 0.0),
                                       ("Forty Five Up", 1.0), ("DoubleDown", -2.0), ("sideways", None),
                                       ("", None), (None, None)])
def test_encode_trend(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(fx.encode_trend("x")).first()[0] == want


@pytest.mark.parametrize("text,want", [("0.5", 0.0), ("1.5", 2.0), ("2.5", 2.0), ("-3", -2.0), ("x", None)])
def test_rate_to_trend_half_even_and_clip(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(fx.rate_to_trend("x")).first()[0] == want


def test_fmt_g_and_fmt_0f(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (30.0,), (2.5,), (-0.4,), (1234567.0,)], "x double")
    got = df.select(fx.fmt_g("x"), fx.fmt_0f("x")).collect()
    assert [r[0] for r in got] == ["0.5", "1", "30", "2.5", "-0.4", "1.23457e+06"]
    assert [r[1] for r in got] == ["0", "1", "30", "2", "-0", "1234567"]


def test_pump_feed_first_truthy(spark):
    bolus = spark.createDataFrame(
        [("2026-04-21T07:33:40", None, 0.0, 3.0, 600.0, None, 0.0, 0.0, 45.0, 0.0)],
        "eventDateTime string, requestDateTime string, insulinDelivered double, requestedInsulin double, "
        "duration double, iob double, carbsRequest double, carbsAmount double, carbs double, carbAmount double")
    basal = spark.createDataFrame([("2026-04-21T07:00:00Z", 0.8, 0.0)],
                                  "eventDateTime string, basalRate double, duration double")
    event = spark.createDataFrame([("2026-04-21T08:00:00", "pumpingResumed", None, 30.0),
                                   ("2026-04-21T09:00:00", "PumpingSuspended", 1.0, None)],
                                  "eventDateTime string, eventType string, value double, duration double")
    out = {r["event_type"] + str(r["timestamp"].hour): r for r in rd.pump_feed(bolus, basal, event).collect()}
    b = out["bolus7"]
    assert b["value"] == 3.0 and b["duration_minutes"] == 10.0 and b["carbs_g"] == 45.0 and b["iob_units"] is None
    assert out["basal7"]["duration_minutes"] == 5.0
    assert out["control_iq_action8"]["duration_minutes"] == 30.0      # resume is an action, not a suspend
    assert out["suspend9"]["value"] == 1.0


def test_keep_last_keep_first_union_upsert(spark):
    old = spark.createDataFrame([("a", 1, 10.0, 0), ("a", 2, 20.0, 1)], "s string, t int, v double, seq long")
    new = spark.createDataFrame([("a", 2, 21.0, 0), ("a", 3, 30.0, 1)], "s string, t int, v double, seq long")
    up = {r["t"]: r["v"] for r in clean.upsert_latest(old, new, ["s", "t"]).collect()}
    assert up == {1: 10.0, 2: 21.0, 3: 30.0}
    again = {r["t"]: r["v"] for r in clean.upsert_latest(clean.upsert_latest(old, new, ["s", "t"]), new,
                                                         ["s", "t"]).collect()}
    assert again == up                                                # idempotent
    df = spark.createDataFrame([("a", 1, "x", 2), ("a", 1, "y", 1)], "s string, t int, note string, seq long")
    assert clean.keep_first(df, ["s", "t"], ["seq"]).first()["note"] == "y"
    assert clean.keep_last(df, ["s", "t"], ["seq"]).first()["note"] == "x"


def test_treatments_derive_union_validate(spark):
    pump = spark.createDataFrame([("a", "2026-04-21 07:00:00", "bolus", 0.0), ("a", "2026-04-21 08:00:00", "bolus", None),
                                  ("a", "2026-04-21 09:00:00", "basal", 20.0), ("a", "2026-04-21 10:00:00", "bolus", 30.0)],
                                 "series_id string, timestamp string, event_type string, carbs_g double") \
        .withColumn("timestamp", F.to_timestamp("timestamp"))
    d = clean.derive_treatments(pump, seq_col=None)
    assert [r["carbs_g"] for r in d.collect()] == [30.0]
    manual = d.withColumn("source", F.lit("manual")).withColumn("notes", F.lit("juice"))
    u = clean.union_treatments(d, manual, d)
    assert u.count() == 2                                           # exact duplicate from d dropped
    ok, bad = clean.validate_treatments(
        u.unionByName(u.limit(1).withColumn("kind", F.lit("lunch"))).drop("seq"))
    assert ok.count() == 2 and [r["reason"] for r in bad.collect()] == ["bad_kind"]
