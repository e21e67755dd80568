"""Timeline operators on hand-built frames."""
import math
from datetime import datetime, timedelta

import pytest


from tideline.operators.timeline import gapless_grid, unified_timeline

T0 = datetime(2026, 4, 21, 7, 0, 0)


def ts(minutes, seconds=0):
    return T0 + timedelta(minutes=minutes, seconds=seconds)


def readings(spark, rows):
    return spark.createDataFrame(
        [("a", ts(m, s), g, None, i) for i, (m, s, g) in enumerate(rows)],
        "series_id string, timestamp timestamp, glucose_mg_dl double, trend_arrow_encoded double, seq long")


def pump(spark, rows):
    return spark.createDataFrame(
        [("a", ts(m, s), et, v, d, iob, None, i) for i, (m, s, et, v, d, iob) in enumerate(rows)],
        "series_id string, timestamp timestamp, event_type string, value double, duration_minutes double, "
        "iob_units double, carbs_g double, seq long")


def tl_dict(df):
    return {r["timestamp"]: r.asDict() for r in df.collect()}


def test_grid_is_gapless_floor_to_ceil(spark):
    r = readings(spark, [(2, 0, 100.0), (31, 10, 120.0)])
    g = gapless_grid(r, None).orderBy("timestamp").collect()
    times = [x["timestamp"] for x in g]
    assert times[0] == ts(0) and times[-1] == ts(35)
    assert all((b - a) == timedelta(minutes=5) for a, b in zip(times, times[1:]))


def test_bin_mean_and_gaps_stay_null(spark):
    r = readings(spark, [(0, 0, 100.0), (3, 0, 110.0), (12, 0, 130.0)])
    out = tl_dict(unified_timeline(r))
    assert out[ts(0)]["glucose_mg_dl"] == pytest.approx(105.0)
    assert out[ts(5)]["glucose_mg_dl"] is None
    assert out[ts(10)]["glucose_mg_dl"] == 130.0
    assert out[ts(5)]["carbs_g"] == 0.0 and out[ts(5)]["is_suspended"] is False


def test_asof_basal_null_latest_and_ties(spark):
    r = readings(spark, [(0, 0, 100.0), (40, 0, 100.0)])
    p = pump(spark, [(2, 0, "basal", 1.0, 5.0, None),
                     (12, 0, "basal", 2.0, 5.0, None),
                     (12, 0, "basal", 3.0, 5.0, None),      # same time, later seq wins
                     (22, 0, "basal", None, 5.0, None)])    # NULL newest sample -> NULL
    out = tl_dict(unified_timeline(r, p))
    assert out[ts(0)]["basal_rate"] is None                  # before first sample
    assert out[ts(5)]["basal_rate"] == 1.0                   # sample at 07:02 visible at 07:05
    assert out[ts(15)]["basal_rate"] == 3.0
    assert out[ts(25)]["basal_rate"] is None
    assert out[ts(40)]["basal_rate"] is None


def test_interval_flags_durations(spark):
    r = readings(spark, [(0, 0, 100.0), (60, 0, 100.0)])
    p = pump(spark, [(10, 0, "suspend", 0.0, 0.0, None),     # 0 -> 5 min: [07:10, 07:15)
                     (20, 0, "suspend", 0.0, None, None),    # NULL -> 5 min
                     (31, 0, "suspend", 0.0, 2.0, None),     # [07:31, 07:33): no grid point
                     (40, 0, "suspend", 0.0, 12.0, None),    # [07:40, 07:52)
                     (45, 0, "suspend", 0.0, 10.0, None),    # overlap
                     (50, 0, "control_iq_action", 0.0, None, None)])
    out = tl_dict(unified_timeline(r, p))
    susp = sorted(k for k, v in out.items() if v["is_suspended"])
    assert susp == [ts(10), ts(20), ts(40), ts(45), ts(50)]
    assert [k for k, v in out.items() if v["control_iq_active"]] == [ts(50)]


def test_decay_projection_when_no_reported_iob(spark):
    r = readings(spark, [(0, 0, 100.0), (60, 0, 100.0)])
    p = pump(spark, [(33, 40, "bolus", 2.0, 0.0, None),      # floor minute 07:33
                     (34, 0, "bolus", None, 0.0, None),       # NULL dose counts 0
                     (36, 0, "bolus", 0.0, 0.0, None)])
    out = tl_dict(unified_timeline(r, p))
    assert out[ts(30)]["iob_units"] == 0.0                    # before the bolus
    assert out[ts(35)]["iob_units"] == pytest.approx(2.0 * math.exp(-2 / 240))
    assert out[ts(60)]["iob_units"] == pytest.approx(2.0 * math.exp(-27 / 240))
    # bolus units are floor binned: two boluses in the 07:30 bin
    assert out[ts(30)]["bolus_units"] == 2.0
    assert out[ts(35)]["bolus_units"] == 0.0


def test_reported_iob_forward_filled(spark):
    r = readings(spark, [(0, 0, 100.0), (30, 0, 100.0)])
    p = pump(spark, [(6, 0, "bolus", 1.0, 0.0, 3.0), (7, 0, "bolus", 1.0, 0.0, 2.5),
                     (16, 0, "bolus", 1.0, 0.0, None)])
    out = tl_dict(unified_timeline(r, p))
    assert out[ts(0)]["iob_units"] == 0.0
    assert out[ts(5)]["iob_units"] == 3.0                     # max in bin
    assert out[ts(25)]["iob_units"] == 3.0                    # filled without limit


def test_carbs_outside_grid_dropped_and_summed(spark):
    r = readings(spark, [(0, 0, 100.0), (20, 0, 100.0)])
    t = spark.createDataFrame([("a", ts(6), 10.0, 0), ("a", ts(8), 5.0, 1), ("a", ts(90), 50.0, 2)],
                              "series_id string, timestamp timestamp, carbs_g double, seq long")
    out = tl_dict(unified_timeline(r, None, t))
    assert out[ts(5)]["carbs_g"] == 15.0
    assert sum(v["carbs_g"] for v in out.values()) == 15.0


def test_blocks_do_not_change_results(spark):
    """Same answer for any block length: hot series are split safely."""
    rows = [(m, 0, 100.0 + m) for m in range(0, 600, 7)]
    r = readings(spark, rows)
    p = pump(spark, [(m, 0, "basal", float(m), 5.0, None) for m in range(3, 600, 97)]
             + [(m, 0, "bolus", 1.0, 0.0, None) for m in range(11, 600, 130)]
             + [(m, 0, "suspend", 0.0, 33.0, None) for m in range(50, 600, 151)])
    a = unified_timeline(r, p, block_minutes=60).orderBy("timestamp").collect()
    b = unified_timeline(r, p, block_minutes=1440).orderBy("timestamp").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for k in x.asDict():
            if isinstance(x[k], float):
                assert x[k] == pytest.approx(y[k])
            else:
                assert x[k] == y[k]


def test_series_are_independent(spark):
    r = spark.createDataFrame([("a", ts(0), 100.0, None, 0), ("b", ts(500), 90.0, None, 1)],
                              "series_id string, timestamp timestamp, glucose_mg_dl double, "
                              "trend_arrow_encoded double, seq long")
    out = unified_timeline(r).groupBy("series_id").count().collect()
    assert {x["series_id"]: x["count"] for x in out} == {"a": 1, "b": 1}


def test_fills_cross_blocks_without_events(spark):
    """Basal (a NULL newest sample included) and reported IOB reach blocks days after
    the last event; of several reports in one bin the largest is carried."""
    day = 1440
    r = readings(spark, [(0, 0, 100.0), (9 * day, 0, 110.0)])
    p = pump(spark, [(10, 0, "basal", 0.8, 5.0, None), (2 * day, 0, "basal", None, 5.0, None),
                     (day + 1, 0, "bolus", 1.0, 0.0, 3.5), (day + 2, 0, "bolus", 1.0, 0.0, 2.0),
                     (6 * day, 0, "basal", 1.1, 5.0, None), (3 * day, 0, "suspend", 0.0, 20.0, None)])
    for block in (120, 1440, 4320):
        out = tl_dict(unified_timeline(r, p, block_minutes=block))
        assert len(out) == 9 * day // 5 + 1
        assert [out[ts(m)]["basal_rate"] for m in (5, 10, 2 * day - 5, 2 * day, 5 * day, 6 * day, 9 * day)] == [
            None, 0.8, 0.8, None, None, 1.1, 1.1]
        assert [out[ts(m)]["iob_units"] for m in (0, day - 5, day, 4 * day, 9 * day)] == [0.0, 0.0, 3.5, 3.5, 3.5]


def test_dense_rows_are_joined_to_nothing(spark, tmp_path):
    """The grid has one exchange and no join; each of the inputs is scanned for its
    own aggregates only (readings 2, pump 3, treatments 1)."""
    r = readings(spark, [(0, 0, 100.0), (600, 0, 110.0)])
    p = pump(spark, [(10, 0, "basal", 0.8, 5.0, None), (20, 0, "bolus", 1.0, 0.0, None)])
    t = r.selectExpr("series_id", "timestamp", "glucose_mg_dl AS carbs_g")
    ins = []
    for name, df in (("r", r), ("p", p), ("t", t)):
        df.write.parquet(str(tmp_path / name))
        ins.append(spark.read.parquet(str(tmp_path / name)))
    plan = unified_timeline(*ins)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan parquet") == 6
