"""Late pump events (X1), staleness timers (X4), streamed forecasts."""
import os
import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators import alerts as al
from tideline.operators import drift as dr
from tideline.operators.features import timeline_features
from tideline.operators.clean import derive_treatments, union_treatments
from tideline.session import checkpoint_dir
from tideline.streaming import forecasts as fc
from tideline.streaming import refresh as rf
from tideline.streaming import staleness

T0 = datetime(2026, 4, 21)
READINGS = "series_id string, timestamp timestamp, glucose_mg_dl double, trend_arrow_encoded double, seq long"
PUMP = "series_id string, timestamp timestamp, event_type string, value double, duration_minutes double, iob_units double, carbs_g double, seq long"
MANUAL = "series_id string, timestamp timestamp, kind string, carbs_g double, notes string, source string, seq long"


def scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "tests", f"{name}-{uuid.uuid4().hex}")


def same_features(spark, cycle, readings, pump, manual):
    carbs = union_treatments(derive_treatments(pump), manual)
    want = timeline_features(readings, pump, carbs)
    got = cycle.features(spark)
    cols = [c for c in want.columns if c not in ("series_id", "timestamp")]
    rounded = [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]
    a, b = (d.select("series_id", "timestamp", *rounded) for d in (got, want))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0, [a.exceptAll(b).orderBy("series_id", "timestamp").head(2), b.exceptAll(a).orderBy("series_id", "timestamp").head(2)]


def test_events_that_land_late_equal_one_batch(spark):
    """Five days of two series dealt to batches at random: every kind of pump
    event, carbs and readings come late, some alone; one batch runs twice."""
    rng = random.Random(4)
    at = lambda: T0 + timedelta(seconds=rng.randrange(5 * 86_400))
    r = [(s, T0 + timedelta(minutes=5 * i + (s == "b")), 100.0 + i % 37, float(i % 5 - 2), i) for s in "ab" for i in range(0, 1440, 1 + 2 * (s == "b"))
         if not 300 < i < 700]  # a gap of more than a day
    p = [(rng.choice("ab"), at(), "bolus", rng.uniform(0, 5), 0.0, None, float(rng.choice([0, 20, 35])), k) for k in range(12)]
    p += [("a", at(), "bolus", 1.0, 0.0, rng.uniform(0, 4), None, 100 + k) for k in range(5)]
    p += [(rng.choice("ab"), at(), "basal", rng.uniform(0, 2), 5.0, None, None, 200 + k) for k in range(12)]
    p += [(rng.choice("ab"), at(), rng.choice(rf.INTERVALS), 0.0, float(rng.choice([0, 30, 600, 2000])), None, None, 300 + k) for k in range(8)]
    p += [("b", T0 - timedelta(days=1), "basal", 0.7, 5.0, None, None, 400), ("c", at(), "bolus", 2.0, 0.0, None, 10.0, 401)]
    m = [(rng.choice("ab"), at(), "snack", float(rng.choice([5, 15])), "", "manual", k) for k in range(8)]
    deal = lambda rows, late: [(x, rng.choice([1, 2, 3]) if rng.random() < late else 0 if x[1] < T0 + timedelta(days=3) else 1) for x in rows]
    dealt = {"readings": (deal(r, 0.05), READINGS), "pump": (deal(p, 0.6), PUMP), "treatments": (deal(m, 0.6), MANUAL)}
    dealt["readings"][0][:] = [(x, min(k, 2)) for x, k in dealt["readings"][0]]  # the last batch has no reading
    cycle = rf.RefreshCycle(scratch(spark, "late"))

    def batch(k):
        return rf.feeds(*[spark.createDataFrame([x for x, j in rows if j == k], schema) for rows, schema in dealt.values()])

    for k in (0, 1, 2, 3, 2):
        cycle(batch(k), k)
    same_features(spark, cycle, *[spark.createDataFrame([x for x, _ in rows], schema) for rows, schema in dealt.values()])
    windows = spark.read.parquet(os.path.join(cycle.store, "windows"))
    assert windows.filter("_upto is not null").count() > 0  # some intervals end inside their series


def test_rebuild_reads_only_dates_it_needs(spark):
    rows = [("a", T0 + timedelta(hours=i), 100.0, 0.0, i) for i in range(24 * 20)]
    cycle = rf.RefreshCycle(scratch(spark, "prune"))
    pump = [("a", T0 + timedelta(hours=3 * i), "basal", 1.0, 5.0, None, None, i) for i in range(160)]
    cycle(rf.feeds(spark.createDataFrame(rows, READINGS), spark.createDataFrame(pump, PUMP)), 0)
    day = (T0 + timedelta(days=18)).date()
    window = spark.createDataFrame([("a", T0, T0 + timedelta(days=19), None, T0 + timedelta(days=18), None)],
                                   "series_id string, _start timestamp, _settled timestamp, _hi timestamp, _since timestamp, _upto timestamp")
    plan = cycle._pump_in(spark, window, day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and str(day) in plan


def test_silent_series_is_judged_by_a_timer(spark):
    src = scratch(spark, "silent")
    a = [("a", T0 + timedelta(minutes=5 * i), 100.0, None, i) for i in range(30)]
    b = [("b", T0 + timedelta(minutes=5 * i), 120.0, None, i) for i in range(6)]
    steps = [[x for x in a + b if lo <= x[1] < lo + timedelta(minutes=30)] for lo in (T0 + timedelta(minutes=30 * k) for k in range(5))]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, READINGS).coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    out = scratch(spark, "stale")
    alerts = staleness.watch(stream, event_time=True)
    alerts.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option(
        "checkpointLocation", scratch(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    got = [r for r in spark.read.parquet(out).collect()]
    assert [(r.series_id, r.type, r.severity) for r in got] == [("b", "stale_data", "warn")]
    assert got[0].message.startswith("No CGM reading in ") and "2026-04-21" in got[0].detail


def test_streamed_forecasts_equal_the_batch_join(spark):
    log = [("a", T0 + timedelta(minutes=5 * i), T0 + timedelta(minutes=5 * i + 30), 100.0, 110.0 + i, i) for i in range(200)]
    truth = [("a", T0 + timedelta(minutes=5 * i), 105.0 + i % 9) for i in range(0, 190, 3)]
    log_schema = "series_id string, predicted_at timestamp, target_timestamp timestamp, current_glucose double, prediction_30m double, seq long"
    truth_schema = "series_id string, timestamp timestamp, glucose_mg_dl double"
    base = scratch(spark, "forecasts")
    for k in range(4):  # a forecast lands before its truth
        spark.createDataFrame(log[50 * k:50 * k + 50], log_schema).coalesce(1).write.parquet(f"{base}/log/{k}")
        spark.createDataFrame([x for x in truth if 50 * k <= (x[1] - T0).seconds // 300 + 288 * (x[1] - T0).days < 50 * k + 50], truth_schema).coalesce(1).write.parquet(f"{base}/truth/{k}")
    streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/{n}")
               for n, s in (("log", log_schema), ("truth", truth_schema))]
    fc.start_forecast_truth(spark, *streams, f"{base}/out", name=uuid.uuid4().hex, available_now=True).awaitTermination()
    whole = spark.createDataFrame(log, log_schema)
    want = dr.join_with_actuals(whole, spark.createDataFrame(truth, truth_schema))
    got = fc.forecast_truth_view(whole, f"{base}/out").select(*want.columns)
    assert got.count() == 200 and got.exceptAll(want).count() == 0
    done = spark.read.parquet(f"{base}/out")
    assert done.filter("actual_30m is null").count() > 50 and done.count() < 200  # given up in the stream, and still waiting


def test_thresholds_of_a_series(spark):
    rows = [("a", 100.0, T0, 75.0), ("b", 100.0, T0, 75.0), ("c", 100.0, T0, 75.0)]
    d = spark.createDataFrame(rows, "series_id string, current_glucose double, current_timestamp timestamp, prediction_30m double")
    table = spark.createDataFrame([("a", 80.9, None), ("b", None, 60.0)], "series_id string, low_mg_dl double, high_mg_dl double")
    got = {(r.series_id, r.type): r.message for r in al.detect(d, keep_cols=["series_id"], now=F.lit(T0), series_thresholds=table).collect()}
    assert set(got) == {("a", "predicted_low"), ("b", "predicted_high")}
    assert "below 80)" in got["a", "predicted_low"] and "above 60)" in got["b", "predicted_high"]
