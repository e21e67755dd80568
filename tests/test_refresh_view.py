"""The live feature view: rows are compared with the stretches that later batches settled, not ranked by key."""
import os
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.session import checkpoint_dir
from tideline.streaming import refresh as rf

T0 = datetime(2026, 4, 21)
READINGS = "series_id string, timestamp timestamp, glucose_mg_dl double, trend_arrow_encoded double, seq long"


def landed(spark, minutes, add=0.0):
    return spark.createDataFrame([("a", T0 + timedelta(minutes=m), 100.0 + m % 50 + add, 0.0, m) for m in minutes], READINGS)


def values(df):
    return {r["timestamp"]: r["glucose_mg_dl"] for r in df.collect()}


def test_view_takes_the_last_stretch(spark):
    """Three batches, the last revising a day in the middle; no window, and no shuffle of the features."""
    cycle = rf.RefreshCycle(os.path.join(checkpoint_dir(spark), "tests", f"view-{uuid.uuid4().hex}"))
    cycle(landed(spark, range(0, 2880, 5)), 0)
    cycle(landed(spark, range(2880, 4320, 5)), 1)
    cycle(landed(spark, range(1440, 1500, 5), add=7.0), 2)
    out = cycle.features(spark)
    got = values(out)
    assert len(got) == out.count() == 4320 // 5
    for m in range(0, 4320, 5):
        assert got[T0 + timedelta(minutes=m)] == 100.0 + m % 50 + (7.0 if 1440 <= m < 1500 else 0.0)
    ranked = spark.read.parquet(cycle._path("features")).filter("settled").groupBy("timestamp").agg(F.max_by("glucose_mg_dl", "batch").alias("glucose_mg_dl"))
    assert values(ranked) == got
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_batch_that_did_not_end_changes_nothing(spark):
    """Rows whose batch died before its edges were written don't count, nor do they come twice."""
    cycle = rf.RefreshCycle(os.path.join(checkpoint_dir(spark), "tests", f"view-{uuid.uuid4().hex}"))
    cycle(landed(spark, range(0, 1440, 5)), 0)
    want = values(cycle.features(spark))
    half = spark.read.parquet(cycle._path("features/batch=0")).withColumn("glucose_mg_dl", F.lit(1.0))
    half.write.parquet(cycle._path("features/batch=1"))
    out = cycle.features(spark)
    assert values(out) == want and out.count() == len(want)


def test_settled_rows_are_told_apart_in_the_blocks(spark, monkeypatch):
    """A batch's rows are joined to no table of windows: they come settled out of their blocks."""
    seen = []
    keep = rf.write_batch
    monkeypatch.setattr(rf, "write_batch", lambda d, path, *a, **k: (seen.append(d._jdf.queryExecution().sparkPlan().toString()) if path.endswith("/features") else None,
                                                                    keep(d, path, *a, **k))[1])
    cycle = rf.RefreshCycle(os.path.join(checkpoint_dir(spark), "tests", f"view-{uuid.uuid4().hex}"))
    cycle(landed(spark, range(0, 720, 5)), 0)
    assert len(seen) == 1 and "Join" not in seen[0][:seen[0].index("MapInArrow")]
