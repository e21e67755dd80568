"""Streaming (X1-X3) and quality helpers."""
import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators import quality as qa
from tideline.streaming import refresh as rf

T0 = datetime(2026, 4, 21)


def test_stream_equals_batch_over_several_files(spark):
    src = tempfile.mkdtemp(prefix="tl-src-")
    rows = [("a" if i % 3 else "b", T0 + timedelta(minutes=2 * i), float(i), None) for i in range(300)]
    schema = "series_id string, timestamp timestamp, glucose_mg_dl double, trend_arrow_encoded double"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.filter(F.pmod(F.hour("timestamp"), F.lit(3)) == k).write.mode("overwrite").parquet(os.path.join(src, f"f{k}"))
    store = tempfile.mkdtemp(prefix="tl-store-")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True) \
        .parquet(src)
    q = rf.stream_bin_means(spark, stream, os.path.join(store, "bins"), name=os.path.basename(store))
    q.awaitTermination()
    got = {(r["series_id"], r["timestamp"]): r["glucose_mg_dl"] for r in rf.latest_bins(spark, os.path.join(store, "bins")).collect()}
    want = {(r["series_id"], r["timestamp"]): r["glucose_mg_dl"] for r in rf.batch_bin_means(df).collect()}
    assert got == want


def test_refresh_cycle_tail_and_idempotent_upsert(spark):
    store = tempfile.mkdtemp(prefix="tl-refresh-")
    cyc = rf.RefreshCycle(store=store)
    schema = "series_id string, timestamp timestamp, glucose_mg_dl double, trend_arrow_encoded double, seq long"
    b1 = spark.createDataFrame([("a", T0 + timedelta(minutes=5 * i), 100.0 + i, None, i) for i in range(50)], schema)
    b2 = spark.createDataFrame([("a", T0 + timedelta(minutes=5 * i), 200.0 + i, None, i) for i in range(45, 60)], schema)
    cyc(b1, 0)
    cyc(b2, 1)
    cyc(b2, 1)                                  # replayed batch: same latest view
    r = {x["timestamp"]: x["glucose_mg_dl"] for x in cyc.readings(spark).collect()}
    assert len(r) == 60 and r[T0 + timedelta(minutes=5 * 45)] == 245.0 and r[T0] == 100.0


def test_gaps_regularity_decimate_topk(spark):
    rows = [("a", T0 + timedelta(minutes=m), 100.0) for m in (0, 5, 10, 60, 65, 200)]
    df = spark.createDataFrame(rows, "series_id string, timestamp timestamp, glucose_mg_dl double")
    gaps = [(g["gap_start"], g["duration_minutes"]) for g in qa.find_gaps(df, block_minutes=30).orderBy("gap_start").collect()]
    assert gaps == [(T0 + timedelta(minutes=10), 50.0), (T0 + timedelta(minutes=65), 135.0)]
    reg = qa.grid_regularity(df, block_minutes=30).first()
    assert reg["n_rows"] == 6 and reg["max_step_minutes"] == 135.0 and reg["is_regular"] is False
    # 6 rows, n=2 -> stride 3 -> positions 0 and 3
    assert [r["timestamp"] for r in qa.decimate(df, 2).orderBy("timestamp").collect()] == \
        [T0, T0 + timedelta(minutes=60)]
    assert qa.top_per_series(df, 2).count() == 2
    assert qa.top_recent(df, 1).first()["timestamp"] == T0 + timedelta(minutes=200)


def test_time_in_range_and_profile(spark):
    df = spark.createDataFrame([("a", T0, 60.0), ("a", T0, 100.0), ("a", T0, 200.0), ("a", T0, None), ("b", T0, None)],
                               "series_id string, timestamp timestamp, glucose_mg_dl double")
    t = {r["series_id"]: r for r in qa.time_in_range(df).collect()}
    assert round(t["a"]["low_pct"], 6) == round(100 / 3, 6) and t["a"]["n_readings"] == 3
    assert t["b"]["low_pct"] == 0.0 and t["b"]["n_readings"] == 0
    prof = {r["column_name"]: r for r in qa.profile(df).collect()}
    assert prof["glucose_mg_dl"]["null_count"] == 2 and prof["series_id"]["n_rows"] == 5


def test_landed_folders_of_several_files_are_one_batch_each(spark, monkeypatch):
    import glob

    from tideline.plans import catalog

    base, batches = tempfile.mkdtemp(prefix="tl-landed-"), []
    readings = catalog.st.readings
    monkeypatch.setattr(catalog, "_scratch", lambda *_: base)
    monkeypatch.setattr(catalog.st, "readings", lambda *a: readings(*a).repartition(4, "seq"))
    monkeypatch.setattr(catalog, "_as_batch", lambda cycle, i: lambda df, number: batches.append((i, number, df.count())))
    catalog.refreshed(spark, "/root/testdata/sf0.001", replay=False)
    landed = [glob.glob(f"{base}/readings/lands={i}/part-*.parquet") for i in range(3)]
    assert all(len(files) > 1 for files in landed)
    rows = [sum(spark.read.parquet(f"{base}/{feed}/lands={i}").count() for feed in ("readings", "pump", "treatments")) for i in range(3)]
    assert batches == [(i, 0, rows[i]) for i in range(3)]
