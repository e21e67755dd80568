"""A batch's feature rows are written by the tasks that lay them out, and the live view joins them to pieces of stretches."""
import os
import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators.features import timeline_features
from tideline.session import checkpoint_dir
from tideline.streaming import refresh as rf

from .test_dense import inputs, rows, same
from .test_refresh_view import landed, values

T0 = datetime(2026, 4, 21)


def scratch(spark, name):
    path = os.path.join(checkpoint_dir(spark), "tests", f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def test_tasks_write_the_rows_that_they_lay_out(spark):
    """The same rows, blocks cut by Arrow batches too; only a row a block comes out."""
    given = inputs(spark)
    settled = given[0].select("series_id", F.lit(T0 + timedelta(days=1)).alias("since"), F.lit(T0 + timedelta(days=2)).alias("upto")).distinct()
    plain = timeline_features(*given, settled=settled)
    want, conf = rows(plain), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    for n in (before, 7):
        folder = scratch(spark, "written")
        open(os.path.join(folder, ".part-000000.parquet-9"), "w").close()  # of an attempt that died
        try:
            spark.conf.set(conf, n)
            out = timeline_features(*given, settled=settled, folder=folder)
            assert out.columns == ["series_id", "_start", "_end"]
            got = {r["series_id"]: (r[1], r[2]) for r in out.groupBy("series_id").agg(F.min("_start"), F.max("_end")).collect()}
        finally:
            spark.conf.set(conf, before)
        file = spark.read.parquet(folder)
        assert file.dtypes == plain.dtypes
        same(rows(file), want, plain.columns)
        assert got == {r["series_id"]: (r[1], r[2]) for r in plain.filter("settled").groupBy("series_id").agg(F.min("timestamp"), F.max("timestamp")).collect()}


def test_pieces_of_stretches(spark):
    """Every minute belongs to the newest batch whose stretch covers it."""
    rng = random.Random(7)
    of = []
    for batch in range(9):
        for s in "abc":
            a, n = rng.randrange(60), rng.randrange(30)
            of.append((s, batch, T0 + timedelta(minutes=a), T0 + timedelta(minutes=a + n)))
    edges = spark.createDataFrame(of, "series_id string, batch int, _start timestamp, _end timestamp")
    pieces = rf._newest_stretches(edges, ["series_id"]).collect()
    for s in "abc":
        for m in range(100):
            at = T0 + timedelta(minutes=m)
            want = [b for k, b, x, y in of if k == s and x <= at <= y]
            got = [p["_newest"] for p in pieces if p["_of_series_id"] == s and p["_from"] <= at < p["_to"]]
            assert got == ([max(want)] if want else [])


def test_rows_come_by_generated_joins_and_leave_nothing_behind(spark):
    """No row carries its series' stretches, no interpreted filter; half a batch that died is cleared."""
    cycle = rf.RefreshCycle(scratch(spark, "cycle"))
    os.makedirs(cycle._path("features/_writing/died"))
    cycle(landed(spark, range(0, 1440, 5)), 0)
    cycle(landed(spark, range(600, 660, 5), add=5.0), 1)
    assert not os.path.exists(cycle._path("features/_writing/died"))
    assert all(f.endswith(".parquet") for f in os.listdir(cycle._path("features/batch=0")) if not f.startswith("."))
    out = cycle.features(spark)
    assert "exists(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = values(out)
    assert len(got) == out.count() == 288
    assert all(got[T0 + timedelta(minutes=m)] == 100.0 + m % 50 + (5.0 if 600 <= m < 660 else 0.0) for m in range(0, 1440, 5))


def test_inputs_of_a_rebuild_are_computed_once(spark, monkeypatch):
    """The layout reads readings and pump events several times: it finds them joined and ranked."""
    seen = []
    keep = rf.timeline_features
    monkeypatch.setattr(rf, "timeline_features", lambda *a, **k: (seen.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in a[:2]), keep(*a, **k))[1])
    pump = spark.createDataFrame([("a", T0 + timedelta(minutes=7 * m), ["bolus", "basal"][m % 2], 1.0, 0.0, None, 10.0, m) for m in range(40)],
                                 "series_id string, timestamp timestamp, event_type string, value double, duration_minutes double, "
                                 "iob_units double, carbs_g double, seq long")
    cycle = rf.RefreshCycle(scratch(spark, "cycle"))
    cycle(rf.feeds(landed(spark, range(0, 300, 5)), pump), 0)
    assert len(seen) == 2 and not any(node in plan for plan in seen for node in ("Join", "Window", "Union"))
    assert cycle.features(spark).count() == 60
