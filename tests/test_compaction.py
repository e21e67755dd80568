"""Compaction of append logs (K2-K4): views before and after, replay, runs that die, vacuum, the live cycle."""
import os
import uuid
from datetime import datetime, timedelta

from tests.test_live import MANUAL, PUMP, READINGS, same_features
from tideline.session import checkpoint_dir
from tideline.sinks.compaction import AppendLog
from tideline.sinks.writers import write_batch
from tideline.streaming import refresh as rf

T0 = datetime(2026, 4, 21)
SCHEMA = "series_id string, timestamp timestamp, v double"
KEY = ("series_id", "timestamp")


def scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "tests", f"{name}-{uuid.uuid4().hex}")


def batch(spark, k, days, hot="a"):
    """24 rows a day of a hot series, 2 of another, valued by batch."""
    rows = [(hot, T0 + timedelta(days=d, hours=h), 100.0 * k + h) for d in days for h in range(24)]
    rows += [("b", T0 + timedelta(days=d, hours=12 * h), 100.0 * k) for d in days for h in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted((r["series_id"], str(r["timestamp"]), r["v"], r["batch"]) for r in df.collect())


def files(spark, log):
    return len(log.rows(spark).inputFiles())


def test_view_is_the_same_and_files_fall(spark):
    log = AppendLog(scratch(spark, "log"), key_cols=KEY)
    assert log.compact(spark) is None
    for k, days in enumerate([(0, 1, 2), (1,), (1, 2), (2, 3), (3,)]):
        write_batch(batch(spark, k, days).repartition(4), log.path, k)
    want, many = content(log.view(spark)), files(spark, log)
    assert log.compact(spark) == 3 and content(log.view(spark)) == want and files(spark, log) < many / 2
    assert log.compact(spark) is None                                # nothing new
    newest = spark.read.parquet(f"{log.path}-compacted/gen=3")
    assert newest.count() == 4 * 26 and len(newest.inputFiles()) == newest.select("date").distinct().count() == 4  # a file a day
    write_batch(batch(spark, 5, (3, 9)), log.path, 5)
    want = content(log.view(spark))
    assert log.compact(spark) == 4 and content(log.view(spark)) == want
    # only the date that batch 4 touched was written again
    assert {n for n in os.listdir(f"{log.path}-compacted/gen=4".replace("file:", "")) if n.startswith("date=")} == {"date=2026-04-24"}
    assert log.vacuum(spark) > 0 and content(log.view(spark)) == want
    assert log.batches(spark) == [4, 5] and log.vacuum(spark) == 0
    assert not os.path.exists(f"{log.path}-compacted/gen=3/date=2026-04-25".replace("file:", ""))


def test_replays_and_dead_runs_change_nothing(spark):
    log = AppendLog(scratch(spark, "log"), key_cols=KEY)
    for k in range(4):
        write_batch(batch(spark, k, (k, k + 1)), log.path, k)
    want = content(log.view(spark))
    # a run that dies after its rows, or while it writes the manifest
    write_batch(batch(spark, 7, (0,)), f"{log.path}-compacted/dead", 0)
    os.makedirs(f"{log.path}-compacted/gen=2/date=2026-04-21".replace("file:", ""))
    os.makedirs(f"{log.path}-compacted/manifest/through=2".replace("file:", ""))
    assert log.manifests(spark) == [] and content(log.view(spark)) == want
    assert log.compact(spark) == 2 and content(log.view(spark)) == want
    write_batch(batch(spark, 3, (3, 4)), log.path, 3)                 # the newest batch again
    write_batch(batch(spark, 1, (1, 2)), log.path, 1)                 # a folded one again
    assert content(log.view(spark)) == want
    before = log.view(spark)                                          # a reader that planned before ...
    write_batch(batch(spark, 4, (4,)), log.path, 4)
    assert log.compact(spark) == 3 and log.vacuum(spark) > 0
    assert content(before) == want                                    # ... can finish after the next run and its vacuum


def test_retention_and_empty_and_null_dates(spark):
    log = AppendLog(scratch(spark, "kept"), keep=5, order_cols=("timestamp", "batch"))
    for k in range(4):
        write_batch(batch(spark, k, (k, 3 - k)), log.path, k)
    want = content(log.view(spark))
    assert len(want) == 10
    assert log.compact(spark) == 2 and content(log.view(spark)) == want
    assert spark.read.parquet(f"{log.path}-compacted/gen=2").count() == 10
    log = AppendLog(scratch(spark, "null"), key_cols=KEY)
    write_batch(batch(spark, 0, ()), log.path, 0)
    write_batch(spark.createDataFrame([("a", None, 1.0), (None, T0, 2.0), ("a", None, 3.0)], SCHEMA), log.path, 1)
    write_batch(batch(spark, 2, ()), log.path, 2)
    assert log.compact(spark, spare=2) == 0 and log.compact(spark) == 1
    assert sorted((r["series_id"] or "", r["v"]) for r in log.view(spark).collect()) == [("", 2.0), ("a", 3.0)]
    write_batch(spark.createDataFrame([("a", None, 4.0)], SCHEMA), log.path, 3)
    write_batch(batch(spark, 4, ()), log.path, 4)
    assert log.compact(spark, spare=0) == 4
    assert sorted((r["series_id"] or "", r["v"]) for r in log.view(spark).collect()) == [("", 2.0), ("a", 4.0)]
    none = AppendLog(scratch(spark, "none"), key_cols=KEY)
    write_batch(batch(spark, 0, ()), none.path, 0)
    assert none.compact(spark, spare=0) == 0 and none.view(spark).count() == 0


def test_live_cycle_compacted_between_batches(spark):
    r = [("a", T0 + timedelta(minutes=5 * i), 100.0 + i % 37, float(i % 5 - 2), i) for i in range(900)]
    p = [("a", T0 + timedelta(hours=5 * i), "basal", 0.5 + i % 3, 5.0, None, None, i) for i in range(14)]
    p += [("a", T0 + timedelta(hours=7 * i + 1), "bolus", 1.0 + i, 0.0, None, 10.0, 50 + i) for i in range(9)]
    m = [("a", T0 + timedelta(hours=11 * i), "snack", 12.0, "", "manual", i) for i in range(6)]
    dealt = {"readings": (r, READINGS), "pump": (p, PUMP), "treatments": (m, MANUAL)}
    cycle = rf.RefreshCycle(scratch(spark, "cycle"))

    def lands(x):
        return 3 if x[-1] % 7 == 3 else min(int((x[1] - T0) / timedelta(hours=26)), 2)

    for k in (0, 1, 2, 3, 3):
        cycle(rf.feeds(*[spark.createDataFrame([x for x in rows if lands(x) == k], schema) for rows, schema in dealt.values()]), k)
        done = cycle.compact(spark)
    assert done == {"landed": None, "features": None}                 # the replay brought no new batch
    assert cycle._log("landed").manifests(spark) == [1, 2] and cycle._log("landed").batches(spark) == [2, 3]
    same_features(spark, cycle, *[spark.createDataFrame(*x) for x in dealt.values()])
