"""Dense rows from arrays of blocks: nothing dense is sorted or hashed, batches may cut a block, tasks follow the bins."""
import math
from datetime import datetime, timedelta

import pytest

from tideline.operators import timeline as tl
from tideline.operators.features import feature_names, label_names, timeline_features
from tideline.operators.timeline import grid_tasks, unified_timeline
from tideline.session import ensure_conf

T0 = datetime(2026, 4, 21, 7, 0, 0)


def inputs(spark):
    """Two series with a null key between them, readings and events over four days."""
    keys = ["a", None, "b"]
    at = lambda m: T0 + timedelta(minutes=m)
    r = [(k, at(m), 100.0 + m % 97, 1.0, m) for i, k in enumerate(keys) for m in range(i, 4 * 1440, 41 + i)]
    kinds = ["bolus", "basal", "suspend", "control_iq_action", "bolus"]
    p = [(k, at(m), kinds[m % 5], None if m % 11 == 0 else 0.5 + m % 7, float(m % 90), 2.0 if k == "b" and m % 3 == 0 else None, float(m % 2 * 9), m)
         for i, k in enumerate(keys) for m in range(5 + i, 4 * 1440, 173)]
    t = [(k, at(m), 12.0, m) for k in keys for m in range(60, 5 * 1440, 577)]
    return (spark.createDataFrame(r, "series_id string, timestamp timestamp, glucose_mg_dl double, trend_arrow_encoded double, seq long"),
            spark.createDataFrame(p, "series_id string, timestamp timestamp, event_type string, value double, duration_minutes double, "
                                     "iob_units double, carbs_g double, seq long"),
            spark.createDataFrame(t, "series_id string, timestamp timestamp, carbs_g double, seq long"))


def rows(df):
    return sorted(df.collect(), key=lambda x: (x["series_id"] or "", x["timestamp"]))


def same(a, b, names):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for c in names:
            u, v = x[c], y[c]
            assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) if isinstance(u, float) and isinstance(v, float) else u == v, (c, x, y)


@pytest.mark.parametrize("of", [unified_timeline, timeline_features])
def test_dense_rows_are_neither_sorted_nor_hashed(spark, of):
    """Behind the exchange of the segments there is their sort and one pass."""
    plan = of(*inputs(spark))._jdf.queryExecution().sparkPlan().toString()
    dense = plan[:plan.index("RepartitionBy")] if "RepartitionBy" in plan else plan[:plan.index("Exchange")]
    assert "MapInArrow" in dense and dense.count("Sort ") == 1
    for node in ("Aggregate", "Window", "Generate", "Join"):
        assert node not in dense


@pytest.mark.parametrize("of", [unified_timeline, timeline_features])
def test_batches_may_cut_blocks(spark, of):
    """A block whose segments come in several Arrow batches is summed up over them."""
    conf, want = "spark.sql.execution.arrow.maxRecordsPerBatch", rows(of(*inputs(spark)))
    before = spark.conf.get(conf)
    try:
        for n in (1, 3, 7):
            spark.conf.set(conf, n)
            got = rows(of(*inputs(spark)))
            same(got, want, want[0].asDict())
    finally:
        spark.conf.set(conf, before)


@pytest.mark.parametrize("of", [unified_timeline, timeline_features])
def test_series_do_not_touch(spark, of):
    """Blocks laid out together, that of a null key too, equal those of each series alone."""
    whole = rows(of(*inputs(spark)))
    for k in ("a", None, "b"):
        alone = rows(of(*[d.filter(d.series_id.eqNullSafe(k)) for d in inputs(spark)]))
        mine = [x for x in whole if x["series_id"] == k]
        same(mine, alone, mine[0].asDict())


@pytest.mark.parametrize("columns", [["basal_rate"], ["is_suspended", "control_iq_active"], ["iob_units"], ["bolus_units", "glucose_mg_dl"]])
def test_timeline_columns_alone(spark, columns):
    got, want = rows(unified_timeline(*inputs(spark), columns=columns)), rows(unified_timeline(*inputs(spark)))
    assert set(got[0].asDict()) == {"series_id", "timestamp", *columns}
    same(got, want, got[0].asDict())


@pytest.mark.parametrize("columns", [["target_30m", "target_60m"], ["carbs_sum_60m", "minutes_since_bolus"], ["hour_sin", "dow"],
                                     ["glucose_std_60m"], ["iob_units", "is_suspended"]])
def test_features_alone(spark, columns):
    got, want = rows(timeline_features(*inputs(spark), columns=columns)), rows(timeline_features(*inputs(spark)))
    assert set(got[0].asDict()) == {"series_id", "timestamp", *columns}
    assert list(want[0].asDict()) == ["series_id", "timestamp", *feature_names(), *label_names()]
    same(got, want, got[0].asDict())


def test_tasks_grow_with_the_grid(spark, monkeypatch):
    r, p, _ = inputs(spark)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = unified_timeline(r, p).count()
    assert grid_tasks(r, p, ["series_id"], 5) == few
    monkeypatch.setattr(tl, "BINS_PER_TASK", 100)
    assert grid_tasks(r, p, ["series_id"], 5) == -(-bins // 100) > few
    assert unified_timeline(r, p).rdd.getNumPartitions() == -(-bins // 100)


def test_wide_projections_are_compiled(spark):
    """No generated method above HotSpot's limit, which would run interpreted; a lower limit of the platform stays."""
    conf = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(conf)
    try:
        spark.conf.unset(conf)
        ensure_conf(spark)
        assert int(spark.conf.get(conf)) <= 8000
        spark.conf.set(conf, 4000)
        ensure_conf(spark)
        assert spark.conf.get(conf) == "4000"
    finally:
        spark.conf.set(conf, before)
