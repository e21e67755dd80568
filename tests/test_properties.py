"""Property tests (hypothesis): timeline invariants on random event sets."""
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.operators.timeline import unified_timeline

T0 = datetime(2026, 4, 21)
minutes = st.integers(min_value=0, max_value=600)

SCHEMA_R = "series_id string, timestamp timestamp, glucose_mg_dl double, trend_arrow_encoded double, seq long"
SCHEMA_P = ("series_id string, timestamp timestamp, event_type string, value double, duration_minutes double, "
            "iob_units double, carbs_g double, seq long")


@settings(max_examples=8, deadline=None)
@given(reads=st.lists(minutes, min_size=1, max_size=12),
       boluses=st.lists(st.tuples(minutes, st.floats(0, 10)), max_size=6),
       susp=st.lists(st.tuples(minutes, st.one_of(st.none(), st.floats(-5, 90))), max_size=5))
def test_timeline_invariants(spark, reads, boluses, susp):
    r = spark.createDataFrame([("s", T0 + timedelta(minutes=m), 100.0, None, i) for i, m in enumerate(reads)], SCHEMA_R)
    events = [("s", T0 + timedelta(minutes=m), "bolus", v, 0.0, None, None, i) for i, (m, v) in enumerate(boluses)]
    events += [("s", T0 + timedelta(minutes=m), "suspend", 0.0, d, None, None, 100 + i) for i, (m, d) in enumerate(susp)]
    p = spark.createDataFrame(events, SCHEMA_P) if events else None
    rows = unified_timeline(r, p, block_minutes=60).orderBy("timestamp").collect()
    times = [x["timestamp"] for x in rows]
    # gapless 5-minute grid from floor(min) to ceil(max)
    assert all(b - a == timedelta(minutes=5) for a, b in zip(times, times[1:]))
    # bolus units are conserved inside the grid
    assert abs(sum(x["bolus_units"] for x in rows) - sum(v for _, v in boluses)) < 1e-9
    # modelled IOB is never negative
    assert all(x["iob_units"] >= 0 for x in rows)
    # flags do not depend on the order events arrive in
    if p is not None:
        rev = spark.createDataFrame(list(reversed(events)), SCHEMA_P)
        flags = [x["is_suspended"] for x in unified_timeline(r, rev, block_minutes=1440).orderBy("timestamp").collect()]
        assert flags == [x["is_suspended"] for x in rows]


def test_features_do_not_leak_future_rows(spark):
    """Features (not labels) at time t are unchanged when rows after t change."""
    import numpy as np
    import pandas as pd

    from tideline.operators.features import build_features
    rng = np.random.default_rng(5)
    ts = pd.date_range("2026-04-21", periods=600, freq="5min")
    g = rng.normal(120, 20, len(ts))
    cut = ts[300]
    base = pd.DataFrame({"series_id": "s", "timestamp": ts, "glucose_mg_dl": g, "trend_arrow_encoded": 0.0,
                         "iob_units": 0.0, "bolus_units": rng.random(len(ts)), "basal_rate": 1.0,
                         "is_suspended": False, "control_iq_active": False, "carbs_g": rng.random(len(ts)) * 5})
    changed = base.copy()
    later = changed.timestamp > cut
    changed.loc[later, ["glucose_mg_dl", "bolus_units", "carbs_g"]] = 999.0
    a = build_features(spark.createDataFrame(base), block_bins=120).filter(f"timestamp <= '{cut}'")
    b = build_features(spark.createDataFrame(changed), block_bins=120).filter(f"timestamp <= '{cut}'")
    cols = [c for c in a.columns if not c.startswith("target_")]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert a.select("target_30m").exceptAll(b.select("target_30m")).count() > 0   # labels do look ahead


def test_modelled_iob_is_additive_over_boluses(spark):
    r = spark.createDataFrame([("s", T0, 100.0, None, 0), ("s", T0 + timedelta(hours=12), 100.0, None, 1)], SCHEMA_R)

    def iob(events):
        p = spark.createDataFrame(events, SCHEMA_P)
        return {x["timestamp"]: x["iob_units"] for x in unified_timeline(r, p).collect()}

    e1 = [("s", T0 + timedelta(minutes=33), "bolus", 2.0, 0.0, None, None, 0)]
    e2 = [("s", T0 + timedelta(minutes=91, seconds=20), "bolus", 1.5, 0.0, None, None, 1)]
    a, b, ab = iob(e1), iob(e2), iob(e1 + e2)
    assert all(abs(ab[t] - (a[t] + b[t])) < 1e-12 for t in ab)
