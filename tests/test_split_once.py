"""Features are computed and split once; fits, scores and metrics scan the stored split."""
from datetime import datetime, timedelta

from tideline.operators import model as md


def rows(spark):
    t0 = datetime(2026, 4, 21)
    return spark.createDataFrame([(s, t0 + timedelta(hours=i), float(i % 7), float(i % 5), None if i % 9 == 0 else float((i * 3) % 7))
                                  for s in "ab" for i in range(60)],
                                 "series_id string, timestamp timestamp, x double, target_30m double, target_60m double")


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_fit_scans_one_stored_split(spark, monkeypatch):
    """The split that fit returns is a scan, and a fit of another target takes it as it is."""
    calls = []
    whole = md.time_split
    monkeypatch.setattr(md, "time_split", lambda *a, **k: calls.append(1) or whole(*a, **k))
    _, sp = md.fit(rows(spark), ["x"], params=dict(maxIter=2, maxDepth=2))
    assert "Window" not in plan(sp) and "Exchange" not in plan(sp) and "Join" not in plan(sp)
    want = whole(rows(spark))
    key = ["series_id", "timestamp", "split"]
    assert sp.select(*key).exceptAll(want.select(*key)).count() == 0 and sp.count() == want.count() == 120
    model, again = md.fit(sp, ["x"], target_col="target_60m", params=dict(maxIter=2, maxDepth=2))
    assert again is sp and calls == [1] and model.transform(sp).count() == 120
