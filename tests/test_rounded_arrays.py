"""Features that come rounded out of the arrays equal those that ``finish`` rounds."""
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.dense import Blocks
from tideline.operators.features import timeline_features
from tideline.plans import catalog
from tideline.plans.output import DIGITS, finish, round_half_away

from .test_dense import inputs, rows


def test_rounding_is_that_of_the_output(spark):
    """Ties, negative ones and neighbours of ties, zeros, large and special values."""
    ties = [(k + 0.5) / 10 ** 6 for k in range(-40, 40)] + [0.5, 2.5e-6, 1234.5678905, 0.1 + 0.2]
    x = [float(v) for t in ties for v in (t, np.nextafter(t, 9), np.nextafter(t, -9))] + [0.0, -0.0, -1e-9, 1e300, -1e18, float("inf"), float("-inf"), float("nan")]
    b = Blocks(1, 1, 0, 0, 5, 1.0, DIGITS)
    with np.errstate(all="ignore"):
        got = b.shown(np.array(x))
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double").orderBy("i").select(round_half_away(F.col("x"))).collect()]
    for v, a, w in zip(x, got, want):
        assert (a == w or np.isnan(a) and np.isnan(w)) and np.signbit(a) == np.signbit(w) or np.isnan(v), (v, a, w)


def test_features_come_out_finished(spark):
    """The same rows and types, the parts of blocks too, nulls only where a feature may miss."""
    given = inputs(spark)
    want, got = finish(timeline_features(*given)), timeline_features(*given, digits=DIGITS)
    assert got.dtypes == want.dtypes
    a, b = rows(want), rows(got)
    assert a == b and len(a) > 0
    for f in got.schema.fields[1:]:
        assert f.nullable == f.name.startswith(("glucose_", "trend_", "basal_", "target_")), f


def test_query_rounds_no_row_in_spark(spark, tmp_path):
    """``features`` has nothing behind the arrays."""
    events = spark.createDataFrame([(k, f"2024-01-0{1 + k % 5} 0{k % 9}:11:07", k % 3, ["view", "click", "purchase", "signup", "error"][k % 5], k / 7, '{"k": %d}' % k)
                                    for k in range(60)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    out = catalog.q_features(spark, str(tmp_path))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.lstrip("* ").startswith("MapInArrow")
    assert dict(out.dtypes)["dow"] == "bigint" and out.schema["timestamp"].dataType == T.TimestampNTZType()
    assert rows_of(out) == rows_of(finish(catalog.features(spark, str(tmp_path))))


def rows_of(df):
    return sorted(map(repr, df.collect()))
