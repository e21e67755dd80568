"""Canonical table schemas and ``conform``.

Every table carries the series key(s) in front; the default key is
``series_id``. ``conform`` adds missing columns as typed NULL, casts with
``try_cast`` semantics (bad values become NULL instead of failing) and
projects to the fixed column list.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SERIES = ("series_id",)

# Fixed vocabularies of the data model.
EVENT_TYPES = ("basal", "bolus", "suspend", "control_iq_action")
TREATMENT_KINDS = ("meal", "low_treatment", "snack", "correction", "other")

READINGS = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("glucose_mg_dl", T.DoubleType()),
    T.StructField("trend_arrow_encoded", T.DoubleType()),
])

PUMP = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("duration_minutes", T.DoubleType()),
    T.StructField("iob_units", T.DoubleType()),
    T.StructField("carbs_g", T.DoubleType()),
    T.StructField("bg_at_bolus", T.DoubleType()),
    T.StructField("food_insulin", T.DoubleType()),
    T.StructField("correction_insulin", T.DoubleType()),
])

TREATMENTS = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("carbs_g", T.DoubleType()),
    T.StructField("notes", T.StringType()),
    T.StructField("source", T.StringType()),
])

TIMELINE = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("glucose_mg_dl", T.DoubleType()),
    T.StructField("trend_arrow_encoded", T.DoubleType()),
    T.StructField("iob_units", T.DoubleType()),
    T.StructField("bolus_units", T.DoubleType()),
    T.StructField("basal_rate", T.DoubleType()),
    T.StructField("is_suspended", T.BooleanType()),
    T.StructField("control_iq_active", T.BooleanType()),
    T.StructField("carbs_g", T.DoubleType()),
])

PREDICTIONS_LOG = T.StructType([
    T.StructField("predicted_at", T.TimestampType()),
    T.StructField("target_timestamp", T.TimestampType()),
    T.StructField("current_glucose", T.DoubleType()),
    T.StructField("prediction_30m", T.DoubleType()),
])

ALERTS_LOG = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("detail", T.StringType()),
])

ACTIONS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("units", T.DoubleType()),
    T.StructField("minutes", T.DoubleType()),
    T.StructField("grams", T.DoubleType()),
])


def with_series(schema: T.StructType, series_cols=DEFAULT_SERIES,
                series_type: T.DataType = T.StringType()) -> T.StructType:
    """Prefix a schema with the series key column(s)."""
    fields = [T.StructField(c, series_type) for c in series_cols]
    return T.StructType(fields + [f for f in schema.fields if f.name not in series_cols])


def _coerce(col: Column, src: T.DataType, dst: T.DataType) -> Column:
    if src == dst:
        return col
    if isinstance(dst, T.TimestampType):
        if isinstance(src, T.StringType):
            return F.try_to_timestamp(col)
        if isinstance(src, (T.TimestampNTZType, T.DateType)):
            return col.cast(dst)
    if isinstance(src, T.StringType) and isinstance(dst, T.NumericType):
        # to_numeric(errors="coerce"): unparsable -> NULL
        return col.try_cast(dst)
    if isinstance(dst, T.StringType):
        return col.cast(dst)
    return col.try_cast(dst)


def conform(df: DataFrame, schema: T.StructType, series_cols=()) -> DataFrame:
    """Add missing columns as typed NULL, cast, NaN -> NULL, project."""
    present = {f.name: f.dataType for f in df.schema.fields}
    out = [F.col(c) for c in series_cols]
    for f in schema.fields:
        if f.name in series_cols:
            continue
        if f.name in present:
            c = _coerce(F.col(f.name), present[f.name], f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))  # NULL is the only missing marker
        out.append(c.alias(f.name))
    return df.select(*out)


def empty(spark, schema: T.StructType, series_cols=DEFAULT_SERIES) -> DataFrame:
    """Typed empty table (alerts/treatments/log with fixed columns)."""
    return spark.createDataFrame([], with_series(schema, series_cols))
