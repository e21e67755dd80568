"""Stand-in inputs built from the driver's ``events`` table.

The role map only renames and re-types rows; it does none of the
operators' work. Series = ``user_id``.

* ``view``     -> sensor reading: glucose = value, trend from the rate
                  ``(k - 50) / 25`` mg/dL/min through P3
* ``purchase`` -> bolus: dose = value, carbs_g = k (0 means none),
                  reported IOB = k / 10 when k >= 90 else missing
* ``click``    -> basal sample: rate = value, duration 5 min
* ``signup``   -> interval event, duration = value minutes:
                  ``suspend`` when k < 50, else ``control_iq_action``
* ``error``    -> manual carb treatment: carbs_g = value, kind ``snack``

``k`` is the integer in ``props`` (JSON ``{"k": n}``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rate_to_trend

SERIES = ("user_id",)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` cast once to an instant (session zone is UTC)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_events(spark, sf_dir)
    return ev.filter(F.col("event_type") == "view").select(
        "user_id",
        F.col("ts").alias("timestamp"),
        F.col("value").alias("glucose_mg_dl"),
        rate_to_trend((F.col("k") - 50) / F.lit(25.0)).alias("trend_arrow_encoded"),
        F.col("event_id").alias("seq"),
    )


def pump_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "click", "signup"))
    et = F.col("event_type")
    return ev.select(
        "user_id",
        F.col("ts").alias("timestamp"),
        F.when(et == "purchase", "bolus").when(et == "click", "basal")
         .when(F.col("k") < 50, "suspend").otherwise("control_iq_action").alias("event_type"),
        F.col("value"),
        F.when(et == "click", F.lit(5.0)).when(et == "signup", F.col("value"))
         .otherwise(F.lit(0.0)).alias("duration_minutes"),
        F.when((et == "purchase") & (F.col("k") >= 90), F.col("k") / F.lit(10.0)).alias("iob_units"),
        F.when(et == "purchase", F.col("k").cast("double")).alias("carbs_g"),
        F.col("event_id").alias("seq"),
    )


def manual_treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_events(spark, sf_dir)
    return ev.filter(F.col("event_type") == "error").select(
        "user_id",
        F.col("ts").alias("timestamp"),
        F.lit("snack").alias("kind"),
        F.col("value").alias("carbs_g"),
        F.lit("").alias("notes"),
        F.lit("manual").alias("source"),
        F.col("event_id").alias("seq"),
    )


def floor5(ts):
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(300_000_000)))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast log rows: one per ``view`` event, issued 30 min before the
    reading's 5-minute bin and aimed at that bin."""
    ev = load_events(spark, sf_dir).filter(F.col("event_type") == "view")
    tgt = floor5(F.col("ts"))
    return ev.select(
        "user_id",
        (tgt - F.expr("INTERVAL 30 MINUTES")).alias("predicted_at"),
        tgt.alias("target_timestamp"),
        (F.col("value") * (F.lit(1.0) + (F.col("k") - 50) / F.lit(200.0))).alias("current_glucose"),
        (F.col("value") * F.col("k") / F.lit(50.0)).alias("prediction_30m"),
        F.col("event_id").alias("seq"),
    )


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-engine input rows: reading, its time, a forecast and the
    evaluation time ``k`` minutes later."""
    ev = load_events(spark, sf_dir).filter(F.col("event_type") == "view")
    return ev.select(
        "user_id", "event_id",
        F.col("ts").alias("current_timestamp"),
        F.col("value").alias("current_glucose"),
        (F.col("value") * F.col("k") / F.lit(50.0)).alias("prediction_30m"),
        (F.col("ts") + F.make_interval(mins=F.col("k"))).alias("now"),
    )


def dense_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value as a reading: the densest signal in the data,
    used by the model queries on a 6-hour grid."""
    ev = load_events(spark, sf_dir)
    return ev.select("user_id", F.col("ts").alias("timestamp"), F.col("value").alias("glucose_mg_dl"),
                     rate_to_trend((F.col("k") - 50) / F.lit(25.0)).alias("trend_arrow_encoded"),
                     F.col("event_id").alias("seq"))


def _iso(ts):
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def pump_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed vendor records (bolus, basal, event) with the vendor's field
    names, including zero / missing values that the first-truthy rule skips."""
    ev = load_events(spark, sf_dir)
    k = F.col("k")
    bolus = ev.filter(F.col("event_type") == "purchase").select(
        "user_id", "event_id", F.when(k % 6 == 0, F.lit("")).otherwise(_iso(F.col("ts"))).alias("eventDateTime"),
        _iso(F.col("ts") - F.when(k % 6 == 0, F.expr("INTERVAL 1 MINUTE")).otherwise(F.expr("INTERVAL 9 MINUTES"))).alias("requestDateTime"),
        F.when(k % 4 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("insulinDelivered"),
        F.col("value").alias("requestedInsulin"),
        F.when(k % 2 == 0, (k * 6).cast("double")).alias("duration"),
        F.when(k >= 90, k / F.lit(10.0)).alias("iob"),
        F.when(k % 3 == 0, F.lit(0.0)).otherwise(k.cast("double")).alias("carbsRequest"),
        (k % 7).cast("double").alias("carbAmount"),
        F.when(k % 5 == 0, F.col("value")).alias("bgValue"),
        F.col("value").alias("targetBG"))
    basal = ev.filter(F.col("event_type") == "click").select(
        "user_id", "event_id", _iso(F.col("ts")).alias("eventDateTime"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("basalRate"),
        F.when(k % 2 == 0, F.lit(None).cast("double")).otherwise(F.lit(5.0)).alias("duration"))
    label = (F.when(k % 4 == 0, "pumpingSuspended").when(k % 4 == 1, "pumpingResumed")
             .when(k % 4 == 2, "ControlIQ basal increase"))
    event = ev.filter(F.col("event_type") == "signup").select(
        "user_id", "event_id", _iso(F.col("ts")).alias("eventDateTime"), label.alias("eventType"),
        F.col("value").alias("value"),
        F.when(k % 3 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("duration"))
    return bolus, basal, event


def raw_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-typed export fields: reading text with Low/High/blank/bad
    values, trend labels in several spellings, rate-of-change text and
    timestamps with and without a zone offset."""
    ev = load_events(spark, sf_dir)
    k = F.col("k")
    labels = F.array(*[F.lit(x) for x in ("DoubleDown", "SingleDown", "FortyFiveDown", "Flat", "None",
                                          "FortyFiveUp", "SingleUp", "DoubleUp", "none", " Forty Five Up ",
                                          "NONE", "sideways", "")])
    reading = (F.when(F.col("value") < 1, F.lit("Low")).when(F.col("value") > 300, F.lit(" HIGH "))
               .when(k == 13, F.lit("")).when(k == 17, F.lit("n/a")).when(k == 19, F.lit("NaN"))
               .when(k == 23, F.lit("120d")).when(k == 29, F.lit("99f")).when(k == 31, F.lit(" 1.5e2 "))
               .otherwise(F.col("value").cast("string")))
    rate = F.when(k == 7, F.lit("fast")).when(k == 37, F.lit("1d")).otherwise(((k - 50) / F.lit(20.0)).cast("string"))
    base = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    ts_text = (F.when(k % 3 == 0, F.concat(shifted, F.lit("+02:00"))).when(k % 3 == 1, F.concat(base, F.lit("Z")))
               .when(k == 50, F.lit("not a time")).otherwise(base))
    return ev.select("user_id", "event_id", reading.alias("reading_text"),
                     F.element_at(labels, (k % 13) + 1).alias("trend_text"), rate.alias("rate_text"),
                     ts_text.alias("ts_text"))
