"""DuckDB oracle SQL for the query catalogue.

Written independently of the Spark code paths: grids by ``range``,
as-of by ``ASOF JOIN``, interval flags and decay by range joins, windows
over whole series. Outputs are rounded to 6 places like ``output.finish``.
"""
from __future__ import annotations

US5 = 300_000_000      # 5 minutes in microseconds
US60 = 3_600_000_000   # 1 hour


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


EV = """ev AS (
  SELECT event_id, user_id, event_type, value, CAST(ts AS TIMESTAMP) AS ts,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

RD = """rd AS (
  SELECT user_id, ts AS timestamp, value AS glucose_mg_dl,
         CASE WHEN k IS NOT NULL
              THEN round_even(greatest(-2.0, least(2.0, CAST(k - 50 AS DOUBLE) / 25.0)), 0) END
           AS trend_arrow_encoded,
         event_id AS seq
  FROM ev WHERE event_type = 'view')"""

PUMP = """pump AS (
  SELECT user_id, ts AS timestamp,
         CASE WHEN event_type = 'purchase' THEN 'bolus' WHEN event_type = 'click' THEN 'basal'
              WHEN k < 50 THEN 'suspend' ELSE 'control_iq_action' END AS event_type,
         value,
         CASE WHEN event_type = 'click' THEN 5.0 WHEN event_type = 'signup' THEN value ELSE 0.0 END
           AS duration_minutes,
         CASE WHEN event_type = 'purchase' AND k >= 90 THEN CAST(k AS DOUBLE) / 10.0 END AS iob_units,
         CASE WHEN event_type = 'purchase' THEN CAST(k AS DOUBLE) END AS carbs_g,
         event_id AS seq
  FROM ev WHERE event_type IN ('purchase', 'click', 'signup'))"""

TR = """tr AS (
  SELECT user_id, timestamp, kind, carbs_g, notes, source, src_ix, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, timestamp, source, kind, carbs_g
                                 ORDER BY src_ix, seq) AS rn
    FROM (SELECT user_id, timestamp, 'meal' AS kind, carbs_g, '' AS notes, 'tandem_bolus' AS source,
                 0 AS src_ix, seq
          FROM pump WHERE event_type = 'bolus' AND carbs_g IS NOT NULL AND carbs_g > 0
          UNION ALL
          SELECT user_id, ts, 'snack', value, '', 'manual', 1, event_id FROM ev WHERE event_type = 'error'))
  WHERE rn = 1)"""

BASE = [EV, RD, PUMP, TR]


def timeline_ctes(us: int = US5) -> list[str]:
    """CTEs ending in ``tl``: the unified timeline on a grid of ``us`` micros."""
    minutes = us // 60_000_000
    return BASE + [
        f"""ext AS (
  SELECT user_id, min(us) AS lo_us, max(us) AS hi_us, bool_or(riob) AS has_real FROM (
    SELECT user_id, epoch_us(timestamp) AS us, false AS riob FROM rd
    UNION ALL
    SELECT user_id, epoch_us(timestamp), event_type = 'bolus' AND iob_units IS NOT NULL FROM pump)
  GROUP BY user_id)""",
        f"""grid AS (
  SELECT user_id, has_real, unnest(range(lo_us // {us}, (hi_us + {us} - 1) // {us} + 1)) AS bin FROM ext)""",
        f"""gagg AS (
  SELECT user_id, epoch_us(timestamp) // {us} AS bin, avg(glucose_mg_dl) AS g, avg(trend_arrow_encoded) AS t
  FROM rd GROUP BY ALL)""",
        f"""bagg AS (
  SELECT user_id, epoch_us(timestamp) // {us} AS bin, sum(coalesce(value, 0.0)) AS bolus_sum,
         max(iob_units) AS iob_max
  FROM pump WHERE event_type = 'bolus' GROUP BY ALL)""",
        """bas AS (
  SELECT user_id, epoch_us(timestamp) AS us, value AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, timestamp ORDER BY seq DESC) AS rn
    FROM pump WHERE event_type = 'basal') WHERE rn = 1)""",
        f"""asofb AS (
  SELECT g.user_id, g.bin, b.v AS basal_rate
  FROM grid g ASOF LEFT JOIN bas b ON g.user_id = b.user_id AND g.bin * {us} >= b.us)""",
        f"""decay AS (
  SELECT g.user_id, g.bin,
         sum(b.dose * exp(-CAST(g.bin * {minutes} - b.tmin AS DOUBLE) / 240.0)) AS iob_decay
  FROM grid g JOIN (
    SELECT user_id, epoch_us(timestamp) // 60000000 AS tmin, coalesce(value, 0.0) AS dose
    FROM pump WHERE event_type = 'bolus' AND coalesce(value, 0.0) > 0) b
    ON g.user_id = b.user_id AND g.bin * {minutes} - b.tmin BETWEEN 0 AND 1200
  GROUP BY ALL)""",
        """iv AS (
  SELECT user_id, event_type, epoch_us(timestamp) AS s_us,
         epoch_us(timestamp) + CAST(trunc(CASE WHEN duration_minutes IS NULL OR duration_minutes <= 0
                                              THEN 5.0 ELSE duration_minutes END * 60000000.0) AS BIGINT)
           AS e_us
  FROM pump WHERE event_type IN ('suspend', 'control_iq_action'))""",
        f"""flags AS (
  SELECT g.user_id, g.bin, bool_or(iv.event_type = 'suspend') AS susp,
         bool_or(iv.event_type = 'control_iq_action') AS ciq
  FROM grid g JOIN iv ON g.user_id = iv.user_id AND g.bin * {us} >= iv.s_us AND g.bin * {us} < iv.e_us
  GROUP BY ALL)""",
        f"""cagg AS (
  SELECT user_id, epoch_us(timestamp) // {us} AS bin, sum(coalesce(carbs_g, 0.0)) AS carbs
  FROM tr GROUP BY ALL)""",
        f"""tl AS (
  SELECT g.user_id, g.bin, make_timestamp(g.bin * {us}) AS timestamp,
         ga.g AS glucose_mg_dl, ga.t AS trend_arrow_encoded,
         CASE WHEN g.has_real
              THEN coalesce(last_value(bo.iob_max IGNORE NULLS) OVER (
                     PARTITION BY g.user_id ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)
              ELSE coalesce(d.iob_decay, 0.0) END AS iob_units,
         coalesce(bo.bolus_sum, 0.0) AS bolus_units,
         a.basal_rate,
         coalesce(f.susp, false) AS is_suspended,
         coalesce(f.ciq, false) AS control_iq_active,
         coalesce(c.carbs, 0.0) AS carbs_g
  FROM grid g
  LEFT JOIN gagg ga ON ga.user_id = g.user_id AND ga.bin = g.bin
  LEFT JOIN bagg bo ON bo.user_id = g.user_id AND bo.bin = g.bin
  LEFT JOIN asofb a ON a.user_id = g.user_id AND a.bin = g.bin
  LEFT JOIN decay d ON d.user_id = g.user_id AND d.bin = g.bin
  LEFT JOIN flags f ON f.user_id = g.user_id AND f.bin = g.bin
  LEFT JOIN cagg c ON c.user_id = g.user_id AND c.bin = g.bin)""",
    ]


TL_COLS = ["glucose_mg_dl", "trend_arrow_encoded", "iob_units", "bolus_units", "basal_rate",
           "is_suspended", "control_iq_active", "carbs_g"]


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def timeline_select(us: int = US5) -> str:
    cols = ", ".join(r6(c) + f" AS {c}" if c not in ("is_suspended", "control_iq_active") else c
                     for c in TL_COLS)
    return with_ctes(timeline_ctes(us), f"SELECT user_id, timestamp, {cols} FROM tl")


def feature_ctes() -> list[str]:
    """CTEs ending in ``ft``: the feature table over the 5-minute timeline."""
    w = "PARTITION BY user_id ORDER BY bin"

    def rows(n):
        return f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    sel = ["user_id", "bin", "timestamp", "glucose_mg_dl", "trend_arrow_encoded", "iob_units",
           "bolus_units", "basal_rate", "CAST(is_suspended AS BIGINT) AS is_suspended",
           "CAST(control_iq_active AS BIGINT) AS control_iq_active", "carbs_g"]
    for m in (5, 10, 15, 30, 60, 120, 240):
        sel.append(f"lag(glucose_mg_dl, {m // 5}) OVER ({w}) AS glucose_lag_{m}m")
    for m in (5, 15, 30):
        sel.append(f"glucose_mg_dl - lag(glucose_mg_dl, {m // 5}) OVER ({w}) AS glucose_delta_{m}m")
    for m in (15, 30, 60, 120):
        n = m // 5
        k = max(2, n // 2)
        sel.append(f"CASE WHEN count(glucose_mg_dl) OVER {rows(n)} >= {k} "
                   f"THEN avg(glucose_mg_dl) OVER {rows(n)} END AS glucose_mean_{m}m")
        sel.append(f"CASE WHEN count(glucose_mg_dl) OVER {rows(n)} >= {k} "
                   f"THEN stddev_samp(glucose_mg_dl) OVER {rows(n)} END AS glucose_std_{m}m")
        sel.append(f"(glucose_mg_dl - lag(glucose_mg_dl, {n - 1}) OVER ({w})) / {float(n - 1)} "
                   f"AS glucose_slope_{m}m")
    for src, pfx in (("carbs_g", "carbs"), ("bolus_units", "bolus")):
        for m in (15, 30, 60, 120):
            sel.append(f"sum(coalesce({src}, 0.0)) OVER {rows(m // 5)} AS {pfx}_sum_{m}m")
        sel.append(f"least(480.0, coalesce(CAST(bin - last_value(CASE WHEN coalesce({src}, 0.0) > 0 THEN bin END "
                   f"IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) * 5.0, "
                   f"9999.0)) AS minutes_since_{pfx}")
    sel += ["sin(2 * pi() * (hour(timestamp) + minute(timestamp) / 60.0) / 24.0) AS hour_sin",
            "cos(2 * pi() * (hour(timestamp) + minute(timestamp) / 60.0) / 24.0) AS hour_cos",
            "CAST(isodow(timestamp) - 1 AS BIGINT) AS dow",
            "CAST(isodow(timestamp) - 1 >= 5 AS BIGINT) AS is_weekend",
            f"lead(glucose_mg_dl, 6) OVER ({w}) AS target_30m",
            f"lead(glucose_mg_dl, 12) OVER ({w}) AS target_60m"]
    return timeline_ctes(US5) + ["ft AS (SELECT " + ",\n  ".join(sel) + " FROM tl)"]


FEATURE_NAMES = (
    ["glucose_mg_dl", "trend_arrow_encoded", "iob_units", "bolus_units", "basal_rate", "is_suspended",
     "control_iq_active", "carbs_g"]
    + [f"glucose_lag_{m}m" for m in (5, 10, 15, 30, 60, 120, 240)]
    + [f"glucose_delta_{m}m" for m in (5, 15, 30)]
    + [x for m in (15, 30, 60, 120) for x in (f"glucose_mean_{m}m", f"glucose_std_{m}m", f"glucose_slope_{m}m")]
    + [f"carbs_sum_{m}m" for m in (15, 30, 60, 120)] + ["minutes_since_carbs"]
    + [f"bolus_sum_{m}m" for m in (15, 30, 60, 120)] + ["minutes_since_bolus"]
    + ["hour_sin", "hour_cos", "dow", "is_weekend"])

INT_FEATURES = {"is_suspended", "control_iq_active", "dow", "is_weekend"}


def feature_select(cols: list[str] | None = None, where: str = "") -> str:
    cols = cols or FEATURE_NAMES + ["target_30m", "target_60m"]
    body = ", ".join(c if c in INT_FEATURES else f"{r6(c)} AS {c}" for c in cols)
    return with_ctes(feature_ctes(), f"SELECT user_id, timestamp, {body} FROM ft {where}")


def resample_mean_sql(us: int = US5) -> str:
    return with_ctes(BASE, f"""SELECT user_id, make_timestamp(epoch_us(timestamp) // {us} * {us}) AS timestamp,
  {r6('avg(glucose_mg_dl)')} AS glucose_mg_dl, {r6('avg(trend_arrow_encoded)')} AS trend_arrow_encoded
FROM rd GROUP BY ALL""")


def grid_align_sql(us: int = US60) -> str:
    return with_ctes(timeline_ctes(us), f"""SELECT g.user_id, make_timestamp(g.bin * {us}) AS timestamp,
  {r6('ga.g')} AS glucose_mg_dl
FROM grid g LEFT JOIN gagg ga ON ga.user_id = g.user_id AND ga.bin = g.bin""")


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql


register("unified_timeline_5m", timeline_select(US5))
register("unified_timeline_1h", timeline_select(US60))
register("features", feature_select())
register("resample_mean_5m", resample_mean_sql(US5))
register("grid_align_1h", grid_align_sql(US60))


# ------------------------------------------------------------- more oracles
def tl_cols_sql(us: int, cols: list[str], where: str = "") -> str:
    body = ", ".join(c if c in ("is_suspended", "control_iq_active") else f"{r6(c)} AS {c}" for c in cols)
    return with_ctes(timeline_ctes(us), f"SELECT user_id, timestamp, {body} FROM tl {where}")


def decay_only_sql(us: int = US60) -> str:
    return with_ctes(timeline_ctes(us), f"""SELECT g.user_id, make_timestamp(g.bin * {us}) AS timestamp,
  {r6('coalesce(d.iob_decay, 0.0)')} AS iob_units
FROM grid g LEFT JOIN decay d ON d.user_id = g.user_id AND d.bin = g.bin""")


GAP_SQL = with_ctes(BASE, f"""SELECT user_id, prev AS gap_start, timestamp AS gap_end,
  {r6('(epoch_us(timestamp) - epoch_us(prev)) / 60000000.0')} AS duration_minutes
FROM (SELECT user_id, timestamp, lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) AS prev
      FROM rd WHERE glucose_mg_dl IS NOT NULL)
WHERE (epoch_us(timestamp) - epoch_us(prev)) / 60000000.0 > 720.0""")

REGULARITY_SQL = with_ctes(BASE, f"""SELECT user_id, count(*) AS n_rows, {r6('max(step)')} AS max_step_minutes,
  coalesce(bool_and(step = 5.0), true) AS is_regular
FROM (SELECT user_id, CAST(bin - lag(bin) OVER (PARTITION BY user_id ORDER BY bin) AS DOUBLE) * 5.0 AS step
      FROM (SELECT DISTINCT user_id, epoch_us(timestamp) // {US5} AS bin FROM rd))
GROUP BY user_id""")


def _pct(cond: str) -> str:
    return r6(f"coalesce(CAST(count_if({cond}) AS DOUBLE) * 100.0 / nullif(count(glucose_mg_dl), 0), 0.0)")


TIR_SQL = with_ctes(BASE, f"""SELECT user_id, {_pct('glucose_mg_dl < 20.0')} AS low_pct,
  {_pct('glucose_mg_dl >= 20.0 AND glucose_mg_dl <= 80.0')} AS in_range_pct,
  {_pct('glucose_mg_dl > 80.0')} AS high_pct, count(glucose_mg_dl) AS n_readings
FROM rd GROUP BY user_id""")

_PROFILE_COLS = ["timestamp"] + TL_COLS


def profile_sql(us: int = US60) -> str:
    aggs = ", ".join(f"count({c}) AS c{i}" for i, c in enumerate(_PROFILE_COLS))
    parts = [f"SELECT n AS n_rows, CAST({len(_PROFILE_COLS)} AS BIGINT) AS n_columns, mn AS min_ts, mx AS max_ts, "
             f"'{c}' AS column_name, n - c{i} AS null_count, c{i} AS non_null FROM a"
             for i, c in enumerate(_PROFILE_COLS)]
    return with_ctes(timeline_ctes(us) + [
        f"a AS (SELECT count(*) AS n, min(timestamp) AS mn, max(timestamp) AS mx, {aggs} FROM tl)"],
        "\nUNION ALL\n".join(parts))


def activity_sql(us: int = US60) -> str:
    return with_ctes(timeline_ctes(us), f"""SELECT user_id, {r6('sum(bolus_units)')} AS total_bolus_units,
  {r6('max(iob_units)')} AS max_iob_units, CAST(count_if(is_suspended) AS BIGINT) AS suspended_bins,
  CAST(count_if(control_iq_active) AS BIGINT) AS control_iq_bins
FROM tl GROUP BY user_id""")


VALUE_COUNTS_SQL = with_ctes(BASE, """SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM pump GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM tr GROUP BY ALL""")

KEEP_LAST_SQL = with_ctes(BASE, f"""SELECT user_id, hour, timestamp, {r6('glucose_mg_dl')} AS glucose_mg_dl,
  {r6('trend_arrow_encoded')} AS trend_arrow_encoded, seq
FROM (SELECT *, date_trunc('hour', timestamp) AS hour,
             row_number() OVER (PARTITION BY user_id, date_trunc('hour', timestamp)
                                ORDER BY timestamp DESC, seq DESC) AS rn FROM rd)
WHERE rn = 1""")

KEEP_FIRST_SQL = with_ctes(BASE, f"""SELECT user_id, event_type, day, ts, {r6('value')} AS value, event_id
FROM (SELECT *, CAST(ts AS DATE) AS day,
             row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn
      FROM ev)
WHERE rn = 1""")

UNION_SOURCES_SQL = with_ctes(BASE, f"""SELECT user_id, timestamp, kind, {r6('carbs_g')} AS carbs_g, notes, source FROM tr""")

UPSERT_SQL = with_ctes(BASE, f"""SELECT user_id, timestamp, {r6('glucose_mg_dl')} AS glucose_mg_dl,
  {r6('trend_arrow_encoded')} AS trend_arrow_encoded
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, timestamp ORDER BY prio DESC, seq DESC) AS rn FROM (
        SELECT user_id, timestamp, glucose_mg_dl, trend_arrow_encoded, seq, 0 AS prio FROM rd
        WHERE timestamp < TIMESTAMP '2024-01-20'
        UNION ALL
        SELECT user_id, timestamp, glucose_mg_dl + 1.0, trend_arrow_encoded, seq, 1 FROM rd
        WHERE timestamp >= TIMESTAMP '2024-01-15'))
WHERE rn = 1""")

_LABELS = ("DoubleDown", "SingleDown", "FortyFiveDown", "Flat", "None", "FortyFiveUp", "SingleUp", "DoubleUp",
           "none", " Forty Five Up ", "NONE", "sideways", "")
RS = """rs AS (
  SELECT user_id, event_id,
    CASE WHEN value < 1 THEN 'Low' WHEN value > 300 THEN ' HIGH ' WHEN k = 13 THEN '' WHEN k = 17 THEN 'n/a'
         WHEN k = 19 THEN 'NaN' WHEN k = 23 THEN '120d' WHEN k = 29 THEN '99f' WHEN k = 31 THEN ' 1.5e2 '
         ELSE CAST(value AS VARCHAR) END AS reading_text,
    [""" + ", ".join("'" + x + "'" for x in _LABELS) + """][k % 13 + 1] AS trend_text,
    CASE WHEN k = 7 THEN 'fast' WHEN k = 37 THEN '1d' ELSE CAST(CAST(k - 50 AS DOUBLE) / 20.0 AS VARCHAR) END AS rate_text,
    CASE WHEN k % 3 = 0 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00'
         WHEN k % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
         WHEN k = 50 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text
  FROM ev)"""


def p1(x: str) -> str:
    s = f"trim({x})"
    return (f"CASE WHEN {x} IS NULL OR {s} = '' OR lower({s}) IN ('nan', 'none') THEN NULL "
            f"WHEN lower({s}) = 'low' THEN 39.0 WHEN lower({s}) = 'high' THEN 401.0 "
            f"ELSE TRY_CAST({s} AS DOUBLE) END")


_CODES = {"doubledown": -2, "singledown": -2, "fortyfivedown": -1, "flat": 0, "none": 0,
          "fortyfiveup": 1, "singleup": 2, "doubleup": 2}


def p2(x: str) -> str:
    s = f"replace(lower(trim({x})), ' ', '')"
    cases = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in _CODES.items())
    return (f"CASE WHEN {x} = 'None' THEN 0.0 WHEN {x} IS NULL OR {s} = '' OR {s} IN ('nan', 'none') THEN NULL "
            f"ELSE (CASE {s} {cases} END) END")


def p3(x: str) -> str:
    r = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {r} IS NOT NULL THEN round_even(greatest(-2.0, least(2.0, {r})), 0) END"


def p5(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '(Z|z|[+-]\\d{{2}}(:?\\d{{2}})?)$') "
            f"THEN timezone('UTC', TRY_CAST({x} AS TIMESTAMPTZ)) ELSE TRY_CAST({x} AS TIMESTAMP) END")


PARSE_SQL = with_ctes([EV, RS], f"""SELECT user_id, event_id, {r6(p1('reading_text'))} AS glucose_mg_dl,
  {r6(p2('trend_text'))} AS trend_from_label, {r6(p3('rate_text'))} AS trend_from_rate,
  {p5('ts_text')} AS timestamp
FROM rs""")

ENCODE_SQL = with_ctes([EV, RS], f"""SELECT user_id, event_id, trend_text, {r6(p2('trend_text'))} AS trend
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'egv' WHEN event_id % 3 = 1 THEN 'EGV' ELSE 'Calibration' END
                  AS event_type FROM rs)
WHERE upper(event_type) = 'EGV'""")

SPLIT_SQL = with_ctes(BASE, """SELECT user_id, split, count(glucose_mg_dl) AS labelled_rows, count(*) AS rows,
  min(timestamp) AS first_ts, max(timestamp) AS last_ts, 'target_30m' AS target
FROM (SELECT *, CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                     WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) - 1 AS pos,
                   count(*) OVER (PARTITION BY user_id) AS n FROM rd))
GROUP BY user_id, split""")

PAIRS = """pairs AS (
  SELECT user_id, timestamp, glucose_mg_dl AS y,
         lag(glucose_mg_dl) OVER (PARTITION BY user_id ORDER BY timestamp) AS yhat FROM rd)"""

METRICS_SQL = with_ctes(BASE + [PAIRS], f"""SELECT count(*) AS n, {r6('avg(abs(yhat - y))')} AS mae,
  {r6('sqrt(avg((yhat - y) * (yhat - y)))')} AS rmse,
  {r6('avg(CASE WHEN abs(yhat - y) <= 20 THEN 1.0 ELSE 0.0 END) * 100.0')} AS pct_within_20,
  {r6('avg(CASE WHEN abs(yhat - y) <= 30 THEN 1.0 ELSE 0.0 END) * 100.0')} AS pct_within_30,
  {r6('CAST(count_if(y < 70 AND yhat < 80) AS DOUBLE) / nullif(count_if(y < 70), 0)')} AS hypo_recall,
  {r6('median(abs(yhat - y))')} AS median_abs_err
FROM pairs WHERE y IS NOT NULL AND yhat IS NOT NULL""")

HYPO_SQL = with_ctes(BASE + [PAIRS], f"""SELECT user_id, CAST(count_if(y < 70.0) AS BIGINT) AS n_low,
  {r6('CAST(count_if(y < 70.0 AND yhat < 80.0) AS DOUBLE) / nullif(count_if(y < 70.0), 0)')} AS hypo_recall
FROM pairs WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY user_id""")


#: alert details as typed columns; the texts' numbers are compared after parsing
DETAILS = ("cur", "pred", "delta", "age", "seen")


def details(*have: str) -> str:
    """The detail columns, NULL for fields that a rule does not carry."""
    return ", ".join(f"{x if x in have else 'NULL'} AS d_{x}" for x in DETAILS)


def f0(x: str) -> str:
    return f"printf('%.0f', {x})"


TS_TEXT = ("strftime(cts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(cts) % 1000000 <> 0 "
           "THEN '.' || lpad(CAST(epoch_us(cts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'")

ALERTS_SQL = with_ctes([EV, f"""f AS (
  SELECT user_id, event_id, ts AS cts, value AS cur, value * k / 50.0 AS pred,
         (value * k / 50.0) - value AS delta,
         (epoch_us(ts + to_minutes(k)) - epoch_us(ts)) / 60000000.0 AS age, {TS_TEXT.replace('cts', 'ts')} AS seen
  FROM ev WHERE event_type = 'view')""", f"""a AS (
  SELECT user_id, event_id, 1 AS grp, 'sensor_extreme' AS type, 'critical' AS severity,
         'Sensor reads LOW (≤39 mg/dL). Confirm with a fingerstick.' AS message,
         {details('cur')} FROM f WHERE cur <= 39.0
  UNION ALL
  SELECT user_id, event_id, 1, 'sensor_extreme', 'critical',
         'Sensor reads HIGH (≥401 mg/dL). Confirm with a fingerstick.',
         {details('cur')} FROM f WHERE cur > 39.0 AND cur >= 401.0
  UNION ALL
  SELECT user_id, event_id, 2, 'stale_data', 'warn',
         'No CGM reading in ' || {f0('age')} || ' min — predictions are based on outdated data.',
         {details('age', 'seen')} FROM f WHERE age > 15.0
  UNION ALL
  SELECT user_id, event_id, 3, 'predicted_low', 'critical',
         'Predicted ' || {f0('pred')} || ' mg/dL in 30 min (below 70). Consider pre-treating.',
         {details('pred', 'delta')} FROM f WHERE pred < 70.0
  UNION ALL
  SELECT user_id, event_id, 3, 'predicted_high', 'warn',
         'Predicted ' || {f0('pred')} || ' mg/dL in 30 min (above 250). Possible correction window.',
         {details('pred', 'delta')} FROM f WHERE pred > 250.0
  UNION ALL
  SELECT user_id, event_id, 4, 'predicted_drop', 'warn',
         'Predicted drop of ' || {f0('-delta')} || ' mg/dL in the next 30 min. Watch for an oncoming low.',
         {details('pred', 'delta')} FROM f WHERE delta <= -50.0
  UNION ALL
  SELECT user_id, event_id, 4, 'predicted_rise', 'info',
         'Predicted rise of ' || {f0('delta')} || ' mg/dL in the next 30 min. Likely a carb-driven spike.',
         {details('pred', 'delta')} FROM f
         WHERE delta > -50.0 AND delta >= 60.0)"""],
    f"""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_id ORDER BY grp) - 1 AS BIGINT)
  AS alert_ix, type, severity, message, {r6('d_cur')} AS detail_current, {r6('d_pred')} AS detail_prediction,
  {r6('d_delta')} AS detail_delta, {r6('d_age')} AS detail_age, CAST(d_seen AS VARCHAR) AS detail_last_seen FROM a""")

LOG = f"""lg AS (
  SELECT user_id, predicted_at, target_timestamp, current_glucose, prediction_30m FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, predicted_at ORDER BY seq DESC) AS rn FROM (
      SELECT user_id, make_timestamp(epoch_us(ts) // {US5} * {US5}) - INTERVAL 30 MINUTE AS predicted_at,
             make_timestamp(epoch_us(ts) // {US5} * {US5}) AS target_timestamp,
             value * (1.0 + CAST(k - 50 AS DOUBLE) / 200.0) AS current_glucose,
             value * k / 50.0 AS prediction_30m, event_id AS seq
      FROM ev WHERE event_type = 'view'))
  WHERE rn = 1)"""
SCORED = f"""sc AS (
  SELECT l.*, t.g AS actual_30m, abs(l.prediction_30m - t.g) AS abs_error
  FROM lg l LEFT JOIN (SELECT user_id, make_timestamp(epoch_us(timestamp) // {US5} * {US5}) AS ts,
                              avg(glucose_mg_dl) AS g FROM rd GROUP BY ALL) t
    ON t.user_id = l.user_id AND t.ts = l.target_timestamp)"""
DRIFT_BASE = BASE + [LOG, SCORED]

JOIN_SQL = with_ctes(DRIFT_BASE, f"""SELECT user_id, predicted_at, target_timestamp,
  {r6('current_glucose')} AS current_glucose, {r6('prediction_30m')} AS prediction_30m,
  {r6('actual_30m')} AS actual_30m, {r6('abs_error')} AS abs_error FROM sc""")

_NOW = "TIMESTAMP '2024-01-30 00:00:00'"
TRAILING = f"""tm AS (
  SELECT user_id, count(actual_30m) AS n_scored,
    avg(CASE WHEN actual_30m IS NOT NULL AND target_timestamp >= {_NOW} - INTERVAL 24 HOUR
             THEN abs(prediction_30m - actual_30m) END) AS mae_24h,
    sqrt(avg(CASE WHEN actual_30m IS NOT NULL AND target_timestamp >= {_NOW} - INTERVAL 24 HOUR
             THEN (prediction_30m - actual_30m) * (prediction_30m - actual_30m) END)) AS rmse_24h,
    avg(CASE WHEN actual_30m IS NOT NULL AND target_timestamp >= {_NOW} - INTERVAL 7 DAY
             THEN abs(prediction_30m - actual_30m) END) AS mae_7d,
    sqrt(avg(CASE WHEN actual_30m IS NOT NULL AND target_timestamp >= {_NOW} - INTERVAL 7 DAY
             THEN (prediction_30m - actual_30m) * (prediction_30m - actual_30m) END)) AS rmse_7d,
    avg(CASE WHEN actual_30m IS NOT NULL THEN abs(prediction_30m - actual_30m) END) AS mae_all
  FROM sc GROUP BY user_id)"""
_TM_COLS = ["mae_24h", "rmse_24h", "mae_7d", "rmse_7d", "mae_all"]
TRAILING_SQL = with_ctes(DRIFT_BASE + [TRAILING],
                         "SELECT user_id, n_scored, " + ", ".join(f"{r6(c)} AS {c}" for c in _TM_COLS) + " FROM tm")

ROLLING_SQL = with_ctes(DRIFT_BASE, f"""SELECT user_id, target_timestamp,
  {r6('avg(abs_error) OVER (PARTITION BY user_id ORDER BY epoch_us(target_timestamp) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)')}
  AS rolling_mae
FROM sc WHERE actual_30m IS NOT NULL""")


def f_n(x: str, n: int) -> str:
    return f"printf('%.{n}f', {x})"


DRIFT_SQL = with_ctes(DRIFT_BASE + [TRAILING], "SELECT user_id, n_scored, "
                      + ", ".join(f"{r6(c)} AS {c}" for c in _TM_COLS) + f""",
  CAST(25.0 AS DOUBLE) AS trained_mae,
  {r6('mae_24h / 25.0')} AS drift_ratio,
  coalesce(mae_24h / 25.0 >= 1.5, false) AS recommend_retrain,
  CASE WHEN mae_24h / 25.0 >= 1.5
       THEN 'Live 24h MAE (' || {f_n('mae_24h', 1)} || ') is ' || {f_n('mae_24h / 25.0', 2)}
            || '× the trained-test MAE (25.0). Consider retraining.'
       WHEN mae_24h IS NOT NULL
       THEN 'Live accuracy in line with training (24h MAE ' || {f_n('mae_24h', 1)} || ' vs trained 25.0, ratio '
            || {f_n('mae_24h / 25.0', 2)} || ').'
       ELSE 'Scored ' || CAST(n_scored AS VARCHAR) || ' predictions. Need a trained model + more time to assess drift.'
  END AS recommendation
FROM tm""")

BACKTEST_SQL = with_ctes(DRIFT_BASE, f"""SELECT user_id, count(*) AS n, {r6('avg(abs_error)')} AS mae
FROM sc WHERE abs_error IS NOT NULL GROUP BY user_id""")

_ACTIONS = [(0, None, 0.0, 0.0, 0.0, "baseline (no action)"), (1, "bolus", 0.5, 0.0, 0.0, "bolus +0.5U now"),
            (2, "bolus", 1.0, 0.0, 0.0, "bolus +1U now"), (3, "bolus", 2.0, 0.0, 0.0, "bolus +2U now"),
            (4, "bolus", 3.0, 0.0, 0.0, "bolus +3U now"), (5, "suspend", 0.0, 30.0, 0.0, "suspend basal for 30 min"),
            (6, "suspend", 0.0, 60.0, 0.0, "suspend basal for 60 min"), (7, "carbs", 0.0, 0.0, 8.0, "eat 8g carbs now"),
            (8, "carbs", 0.0, 0.0, 15.0, "eat 15g carbs now"), (9, "carbs", 0.0, 0.0, 30.0, "eat 30g carbs now")]


def scenario_sql() -> str:
    vals = ", ".join(f"({i}, {'NULL' if k is None else repr(k)}, {u}, {m}, {g}, '{lab}')"
                     for i, k, u, m, g, lab in _ACTIONS)
    b = "(a.kind = 'bolus' AND a.units > 0)"
    s = "(a.kind = 'suspend' AND a.minutes > 0)"
    c = "(a.kind = 'carbs' AND a.grams > 0)"
    cols = [f"CAST(a.ix AS BIGINT) AS scenario_ix", "a.label AS scenario",
            r6(f"CASE WHEN {b} THEN f.iob_units + a.units ELSE f.iob_units END") + " AS iob_units",
            r6(f"CASE WHEN {s} THEN 0.0 ELSE f.basal_rate END") + " AS basal_rate",
            f"CAST(CASE WHEN {s} THEN 1 ELSE f.is_suspended END AS BIGINT) AS is_suspended"]
    for m in (15, 30, 60, 120):
        cols.append(r6(f"CASE WHEN {c} THEN f.carbs_sum_{m}m + a.grams ELSE f.carbs_sum_{m}m END") + f" AS carbs_sum_{m}m")
    cols.append(r6(f"CASE WHEN {c} THEN 0.0 ELSE f.minutes_since_carbs END") + " AS minutes_since_carbs")
    for m in (15, 30, 60, 120):
        cols.append(r6(f"CASE WHEN {b} THEN f.bolus_sum_{m}m + a.units ELSE f.bolus_sum_{m}m END") + f" AS bolus_sum_{m}m")
    cols.append(r6(f"CASE WHEN {b} THEN 0.0 ELSE f.minutes_since_bolus END") + " AS minutes_since_bolus")
    return with_ctes(feature_ctes() + [f"a(ix, kind, units, minutes, grams, label) AS (VALUES {vals})"],
                     "SELECT f.user_id, f.timestamp, " + ", ".join(cols)
                     + " FROM ft f, a WHERE f.glucose_mg_dl IS NOT NULL")


_COMPLETE = ["glucose_mg_dl", "iob_units", "basal_rate", "carbs_sum_120m", "minutes_since_bolus"]
LATEST_SQL = with_ctes(feature_ctes(), "SELECT user_id, timestamp, " + ", ".join(f"{r6(c)} AS {c}" for c in _COMPLETE)
                       + " FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC) AS rn FROM ft WHERE "
                       + " AND ".join(f"{c} IS NOT NULL" for c in _COMPLETE) + ") WHERE rn = 1")

_RD_OUT = f"user_id, timestamp, {r6('glucose_mg_dl')} AS glucose_mg_dl, {r6('trend_arrow_encoded')} AS trend_arrow_encoded"
DECIMATE_SQL = with_ctes(BASE, f"""SELECT {_RD_OUT} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n FROM rd)
WHERE pos % greatest(1, n // 5) = 0""")
TOPK_SQL = with_ctes(BASE, f"SELECT {_RD_OUT} FROM rd ORDER BY timestamp DESC, seq DESC LIMIT 50")
TOPK_SERIES_SQL = with_ctes(BASE, f"""SELECT {_RD_OUT}, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC) AS BIGINT) AS rank FROM rd)
WHERE rank <= 3""")
DATE_FILTER_SQL = with_ctes(BASE, f"""SELECT {_RD_OUT} FROM rd
WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-13'""")


def markers_sql(us: int = US60) -> str:
    return with_ctes(timeline_ctes(us), f"""SELECT user_id, timestamp, {r6('bolus_units')} AS bolus_units, is_suspended
FROM tl WHERE bolus_units > 0 OR is_suspended""")


DERIVE_SQL = with_ctes(BASE, f"""SELECT user_id, timestamp, 'meal' AS kind, {r6('carbs_g')} AS carbs_g, '' AS notes,
  'tandem_bolus' AS source FROM pump WHERE event_type = 'bolus' AND carbs_g IS NOT NULL AND carbs_g > 0""")

STREAMS = """b AS (
  SELECT user_id, event_id, ts, k,
         CASE WHEN k % 4 = 0 THEN 0.0 ELSE value END AS insulinDelivered, value AS requestedInsulin,
         CASE WHEN k % 2 = 0 THEN CAST(k * 6 AS DOUBLE) END AS duration,
         CASE WHEN k >= 90 THEN CAST(k AS DOUBLE) / 10.0 END AS iob,
         CASE WHEN k % 3 = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS carbsRequest,
         CAST(k % 7 AS DOUBLE) AS carbAmount,
         CASE WHEN k % 5 = 0 THEN value END AS bgValue, value AS targetBG
  FROM ev WHERE event_type = 'purchase'),
ba AS (
  SELECT user_id, event_id, ts, CASE WHEN k % 5 = 0 THEN 0.0 ELSE value END AS basalRate,
         CASE WHEN k % 2 = 0 THEN NULL ELSE 5.0 END AS duration
  FROM ev WHERE event_type = 'click'),
e AS (
  SELECT user_id, event_id, ts,
         CASE WHEN k % 4 = 0 THEN 'pumpingSuspended' WHEN k % 4 = 1 THEN 'pumpingResumed'
              WHEN k % 4 = 2 THEN 'ControlIQ basal increase' END AS eventType,
         value, CASE WHEN k % 3 = 0 THEN 0.0 ELSE value END AS duration
  FROM ev WHERE event_type = 'signup')"""

PUMP_STREAMS_SQL = with_ctes([EV, STREAMS], f"""SELECT user_id, event_id,
  CASE WHEN k % 6 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts END AS timestamp, 'bolus' AS event_type,
  {r6('coalesce(nullif(insulinDelivered, 0), nullif(requestedInsulin, 0), 0.0)')} AS value,
  {r6('CASE WHEN coalesce(duration, 0.0) <> 0 THEN duration / 60.0 ELSE 0.0 END')} AS duration_minutes,
  {r6('iob')} AS iob_units, {r6('coalesce(nullif(carbsRequest, 0), carbAmount)')} AS carbs_g,
  {r6('coalesce(nullif(bgValue, 0), targetBG)')} AS bg_at_bolus,
  CAST(NULL AS DOUBLE) AS food_insulin, CAST(NULL AS DOUBLE) AS correction_insulin FROM b
UNION ALL
SELECT user_id, event_id, ts, 'basal', {r6('coalesce(nullif(basalRate, 0), 0.0)')},
  {r6('coalesce(nullif(duration, 0), 5.0)')}, NULL, NULL, NULL, NULL, NULL FROM ba
UNION ALL
SELECT user_id, event_id, ts,
  CASE WHEN contains(lower(coalesce(eventType, '')), 'suspend') THEN 'suspend' ELSE 'control_iq_action' END,
  {r6('coalesce(nullif(value, 0), 0.0)')}, {r6('coalesce(nullif(duration, 0), 0.0)')}, NULL, NULL, NULL, NULL, NULL
FROM e""")

FIRST_TRUTHY_SQL = with_ctes([EV, STREAMS], f"""SELECT user_id, event_id,
  {r6('coalesce(nullif(insulinDelivered, 0), nullif(requestedInsulin, 0), 0.0)')} AS dose,
  {r6('coalesce(nullif(carbsRequest, 0), carbAmount)')} AS carbs_g,
  {r6('coalesce(nullif(bgValue, 0), targetBG)')} AS bg FROM b""")

COUNTERS_SQL = with_ctes(BASE, """SELECT 'raw_events' AS stage, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts,
  CAST(count_if(event_type = 'error') AS BIGINT) AS carb_tagged FROM ev
UNION ALL SELECT 'clean_readings', count(*), min(timestamp), max(timestamp), 0 FROM rd
UNION ALL SELECT 'pump_events', count(*), min(timestamp), max(timestamp),
  CAST(count_if(event_type = 'bolus' AND carbs_g > 0) AS BIGINT) FROM pump""")

_LAG_DELTA = [f"glucose_lag_{m}m" for m in (5, 10, 15, 30, 60, 120, 240)] + \
    [f"glucose_delta_{m}m" for m in (5, 15, 30)]
_ROLLING = [x for m in (15, 30, 60, 120) for x in (f"glucose_mean_{m}m", f"glucose_std_{m}m", f"glucose_slope_{m}m")]
_RECENCY = [f"carbs_sum_{m}m" for m in (15, 30, 60, 120)] + ["minutes_since_carbs"] + \
    [f"bolus_sum_{m}m" for m in (15, 30, 60, 120)] + ["minutes_since_bolus"]

for _name, _sql in {
    "bin_sum_1h": tl_cols_sql(US60, ["bolus_units", "carbs_g"]),
    "bin_max_ffill_1h": tl_cols_sql(US60, ["iob_units"]),
    "asof_basal_1h": tl_cols_sql(US60, ["basal_rate"]),
    "interval_flag_5m": tl_cols_sql(US5, ["is_suspended", "control_iq_active"],
                                    "WHERE is_suspended OR control_iq_active"),
    "decay_projection_1h": decay_only_sql(US60),
    "lag_delta_features": feature_select(_LAG_DELTA),
    "rolling_features": feature_select(_ROLLING),
    "recency_features": feature_select(_RECENCY),
    "calendar_features": feature_select(["hour_sin", "hour_cos", "dow", "is_weekend"]),
    "labels": feature_select(["target_30m", "target_60m"]),
    "gap_report": GAP_SQL,
    "grid_regularity": REGULARITY_SQL,
    "time_in_range": TIR_SQL,
    "profile_nulls": profile_sql(),
    "activity_summary": activity_sql(),
    "value_counts": VALUE_COUNTS_SQL,
    "keep_last_dedupe": KEEP_LAST_SQL,
    "keep_first_dedupe": KEEP_FIRST_SQL,
    "union_sources": UNION_SOURCES_SQL,
    "upsert_readings": UPSERT_SQL,
    "parse_readings": PARSE_SQL,
    "encode_trend": ENCODE_SQL,
    "chrono_split": SPLIT_SQL,
    "regression_metrics": METRICS_SQL,
    "hypo_recall": HYPO_SQL,
    "alerts": ALERTS_SQL,
    "forecast_truth_join": JOIN_SQL,
    "trailing_metrics": TRAILING_SQL,
    "rolling_mae_6h": ROLLING_SQL,
    "drift_status": DRIFT_SQL,
    "backtest_mae": BACKTEST_SQL,
    "scenario_rewrite": scenario_sql(),
    "latest_complete_row": LATEST_SQL,
    "decimate": DECIMATE_SQL,
    "topk_recent": TOPK_SQL,
    "topk_recent_per_series": TOPK_SERIES_SQL,
    "date_filter": DATE_FILTER_SQL,
    "event_markers": markers_sql(),
    "derive_treatments": DERIVE_SQL,
    "union_pump_streams": PUMP_STREAMS_SQL,
    "first_truthy": FIRST_TRUTHY_SQL,
    "stage_counters": COUNTERS_SQL,
}.items():
    register(_name, _sql)

register("stream_equals_batch", resample_mean_sql(US5))
register("refresh_equals_batch", ORACLE["features"])
register("refresh_late_pump", ORACLE["features"])
register("stream_forecast_truth", JOIN_SQL)
register("alerts_by_series", with_ctes([EV], f"""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_id ORDER BY a.grp) - 1 AS BIGINT) AS alert_ix,
  a.type, a.severity, a.message FROM (
  SELECT user_id, event_id, unnest([
    CASE WHEN cur <= 39 THEN {{'grp': 1, 'type': 'sensor_extreme', 'severity': 'critical', 'message': 'Sensor reads LOW (≤39 mg/dL). Confirm with a fingerstick.'}}
         WHEN cur >= 401 THEN {{'grp': 1, 'type': 'sensor_extreme', 'severity': 'critical', 'message': 'Sensor reads HIGH (≥401 mg/dL). Confirm with a fingerstick.'}} END,
    CASE WHEN age > stale THEN {{'grp': 2, 'type': 'stale_data', 'severity': 'warn',
         'message': 'No CGM reading in ' || {f0('age')} || ' min — predictions are based on outdated data.'}} END,
    CASE WHEN pred < low THEN {{'grp': 3, 'type': 'predicted_low', 'severity': 'critical',
         'message': 'Predicted ' || {f0('pred')} || ' mg/dL in 30 min (below ' || low || '). Consider pre-treating.'}}
         WHEN pred > high THEN {{'grp': 3, 'type': 'predicted_high', 'severity': 'warn',
         'message': 'Predicted ' || {f0('pred')} || ' mg/dL in 30 min (above ' || high || '). Possible correction window.'}} END,
    CASE WHEN delta <= -fall THEN {{'grp': 4, 'type': 'predicted_drop', 'severity': 'warn',
         'message': 'Predicted drop of ' || {f0('-delta')} || ' mg/dL in the next 30 min. Watch for an oncoming low.'}}
         WHEN delta >= 60 THEN {{'grp': 4, 'type': 'predicted_rise', 'severity': 'info',
         'message': 'Predicted rise of ' || {f0('delta')} || ' mg/dL in the next 30 min. Likely a carb-driven spike.'}} END]) AS a
  FROM (SELECT user_id, event_id, value AS cur, value * k / 50.0 AS pred, (value * k / 50.0) - value AS delta,
               (epoch_us(ts + to_minutes(k)) - epoch_us(ts)) / 60000000.0 AS age,
               CASE WHEN user_id % 3 <> 0 THEN 40 + user_id % 50 ELSE 70 END AS low,
               CASE WHEN user_id % 3 <> 0 AND user_id % 2 = 0 THEN 100 + user_id % 70 ELSE 250 END AS high,
               CASE WHEN user_id % 3 <> 0 AND user_id % 5 = 0 THEN 30 ELSE 15 END AS stale,
               CASE WHEN user_id % 3 <> 0 THEN 20 ELSE 50 END AS fall FROM ev WHERE event_type = 'view')) WHERE a IS NOT NULL"""))

register("export_csv_roundtrip", with_ctes(BASE, f"""SELECT user_id, timestamp,
  {r6("CASE WHEN seq % 3 = 0 THEN 200.0 + seq % 7 WHEN glucose_mg_dl < 40 THEN 39.0 WHEN glucose_mg_dl > 400 THEN 401.0 ELSE glucose_mg_dl END")}
    AS glucose_mg_dl,
  {r6('trend_arrow_encoded')} AS trend_arrow_encoded
FROM rd"""))

register("date_filter_partitioned", DATE_FILTER_SQL)

register("sensor_feed", with_ctes([EV], f"""SELECT user_id, ts AS timestamp, {r6('value')} AS glucose_mg_dl,
  {r6("CASE k % 8 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN -1 WHEN 6 THEN -2 WHEN 7 THEN -2 END")}
    AS trend_arrow_encoded FROM ev WHERE event_type = 'view'"""))

# a series counts with pump events alone: the survey's J1 takes readings UNION pump events
register("grid_pump_only", with_ctes([EV], f"""SELECT user_id, make_timestamp(unnest(range(lo // {US60}, (hi + {US60} - 1) // {US60} + 1)) * {US60}) AS timestamp
FROM (SELECT user_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM ev
      WHERE event_type IN ('purchase', 'click', 'signup') OR (event_type = 'view' AND user_id % 2 = 0) GROUP BY user_id)"""))

register("alerts_retained", with_ctes([EV], """SELECT user_id, event_id, alert_ix, type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, alert_ix DESC) AS rn FROM (
    SELECT user_id, event_id, ts, CAST(row_number() OVER (PARTITION BY event_id ORDER BY g) - 1 AS BIGINT) AS alert_ix, type FROM (
      SELECT user_id, event_id, date_trunc('day', ts) AS ts, 1 AS g, 'sensor_extreme' AS type FROM ev
      WHERE event_type = 'view' AND (value <= 39 OR value >= 401)
      UNION ALL SELECT user_id, event_id, date_trunc('day', ts), 2, 'stale_data' FROM ev
      WHERE event_type = 'view' AND k > 15
      UNION ALL SELECT user_id, event_id, date_trunc('day', ts), 3, 'predicted_low' FROM ev
      WHERE event_type = 'view' AND value * k / 50.0 < 80
      UNION ALL SELECT user_id, event_id, date_trunc('day', ts), 3, 'predicted_high' FROM ev
      WHERE event_type = 'view' AND value * k / 50.0 >= 80 AND value * k / 50.0 > 250
      UNION ALL SELECT user_id, event_id, date_trunc('day', ts), 4, 'predicted_drop' FROM ev
      WHERE event_type = 'view' AND value * k / 50.0 - value <= -50
      UNION ALL SELECT user_id, event_id, date_trunc('day', ts), 4, 'predicted_rise' FROM ev
      WHERE event_type = 'view' AND value * k / 50.0 - value >= 60)))
WHERE rn <= 10"""))

register("compacted_alerts", ORACLE["alerts_retained"])
_LANDED = ["timestamp < TIMESTAMP '2024-01-20'", "timestamp >= TIMESTAMP '2024-01-15'", "seq % 17 = 0", "seq % 5 = 1", "seq % 3 = 0"]
register("compacted_upsert", with_ctes(BASE, f"""SELECT user_id, timestamp, {r6('glucose_mg_dl')} AS glucose_mg_dl,
  {r6('trend_arrow_encoded')} AS trend_arrow_encoded, CAST(batch AS BIGINT) AS batch
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, timestamp ORDER BY batch DESC, seq DESC) AS rn FROM (
  {" UNION ALL ".join(f"SELECT user_id, timestamp, glucose_mg_dl + {i} AS glucose_mg_dl, trend_arrow_encoded, seq, {i} AS batch FROM rd WHERE {c}" for i, c in enumerate(_LANDED))}))
WHERE rn = 1"""))

# ---------------------------------------------------------- model queries
US6H = 6 * US60  # the model queries' grid; every event's value is a reading
_DENSE = RD.replace(" WHERE event_type = 'view'", "")
MODEL_FT = [_DENSE if c == RD else c for c in timeline_ctes(US6H)] + feature_ctes()[-1:]
_NEWEST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC) AS rn
  FROM ft WHERE glucose_mg_dl IS NOT NULL AND iob_units IS NOT NULL) WHERE rn = 1)"""
_PARTS = """parts AS (SELECT *, CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                     WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) - 1 AS pos,
               count(*) OVER (PARTITION BY user_id) AS n FROM ft))"""


def _scaled(name: str) -> str:
    """A 5-minute feature's name on the 6-hour grid."""
    head, _, tail = name.rpartition("_")
    return f"{head}_{int(tail[:-1]) * 72}m" if tail[:-1].isdigit() and tail.endswith("m") else name


register("latest_complete_all", with_ctes(MODEL_FT, f"""SELECT s.user_id, f.timestamp, f.timestamp IS NOT NULL AS found,
  {r6('f.glucose_mg_dl')} AS glucose_mg_dl
FROM (SELECT DISTINCT user_id FROM ft) s LEFT JOIN (
  SELECT user_id, timestamp, glucose_mg_dl, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC) AS rn FROM ft
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in FEATURE_NAMES)}) f ON f.user_id = s.user_id AND f.rn = 1"""))
register("model_split_counts", with_ctes(MODEL_FT + [_PARTS], " UNION ALL ".join(
    f"SELECT split, count(*) AS n_rows, count({c}) AS n_labelled, count(*) AS n_scored, '{_scaled(c)}' AS target FROM parts GROUP BY split"
    for c in ("target_30m", "target_60m"))))
register("latest_prediction_check", with_ctes(MODEL_FT + [_NEWEST], f"""SELECT user_id, timestamp AS as_of,
  {r6('glucose_mg_dl')} AS current_glucose, true AS change_adds_up FROM last"""))
register("contributions_check", with_ctes(MODEL_FT, f"""SELECT user_id, count(*) AS n_rows,
  CAST({len(FEATURE_NAMES)} AS BIGINT) AS n_features, count(*) AS n_additive FROM ft GROUP BY user_id"""))
register("importance_check", "SELECT feature, count(*) > 0 AS nonnegative FROM events, unnest(["
         + ", ".join(f"'{_scaled(c)}'" for c in FEATURE_NAMES) + "]) AS t(feature) GROUP BY feature")
register("local_explanation_check", with_ctes(MODEL_FT + [_NEWEST], """SELECT user_id, timestamp, CAST(8 AS BIGINT) AS n_top,
  true AS in_order, CAST(8 AS BIGINT) AS n_features FROM last"""))
register("whatif_check", with_ctes(MODEL_FT + [_NEWEST], f"""SELECT user_id, timestamp, CAST({len(_ACTIONS)} AS BIGINT) AS n_scenarios,
  CAST({len(_ACTIONS)} AS BIGINT) AS n_scored, CAST(0.0 AS DOUBLE) AS baseline_delta, true AS suspends_alike FROM last"""))
register("explain_sample", with_ctes(MODEL_FT, f"""SELECT user_id, timestamp, {r6('glucose_mg_dl')} AS glucose_mg_dl FROM ft
ORDER BY md5('0|' || user_id || '|' || epoch_us(timestamp)), user_id, timestamp LIMIT 2000"""))
register("drift_from_metrics", with_ctes(DRIFT_BASE + [TRAILING], f"""SELECT user_id, n_scored, {r6('mae_24h')} AS mae_24h,
  (__N_TEST__) AS n_test, true AS trained, true AS ratio_adds_up FROM tm""").replace("__N_TEST__", with_ctes(
      MODEL_FT + [_PARTS], "SELECT count(target_30m) FROM parts WHERE split = 'test'")))

register("profile_nulls_5m", profile_sql(US5))
register("activity_summary_5m", activity_sql(US5))
register("event_markers_5m", markers_sql(US5))

register("treatments_quarantine", with_ctes([EV], f"""SELECT user_id, timestamp, kind, {r6('carbs_g')} AS carbs_g, reason, reason IS NULL AS stored
FROM (SELECT *, CASE WHEN kind IS NULL OR kind = 'walk' THEN 'bad_kind' WHEN carbs_g < 0 THEN 'negative_carbs' END AS reason
      FROM (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END AS timestamp,
                   CASE WHEN event_id % 5 = 0 THEN 'walk' WHEN event_id % 13 <> 0 THEN 'snack' END AS kind,
                   coalesce(CASE WHEN event_id % 7 = 0 THEN -value WHEN event_id % 3 <> 0 THEN value END, 0.0) AS carbs_g
            FROM ev WHERE event_type = 'error'))"""))

register("stored_window", with_ctes(BASE, f"""SELECT user_id, timestamp, {r6('CAST(glucose_mg_dl AS FLOAT)')} AS glucose_mg_dl,
  {r6('trend_arrow_encoded')} AS trend_arrow_encoded, seq
FROM rd WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20'"""))

# the newest forecast of each series in one line, with what the alerts oracle says of it
register("summary_lines", f"""SELECT user_id, 'as_of=' || {TS_TEXT} || '  current=' || {f0('cur')} || '  predict_30m=' || {f0('pred')}
    || '  Δ=' || CASE WHEN pred - cur >= 0 THEN '+' ELSE '' END || {f0('pred - cur')}
    || coalesce('  alerts: ' || (SELECT string_agg(severity || ':' || type, ', ' ORDER BY alert_ix)
                                 FROM ({ORACLE["alerts"]}) a WHERE a.user_id = n.user_id AND a.event_id = n.event_id), '') AS summary
FROM (SELECT user_id, event_id, ts AS cts, value AS cur, value * k / 50.0 AS pred,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM (SELECT event_id, user_id, event_type, value, CAST(ts AS TIMESTAMP) AS ts,
                   TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
      WHERE event_type = 'view') n
WHERE rn = 1""")

register("stream_stale_series", with_ctes([EV], f"""SELECT user_id, 'stale_data' AS type, 'warn' AS severity,
  'No CGM reading in ' || {f0('(now_ms - last_ms) / 60000.0')} || ' min — predictions are based on outdated data.' AS message
FROM (SELECT user_id, epoch_ms(max(ts)) AS last_ms, (SELECT epoch_ms(max(ts)) FROM ev WHERE event_type = 'view') AS now_ms
      FROM ev WHERE event_type = 'view' GROUP BY user_id)
WHERE last_ms + 15 * 60000 < now_ms"""))

register("model_reload_check", with_ctes(MODEL_FT, """SELECT user_id, count(*) AS n_rows, count(*) AS n_same, true AS same_features
FROM ft GROUP BY user_id"""))
