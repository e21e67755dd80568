"""Column expressions (JVM side, codegen friendly).

P1 reading parse, P2 trend-label encode, P3 rate-of-change to trend,
P5 timestamp parse to UTC, P10 calendar encode, P17 exponential decay,
P18 scenario labels, R3 number formatting, plus time-bin arithmetic that
the grid operators share.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Reading sentinels for the literal strings "Low" / "High".
LOW_SENTINEL = 39.0
HIGH_SENTINEL = 401.0
# Trend-arrow label -> code (labels lower-cased, spaces removed).
TREND_CODES = {
    "doubledown": -2, "singledown": -2, "fortyfivedown": -1, "flat": 0,
    "none": 0, "fortyfiveup": 1, "singleup": 2, "doubleup": 2,
}
# Integer feed trend 0-7 -> code (0 = no trend).
FEED_TREND_CODES = {0: None, 1: 2, 2: 2, 3: 1, 4: 0, 5: -1, 6: -2, 7: -2}
# Insulin decay: time constant and projection horizon in minutes.
IOB_TAU_MIN = 240.0
IOB_HORIZON_MIN = 1200
# ---------------------------------------------------------------------------

MICROS_PER_MINUTE = 60_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c) -> Column:
    c = col_(c)
    return F.nanvl(c, F.lit(None).cast("double"))


#: a plain number; a JVM cast would also take type suffixes as in '120d'
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_or_null(c) -> Column:
    """Text -> double; anything that is not a plain number -> NULL."""
    s = F.regexp_replace(col_(c).cast("string"), r"^\s+|\s+$", "")
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


# ---- P1 -------------------------------------------------------------------
def parse_reading(c) -> Column:
    """'Low' -> 39, 'High' -> 401, ''/nan/none -> NULL, unparsable -> NULL."""
    s = F.regexp_replace(col_(c).cast("string"), r"^\s+|\s+$", "")
    low = F.lower(s)
    return (F.when(s.isNull() | (s == "") | low.isin("nan", "none"), F.lit(None).cast("double"))
            .when(low == "low", F.lit(LOW_SENTINEL))
            .when(low == "high", F.lit(HIGH_SENTINEL))
            .otherwise(number_or_null(s)))


# ---- P2 -------------------------------------------------------------------
def encode_trend(c) -> Column:
    """Trend label -> -2..2; exact 'None' is flat, other spellings of none are missing."""
    raw = col_(c).cast("string")
    s = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), " ", "")
    lookup = F.create_map(*[x for k, v in TREND_CODES.items() for x in (F.lit(k), F.lit(float(v)))])
    return (F.when(raw == "None", F.lit(0.0))
            .when(raw.isNull() | (s == "") | s.isin("nan", "none"), F.lit(None).cast("double"))
            .otherwise(F.element_at(lookup, s)))


# ---- P3 -------------------------------------------------------------------
def rate_to_trend(c) -> Column:
    """Rate of change (mg/dL/min): clip to [-2, 2], round half-even; bad -> NULL."""
    r = number_or_null(c)
    return F.when(r.isNotNull(), F.bround(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), r)), 0))


def feed_trend(c) -> Column:
    """Integer feed trend (0-7, NULL = 0) -> code."""
    lookup = F.create_map(*[x for k, v in FEED_TREND_CODES.items()
                            for x in (F.lit(k), F.lit(None if v is None else float(v)).cast("double"))])
    return F.element_at(lookup, F.coalesce(col_(c).cast("int"), F.lit(0)))


# ---- P5 -------------------------------------------------------------------
_AWARE = r"(Z|z|[+-]\d{2}(:?\d{2})?)$"


def to_utc(c, source_tz: str = "UTC") -> Column:
    """Parse to a UTC instant: zone-aware text is converted, naive text is
    read in ``source_tz`` (default UTC); unparsable -> NULL."""
    c = col_(c)
    s = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    parsed = F.try_to_timestamp(s)
    if source_tz.upper() in ("UTC", "Z"):
        return parsed
    return F.when(s.rlike(_AWARE), parsed).otherwise(F.to_utc_timestamp(parsed, source_tz))


# ---- time bins --------------------------------------------------------------
def micros(ts) -> Column:
    """Microseconds since epoch of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(col_(ts).cast("timestamp"))


def floor_bin(ts, freq_minutes: int) -> Column:
    step = int(freq_minutes) * MICROS_PER_MINUTE
    us = micros(ts)
    return ((us - F.pmod(us, F.lit(step))) / F.lit(step)).cast("long")


def ceil_bin(ts, freq_minutes: int) -> Column:
    step = int(freq_minutes) * MICROS_PER_MINUTE
    us = micros(ts)
    return floor_bin(ts, freq_minutes) + F.when(F.pmod(us, F.lit(step)) != 0, 1).otherwise(0)


def bin_ceil_of_micros(us: Column, freq_minutes: int) -> Column:
    step = int(freq_minutes) * MICROS_PER_MINUTE
    return ((us - F.pmod(us, F.lit(step))) / F.lit(step)).cast("long") + \
        F.when(F.pmod(us, F.lit(step)) != 0, 1).otherwise(0)


def bin_to_ts(b, freq_minutes: int) -> Column:
    return F.timestamp_micros(col_(b) * F.lit(int(freq_minutes) * MICROS_PER_MINUTE))


def block_of(b, bins_per_block: int) -> Column:
    b = col_(b)
    return ((b - F.pmod(b, F.lit(bins_per_block))) / F.lit(bins_per_block)).cast("long")


def minutes_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_MINUTE))


# ---- P10 --------------------------------------------------------------------
def calendar_columns(ts) -> dict[str, Column]:
    ts = col_(ts)
    hour = F.hour(ts) + F.minute(ts) / F.lit(60.0)
    ang = F.lit(2 * math.pi) * hour / F.lit(24.0)
    dow = F.weekday(ts)  # Monday = 0
    return {
        "hour_sin": F.sin(ang),
        "hour_cos": F.cos(ang),
        "dow": dow.cast("byte"),
        "is_weekend": (dow >= 5).cast("byte"),
    }


# ---- P17 --------------------------------------------------------------------
def decay(dose, elapsed_min, tau_min: float = IOB_TAU_MIN) -> Column:
    """What is left of ``dose`` after ``elapsed_min`` minutes."""
    return col_(dose) * F.exp(-col_(elapsed_min) / F.lit(float(tau_min)))


# ---- P18 / R3 -----------------------------------------------------------------
def fmt_g(c) -> Column:
    """Python ``format(x, 'g')``: 6 significant digits, trailing zeros dropped."""
    s = F.format_string("%.6g", col_(c).cast("double"))
    s = F.regexp_replace(s, r"(\.\d*?[1-9])0+(e|$)", "$1$2")
    return F.regexp_replace(s, r"\.0+(e|$)", "$1")


def fmt_0f(c) -> Column:
    """Python ``f'{x:.0f}'`` (half-even, keeps '-0')."""
    c = col_(c).cast("double")
    r = F.bround(c, 0)
    return F.when(c.isNull(), F.lit("nan")).when((c < 0) & (r == 0), F.lit("-0")) \
        .otherwise(r.cast("long").cast("string"))


def fmt_fixed(c, digits: int) -> Column:
    """Python ``f'{x:.Nf}'`` for N >= 1 (half-even on the printed value)."""
    return F.format_string(f"%.{digits}f", F.bround(col_(c).cast("double"), digits))
