"""Output typing shared by catalogue queries: timestamps as TIMESTAMP_NTZ
(wall clock in UTC, like DuckDB's TIMESTAMP), doubles rounded to 6 places,
integral counts as BIGINT."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def round_half_away(c, digits: int = DIGITS):
    """``round(x * 10^d) / 10^d`` with halves away from zero (DuckDB's
    rounding of DOUBLE), in small arithmetic that stays in generated code
    (Spark's ``round`` on doubles goes through BigDecimal per value).
    NaN and infinities pass through; -0.0 becomes 0.0."""
    m = F.lit(float(10 ** digits))
    y = c * m
    r = F.rint(y)
    return F.when(F.abs(y - r) == F.lit(0.5), y + F.signum(y) * F.lit(0.5)).otherwise(r) / m + F.lit(0.0)


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round_half_away(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
