"""Scalar column helpers (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """String/number -> DOUBLE, NULL when unparsable (never raises under ANSI)."""
    return col_(c).try_cast("double")


def to_int_or_zero(c) -> Column:
    """String -> BIGINT truncated toward zero, 0 when unparsable/NaN/inf/missing."""
    d = col_(c).try_cast("double")
    return F.coalesce(F.when(~F.isnan(d), d.try_cast("bigint")), F.lit(0).cast("bigint"))


def full_name(first, second) -> Column:
    """trim(first || ' ' || second) with a missing part treated as ''."""
    return F.trim(F.concat_ws(" ", F.coalesce(col_(first), F.lit("")),
                              F.coalesce(col_(second), F.lit(""))))


# Date, optionally with time, fraction and zone; what doesn't fit is no timestamp.
_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_utc(c) -> Column:
    """'yyyy-MM-dd', optionally with '[T ]HH:mm[:ss[.f]]' and 'Z' or an offset -> TIMESTAMP; bad -> NULL.

    Strings without a zone are read as UTC whatever the session time zone is.
    """
    raw = col_(c).cast("string")
    no_seconds = (F.length(raw) >= 16) & (F.substring(raw, 17, 1) != ":")
    s = F.when(no_seconds, F.concat(F.substring(raw, 1, 16), F.lit(":00"), F.substr(raw, F.lit(17)))).otherwise(raw)
    zone = F.when(F.length(s) == 10, F.lit(" 00:00:00Z")).when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit("")).otherwise(F.lit("Z"))
    return F.when(raw.rlike(_TIMESTAMP), F.concat(s, zone).try_cast("timestamp"))


def utc_wall(c) -> Column:
    """An instant (TIMESTAMP) as its UTC wall-clock TIMESTAMP_NTZ, session-zone independent."""
    return F.to_utc_timestamp(col_(c), F.current_timezone()).cast("timestamp_ntz")


def safe_div(a, b) -> Column:
    """a / b when b > 0 else NULL (plain division by zero raises under ANSI)."""
    return F.when(col_(b) > 0, col_(a) / col_(b))


def flag(cond: Column) -> Column:
    """Boolean condition as DOUBLE 0/1 with a missing input counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def age_days(then, as_of) -> Column:
    """Elapsed days between two timestamps, fractional."""
    return F.timestamp_diff("MICROSECOND", col_(then), col_(as_of)) / F.lit(86400e6)


def r6(c) -> Column:
    """Round to 6 places; normalises -0.0 to 0.0 (the oracle compares values)."""
    return F.round(col_(c).cast("double"), 6) + F.lit(0.0)
