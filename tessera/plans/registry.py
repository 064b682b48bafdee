"""Query registry: Spark builder + DuckDB oracle SQL per operator.

Result conventions shared by both sides so that value hashes compare:
doubles rounded to 6 places (with -0.0 folded to 0.0), timestamps rendered as
'yyyy-MM-dd HH:mm:ss[.ffffff]' strings, integer keys BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def normalise(df: DataFrame) -> DataFrame:
    exprs = []
    for f in df.schema.fields:
        c = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            e = f"round(CAST({c} AS DOUBLE), 6) + 0D"
        elif isinstance(f.dataType, T.TimestampType):  # an instant: rendered in UTC
            e = f"date_format(to_utc_timestamp({c}, current_timezone()), 'yyyy-MM-dd HH:mm:ss')"
        elif isinstance(f.dataType, T.TimestampNTZType):
            e = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            e = f"CAST({c} AS BIGINT)"
        else:
            e = c
        exprs.append(f"{e} AS {c}")
    return df.selectExpr(*exprs)


def sql_out(inner: str, doubles=(), timestamps=()) -> str:
    """Wrap an oracle query with the same rounding / rendering as ``normalise``."""
    reps = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles]
    reps += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in timestamps]
    if not reps:
        return inner
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM ({inner}) AS _q"
