"""Refresh planning against a fetch log (TTL freshness), as semi / anti joins.

A fetch log row (entity_type, entity_id, fetched_at) is fresh when
age = as_of - fetched_at is below the TTL; a NULL fetched_at (invalidated
entry) is never fresh.  ``force`` turns every request into a miss.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import age_days, utc_wall

# TTLs in days per entity kind.
TTL_DAYS = {"historical": 365.0, "current": 1.0, "league": 7.0}


def fresh_log(log: DataFrame, as_of: datetime, ttl_days: float) -> DataFrame:
    """Newest fetch per entity that is still within the TTL (aggregate, then filter).

    Ages are taken between UTC wall-clock values (``as_of`` is a naive UTC
    time), so the result does not depend on the session time zone.
    """
    fetched = F.col("fetched_at")
    if isinstance(log.schema["fetched_at"].dataType, T.TimestampType):
        fetched = utc_wall(fetched)
    newest = log.groupBy("entity_id").agg(F.max(fetched).alias("fetched_at"))
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return newest.filter(age_days("fetched_at", now) < ttl_days)


def refresh_plan(requested: DataFrame, log: DataFrame, as_of: datetime, ttl_days: float,
                 force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of the requested ids; misses are the ids to fetch again."""
    ids = requested.select("entity_id").distinct()
    if force:
        return ids.limit(0), ids
    fresh = fresh_log(log, as_of, ttl_days).select("entity_id")
    return ids.join(fresh, "entity_id", "left_semi"), ids.join(fresh, "entity_id", "left_anti")
