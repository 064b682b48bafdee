"""Streaming latest-snapshot table: two runs, restart from the checkpoint, third run."""

import os

from pyspark.sql import types as T

from tessera.session import scratch_path
from tessera.streaming.latest import latest_snapshot_stream, read_latest

SCHEMA = T.StructType([T.StructField("entity", T.StringType()), T.StructField("entity_id", T.LongType()),
                       T.StructField("n", T.LongType()), T.StructField("snapshot_ts", T.StringType())])


def _land(spark, landing, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").json(os.path.join(landing, name))


def test_latest_stream_with_restart(spark):
    landing, table, ckpt = (scratch_path(spark, n) for n in ("land", "latest", "ckpt"))
    _land(spark, landing, [("p", 1, 10, "20240101T000000Z"), ("p", 2, 20, "20240101T000000Z")], "run1")
    _land(spark, landing, [("p", 1, 11, "20240201T000000Z")], "run2")
    q = latest_snapshot_stream(spark, landing + "/*", SCHEMA, table, ckpt)
    q.awaitTermination()
    got = {r.entity_id: (r.n, r.snapshot_ts) for r in read_latest(spark, table).collect()}
    assert got == {1: (11, "20240201T000000Z"), 2: (20, "20240101T000000Z")}
    # a late, older snapshot must not win; a newer one for key 2 must
    _land(spark, landing, [("p", 1, 9, "20231201T000000Z"), ("p", 2, 21, "20240301T000000Z")], "run3")
    q = latest_snapshot_stream(spark, landing + "/*", SCHEMA, table, ckpt)
    q.awaitTermination()
    got = {r.entity_id: (r.n, r.snapshot_ts) for r in read_latest(spark, table).collect()}
    assert got == {1: (11, "20240201T000000Z"), 2: (21, "20240301T000000Z")}
