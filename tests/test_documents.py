"""Nested player documents read as multi-line JSON, flattened with the allow-list."""

import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import context as ctxop
from tessera.operators import flatten as fl
from tessera.session import scratch_path

SS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
DOC_SCHEMA = T.StructType([T.StructField("history", SS), T.StructField("fixtures", SS),
                           T.StructField("history_past", SS)])


def _write_docs(base):
    os.makedirs(base, exist_ok=True)
    doc = {"history": [
        {"element": 7, "round": 25, "kickoff_time": "2025-02-15T15:00:00Z", "total_points": 2, "minutes": 90,
         "influence": "5.0", "was_home": True, "value": 55, "expected_goals": "0.12"},
        {"element": 7, "round": 26, "kickoff_time": "2025-02-22T15:00:00Z", "total_points": 6, "minutes": 30,
         "influence": "12.4", "was_home": False, "value": 55},
        {"element": 7, "round": 26, "kickoff_time": "2025-02-25T19:30:00Z", "total_points": 1, "minutes": 0,
         "influence": "bad", "was_home": True, "value": 56}],
        "fixtures": [{"id": 301, "event": 27, "team_h": 3, "team_a": 9, "team_h_difficulty": 2, "team_a_difficulty": 4,
                      "finished": False},
                     {"id": 302, "event": None, "team_h": 9, "team_a": 3, "team_h_difficulty": 3,
                      "team_a_difficulty": 3, "finished": False}],
        "history_past": []}
    with open(os.path.join(base, "player_7_20250301T000000Z.json"), "w") as fh:
        json.dump(doc, fh, indent=2)
    with open(os.path.join(base, "player_8_20250301T000000Z.json"), "w") as fh:
        json.dump({"history": [], "fixtures": [], "history_past": []}, fh, indent=2)


def test_multiline_documents_flatten(spark):
    base = scratch_path(spark, "raw-docs").removeprefix("file:")
    _write_docs(base)
    docs = (spark.read.schema(DOC_SCHEMA).option("multiLine", True).json(base)
            .select(F.regexp_extract(F.col("_metadata.file_name"), r"player_(\d+)_", 1).cast("bigint").alias("doc"),
                    "history", "fixtures"))
    cols = {"round": "bigint", "kickoff_time": "timestamp", "total_points": "double", "minutes": "double",
            "influence": "double", "was_home": "boolean", "value": "double", "expected_goals": "double"}
    h = fl.flatten_history(docs, "doc", "history", cols, key_field="element", rename={"round": "gw"})
    rows = sorted(h.collect(), key=lambda r: r.pos)
    assert [r.gw for r in rows] == [25, 26, 26]                  # double round kept as two rows
    assert rows[0].influence == 5.0 and rows[2].influence is None  # numeric string / bad string
    assert rows[0].expected_goals == 0.12 and rows[1].expected_goals is None  # optional key absent
    assert rows[0].was_home is True and rows[0].doc_key == 7
    assert [r.doc for r in fl.keys_without_rows(docs, "doc", "history").collect()] == [8]
    fx = docs.select(F.explode("fixtures").alias("f")).select(
        *[F.col("f")[c].try_cast("bigint").alias(c) for c in ("id", "event", "team_h", "team_a",
                                                              "team_h_difficulty", "team_a_difficulty")],
        F.col("f")["finished"].try_cast("boolean").alias("finished"))
    sides = ctxop.fixture_sides(fx).collect()
    assert {(r.team_id, r.gw) for r in sides} == {(3, 27), (9, 27)}   # unscheduled fixture dropped
