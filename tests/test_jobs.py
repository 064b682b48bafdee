"""Landing and training jobs end to end on small inputs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import matrix as mx
from tessera.operators.model import ForecastModel
from tessera.plans.jobs import landing_job, train_job
from tessera.session import scratch_path
from tessera.sources.splits import write_splits


def test_landing_job(spark):
    path = scratch_path(spark, "landing-job")
    spark.createDataFrame([('{"id": 1, "status": "a", "team": 3}',), ('{"id": 2, "status": "u", "team": 4}',),
                           ('{"id": 3, "team"',), ('{"id": 4, "team": 5}',)], "value string").write.text(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType()),
                           T.StructField("team", T.LongType())])
    out = landing_job(spark, path, schema, scratch_path(spark, "bronze-job"), scratch_path(spark, "quar"),
                      snapshot="20240101T000000Z")
    assert out == {"snapshot_ts": "20240101T000000Z", "landed": 2, "quarantined": 1}


def test_landing_job_without_a_good_record(spark):
    path = scratch_path(spark, "landing-bad")
    spark.createDataFrame([("{",), ("",)], "value string").write.text(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
    out = landing_job(spark, path, schema, scratch_path(spark, "bronze-bad"), scratch_path(spark, "quar-bad"))
    assert (out["landed"], out["quarantined"]) == (0, 1)


def test_train_job_writes_model_and_record(spark):
    rng = np.random.default_rng(0)
    rows = [(p, gw, float(rng.poisson(3)), float(rng.normal(3, 1)), float(rng.uniform(4, 9)))
            for p in range(60) for gw in range(1, 16)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["player_id", "gw", "total_points", "f_roll3", "cost"]))
    base = scratch_path(spark, "splits-job")
    write_splits(mx.temporal_split(df, 12), base, "v1")
    model_path, exp = scratch_path(spark, "model-job"), scratch_path(spark, "exp-job")
    rec = train_job(spark, base, "v1", model_path, exp, params={"max_iter": 5}, qrf_trees=3).first()
    assert rec.metrics.rmse >= rec.metrics.mae and len(rec.per_gw) == 4 and len(rec.top_features) == 4
    loaded = ForecastModel.load(spark, model_path)
    assert loaded.feature_cols == ["f_roll3", "cost"]
    assert spark.read.json(exp).count() == 1
