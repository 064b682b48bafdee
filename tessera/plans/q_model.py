"""Queries: missing-value preparation, boosted-tree fit/predict, calibration,
quantile bands, importance, next-period scoring, experiment record and the
train-and-score build.  Model outputs have no SQL oracle (rows-only check in
the driver); their invariants are tested in pytest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import context as ctxop
from tessera.operators import evaluate as ev
from tessera.operators import matrix as mx
from tessera.operators import model as ml
from tessera.plans import analogue as an
from tessera.plans import builds
from tessera.plans.q_eval import TARGET_GW, VAL_START
from tessera.plans.q_features import KEY, MEASURES, ORDER
from tessera.plans.registry import query, sql_out
from tessera.session import scratch_path, shared_dir


@query("impute_flags", sql_out(f"""SELECT player_id, fixture_id,
  coalesce(minutes, (SELECT quantile_disc(minutes, 0.5) FROM ({an.HISTORY_SQL}) AS q)) AS minutes_imputed,
  CAST(minutes IS NULL AS DOUBLE) AS minutes_missing
FROM ({an.HISTORY_SQL}) AS h""", doubles=["minutes_imputed", "minutes_missing"]))
def q_impute_flags(spark, d):
    """M2: median imputation + missing flag (exact median by rank selection; training takes a 1e-3 sketch)."""
    h = an.history(spark, d).select("player_id", "fixture_id", "minutes")
    return ml.impute_flags(h, ["minutes"], exact=True).select(
        "player_id", "fixture_id", "minutes_imputed", "minutes_missing")


NUMBER = "row_no"  # of a player's rows in order


def matrix(spark, d):
    """The matrix of all rows, also those without a target, numbered by player, with their split."""
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy(*[F.col(o).asc_nulls_last() for o in ORDER]))
    m, cols = builds.feature_build(an.history_with_players(spark, d).withColumn(NUMBER, number), an.fixtures(spark, d),
                                   an.teams(spark, d), measures=MEASURES, extra_ids=("fixture_id", NUMBER), unlabelled=True)
    return mx.temporal_split(m, VAL_START), cols


def fitted(spark, d, parts=("gbt", "calibrator", "quantiles")):
    """Train the parts a query needs, with the default parameters: (model, train, val, matrix of all rows, features)."""
    rows, cols = matrix(spark, d)
    shared_dir(spark)
    # reliable checkpoint in the shared folder: many training jobs and the features of the next period read the
    # matrix, and a lost executor must not replay the whole feature build
    rows = rows.checkpoint(eager=True)
    labelled = rows.drop(NUMBER).filter(F.col("total_points").isNotNull())
    train, val = (labelled.filter(F.col("split") == side) for side in ("train", "val"))
    model = ml.ForecastModel(cols)
    if "gbt" in parts:
        model.fit(train)
    if "calibrator" in parts:
        model.fit_calibrator(val)
    if "quantiles" in parts:
        model.fit_quantiles(train)
    return model, train, val, rows, cols


@query("gbt_fit_predict")
def q_gbt_fit_predict(spark, d):
    """M1/M4: boosted trees (absolute loss, time-based validation slice) -> val predictions."""
    model, _, val, _, _ = fitted(spark, d, ("gbt",))
    return model.predict(val, calibrated=False).select("player_id", "gw", "total_points", "prediction")


@query("isotonic_calibrate")
def q_isotonic_calibrate(spark, d):
    """M3: isotonic calibration of the raw prediction on the validation set."""
    model, _, val, _, _ = fitted(spark, d, ("gbt", "calibrator"))
    return model.predict(val, calibrated=True).select("player_id", "gw", "total_points",
                                                      "raw_prediction", "prediction")


@query("quantile_predict")
def q_quantile_predict(spark, d):
    """M5: P10/P50/P90 of the pooled leaf label distributions of a random forest."""
    model, _, val, _, _ = fitted(spark, d, ("quantiles",))
    return model.predict_quantiles(val.select("fixture_id", *model.feature_cols), ["fixture_id"])


_VAL_SQL = f"""SELECT fixture_id, total_points FROM ({an.HISTORY_SQL}) h WHERE gw >= {VAL_START} AND total_points IS NOT NULL"""


@query("quantile_bands", sql_out(f"""SELECT fixture_id, true AS ordered, true AS inside
FROM ({_VAL_SQL}) v"""))
def q_quantile_bands(spark, d):
    """M5: what every band promises: one row for each row, p10 <= p50 <= p90, all among the labels' range."""
    model, train, val, _, _ = fitted(spark, d, ("quantiles",))
    q = model.predict_quantiles(val.select("fixture_id", *model.feature_cols), ["fixture_id"])
    lo, hi = (train.agg(f("total_points")).scalar() for f in (F.min, F.max))
    return q.select("fixture_id", ((F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))).alias("ordered"),
                    ((F.col("p10") >= lo) & (F.col("p90") <= hi)).alias("inside"))


@query("calibrated_rows", sql_out(f"""SELECT fixture_id, total_points, true AS inside FROM ({_VAL_SQL}) v""", doubles=["total_points"]))
def q_calibrated_rows(spark, d):
    """M3/M4: every validation row is scored once, and its calibrated value is in the range of the labels it was fitted to."""
    model, _, val, _, _ = fitted(spark, d, ("gbt", "calibrator"))
    low, high = (val.agg(f("total_points")).scalar() for f in (F.min, F.max))
    return model.predict(val).select("fixture_id", "total_points", F.col("prediction").between(low, high).alias("inside"))


@query("feature_importance")
def q_feature_importance(spark, d):
    """Top-30 importances of the boosted model."""
    model, _, _, _, _ = fitted(spark, d, ("gbt",))
    return model.feature_importance(spark, 30)


def _next_features(spark, d, rows, cols):
    """Features of the next period, from the written matrix: nothing of the history is built again."""
    ctx = ctxop.fixture_context(ctxop.fixture_sides(an.fixtures(spark, d)))
    return mx.prediction_features(rows.drop("split"), ctx, an.teams(spark, d), TARGET_GW,
                                  feature_cols=cols, numbered=NUMBER)


@query("predict_next")
def q_predict_next(spark, d):
    """Next-period scoring with quantiles, value per cost and spread, sorted."""
    model, _, _, rows, cols = fitted(spark, d)
    return ml.predict_next(model, _next_features(spark, d, rows, cols))


def _record(spark, d):
    model, train, val, _, cols = fitted(spark, d)
    scored = model.predict(val)
    metrics = ev.eval_overall(scored, "prediction")
    per = ev.eval_by_period(scored, "prediction")
    imp = model.feature_importance(spark, 20)
    config = {**model.params, "quantiles": list(model.quantiles), "rounds": model.rounds}
    ranges = {side: list(df.agg(F.min("gw"), F.max("gw")).first()) for side, df in (("train", train), ("val", val))}
    return ml.experiment_record(spark, "run", config, ranges, metrics, per, imp)


@query("experiment_record")
def q_experiment_record(spark, d):
    """Nested experiment row appended as JSON to the shared folder and read back."""
    rec = _record(spark, d)
    path = scratch_path(spark, "experiments")
    rec.write.mode("append").json(path)
    return spark.read.schema(rec.schema).json(path)


@query("forecast_build")
def q_forecast_build(spark, d):
    """Train + calibrate + quantiles, then score the next period; ranked output."""
    model, _, _, rows, cols = fitted(spark, d)
    nxt = ml.predict_next(model, _next_features(spark, d, rows, cols))
    return ev.topn_predictions(nxt, 30, pred="predicted_points", keys=["player_id"],
                               columns=["p10", "p50", "p90", "value_per_m", "spread"])
