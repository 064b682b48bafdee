"""Queries: temporal split, splits round trip, profile, prediction features and
forecast evaluation over a deterministic prediction column."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context as ctxop
from tessera.operators import evaluate as ev
from tessera.operators import matrix as mx
from tessera.operators import windows as win
from tessera.plans import analogue as an
from tessera.plans import builds
from tessera.plans.q_features import CTX_SQL, W_SQL, ewm_sql, roll_sql
from tessera.plans.registry import query, sql_out
from tessera.session import scratch_path
from tessera.sources.splits import load_splits, write_splits

VAL_START = 60
TARGET_GW = 80


def scored(spark, d, positions: bool = False):
    """History with deterministic raw / calibrated predictions (stand-ins for a model)."""
    h = an.history_with_players(spark, d) if positions else an.history(spark, d)
    return h.select("player_id", "fixture_id", "gw", *["position_id"] * positions, "total_points",
                    (F.col("total_points") * 0.9 + (F.col("fixture_id") % 7) / 10.0).alias("pred"),
                    (F.col("total_points") * 0.95 + (F.col("fixture_id") % 3) / 10.0).alias("pred_cal"))


SCORED_SQL = f"""SELECT player_id, fixture_id, gw, position_id, total_points,
  total_points * 0.9 + (fixture_id % 7) / 10.0 AS pred,
  total_points * 0.95 + (fixture_id % 3) / 10.0 AS pred_cal
FROM ({an.HISTORY_PLAYERS_SQL}) AS h"""


@query("eval_overall", sql_out(f"""SELECT avg(abs(pred - total_points)) AS mae,
  sqrt(avg((pred - total_points) * (pred - total_points))) AS rmse, count(*) AS n_samples
FROM ({SCORED_SQL}) AS s""", doubles=["mae", "rmse"]))
def q_eval_overall(spark, d):
    """A4: MAE, RMSE and n over all rows."""
    return ev.eval_overall(scored(spark, d))


@query("eval_by_group", sql_out(f"""SELECT CASE position_id WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID'
  WHEN 4 THEN 'FWD' END AS position, avg(abs(pred - total_points)) AS mae
FROM ({SCORED_SQL}) AS s WHERE position_id IN (1, 2, 3, 4) GROUP BY position_id""", doubles=["mae"]))
def q_eval_by_group(spark, d):
    """A5: MAE per position; absent groups omitted, unknown ids ignored."""
    return ev.eval_by_group(scored(spark, d, positions=True))


@query("eval_by_period", sql_out(f"""SELECT gw, avg(abs(pred - total_points)) AS mae, count(*) AS n_players
FROM ({SCORED_SQL}) AS s GROUP BY gw""", doubles=["mae"]))
def q_eval_by_period(spark, d):
    """MAE and n per period, ordered by period."""
    return ev.eval_by_period(scored(spark, d))


@query("calibration_report", sql_out(f"""SELECT avg(abs(pred - total_points)) AS mae_raw,
  avg(abs(pred_cal - total_points)) AS mae_calibrated,
  avg(abs(pred_cal - total_points)) - avg(abs(pred - total_points)) AS delta
FROM ({SCORED_SQL}) AS s""", doubles=["mae_raw", "mae_calibrated", "delta"]))
def q_calibration_report(spark, d):
    """Raw vs calibrated MAE and their difference."""
    return ev.calibration_report(scored(spark, d), "pred", "pred_cal")


def _topk_sql(k: int) -> str:
    return f"""SELECT CAST({k} AS BIGINT) AS k, CASE WHEN count(*) >= {k} THEN round(count(p.fixture_id) / {k}, 4) END AS recall
FROM (SELECT fixture_id FROM ({SCORED_SQL}) s ORDER BY total_points DESC NULLS LAST, fixture_id LIMIT {k}) a
LEFT JOIN (SELECT fixture_id FROM ({SCORED_SQL}) s ORDER BY pred DESC NULLS LAST, fixture_id LIMIT {k}) p
  USING (fixture_id)"""


@query("topk_recall", sql_out(f"{_topk_sql(15)} UNION ALL {_topk_sql(30)}", doubles=["recall"]))
def q_topk_recall(spark, d):
    """Top-15 / top-30 recall over the whole set, key tie-break, rounded to 4."""
    return ev.topk_recall(scored(spark, d), ["fixture_id"], "pred", "total_points")


@query("topn_predictions", sql_out(f"""SELECT row_number() OVER (ORDER BY pred DESC NULLS LAST, fixture_id) AS rank,
  fixture_id, pred, player_id, CASE position_id WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID'
  WHEN 4 THEN 'FWD' END AS pos
FROM (SELECT * FROM ({SCORED_SQL}) s ORDER BY pred DESC NULLS LAST, fixture_id LIMIT 30) AS t""",
    doubles=["pred"]))
def q_topn_predictions(spark, d):
    """Top-30 predictions with rank and position label (the limit is the feature)."""
    return ev.topn_predictions(scored(spark, d, positions=True), 30, pred="pred", keys=["fixture_id"],
                               columns=["player_id"])


@query("temporal_split", f"""SELECT player_id, fixture_id, gw,
  CASE WHEN gw < {VAL_START} THEN 'train' ELSE 'val' END AS split FROM ({an.HISTORY_SQL}) AS h""")
def q_temporal_split(spark, d):
    """Strict time-based split (gw < t train, >= t val) in one pass."""
    h = an.history(spark, d).select("player_id", "fixture_id", "gw")
    labelled = mx.temporal_split(h, VAL_START)
    mx.check_split(labelled)
    return labelled


@query("load_splits", sql_out(f"""SELECT player_id, fixture_id, gw, total_points, was_home,
  CASE WHEN gw < {VAL_START} THEN 'train' ELSE 'val' END AS split FROM ({an.HISTORY_SQL}) AS h""",
    doubles=["total_points"]))
def q_load_splits(spark, d):
    """Write versioned train/val Parquet to the shared folder, read back, infer features."""
    h = an.history(spark, d).select("player_id", "fixture_id", "gw", "total_points", "was_home")
    base = scratch_path(spark, "splits")
    write_splits(mx.temporal_split(h, VAL_START), base, "v1")
    train, val, cols = load_splits(spark, base, "v1")
    assert cols == ["was_home"], cols
    return (train.withColumn("split", F.lit("train"))
            .unionByName(val.withColumn("split", F.lit("val"))))


@query("profile", f"""SELECT count(*) AS n_rows, count(DISTINCT player_id) AS n_players, min(gw) AS min_gw,
  max(gw) AS max_gw, array_to_string(list_sort(list(DISTINCT CAST(year(kickoff_time) AS VARCHAR))), ',') AS seasons
FROM ({an.HISTORY_SQL}) AS h""")
def q_profile(spark, d):
    """Rows, distinct keys, period range, distinct seasons (bounded set)."""
    h = an.history(spark, d)
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("player_id").alias("n_players"),
                 F.min("gw").alias("min_gw"), F.max("gw").alias("max_gw"),
                 F.array_join(F.sort_array(F.collect_set(F.year("kickoff_time").cast("string"))), ",")
                 .alias("seasons"))


PRED_COLS = ["total_points_roll3", "total_points_ewm3", "minutes_roll5", "started_roll3", "sub_risk", "cost"]


def _pred_sql() -> str:
    feats = f"""SELECT *, {roll_sql('total_points', 3)} AS total_points_roll3, {ewm_sql('total_points', 3)} AS total_points_ewm3,
  {roll_sql('minutes', 5)} AS minutes_roll5, {roll_sql('started', 3)} AS started_roll3,
  CASE WHEN rn > 0 THEN sum(1 - started) OVER ({W_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / least(5, rn + 1) END AS sub_risk,
  value / 10 AS cost
FROM (SELECT *, row_number() OVER ({W_SQL}) - 1 AS rn, CAST(coalesce(minutes >= 45, false) AS DOUBLE) AS started
  FROM ({an.HISTORY_PLAYERS_SQL}) hp) AS b"""
    ordk = "CAST(epoch(kickoff_time) AS BIGINT) * 1000000000 + fixture_id"
    last = ", ".join(f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN {ordk} END) AS {c}" for c in PRED_COLS)
    return f"""SELECT s.player_id, s.team_id, CAST({TARGET_GW} AS BIGINT) AS gw, {', '.join('s.' + c for c in PRED_COLS)},
  c.fixture_difficulty, c.opponent_difficulty, c.is_double_gw, c.n_fixtures, t.strength_overall_home
FROM (SELECT player_id, arg_max(team_id, CASE WHEN team_id IS NOT NULL THEN {ordk} END) AS team_id, {last}
      FROM ({feats}) f WHERE gw < {TARGET_GW} GROUP BY player_id) s
JOIN (SELECT * FROM ({CTX_SQL}) x WHERE gw = {TARGET_GW}) c ON c.team_id = s.team_id
LEFT JOIN ({an.TEAMS_SQL}) t ON t.id = s.team_id"""


@query("prediction_features", sql_out(_pred_sql(), doubles=PRED_COLS + ["fixture_difficulty", "opponent_difficulty"]))
def q_prediction_features(spark, d):
    """Latest state per key before the target period joined to its upcoming context."""
    h = an.history_with_players(spark, d)
    h = builds.add_history_features(h, ["total_points", "minutes"]).withColumn("cost", F.col("value") / 10)
    h = h.select("player_id", "team_id", "gw", "kickoff_time", "fixture_id", *PRED_COLS)
    ctx = ctxop.fixture_context(ctxop.fixture_sides(an.fixtures(spark, d)))
    out = mx.prediction_features(h, ctx, an.teams(spark, d), TARGET_GW,
                                 order=("gw", "kickoff_time", "fixture_id"))
    return out.select("player_id", "team_id", "gw", *PRED_COLS, "fixture_difficulty", "opponent_difficulty",
                      "is_double_gw", "n_fixtures", "strength_overall_home")


@query("dedup_newest", f"""SELECT c_custkey AS id, arg_max(season, season) AS season, count(*) AS n_seasons FROM (
  SELECT DISTINCT o_custkey AS c_custkey, CAST(year(o_orderdate) AS VARCHAR) AS season FROM orders) AS s
GROUP BY c_custkey""")
def q_dedup_newest(spark, d):
    """Keep the newest season row per id (max_by aggregate)."""
    o = an.history(spark, d).select(F.col("player_id").alias("id"),
                                    F.year("kickoff_time").cast("string").alias("season")).distinct()
    newest = win.keep_last(o.withColumn("n", F.lit(1)), ["id"], ["season"]).drop("n")
    counts = o.groupBy("id").agg(F.count(F.lit(1)).alias("n_seasons"))
    return newest.join(counts, "id")
