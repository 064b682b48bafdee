"""Period context, as-of alignment, split and evaluation invariants."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import context as ctxop
from tessera.operators import evaluate as ev
from tessera.operators import matrix as mx
from tessera.operators.asof import asof_backward
from tessera.plans.builds import period_dim


def _fixtures(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "event", "team_h", "team_a", "team_h_difficulty",
                                                             "team_a_difficulty", "finished"]))


def test_fixture_context_single_double_blank(spark):
    fx = _fixtures(spark, [(1, 1, 1, 2, 2, 4, True), (2, 2, 1, 3, 3, 5, True), (3, 2, 4, 1, 4, 2, False),
                           (4, None, 1, 2, 2, 2, False)])
    ctx = ctxop.fixture_context(ctxop.fixture_sides(fx)).toPandas().set_index(["team_id", "gw"])
    assert ctx.loc[(1, 1), "n_fixtures"] == 1 and not ctx.loc[(1, 1), "is_double_gw"]
    assert ctx.loc[(1, 2), "n_fixtures"] == 2 and ctx.loc[(1, 2), "is_double_gw"]
    assert ctx.loc[(1, 2), "fixture_difficulty"] == pytest.approx((3 + 2) / 2)
    assert ctx.loc[(1, 2), "is_home"]
    assert (2, 2) not in ctx.index           # blank gw: team absent
    assert 4 not in set(ctxop.fixture_sides(fx).toPandas()["fixture_id"])  # unscheduled dropped


def test_join_fixture_context_no_fanout(spark):
    fx = _fixtures(spark, [(1, 1, 1, 2, 2, 4, True), (2, 1, 3, 1, 3, 5, True)])
    ctx = ctxop.fixture_context(ctxop.fixture_sides(fx))
    hist = spark.createDataFrame(pd.DataFrame({"player_id": [7, 8], "team_id": [1, 9], "gw": [1, 1]}))
    out = ctxop.join_fixture_context(hist, ctx).toPandas().set_index("player_id")
    assert len(out) == 2 and out.loc[7, "n_fixtures"] == 2 and pd.isna(out.loc[8, "fixture_difficulty"])


def _periods(spark):
    ev_ = pd.DataFrame({"id": [1, 2, 3, 4, 5],
                        "deadline_time": ["2024-08-16T17:30:00Z", "2024-08-24T10:00:00Z", "2024-08-31T10:00:00Z",
                                          "2024-09-14T10:00:00Z", None]})
    return period_dim(spark.createDataFrame(ev_))


def test_asof_backward_examples(spark):
    m = spark.createDataFrame(pd.DataFrame({"mid": [1, 2, 3, 4, 5],
                                            "date": pd.to_datetime(["2024-08-17 15:00", "2024-08-25 16:30",
                                                                    "2024-08-10 12:00", "2024-12-01 12:00",
                                                                    "2024-08-24 10:00"])}))
    out = {r.mid: r.gw for r in asof_backward(m, "date", _periods(spark)).collect()}
    assert out[1] == 1 and out[2] == 2
    assert 3 not in out                      # before the first deadline: dropped
    assert out[4] == 4                       # after the last deadline: last period
    assert out[5] == 2                       # exactly at a deadline: that period (inclusive)


def test_asof_duplicate_deadline_later_period_wins(spark):
    per = spark.createDataFrame(pd.DataFrame({"gw": [1, 2, 3], "deadline_time": pd.to_datetime(
        ["2024-01-01", "2024-01-08", "2024-01-08"])}))
    m = spark.createDataFrame(pd.DataFrame({"mid": [1], "date": pd.to_datetime(["2024-01-09"])}))
    assert asof_backward(m, "date", per).first().gw == 3


def test_temporal_split_and_check(spark):
    df = spark.createDataFrame(pd.DataFrame({"gw": list(range(1, 21)), "total_points": [1.0] * 20}))
    lab = mx.temporal_split(df, 16)
    sizes = mx.check_split(lab)
    assert sizes["train"]["max_gw"] == 15 and sizes["val"]["min_gw"] == 16
    with pytest.raises(ValueError):
        mx.check_split(mx.temporal_split(df, 99))


def test_feature_matrix_dedup_and_target_filter(spark):
    pdf = pd.DataFrame({"player_id": [1, 2], "gw": [1, 1], "total_points": [3.0, None], "cost": [5.0, 6.0],
                        "started_roll3": [1.0, 0.0], "x_roll3": [1.0, 2.0], "x_ewm5": [1.0, 2.0]})
    m, cols = mx.feature_matrix(spark.createDataFrame(pdf))
    assert cols == ["cost", "started_roll3", "x_roll3", "x_ewm5"]
    assert m.count() == 1


def test_one_hot_exactly_four(spark):
    df = spark.createDataFrame(pd.DataFrame({"position_id": [1, 4, None, 5]}, dtype="Int64"))
    out = ctxop.one_hot(df, "position_id", (1, 2, 3, 4), "pos").toPandas()
    assert [c for c in out.columns if c.startswith("pos_")] == ["pos_1", "pos_2", "pos_3", "pos_4"]
    assert out[["pos_1", "pos_2", "pos_3", "pos_4"]].sum(axis=1).tolist() == [1.0, 1.0, 0.0, 0.0]


def test_evaluation_invariants(spark):
    pdf = pd.DataFrame({"fixture_id": range(40), "gw": [i % 4 for i in range(40)],
                        "position_id": [i % 5 + 1 for i in range(40)],
                        "total_points": [float(i % 7) for i in range(40)],
                        "pred": [float(i % 7) + (0.5 if i % 3 else -1.0) for i in range(40)]})
    df = spark.createDataFrame(pdf)
    o = ev.eval_overall(df).first()
    assert o.rmse >= o.mae and o.n_samples == 40
    groups = {r.position for r in ev.eval_by_group(df).collect()}
    assert groups == {"GKP", "DEF", "MID", "FWD"}      # id 5 ignored
    rec = {r.k: r.recall for r in ev.topk_recall(df, ["fixture_id"]).collect()}
    assert 0.0 <= rec[15] <= 1.0 and 0.0 <= rec[30] <= 1.0
    small = ev.topk_recall(df.limit(10), ["fixture_id"]).collect()
    assert all(r.recall is None for r in small)           # fewer rows than K
    top = ev.topn_predictions(df, 5, pred="pred", keys=["fixture_id"]).collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]
    assert all(top[i].pred >= top[i + 1].pred for i in range(4))


def test_topk_recall_per_period_matches_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"fixture_id": range(600), "gw": rng.integers(1, 4, 600),
                        "total_points": rng.integers(0, 15, 600).astype(float),
                        "pred": rng.normal(5, 3, 600)})
    got = {r.gw: r.recall for r in ev.topk_recall_per_period(spark.createDataFrame(pdf), ["fixture_id"], k=15).collect()}
    for gw, g in pdf.groupby("gw"):
        a = set(g.sort_values(["total_points", "fixture_id"], ascending=[False, True]).head(15).fixture_id)
        p = set(g.sort_values(["pred", "fixture_id"], ascending=[False, True]).head(15).fixture_id)
        assert got[gw] == round(len(a & p) / 15, 4)


def test_asof_max_age_drops_rows_long_after_last_deadline(spark):
    m = spark.createDataFrame(pd.DataFrame({"mid": [1, 2], "date": pd.to_datetime(["2024-09-20", "2024-12-01"])}))
    out = {r.mid: r.gw for r in asof_backward(m, "date", _periods(spark), max_age="14 days").collect()}
    assert out == {1: 4}


def test_deadlines_are_made_of_months_not_of_orders(spark):
    from tessera.plans import analogue as an
    from tessera.plans import builds
    plan = builds.period_dim(an.periods(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):]
    assert "make_date" not in below and "make_date" in plan
