"""Lagged window features against a pandas oracle (shift(1) + rolling / ewm)."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import windows as win


def _frame(n_keys=6, max_len=40, null_frac=0.2, seed=0, long_key=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_keys):
        n = int(rng.integers(1, max_len))
        for i in range(n):
            rows.append((k, i, float(rng.normal(5, 3)) if rng.random() > null_frac else None,
                         float(rng.integers(0, 91)) if rng.random() > null_frac else None))
    for i in range(long_key):
        rows.append((999, i, float(rng.normal(5, 3)) if rng.random() > null_frac else None, 60.0))
    return pd.DataFrame(rows, columns=["k", "t", "x", "minutes"])


def _pandas_expected(pdf, col, windows, spans):
    pdf = pdf.sort_values(["k", "t"]).copy()
    g = pdf.groupby("k")[col]
    for w in windows:
        pdf[f"{col}_roll{w}"] = g.transform(lambda s: s.shift(1).rolling(w, min_periods=1).mean())
    for s in spans:
        pdf[f"{col}_ewm{s}"] = g.transform(lambda v: v.shift(1).ewm(span=s, min_periods=1).mean())
    return pdf


def _compare(spark_df, pdf, cols):
    got = spark_df.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    exp = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    for c in cols:
        a, b = got[c].to_numpy(dtype=float), exp[c].to_numpy(dtype=float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        m = ~np.isnan(a)
        assert np.allclose(a[m], b[m], rtol=1e-9, atol=1e-9), c


@pytest.mark.parametrize("seed", [0, 1])
def test_roll_and_ewm_match_pandas(spark, seed):
    pdf = _frame(seed=seed)
    sdf = spark.createDataFrame(pdf)
    out = win.lagged_features(sdf, ["k"], ["t"], ["x"], windows=(3, 5), spans=(3, 5))
    exp = _pandas_expected(pdf, "x", (3, 5), (3, 5))
    _compare(out, exp, ["x_roll3", "x_roll5", "x_ewm3", "x_ewm5"])


def test_ewm_long_key_no_overflow(spark):
    """1,500 rows in one key: the closed form q^-rn would overflow past ~1,023 rows."""
    pdf = _frame(n_keys=2, max_len=5, long_key=1500, seed=3)
    out = win.lagged_features(spark.createDataFrame(pdf), ["k"], ["t"], ["x"], windows=(3,), spans=(3, 5))
    _compare(out, _pandas_expected(pdf, "x", (3,), (3, 5)), ["x_roll3", "x_ewm3", "x_ewm5"])


def test_ewm_carries_over_long_null_run(spark):
    vals = [1.0, 2.0] + [None] * 300 + [4.0, 5.0]
    pdf = pd.DataFrame({"k": 1, "t": range(len(vals)), "x": vals})
    out = win.lagged_features(spark.createDataFrame(pdf), ["k"], ["t"], ["x"], windows=(), spans=(3,))
    _compare(out, _pandas_expected(pdf, "x", (), (3,)), ["x_ewm3"])


def test_first_row_null_second_equals_first(spark):
    pdf = pd.DataFrame({"k": [1] * 6 + [2] * 6, "t": list(range(6)) * 2,
                        "x": [float(t + 1 + 10 * k) for k in (1, 2) for t in range(6)]})
    out = win.lagged_features(spark.createDataFrame(pdf), ["k"], ["t"], ["x"], windows=(3, 5), spans=(3,))
    r = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    for k in (1, 2):
        sub = r[r.k == k].reset_index(drop=True)
        assert pd.isna(sub.loc[0, "x_roll3"]) and pd.isna(sub.loc[0, "x_ewm3"])
        assert sub.loc[1, "x_roll3"] == sub.loc[0, "x"]          # only the first row is visible
        assert (sub.loc[4:, "x_roll3"] != sub.loc[4:, "x"]).all()  # never the current target
    assert r[(r.k == 2) & (r.t == 1)]["x_roll5"].iloc[0] == 21.0  # keys do not bleed


def test_missing_measure_skipped(spark):
    pdf = _frame(n_keys=2)
    out = win.lagged_features(spark.createDataFrame(pdf), ["k"], ["t"], ["x", "absent"], windows=(3,), spans=())
    assert "x_roll3" in out.columns and "absent_roll3" not in out.columns


def test_sub_risk_reference_denominator(spark):
    pdf = _frame(n_keys=5, seed=4)
    out = win.minutes_features(spark.createDataFrame(pdf), ["k"], ["t"]).toPandas()
    exp = pdf.sort_values(["k", "t"]).copy()
    exp["started"] = (exp["minutes"] >= 45).astype(float)
    exp["minutes_pct"] = exp["minutes"] / 90.0
    g = exp.groupby("k")["started"]
    exp["sub_risk"] = g.transform(lambda s: s.shift(1).rolling(5, min_periods=1).apply(lambda x: (x < 1).mean()))
    for w in (3, 5):
        exp[f"started_roll{w}"] = g.transform(lambda s: s.shift(1).rolling(w, min_periods=1).mean())
        exp[f"minutes_pct_roll{w}"] = exp.groupby("k")["minutes_pct"].transform(
            lambda s: s.shift(1).rolling(w, min_periods=1).mean())
    _compare(spark.createDataFrame(out), exp,
             ["started", "sub_risk", "started_roll3", "started_roll5", "minutes_pct_roll3", "minutes_pct_roll5"])


def test_last_state_per_column_last_non_missing(spark):
    pdf = pd.DataFrame({"k": [1, 1, 1, 2], "t": [1, 2, 3, 1], "a": [1.0, None, None, 7.0],
                        "b": [None, 2.0, None, None]})
    out = win.last_state(spark.createDataFrame(pdf), ["k"], ["t"], ["a", "b"]).toPandas().set_index("k")
    exp = pdf.sort_values("t").groupby("k")[["a", "b"]].last()
    assert out.loc[1, "a"] == exp.loc[1, "a"] == 1.0 and out.loc[1, "b"] == exp.loc[1, "b"] == 2.0
    assert out.loc[2, "a"] == 7.0 and pd.isna(out.loc[2, "b"])


def test_keep_last(spark):
    pdf = pd.DataFrame({"k": [1, 1, 2], "d": [1, 2, 5], "v": ["a", "b", "c"]})
    sdf = spark.createDataFrame(pdf)
    last = {r.k: r.v for r in win.keep_last(sdf, ["k"], ["d"]).collect()}
    assert last == {1: "b", 2: "c"}


@pytest.mark.parametrize("seed", [5, 6])
def test_segmented_path_equals_pandas(spark, seed):
    """Hot-key path: one key holds most rows, long null runs; same output as pandas."""
    pdf = _frame(n_keys=4, max_len=30, long_key=1200, seed=seed, null_frac=0.3)
    pdf.loc[(pdf.k == 999) & (pdf.t.between(400, 700)), "x"] = None   # null run longer than a segment
    pdf["chunk"] = pdf["t"] // 37
    out = win.lagged_features_segmented(spark.createDataFrame(pdf), ["k"], ["t"], ["x"],
                                        windows=(3, 5), spans=(3, 5), roll_only=("minutes",))
    _compare(out, _pandas_expected(pdf, "x", (3, 5), (3, 5)), ["x_roll3", "x_roll5", "x_ewm3", "x_ewm5"])
    simple = win.lagged_features(spark.createDataFrame(pdf), ["k"], ["t"], ["x"], windows=(3, 5), spans=(3, 5),
                                 roll_only=("minutes",))
    _compare(out, simple.toPandas(), ["minutes_roll3", "minutes_roll5"])


def test_segmented_sub_risk(spark):
    pdf = _frame(n_keys=3, long_key=700, seed=8)
    pdf["chunk"] = pdf["t"] // 50
    sdf = spark.createDataFrame(pdf).selectExpr("*", "CAST(coalesce(minutes >= 45, false) AS DOUBLE) AS started")
    a = win.lagged_features_segmented(sdf, ["k"], ["t"], [], windows=(3,), spans=(), roll_only=("started",),
                                      sub_risk="started")
    b = win.lagged_features(sdf, ["k"], ["t"], [], windows=(3,), spans=(), roll_only=("started",), sub_risk="started")
    _compare(a, b.toPandas(), ["started_roll3", "sub_risk"])


def test_period_strict_excludes_same_period(spark):
    from tessera.plans.builds import add_history_features
    pdf = pd.DataFrame({"player_id": [1] * 5, "fixture_id": [1, 2, 3, 4, 5], "gw": [1, 2, 2, 3, 3],
                        "kickoff_time": pd.to_datetime(["2024-01-01", "2024-01-08", "2024-01-09", "2024-01-15",
                                                        "2024-01-16"]),
                        "total_points": [1.0, 2.0, 4.0, 8.0, 16.0], "minutes": [90.0] * 5})
    df = spark.createDataFrame(pdf)
    row = {r.fixture_id: r.total_points_roll3 for r in add_history_features(df, ["total_points"]).collect()}
    per = {r.fixture_id: r.total_points_roll3
           for r in add_history_features(df, ["total_points"], strict="period").collect()}
    assert row[3] == 1.5 and per[3] == 1.0            # the double-period partner is excluded
    assert per[2] == per[3] and per[4] == per[5] == pytest.approx(7 / 3)


def test_prediction_features_next_row_includes_newest(spark):
    from tessera.plans.builds import prediction_features_next_row
    pdf = pd.DataFrame({"player_id": [1, 1, 1], "fixture_id": [1, 2, 3], "gw": [1, 2, 3], "team_id": [5, 5, 5],
                        "kickoff_time": pd.to_datetime(["2024-01-01", "2024-01-08", "2024-01-15"]),
                        "total_points": [1.0, 2.0, 6.0], "minutes": [90.0, 90.0, 10.0]})
    ctx = spark.createDataFrame(pd.DataFrame({"team_id": [5], "gw": [4], "fixture_difficulty": [2.0],
                                              "opponent_difficulty": [3.0], "is_double_gw": [False],
                                              "n_fixtures": [1]}))
    out = prediction_features_next_row(spark.createDataFrame(pdf), ctx, None, 4, ["total_points"]).first()
    assert out.total_points_roll3 == pytest.approx(3.0) and out.gw == 4 and out.fixture_difficulty == 2.0
    assert out.started_roll3 == pytest.approx(2 / 3)


def test_segmented_two_level_carry(spark):
    """Tiny super-blocks: the carried EWM value crosses several block boundaries."""
    pdf = _frame(n_keys=2, max_len=10, long_key=1500, seed=11, null_frac=0.2)
    pdf.loc[(pdf.k == 999) & (pdf.t.between(200, 1100)), "x"] = None
    pdf["chunk"] = pdf["t"] // 23
    out = win.lagged_features_segmented(spark.createDataFrame(pdf), ["k"], ["t"], ["x"],
                                        windows=(3,), spans=(3, 5), super_block=2)
    _compare(out, _pandas_expected(pdf, "x", (3,), (3, 5)), ["x_roll3", "x_ewm3", "x_ewm5"])


@pytest.mark.parametrize("strategy", ["key", "segmented"])
@pytest.mark.parametrize("gap", [(148, 296), (140, 300), (150, 290), (0, 200), (147, 149)])
def test_missing_segments_at_both_ends(spark, strategy, gap):
    """A run of missing values that covers, begins or ends a segment: the carried value is exact."""
    pdf = pd.DataFrame({"k": [1] * 444, "t": range(444), "x": [float(i * i % 97) for i in range(444)], "minutes": 90.0})
    pdf.loc[pdf.t.between(*gap), "x"] = None
    out = win.lagged_features(spark.createDataFrame(pdf), ["k"], ["t"], ["x"], spans=(3, 5), strategy=strategy)
    _compare(out, _pandas_expected(pdf, "x", (3, 5), (3, 5)), ["x_roll3", "x_roll5", "x_ewm3", "x_ewm5"])


@pytest.mark.parametrize("strategy", ["key", "segmented"])
def test_missing_keys_and_order_values(spark, strategy):
    """Rows without an order value come last in their key; rows without a key are a key of their own."""
    rows = [(k, None if i % 5 == 4 else i // 3, i, float(i)) for k in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, g long, i long, x double")
    got = {(r.k, r.i): r.x_roll3 for r in win.lagged_features(df, ["k"], ["g", "i"], ["x"], strategy=strategy).collect()}
    assert len(got) == 40
    for k in ("a", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        for n, r in enumerate(mine):
            past = [p[3] for p in mine[max(0, n - 3):n]]
            assert got[k, r[2]] == (pytest.approx(sum(past) / len(past)) if past else None)


def test_building_starts_no_job(spark):
    tracker, before = spark.sparkContext.statusTracker(), None
    df = spark.createDataFrame([(1, 1, 2.0)], "k long, t long, x double")
    before = set(tracker.getJobIdsForGroup(None))
    for strategy in ("key", "segmented"):
        win.lagged_features(df, ["k"], ["t"], ["x"], strategy=strategy)
    assert set(tracker.getJobIdsForGroup(None)) == before
    with pytest.raises(ValueError):
        win.lagged_features(df, ["k"], ["t"], ["x"], strategy="auto")


def test_last_state_puts_missing_order_last(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, None, 2.0), (1, 9, None)], "k long, t long, x double")
    assert win.last_state(df, ["k"], ["t"], ["x"]).first().x == 2.0
    assert win.keep_last(df, ["k"], ["t"]).first().x == 2.0


def test_previous_segment_is_one_value_to_carry(spark):
    """Many measures: one value carries the sums of the previous segment, and rows are sorted before they are widened."""
    df = spark.createDataFrame([(1, 1, 2.0, 3.0)], "k long, t long, x double, y double")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = win.lagged_features(df, ["k"], ["t"], ["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("last(") == 1 + 2 * 2


def test_last_state_numbered(spark):
    rows = [(k, None if i % 4 == 3 else i // 2, i, None if i % 3 == 0 else float(i)) for k in (1, 2, None) for i in range(9)]
    df = spark.createDataFrame(rows, "k long, g long, i long, x double")
    plain, numbered = ({r.k: (r.x, r.i) for r in win.last_state(df, ["k"], ["g", "i"], ["x", "i"], numbered=n).collect()}
                       for n in (False, True))
    assert plain == numbered and set(plain) == {1, 2, None}
