"""Queries: lagged windows, minutes reliability, last state, period context,
dimension joins and the flagship feature build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context as ctxop
from tessera.operators import windows as win
from tessera.operators.matrix import feature_matrix
from tessera.plans import analogue as an
from tessera.plans.builds import ROLL_TARGETS, feature_build
from tessera.plans.registry import query, sql_out
from tessera.sources.tables import read_table

KEY = ["player_id"]
ORDER = ["gw", "kickoff_time", "fixture_id"]
W_SQL = "PARTITION BY player_id ORDER BY kickoff_time, fixture_id"
MEASURES = list(ROLL_TARGETS)


def roll_sql(c: str, w: int) -> str:
    return f"avg({c}) OVER ({W_SQL} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def ewm_sql(c: str, span: int) -> str:
    q = f"(1 - 2.0 / ({span} + 1))"
    frame = f"OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (f"sum({c} * pow({q}, -rn)) {frame} / "
            f"sum(CASE WHEN {c} IS NOT NULL THEN pow({q}, -rn) END) {frame}")


HIST_RN = f"""SELECT *, row_number() OVER ({W_SQL}) - 1 AS rn FROM ({an.HISTORY_SQL}) AS h0"""


@query("roll_mean", sql_out(
    f"""SELECT player_id, fixture_id, gw,
  {', '.join(f"{roll_sql(m, w)} AS {m}_roll{w}" for m in MEASURES for w in (3, 5))}
FROM ({an.HISTORY_SQL}) AS h""",
    doubles=[f"{m}_roll{w}" for m in MEASURES for w in (3, 5)]))
def q_roll_mean(spark, d):
    """Mean of the non-missing values among the previous w rows of the key."""
    h = an.history(spark, d)
    out = win.lagged_features(h, KEY, ORDER, MEASURES, windows=(3, 5), spans=())
    return out.select("player_id", "fixture_id", "gw",
                      *[f"{m}_roll{w}" for m in MEASURES for w in (3, 5)])


@query("ewm_mean", sql_out(
    f"""SELECT player_id, fixture_id, gw,
  {', '.join(f"{ewm_sql(m, s)} AS {m}_ewm{s}" for m in MEASURES for s in (3, 5))}
FROM ({HIST_RN}) AS h""",
    doubles=[f"{m}_ewm{s}" for m in MEASURES for s in (3, 5)]))
def q_ewm_mean(spark, d):
    """Lagged EWM (adjust=True, ignore_na=False, min_periods=1), exact for any key length."""
    h = an.history(spark, d)
    out = win.lagged_features(h, KEY, ORDER, MEASURES, windows=(), spans=(3, 5))
    return out.select("player_id", "fixture_id", "gw",
                      *[f"{m}_ewm{s}" for m in MEASURES for s in (3, 5)])


# ------------------------------------------------------- long keys (segmented plan)
LONG_KEY, LONG_ORDER = ["l_returnflag"], ["batch", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
LONG_SQL = """SELECT l_returnflag, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN l_partkey % 53 <> 0 THEN l_orderkey // 200 END AS batch,
  CASE WHEN (l_orderkey // 1000) % 3 <> 1 THEN CAST(l_quantity AS DOUBLE) END AS x FROM lineitem"""
_LONG_W = "PARTITION BY l_returnflag ORDER BY batch ASC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def _long_rows(spark, d):
    """A few keys with thousands of rows, runs of hundreds of missing values and missing order values."""
    li = read_table(spark, d, "lineitem")
    batch = F.floor(F.col("l_orderkey") / 200).cast("bigint")
    gone = F.floor(F.col("l_orderkey") / 1000) % 3 == 1
    return li.select("l_returnflag", *LONG_ORDER[1:],
                     F.when(F.col("l_partkey") % 53 != 0, batch).alias("batch"),
                     F.when(~gone, F.col("l_quantity").cast("double")).alias("x"))


@query("roll_long_key", sql_out(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  avg(x) OVER ({_LONG_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS x_roll3,
  avg(x) OVER ({_LONG_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x_roll5
FROM ({LONG_SQL}) AS t""", doubles=["x_roll3", "x_roll5"]))
def q_roll_long_key(spark, d):
    """W1 on three keys that hold all rows: the segmented plan."""
    out = win.lagged_features(_long_rows(spark, d), LONG_KEY, LONG_ORDER, ["x"], spans=(), strategy="segmented")
    return out.select(*LONG_ORDER[1:5], "x_roll3", "x_roll5")


def _long_ewm_sql(span: int) -> str:
    q = f"(1 - 2.0 / ({span} + 1))"
    return (f"list_sum(list_transform(seen, lambda v, i: coalesce(v, 0) * pow({q}, len(seen) - i))) / "
            f"list_sum(list_transform(seen, lambda v, i: CASE WHEN v IS NOT NULL THEN pow({q}, len(seen) - i) ELSE 0 END))")


@query("ewm_long_key", sql_out(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  last_value(e3 IGNORE NULLS) OVER ({_LONG_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x_ewm3,
  last_value(e5 IGNORE NULLS) OVER ({_LONG_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x_ewm5
FROM (SELECT *, CASE WHEN x IS NOT NULL THEN {_long_ewm_sql(3)} END AS e3, CASE WHEN x IS NOT NULL THEN {_long_ewm_sql(5)} END AS e5
  FROM (SELECT *, list(x) OVER ({_LONG_W} ROWS BETWEEN 150 PRECEDING AND CURRENT ROW) AS seen FROM ({LONG_SQL}) AS t) AS u) AS v""",
    doubles=["x_ewm3", "x_ewm5"]))
def q_ewm_long_key(spark, d):
    """W2 on the same keys: values carried over whole missing segments."""
    out = win.lagged_features(_long_rows(spark, d), LONG_KEY, LONG_ORDER, ["x"], windows=(), strategy="segmented")
    return out.select(*LONG_ORDER[1:5], "x_ewm3", "x_ewm5")


MINUTES_SQL = f"""SELECT player_id, fixture_id, gw,
  CAST(coalesce(minutes >= 45, false) AS DOUBLE) AS started, minutes / 90.0 AS minutes_pct
FROM ({an.HISTORY_SQL}) AS h"""


@query("minutes_flags", sql_out(MINUTES_SQL, doubles=["started", "minutes_pct"]))
def q_minutes_flags(spark, d):
    """started = minutes >= 45 (missing -> 0), minutes_pct = minutes / 90."""
    h = an.history(spark, d)
    return win.minutes_features(h, KEY, ORDER).select("player_id", "fixture_id", "gw",
                                                                  "started", "minutes_pct")


REL_COLS = ["started_roll3", "started_roll5", "minutes_pct_roll3", "minutes_pct_roll5"]


@query("minutes_reliability", sql_out(
    f"""SELECT player_id, fixture_id, gw,
  {roll_sql('started', 3)} AS started_roll3, {roll_sql('started', 5)} AS started_roll5,
  {roll_sql('minutes_pct', 3)} AS minutes_pct_roll3, {roll_sql('minutes_pct', 5)} AS minutes_pct_roll5
FROM (SELECT m.*, h.kickoff_time FROM ({MINUTES_SQL}) m JOIN ({an.HISTORY_SQL}) h USING (player_id, fixture_id)) AS x""",
    doubles=REL_COLS))
def q_minutes_reliability(spark, d):
    """Lagged means of started and minutes_pct."""
    h = an.history(spark, d)
    return win.minutes_features(h, KEY, ORDER).select("player_id", "fixture_id", "gw", *REL_COLS)


@query("sub_risk", sql_out(
    f"""SELECT player_id, fixture_id, gw,
  CASE WHEN row_number() OVER ({W_SQL}) > 1 THEN
    sum(1 - started) OVER ({W_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
    / least(5, row_number() OVER ({W_SQL})) END AS sub_risk
FROM (SELECT m.*, h.kickoff_time FROM ({MINUTES_SQL}) m JOIN ({an.HISTORY_SQL}) h USING (player_id, fixture_id)) AS x""",
    doubles=["sub_risk"]))
def q_sub_risk(spark, d):
    """Share of the last five rows not started, reference denominator."""
    h = an.history(spark, d)
    return win.minutes_features(h, KEY, ORDER).select("player_id", "fixture_id", "gw", "sub_risk")


def _ord_sql() -> str:
    return "CAST(epoch(kickoff_time) AS BIGINT) * 1000000000 + fixture_id"


@query("last_state", sql_out(
    f"""SELECT player_id,
  {', '.join(f"arg_max({m}, CASE WHEN {m} IS NOT NULL THEN {_ord_sql()} END) AS {m}" for m in MEASURES)},
  arg_max(gw, {_ord_sql()}) AS gw
FROM ({an.HISTORY_SQL}) AS h GROUP BY player_id""",
    doubles=MEASURES))
def q_last_state(spark, d):
    """Per key and per column the last non-missing value (columns may mix rows)."""
    h = an.history(spark, d)
    return win.last_state(h, KEY, ORDER, MEASURES + ["gw"])


SIDES_SQL = f"""SELECT id AS fixture_id, event AS gw, team_h AS team_id, team_a AS opponent_id, true AS was_home,
  CAST(team_h_difficulty AS DOUBLE) AS fixture_difficulty, CAST(team_a_difficulty AS DOUBLE) AS opponent_difficulty,
  coalesce(finished, false) AS finished
FROM ({an.FIXTURES_SQL}) f WHERE event IS NOT NULL
UNION ALL
SELECT id, event, team_a, team_h, false, CAST(team_a_difficulty AS DOUBLE), CAST(team_h_difficulty AS DOUBLE),
  coalesce(finished, false)
FROM ({an.FIXTURES_SQL}) f WHERE event IS NOT NULL"""


@query("fixture_sides", sql_out(SIDES_SQL, doubles=["fixture_difficulty", "opponent_difficulty"]))
def q_fixture_sides(spark, d):
    """One row per team per scheduled fixture, unscheduled dropped."""
    return ctxop.fixture_sides(an.fixtures(spark, d))


CTX_SQL = f"""SELECT team_id, gw, avg(fixture_difficulty) AS fixture_difficulty,
  avg(opponent_difficulty) AS opponent_difficulty, bool_or(was_home) AS is_home,
  count(*) > 1 AS is_double_gw, count(fixture_id) AS n_fixtures
FROM ({SIDES_SQL}) s GROUP BY team_id, gw"""


@query("fixture_context", sql_out(CTX_SQL, doubles=["fixture_difficulty", "opponent_difficulty"]))
def q_fixture_context(spark, d):
    """A1: (team, gw) context: mean difficulties, any home leg, double flag, count."""
    return ctxop.fixture_context(ctxop.fixture_sides(an.fixtures(spark, d)))


@query("join_fixture_ctx", sql_out(
    f"""SELECT h.player_id, h.fixture_id, h.gw, h.team_id, c.fixture_difficulty, c.opponent_difficulty,
  c.is_double_gw, c.n_fixtures
FROM ({an.HISTORY_PLAYERS_SQL}) h LEFT JOIN ({CTX_SQL}) c ON c.team_id = h.team_id AND c.gw = h.gw""",
    doubles=["fixture_difficulty", "opponent_difficulty"]))
def q_join_fixture_ctx(spark, d):
    """History left join (team_id, gw) context; right side unique, no fan-out."""
    h = an.history_with_players(spark, d)
    ctx = ctxop.fixture_context(ctxop.fixture_sides(an.fixtures(spark, d)))
    return ctxop.join_fixture_context(h, ctx).select(
        "player_id", "fixture_id", "gw", "team_id", *ctxop.CONTEXT_COLS)


@query("join_dim_left", f"""SELECT player_id, fixture_id, player_name, team_id, position_id
FROM ({an.HISTORY_PLAYERS_SQL}) AS h""")
def q_join_dim_left(spark, d):
    """History left join player dimension on the document key."""
    return an.history_with_players(spark, d).select("player_id", "fixture_id", "player_name",
                                                    "team_id", "position_id")


@query("join_team_strength", f"""SELECT h.player_id, h.fixture_id, h.team_id,
  t.strength_overall_home, t.strength_overall_away, t.strength_attack_home,
  t.strength_attack_away, t.strength_defence_home, t.strength_defence_away
FROM ({an.HISTORY_PLAYERS_SQL}) h LEFT JOIN ({an.TEAMS_SQL}) t ON t.id = h.team_id""")
def q_join_team_strength(spark, d):
    """Broadcast left join of six team strength ratings."""
    h = an.history_with_players(spark, d).select("player_id", "fixture_id", "team_id")
    return ctxop.join_team_strength(h, an.teams(spark, d)).select(
        "player_id", "fixture_id", "team_id", *ctxop.STRENGTH_COLS)


@query("one_hot", sql_out(
    f"""SELECT player_id, fixture_id, position_id,
  {', '.join(f"CAST(coalesce(position_id = {p}, false) AS DOUBLE) AS pos_{p}" for p in (1, 2, 3, 4))}
FROM ({an.HISTORY_PLAYERS_SQL}) AS h""", doubles=[f"pos_{p}" for p in (1, 2, 3, 4)]))
def q_one_hot(spark, d):
    """Exactly four position dummies; NULL position -> all zero."""
    h = an.history_with_players(spark, d).select("player_id", "fixture_id", "position_id")
    return ctxop.one_hot(h, "position_id", (1, 2, 3, 4), "pos")


# ---------------------------------------------------------------- flagship
def feature_build_sql(history: str = an.HISTORY_PLAYERS_SQL, fixtures: str = CTX_SQL, more: tuple = (), enrichment: str = "",
                      us: tuple = ()) -> str:
    """SQL of the flagship; ``more`` are further columns of ``history`` in the matrix, ``us`` those of ``enrichment``."""
    rolls = ", ".join(f"{roll_sql(m, w)} AS {m}_roll{w}" for m in MEASURES for w in (3, 5))
    ewms = ", ".join(f"{ewm_sql(m, s)} AS {m}_ewm{s}" for m in MEASURES for s in (3, 5))
    rel = (f"{roll_sql('started', 3)} AS started_roll3, {roll_sql('started', 5)} AS started_roll5, "
           f"{roll_sql('minutes_pct', 3)} AS minutes_pct_roll3, {roll_sql('minutes_pct', 5)} AS minutes_pct_roll5, "
           f"CASE WHEN rn > 0 THEN sum(1 - started) OVER ({W_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
           f" / least(5, rn + 1) END AS sub_risk")
    base = f"""SELECT *, row_number() OVER ({W_SQL}) - 1 AS rn,
  CAST(coalesce(minutes >= 45, false) AS DOUBLE) AS started, minutes / 90.0 AS minutes_pct
FROM ({history}) AS hp"""
    feats = f"SELECT *, {rolls}, {ewms}, {rel} FROM ({base}) AS b"
    pos = ", ".join(f"CAST(coalesce(position_id = {p}, false) AS DOUBLE) AS pos_{p}" for p in (1, 2, 3, 4))
    roll_names = [f"{m}_roll{w}" for m in MEASURES for w in (3, 5)]
    ewm_names = [f"{m}_ewm{s}" for m in MEASURES for s in (3, 5)]
    # feature order: base list first, then discovered roll/ewm columns (no duplicates)
    base_feats = ["cost", "was_home", "fixture_difficulty", "opponent_difficulty", "is_double_gw",
                  "n_fixtures", "pos_1", "pos_2", "pos_3", "pos_4", *ctxop.STRENGTH_COLS,
                  "started_roll3", "started_roll5", "minutes_pct_roll3", "minutes_pct_roll5", "sub_risk"]
    disc = [c for m in MEASURES for c in ([f"{m}_roll{w}" for w in (3, 5)] + [f"{m}_ewm{s}" for s in (3, 5)])]
    disc += ["started_roll3", "started_roll5", "minutes_pct_roll3", "minutes_pct_roll5"]
    names = list(dict.fromkeys(["player_id", "gw", "player_name", "team_id", "position_id", "kickoff_time"]
                               + base_feats + [*more] + disc + [*us] + ["total_points"]))
    inner = f"""SELECT {', '.join(names)} FROM (
  SELECT f.*, f.value / 10 AS cost, c.fixture_difficulty, c.opponent_difficulty, c.is_double_gw, c.n_fixtures,
    {pos}, t.strength_overall_home, t.strength_overall_away, t.strength_attack_home,
    t.strength_attack_away, t.strength_defence_home, t.strength_defence_away{''.join(f", e.{c}" for c in us)}
  FROM ({feats}) f
  LEFT JOIN ({fixtures}) c ON c.team_id = f.team_id AND c.gw = f.gw
  LEFT JOIN ({an.TEAMS_SQL}) t ON t.id = f.team_id
  {f"LEFT JOIN ({enrichment}) e ON e.fpl_id = f.player_id AND e.gw = f.gw" if us else ""}) AS x
WHERE total_points IS NOT NULL"""
    doubles = ["cost", "fixture_difficulty", "opponent_difficulty", "pos_1", "pos_2", "pos_3", "pos_4",
               "started_roll3", "started_roll5", "minutes_pct_roll3", "minutes_pct_roll5", "sub_risk",
               "total_points", *roll_names, *ewm_names, *more, *us]
    return sql_out(inner, doubles=doubles, timestamps=["kickoff_time"])


@query("feature_build", feature_build_sql())
def q_feature_build(spark, d):
    """C1 (flagship): history -> lagged features -> context -> dummies -> strengths -> matrix."""
    matrix, _ = feature_build(an.history_with_players(spark, d), an.fixtures(spark, d),
                              an.teams(spark, d), measures=MEASURES)
    return matrix


@query("feature_matrix", sql_out(
    f"""SELECT player_id, gw, player_name, team_id, position_id, kickoff_time, was_home, total_points
FROM ({an.HISTORY_PLAYERS_SQL}) AS h WHERE total_points IS NOT NULL""",
    doubles=["total_points"], timestamps=["kickoff_time"]))
def q_feature_matrix(spark, d):
    """Id columns + present base features + discovered lag features + target; rows without target dropped."""
    m, _ = feature_matrix(an.history_with_players(spark, d))
    return m
