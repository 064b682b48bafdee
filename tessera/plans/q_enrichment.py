"""Queries: second-source flattening, shot quality, as-of alignment, mapping,
dedup, enrichment merge and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import parse_utc, to_double, to_int_or_zero
from tessera.operators import flatten as fl
from tessera.operators import windows as win
from tessera.operators.asof import asof_backward
from tessera.plans import analogue as an
from tessera.plans import builds
from tessera.plans.registry import query, sql_out
from tessera.sources.tables import read_table

MATCH_DOUBLES = ["xG", "xA", "npxG"]
SHOT_FLAGS = ["is_danger_zone", "is_header", "is_open_play", "is_big_chance"]
SHOTS_FLAGGED_SQL = f"""SELECT *,
  CAST(coalesce(X > 0.83 AND Y > 0.30 AND Y < 0.70, false) AS DOUBLE) AS is_danger_zone,
  CAST(coalesce(lower(shot_type) = 'head', false) AS DOUBLE) AS is_header,
  CAST(coalesce(lower(situation) = 'openplay', false) AS DOUBLE) AS is_open_play,
  CAST(coalesce(xG >= 0.30, false) AS DOUBLE) AS is_big_chance
FROM ({an.SHOTS_SQL}) AS s"""


@query("flatten_matches", sql_out(an.MATCHES_SQL, doubles=MATCH_DOUBLES, timestamps=["date"]))
def q_flatten_matches(spark, d):
    """Explode match records, typed with tolerant casts, npxG falls back to xG."""
    return fl.flatten_matches(an.second_source_docs(spark, d))


@query("flatten_shots", sql_out(SHOTS_FLAGGED_SQL, doubles=["X", "Y", "xG", *SHOT_FLAGS], timestamps=["date"]))
def q_flatten_shots(spark, d):
    """Explode shots; season from the match of the same document; flags."""
    return fl.flatten_shots(an.second_source_docs(spark, d))


@query("key_fallback", f"""SELECT understat_id, match_id, minute, shot_type FROM ({an.SHOTS_SQL}) AS s""")
def q_key_fallback(spark, d):
    """shotType falls back to 'type' only when the key is missing."""
    return fl.flatten_shots(an.second_source_docs(spark, d)).select(
        "understat_id", "match_id", "minute", "shot_type")


@query("shot_flags", sql_out(f"SELECT understat_id, match_id, minute, {', '.join(SHOT_FLAGS)} "
                             f"FROM ({SHOTS_FLAGGED_SQL}) AS s", doubles=SHOT_FLAGS))
def q_shot_flags(spark, d):
    """Danger zone, header, open play, big chance as 0/1 (missing input -> 0)."""
    return fl.flatten_shots(an.second_source_docs(spark, d)).select(
        "understat_id", "match_id", "minute", *SHOT_FLAGS)


SHOT_AGG_SQL = f"""SELECT understat_id, match_id,
  CASE WHEN count(xG) > 0 THEN coalesce(sum(xG), 0) / count(xG) END AS xG_per_shot,
  CASE WHEN count(xG) > 0 THEN sum(is_danger_zone) / count(xG) END AS danger_zone_pct,
  CASE WHEN count(xG) > 0 THEN sum(is_header) / count(xG) END AS header_pct,
  CASE WHEN count(xG) > 0 THEN sum(is_open_play) / count(xG) END AS open_play_pct,
  sum(is_big_chance) AS big_chances
FROM ({SHOTS_FLAGGED_SQL}) AS s GROUP BY understat_id, match_id"""
SHOT_AGG_DOUBLES = ["xG_per_shot", "danger_zone_pct", "header_pct", "open_play_pct", "big_chances"]


@query("second_source_counts", f"""SELECT o_custkey + {an.US_ID_OFFSET} AS understat_id, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_matches,
  CAST(count(l_orderkey) AS BIGINT) AS n_shots
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def q_second_source_counts(spark, d):
    """Matches and shots per player of the second source, from the documents' lists alone."""
    return fl.document_counts(an.second_source_docs(spark, d))


@query("shot_match_agg", sql_out(SHOT_AGG_SQL, doubles=SHOT_AGG_DOUBLES))
def q_shot_match_agg(spark, d):
    """A2/A3: per (id, match) shot quality with safe ratios."""
    return fl.shot_match_agg(fl.flatten_shots(an.second_source_docs(spark, d)))


MATCH_SHOTS_SQL = f"""SELECT m.*, a.xG_per_shot, a.danger_zone_pct, a.header_pct, a.open_play_pct,
  a.big_chances, m.goals - m.xG AS xG_overperformance
FROM ({an.MATCHES_SQL}) m LEFT JOIN ({SHOT_AGG_SQL}) a USING (understat_id, match_id)"""


@query("join_match_shots", sql_out(
    f"""SELECT understat_id, match_id, xG, goals, xG_per_shot, danger_zone_pct, header_pct, open_play_pct,
  big_chances, xG_overperformance FROM ({MATCH_SHOTS_SQL}) AS j""",
    doubles=["xG", *SHOT_AGG_DOUBLES, "xG_overperformance"]))
def q_join_match_shots(spark, d):
    """Matches left join shot aggregates; xG_overperformance = goals - xG."""
    return builds.second_source_matches(an.second_source_docs(spark, d)).select(
        "understat_id", "match_id", "xG", "goals", *fl.SHOT_FEATURES, "xG_overperformance")


@query("tolerant_casts", f"""SELECT event_id,
  try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k_float,
  coalesce(CASE WHEN NOT isnan(try_cast(json_extract_string(props, '$.k') AS DOUBLE))
    THEN CAST(trunc(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) END, 0) AS k_int,
  try_cast(event_type AS DOUBLE) AS type_float, CAST(0 AS BIGINT) AS type_int,
  coalesce(CAST(trunc(value / 7) AS BIGINT), 0) AS ratio_int
FROM events""")
def q_tolerant_casts(spark, d):
    """string -> float (NULL on failure) and -> int truncating toward zero (0 on failure)."""
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", to_double(k).alias("k_float"), to_int_or_zero(k).alias("k_int"),
                    to_double("event_type").alias("type_float"),
                    to_int_or_zero("event_type").alias("type_int"),
                    to_int_or_zero((F.col("value") / 7).cast("string")).alias("ratio_int"))


@query("coerce_types", sql_out("""SELECT event_id, ts AS ts_parsed,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_parsed,
  try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS TIMESTAMP) AS bad_parsed
FROM events""", doubles=["k"], timestamps=["ts_parsed", "day_parsed", "bad_parsed"]))
def q_coerce_types(spark, d):
    """ISO 'Z', 'yyyy-MM-dd' and junk strings to UTC timestamps; numeric strings to double."""
    e = read_table(spark, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select("event_id", parse_utc(iso).alias("ts_parsed"),
                    parse_utc(F.date_format("ts", "yyyy-MM-dd")).alias("day_parsed"),
                    to_double(F.get_json_object("props", "$.k")).alias("k"),
                    parse_utc(F.col("event_type")).alias("bad_parsed"))


PERIOD_DIM_SQL = f"""SELECT CAST(id AS BIGINT) AS gw, deadline_time FROM ({an.PERIODS_SQL}) AS p
WHERE deadline_time IS NOT NULL"""


@query("period_dim", sql_out(PERIOD_DIM_SQL, timestamps=["deadline_time"]))
def q_period_dim(spark, d):
    """Period calendar; rows without a deadline dropped, ISO strings parsed."""
    return builds.period_dim(an.periods(spark, d))


ASOF_SQL = f"""SELECT m.understat_id, m.match_id, m.date, p.gw
FROM ({an.MATCHES_SQL}) m ASOF JOIN ({PERIOD_DIM_SQL}) p ON m.date >= p.deadline_time"""


@query("asof_period", sql_out(ASOF_SQL, timestamps=["date"]))
def q_asof_period(spark, d):
    """Backward as-of: greatest deadline <= time; before the first -> dropped."""
    m = fl.flatten_matches(an.second_source_docs(spark, d)).select("understat_id", "match_id", "date")
    return asof_backward(m, "date", builds.period_dim(an.periods(spark, d)))


@query("join_mapping", f"""SELECT mp.fpl_id, m.understat_id, m.match_id
FROM ({an.MATCHES_SQL}) m JOIN ({an.MAPPING_SQL}) mp USING (understat_id)""")
def q_join_mapping(spark, d):
    """Second-source rows inner join the id mapping."""
    m = fl.flatten_matches(an.second_source_docs(spark, d)).select("understat_id", "match_id")
    mp = an.mapping_rows(spark, d).filter(F.col("understat_id").isNotNull())
    return m.join(mp.select("fpl_id", "understat_id"), "understat_id", "inner")


@query("dedup_keep_last", sql_out(f"""SELECT fpl_id, gw, match_id, date FROM (
  SELECT a.*, mp.fpl_id, row_number() OVER (PARTITION BY mp.fpl_id, a.gw ORDER BY a.date DESC, a.match_id DESC) AS r
  FROM ({ASOF_SQL}) a JOIN ({an.MAPPING_SQL}) mp USING (understat_id)) AS x WHERE r = 1""", timestamps=["date"]))
def q_dedup_keep_last(spark, d):
    """One row per (fpl_id, gw): the latest match (max_by aggregate, not a window)."""
    m = fl.flatten_matches(an.second_source_docs(spark, d)).select("understat_id", "match_id", "date")
    a = asof_backward(m, "date", builds.period_dim(an.periods(spark, d)))
    mp = an.mapping_rows(spark, d).filter(F.col("understat_id").isNotNull()).select("fpl_id", "understat_id")
    j = a.join(mp, "understat_id").select("fpl_id", "gw", "match_id", "date")
    return win.keep_last(j, ["fpl_id", "gw"], ["date", "match_id"])


# --------------------------------------------------------------- enrichment
US_W = "PARTITION BY understat_id ORDER BY date, match_id"


def _us_feature_sql() -> tuple[str, list[str]]:
    names, exprs = [], []
    for c in builds.US_ROLL_COLS:
        for w in (3, 5):
            names.append(f"us_{c}_roll{w}")
            exprs.append(f"avg({c}) OVER ({US_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS us_{c}_roll{w}")
        for s in (3, 5):
            q = f"(1 - 2.0 / ({s} + 1))"
            fr = f"OVER ({US_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
            names.append(f"us_{c}_ewm{s}")
            exprs.append(f"sum({c} * pow({q}, -rn)) {fr} / "
                         f"sum(CASE WHEN {c} IS NOT NULL THEN pow({q}, -rn) END) {fr} AS us_{c}_ewm{s}")
    feats = f"""SELECT understat_id, match_id, date, season, {', '.join(exprs)} FROM (
  SELECT *, row_number() OVER ({US_W}) - 1 AS rn FROM ({MATCH_SHOTS_SQL}) AS j) AS r"""
    inner = f"""SELECT fpl_id, understat_id, gw, season, date, match_id, {', '.join(names)} FROM (
  SELECT f.*, p.gw, mp.fpl_id,
    row_number() OVER (PARTITION BY mp.fpl_id, p.gw ORDER BY f.date DESC, f.match_id DESC) AS r
  FROM ({feats}) f ASOF JOIN ({PERIOD_DIM_SQL}) p ON f.date >= p.deadline_time
  JOIN ({an.MAPPING_SQL}) mp ON mp.understat_id = f.understat_id) AS x WHERE r = 1"""
    return inner, names


ENRICH_SQL, US_NAMES = _us_feature_sql()


def _enrichment(spark, d):
    return builds.enrichment_features(
        an.second_source_docs(spark, d), an.periods(spark, d),
        an.mapping_rows(spark, d).filter(F.col("understat_id").isNotNull()))


@query("enrichment_build", sql_out(ENRICH_SQL, doubles=US_NAMES, timestamps=["date"]))
def q_enrichment_build(spark, d):
    """match+shots -> lagged us_* features -> as-of period -> mapping -> last per (fpl_id, gw)."""
    return _enrichment(spark, d)


@query("us_roll_ewm", sql_out(f"""SELECT user_id, event_id,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS us_value_roll3,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS us_value_roll5,
  sum(value * pow(0.5, -rn)) OVER w / sum(CASE WHEN value IS NOT NULL THEN pow(0.5, -rn) END) OVER w AS us_value_ewm3,
  sum(value * pow(1 - 2.0 / 6, -rn)) OVER w / sum(CASE WHEN value IS NOT NULL THEN pow(1 - 2.0 / 6, -rn) END) OVER w
    AS us_value_ewm5
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) AS e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    doubles=["us_value_roll3", "us_value_roll5", "us_value_ewm3", "us_value_ewm5"]))
def q_us_roll_ewm(spark, d):
    """The same lagged operators over another key / order / prefix (events per user)."""
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    out = win.lagged_features(e, ["user_id"], ["ts", "event_id"], ["value"], prefix="us_")
    return out.select("user_id", "event_id", "us_value_roll3", "us_value_roll5",
                      "us_value_ewm3", "us_value_ewm5")


JOIN_US = ["us_xG_roll3", "us_xG_ewm5", "us_xG_per_shot_roll5", "us_big_chances_ewm3"]


@query("join_enrichment", sql_out(f"""SELECT h.player_id, h.fixture_id, h.gw, {', '.join('e.' + c for c in JOIN_US)}
FROM ({an.HISTORY_SQL}) h LEFT JOIN ({ENRICH_SQL}) e ON e.fpl_id = h.player_id AND e.gw = h.gw""",
    doubles=JOIN_US))
def q_join_enrichment(spark, d):
    """History left join us_* features on (player_id, gw); unmatched keep NULLs."""
    h = an.history(spark, d).select("player_id", "fixture_id", "gw")
    e = _enrichment(spark, d).select("fpl_id", "gw", *JOIN_US)
    return builds.merge_enrichment(h, e).select("player_id", "fixture_id", "gw", *JOIN_US)


@query("enrichment_coverage", sql_out(f"""SELECT avg(CAST(e.us_xG_roll3 IS NOT NULL AS DOUBLE)) AS coverage,
  count(*) AS n_rows
FROM ({an.HISTORY_SQL}) h LEFT JOIN ({ENRICH_SQL}) e ON e.fpl_id = h.player_id AND e.gw = h.gw""",
    doubles=["coverage"]))
def q_enrichment_coverage(spark, d):
    """A10: share of history rows with a first us_* feature."""
    h = an.history(spark, d).select("player_id", "gw")
    e = _enrichment(spark, d).select("fpl_id", "gw", "us_xG_roll3")
    return builds.enrichment_coverage(builds.merge_enrichment(h, e))


@query("flatten_history", sql_out(f"""SELECT o_custkey + {an.US_ID_OFFSET} AS doc_key,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS BIGINT) AS pos,
  l_orderkey AS match_id, CAST(l_linenumber * 10 AS BIGINT) AS minute, l_discount * 4 AS xG,
  CASE WHEN l_linestatus = 'F' THEN 'Goal' ELSE 'MissedShots' END AS result,
  CAST(NULL AS DOUBLE) AS expected_goals
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", doubles=["xG", "expected_goals"]))
def q_flatten_history(spark, d):
    """Posexplode an array with an allow-list; absent optional columns -> NULL."""
    docs = an.second_source_docs(spark, d)
    cols = {"match_id": "bigint", "minute": "bigint", "xG": "double", "result": "string",
            "expected_goals": "double"}
    return fl.flatten_history(docs, "understat_id", "shotsData", cols)


@query("keys_without_rows", "SELECT o_custkey + 100000 AS understat_id FROM orders "
                            "WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_keys_without_rows(spark, d):
    """Documents whose history array is empty."""
    return fl.keys_without_rows(an.second_source_docs(spark, d), "understat_id", "shotsData")
