"""Domain-shaped inputs derived from the driver tables.

Each builder returns a Spark DataFrame; the constant next to it is the same
relation in SQL for the DuckDB oracle.  Mapping (player = customer, match =
order, period = month index, fixture = line item, shot = line item of an
order, second source = events):

* history: player_id = o_custkey, fixture_id = o_orderkey,
  gw = (year - 1995) * 12 + month of o_orderdate, kickoff_time = o_orderdate,
  total_points = floor(o_totalprice) % 200 / 10, minutes = o_orderkey % 91
  (missing for status 'P'), value = floor(o_totalprice / 1e3) (price x10,
  cost = value / 10); measures have few decimals so that means of them round
  identically in every engine,
  was_home = status 'F'
* players: id = c_custkey, team = c_nationkey, element_type = c_custkey % 4 + 1
* fixtures: id = l_orderkey * 10 + l_linenumber, event = gw of the order
  (NULL when l_returnflag = 'N': unscheduled), team_h = supplier nation,
  team_a = customer nation, difficulties l_linenumber and l_quantity % 5 + 1
* teams: nations with six strength ratings derived from the nation row
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table


# The other rolled measures: small whole numbers (or tenths) from the order's keys, as SQL for both engines.
_DERIVED = {"goals_scored": (7, 4, 1), "assists": (11, 3, 1), "bonus": (13, 4, 1), "bps": (17, 60, 1),
            "influence": (19, 1000, 10), "creativity": (23, 900, 10), "threat": (29, 800, 10),
            "ict_index": (31, 250, 10), "clean_sheets": (37, 2, 1), "goals_conceded": (41, 6, 1),
            "expected_goals": (43, 20, 10), "expected_assists": (47, 15, 10), "expected_goal_involvements": (53, 30, 10)}
DERIVED_SQL = {c: f"CASE WHEN (o_orderkey + {a}) % 29 <> 0 THEN CAST((o_orderkey * {a} + o_custkey) % {m} AS DOUBLE) / {d} END"
               for c, (a, m, d) in _DERIVED.items()}


def gw_of(ts) -> F.Column:
    return ((F.year(ts) - 1995) * 12 + F.month(ts)).cast("bigint")


GW_SQL = "CAST((year({c}) - 1995) * 12 + month({c}) AS BIGINT)"


def history(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("player_id"),
        F.col("o_orderkey").alias("fixture_id"),
        gw_of(F.col("o_orderdate")).alias("gw"),
        F.col("o_orderdate").alias("kickoff_time"),
        ((F.floor("o_totalprice") % 200) / 10.0).alias("total_points"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 91).cast("double")).alias("minutes"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("value"),
        (F.col("o_orderstatus") == "F").alias("was_home"),
        *[F.expr(e).alias(c) for c, e in DERIVED_SQL.items()],
    )


HISTORY_SQL = f"""SELECT o_custkey AS player_id, o_orderkey AS fixture_id,
  {GW_SQL.format(c='o_orderdate')} AS gw, o_orderdate AS kickoff_time,
  CAST(floor(o_totalprice) AS BIGINT) % 200 / 10.0 AS total_points,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 91 AS DOUBLE) END AS minutes,
  CAST(floor(o_totalprice / 1000) AS DOUBLE) AS value, o_orderstatus = 'F' AS was_home,
  {', '.join(f"{e} AS {c}" for c, e in DERIVED_SQL.items())}
FROM orders"""


def players(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("player_name"),
        F.col("c_nationkey").cast("bigint").alias("team"),
        (F.col("c_custkey") % 4 + 1).cast("bigint").alias("element_type"),
    )


PLAYERS_SQL = """SELECT c_custkey AS id, c_name AS player_name, CAST(c_nationkey AS BIGINT) AS team,
  CAST(c_custkey % 4 + 1 AS BIGINT) AS element_type FROM customer"""


# Fixed value: rows of the history in one task of the window layer and of what is trained from it.
PART_ROWS = 100_000


def in_parts(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by the key into parts of about PART_ROWS rows, at least one a core; one part's rows stay as they are."""
    rows = df.count()
    if rows <= PART_ROWS:
        return df
    return df.repartition(max(-(-rows // PART_ROWS), df.sparkSession.sparkContext.defaultParallelism), key)


def history_with_players(spark: SparkSession, d: str) -> DataFrame:
    """History joined to the player dimension (left: unknown players keep their rows).

    The player dimension grows with the data (it is a customer table), so no
    broadcast hint: AQE broadcasts it at run time only if its measured size is
    under the threshold, else the join shuffles on player_id, the same key the
    window layer partitions on.  The history is dealt out by that key first, into
    parts of a bounded number of rows: the features make a row far wider than it
    is in the shuffle, which is what Spark would cut by.
    """
    p = players(spark, d).select(F.col("id").alias("player_id"), "player_name",
                                 F.col("team").alias("team_id"),
                                 F.col("element_type").alias("position_id"))
    return in_parts(history(spark, d), "player_id").join(p, "player_id", "left")


HISTORY_PLAYERS_SQL = f"""SELECT h.*, p.player_name, p.team AS team_id, p.element_type AS position_id
FROM ({HISTORY_SQL}) h LEFT JOIN ({PLAYERS_SQL}) p ON p.id = h.player_id"""


def fixtures(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", spread=True).select("l_orderkey", "l_suppkey", "l_linenumber",
                                                "l_quantity", "l_returnflag", "l_linestatus")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(c, o.o_custkey == c.c_custkey))
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_returnflag") != "N", gw_of(F.col("o_orderdate"))).alias("event"),
        F.col("s_nationkey").cast("bigint").alias("team_h"),
        F.col("c_nationkey").cast("bigint").alias("team_a"),
        F.col("l_linenumber").cast("bigint").alias("team_h_difficulty"),
        (F.col("l_quantity").cast("int") % 5 + 1).cast("bigint").alias("team_a_difficulty"),
        (F.col("l_linestatus") == "F").alias("finished"),
    )


FIXTURES_SQL = f"""SELECT l_orderkey * 10 + l_linenumber AS id,
  CASE WHEN l_returnflag <> 'N' THEN {GW_SQL.format(c='o_orderdate')} END AS event,
  CAST(s_nationkey AS BIGINT) AS team_h, CAST(c_nationkey AS BIGINT) AS team_a,
  CAST(l_linenumber AS BIGINT) AS team_h_difficulty,
  CAST(CAST(l_quantity AS INTEGER) % 5 + 1 AS BIGINT) AS team_a_difficulty,
  l_linestatus = 'F' AS finished
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"""


def teams(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.substring("n_name", 1, 3).alias("short_name"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("strength_overall_home"),
        (F.col("n_nationkey") % 5 + 1).cast("bigint").alias("strength_overall_away"),
        F.length("n_name").cast("bigint").alias("strength_attack_home"),
        (F.col("n_nationkey") % 3 + 2).cast("bigint").alias("strength_attack_away"),
        (F.col("n_regionkey") * 2 + 1).cast("bigint").alias("strength_defence_home"),
        (F.col("n_nationkey") % 7 + 1).cast("bigint").alias("strength_defence_away"),
    )


TEAMS_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, substring(n_name, 1, 3) AS short_name,
  CAST(n_regionkey + 1 AS BIGINT) AS strength_overall_home,
  CAST(n_nationkey % 5 + 1 AS BIGINT) AS strength_overall_away,
  CAST(length(n_name) AS BIGINT) AS strength_attack_home,
  CAST(n_nationkey % 3 + 2 AS BIGINT) AS strength_attack_away,
  CAST(n_regionkey * 2 + 1 AS BIGINT) AS strength_defence_home,
  CAST(n_nationkey % 7 + 1 AS BIGINT) AS strength_defence_away
FROM nation"""


# ------------------------------------------------------------ second source
# Second-source documents: one per order, matchesData = [the order as a match],
# shotsData = its line items as shots.  Every scalar is a string; 'npxG' is
# absent for status 'O' (fallback to xG), 'shotType' is absent on line 1
# (fallback to 'type'), shots carry no season (fallback to the match season),
# key_passes is unparsable for '1-URGENT' orders (tolerant cast -> 0).
US_ID_OFFSET = 100000


def _str(c) -> F.Column:
    return c.cast("string")


def second_source_docs(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus")
    o = read_table(spark, d, "orders", spread=True).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    # line items per order are bounded (at most a few dozen), so the per-order list is small
    # only numbers and flags are shuffled and sorted, by (line number, part, supplier, then every value used), so
    # positions are deterministic and rows still tied are identical; the maps of strings, many times their size, are
    # built from the sorted list
    line = F.struct(*[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                         "l_discount", "l_tax", "l_returnflag", "l_linestatus")])

    def shot(k):
        kind = F.when(k["l_linenumber"] == 1, F.lit("type")).otherwise(F.lit("shotType"))
        shot_type = (F.when(k["l_returnflag"] == "R", "Head")
                     .when(k["l_returnflag"] == "A", "RightFoot").otherwise("LeftFoot"))
        return F.map_from_arrays(
            F.array(F.lit("match_id"), F.lit("minute"), F.lit("X"), F.lit("Y"), F.lit("xG"),
                    F.lit("result"), kind, F.lit("situation"), F.lit("lastAction")),
            F.array(_str(F.col("l_orderkey")), _str(k["l_linenumber"] * 10),
                    _str(F.lit(0.75) + k["l_tax"] * 2), _str(k["l_quantity"] / 50),
                    _str(k["l_discount"] * 4),
                    F.when(k["l_linestatus"] == "F", "Goal").otherwise("MissedShots"),
                    shot_type,
                    F.when(k["l_linestatus"] == "F", "OpenPlay").otherwise("SetPiece"),
                    F.lit("Pass")))
    shots = li.select("l_orderkey", line.alias("k")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("k")).alias("lines"), F.count(F.lit(1)).alias("n_shots"))
    j = o.join(shots, o.o_orderkey == shots.l_orderkey, "left")
    base_keys = ["id", "date", "season", "isHome", "xG", "xA", "goals", "assists", "shots",
                 "key_passes", "yellow", "red", "time", "h_team", "a_team", "h_goals", "a_goals",
                 "position"]
    base_vals = [
        _str(F.col("o_orderkey")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        _str(F.year("o_orderdate")), _str(F.col("o_orderstatus") == "F"),
        _str((F.floor("o_totalprice") % 1000) / 1000.0), _str((F.col("o_orderkey") % 50) / 100.0),
        _str(F.col("o_orderkey") % 3), _str(F.col("o_custkey") % 2),
        _str(F.coalesce(F.col("n_shots"), F.lit(0))),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("n/a")).otherwise(_str(F.col("o_orderkey") % 4)),
        F.lit("0"), F.lit("0"), _str(F.col("o_orderkey") % 91), F.lit("H"), F.lit("A"),
        _str(F.col("o_orderkey") % 4), _str(F.col("o_custkey") % 3), F.lit("FW"),
    ]
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in base_keys]), F.array(*base_vals))
    npx = F.map_from_arrays(F.array(F.lit("npxG")), F.array(_str((F.floor("o_totalprice") % 700) / 1000.0)))
    match = F.when(F.col("o_orderstatus") != "O", F.map_concat(m, npx)).otherwise(m)
    return j.select((F.col("o_custkey") + US_ID_OFFSET).alias("understat_id"),
                    F.array(match).alias("matchesData"),
                    F.coalesce(F.transform("lines", shot), F.array()).alias("shotsData"))


MATCHES_SQL = f"""SELECT o_custkey + {US_ID_OFFSET} AS understat_id, o_orderkey AS match_id,
  o_orderdate AS date, CAST(year(o_orderdate) AS VARCHAR) AS season, o_orderstatus = 'F' AS is_home,
  floor(o_totalprice) % 1000 / 1000.0 AS xG, (o_orderkey % 50) / 100.0 AS xA,
  CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice) % 700 / 1000.0
       ELSE floor(o_totalprice) % 1000 / 1000.0 END AS npxG,
  o_orderkey % 3 AS goals, o_custkey % 2 AS assists,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS shots,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_orderkey % 4 END AS key_passes,
  CAST(0 AS BIGINT) AS yellow_cards, CAST(0 AS BIGINT) AS red_cards, o_orderkey % 91 AS minutes,
  'H' AS h_team, 'A' AS a_team, o_orderkey % 4 AS h_goals, o_custkey % 3 AS a_goals, 'FW' AS position
FROM orders"""

SHOTS_SQL = f"""SELECT o_custkey + {US_ID_OFFSET} AS understat_id, l_orderkey AS match_id,
  CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(NULL AS TIMESTAMP) AS date,
  CAST(l_linenumber * 10 AS BIGINT) AS minute, 0.75 + l_tax * 2 AS X, l_quantity / 50 AS Y,
  l_discount * 4 AS xG, CASE WHEN l_linestatus = 'F' THEN 'Goal' ELSE 'MissedShots' END AS result,
  CASE l_returnflag WHEN 'R' THEN 'Head' WHEN 'A' THEN 'RightFoot' ELSE 'LeftFoot' END AS shot_type,
  CASE WHEN l_linestatus = 'F' THEN 'OpenPlay' ELSE 'SetPiece' END AS situation,
  CAST(NULL AS VARCHAR) AS player_assisted, 'Pass' AS last_action
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def periods(spark: SparkSession, d: str) -> DataFrame:
    """Period calendar derived from the history's months: gw n opens two days
    before its month at 11:30 UTC; gw 1 has no published deadline (dropped)."""
    # a generator in between keeps conditions on the deadlines, which are dear, from being asked of every order
    months = history(spark, d).select("gw").distinct().select(F.explode(F.array("gw")).alias("gw"))
    first_day = F.make_date(F.lit(1995) + F.floor((F.col("gw") - 1) / 12), (F.col("gw") - 1) % 12 + 1, F.lit(1))
    deadline = F.concat(F.date_format(F.date_sub(first_day, 2), "yyyy-MM-dd"), F.lit("T11:30:00Z"))
    return months.select(F.col("gw").alias("id"), F.when(F.col("gw") > 1, deadline).alias("deadline_time"))


PERIODS_SQL = f"""SELECT gw AS id, CASE WHEN gw > 1 THEN
  make_timestamp(CAST(1995 + floor((gw - 1) / 12) AS BIGINT), CAST((gw - 1) % 12 + 1 AS BIGINT), 1, 11, 30, 0)
  - INTERVAL 2 DAYS END AS deadline_time
FROM (SELECT DISTINCT gw FROM ({HISTORY_SQL}) AS h) AS m"""


def mapping_rows(spark: SparkSession, d: str) -> DataFrame:
    """Mapping candidates: every customer; no second-source id for segment
    'AUTOMOBILE'; verified when the account balance is positive."""
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("fpl_id"), F.col("c_name").alias("fpl_name"),
        F.col("c_nationkey").cast("string").alias("fpl_team"),
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col("c_custkey") + US_ID_OFFSET).alias("understat_id"),
        F.col("c_name").alias("understat_name"), F.col("c_nationkey").cast("string").alias("understat_team"),
        F.lit(100.0).alias("match_score"), (F.col("c_acctbal") > 0).alias("verified"),
        F.lit("").alias("notes"))


MAPPING_SQL = f"""SELECT c_custkey AS fpl_id, c_custkey + {US_ID_OFFSET} AS understat_id
FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'"""
