"""Queries: snapshots, landing with quarantine, mapping CSV, embedded JSON,
active filter, matching inputs and fuzzy matching, refresh planning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import full_name
from tessera.operators import matching as mt
from tessera.operators import refresh as rf
from tessera.plans import analogue as an
from tessera.plans.registry import query, sql_out
from tessera.session import scratch_path
from tessera.sources import landing as ld
from tessera.sources import snapshots as sn
from tessera.sources.tables import read_table

# Two landing runs over the events: a full run up to Jan 15 and an incremental
# run with the entities active since Jan 10.
RUNS = (("20240115T000000Z", None, "2024-01-15 00:00:00"), ("20240131T000000Z", "2024-01-10 00:00:00", None))
DOC_SCHEMA = T.StructType([T.StructField("entity", T.StringType()), T.StructField("entity_id", T.LongType()),
                           T.StructField("n_events", T.LongType()), T.StructField("total_value", T.DoubleType()),
                           T.StructField("last_ts", T.StringType())])


def _run_docs(spark, d, lo, hi):
    e = read_table(spark, d, "events")
    if lo:
        e = e.filter(F.col("ts") >= F.lit(lo).cast("timestamp"))
    if hi:
        e = e.filter(F.col("ts") < F.lit(hi).cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value"),
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("last_ts")) \
        .select(F.lit("user").alias("entity"), "*")


def _bronze(spark, d):
    base = scratch_path(spark, "bronze")
    for stamp_, lo, hi in RUNS:
        sn.append_snapshot(_run_docs(spark, d, lo, hi), base, stamp_)
    return sn.read_snapshots(spark, base, DOC_SCHEMA)


def _runs_sql():
    parts = []
    for stamp_, lo, hi in RUNS:
        cond = " AND ".join(x for x in [f"ts >= TIMESTAMP '{lo}'" if lo else "", f"ts < TIMESTAMP '{hi}'" if hi else ""] if x)
        parts.append(f"SELECT user_id AS entity_id, '{stamp_}' AS snapshot_ts, count(*) AS n_events, "
                     f"sum(value) AS total_value FROM events WHERE {cond} GROUP BY user_id")
    return " UNION ALL ".join(parts)


@query("snapshot_append", sql_out(_runs_sql(), doubles=["total_value"]))
def q_snapshot_append(spark, d):
    """Two landing runs appended under snapshot stamps, read back."""
    return _bronze(spark, d).select("entity_id", "snapshot_ts", "n_events", "total_value")


@query("snapshot_latest", sql_out(f"""SELECT entity_id, arg_max(snapshot_ts, snapshot_ts) AS snapshot_ts,
  arg_max(n_events, snapshot_ts) AS n_events, arg_max(total_value, snapshot_ts) AS total_value
FROM ({_runs_sql()}) AS r GROUP BY entity_id""", doubles=["total_value"]))
def q_snapshot_latest(spark, d):
    """Newest snapshot per entity (a view over the append-only bronze)."""
    latest = sn.latest_snapshot(_bronze(spark, d))
    return latest.select("entity_id", "snapshot_ts", "n_events", "total_value")


def _landed(spark, d):
    e = read_table(spark, d, "events")
    js = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = F.when(F.col("event_type") == "error", F.expr("substring(j, 1, length(j) - 2)")).otherwise(F.col("j"))
    path = scratch_path(spark, "landing")
    lines = e.select("event_type", js.alias("j")).select(line.alias("value"))
    lines.unionByName(e.filter("event_type = 'click'").select(F.lit(" ").alias("value"))).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    return ld.land_with_quarantine(spark, path, schema)


@query("land_with_quarantine", """SELECT event_id, user_id, event_type, value FROM events
WHERE event_type <> 'error'""")
def q_land_with_quarantine(spark, d):
    """S3: landed JSON lines (error events arrive truncated, some lines are blank) -> good rows."""
    return _landed(spark, d)[0]


@query("quarantine_rows", """SELECT event_id, user_id FROM events WHERE event_type = 'error'""")
def q_quarantine_rows(spark, d):
    """S3: the records that don't parse, kept with their text."""
    text = F.col(ld.CORRUPT)
    return _landed(spark, d)[1].select(
        F.regexp_extract(text, r'"event_id":(\d+)', 1).cast("bigint").alias("event_id"),
        F.regexp_extract(text, r'"user_id":(\d+)', 1).cast("bigint").alias("user_id"))


def _mapping_csv(spark, d):
    path = scratch_path(spark, "mapping")
    ld.write_mapping(an.mapping_rows(spark, d), path)
    return path


@query("load_mapping", """SELECT c_custkey AS fpl_id, c_custkey + 100000 AS understat_id, c_acctbal > 0 AS verified
FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'""")
def q_load_mapping(spark, d):
    """Mapping CSV written then read: required columns, blank ids dropped, ids cast."""
    return ld.load_mapping(spark, _mapping_csv(spark, d))


@query("mapping_report", """SELECT CAST(count_if(c_mktsegment <> 'AUTOMOBILE' AND c_acctbal > 0) AS BIGINT) AS verified,
  CAST(count_if(c_mktsegment <> 'AUTOMOBILE' AND NOT c_acctbal > 0) AS BIGINT) AS unverified,
  CAST(count_if(c_mktsegment = 'AUTOMOBILE') AS BIGINT) AS no_match FROM customer""")
def q_mapping_report(spark, d):
    """Verified / unverified / no-match counts of the mapping file."""
    raw = spark.read.option("header", True).schema(ld.MAPPING_SCHEMA).csv(_mapping_csv(spark, d))
    return ld.mapping_report(raw)


def _pages_with_vars(spark, d):
    p = read_table(spark, d, "pages", spread=True)
    esc = lambda c: F.replace(c, F.lit('"'), F.lit("\\x22"))
    page = esc(F.to_json(F.struct("page_id", "url")))
    meta = esc(F.to_json(F.struct(F.length("url").alias("n_chars"))))
    script = F.concat(F.lit("<script>var pageData = JSON.parse('"), page, F.lit("'); var metaData = JSON.parse('"),
                      meta, F.lit("');</script>"))
    return p.select("page_id", F.concat("html", script).alias("html"))


@query("extract_embedded_json", """SELECT page_id, 'pageData' AS var_name, page_id AS p_page_id, url AS p_url,
  CAST(NULL AS BIGINT) AS p_n_chars FROM pages
UNION ALL SELECT page_id, 'metaData', NULL, NULL, CAST(length(url) AS BIGINT) FROM pages""")
def q_extract_embedded_json(spark, d):
    """All `var x = JSON.parse('...')` variables of every page, unescaped and parsed."""
    ex = ld.extract_embedded_json(_pages_with_vars(spark, d), "page_id")
    parsed = F.from_json("json", "page_id BIGINT, url STRING, n_chars BIGINT")
    return ex.select("page_id", "var_name", parsed["page_id"].alias("p_page_id"),
                     parsed["url"].alias("p_url"), parsed["n_chars"].alias("p_n_chars"))


@query("page_quarantine", """SELECT page_id, 'pageData,metaData' AS missing FROM pages WHERE url LIKE '%?%'""")
def q_page_quarantine(spark, d):
    """Pages that arrive without a known variable are reported, not lost."""
    pages = _pages_with_vars(spark, d).join(read_table(spark, d, "pages").select("page_id", "url"), "page_id")
    bare = F.when(F.col("url").contains("?"), F.regexp_replace("html", r"JSON\.parse", "JSON.read")).otherwise(F.col("html"))
    return ld.quarantine_pages(pages.withColumn("html", bare), "page_id", ["pageData", "metaData"])


@query("page_variables", "SELECT page_id, url AS page_url, CAST(length(url) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS n_other FROM pages")
def q_page_variables(spark, d):
    """One column per known variable of a page, parsed; an absent list is empty."""
    ex = ld.extract_embedded_json(_pages_with_vars(spark, d), "page_id")
    wide = ld.pivot_variables(ex, "page_id", ["pageData", "metaData", "otherData"], {
        "pageData": "struct<page_id:bigint,url:string>", "metaData": "struct<n_chars:bigint>", "otherData": "array<string>"})
    return wide.select("page_id", F.col("pageData.url").alias("page_url"), F.col("metaData.n_chars").alias("n_chars"),
                       F.size("otherData").alias("n_other"))


def _players_with_status(spark, d):
    c = read_table(spark, d, "customer")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "u").when(F.col("c_mktsegment") == "MACHINERY", None) \
              .otherwise("a")
    return c.select(F.col("c_custkey").alias("id"), status.alias("status"))


@query("filter_active", """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'u'
  WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'a' END AS status FROM customer
WHERE c_mktsegment <> 'BUILDING'""")
def q_filter_active(spark, d):
    """Drop status 'u'; a missing status is kept."""
    return ld.filter_active(_players_with_status(spark, d))


def _match_inputs(spark, d):
    c = read_table(spark, d, "customer")
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    first = F.split_part("c_name", F.lit("#"), F.lit(1))
    second = F.when(F.col("c_acctbal") >= 0, F.split_part("c_name", F.lit("#"), F.lit(2)))
    # nations: a 25-row dimension
    return c.join(F.broadcast(n), "c_nationkey", "left").select(
        F.col("c_custkey").alias("fpl_id"), full_name(first, second).alias("fpl_name"),
        F.coalesce("n_name", F.lit("Unknown")).alias("fpl_team"))


@query("match_inputs", """SELECT c_custkey AS fpl_id,
  trim(split_part(c_name, '#', 1) || ' ' || coalesce(CASE WHEN c_acctbal >= 0 THEN split_part(c_name, '#', 2) END, '')) AS fpl_name,
  coalesce(n_name, 'Unknown') AS fpl_team
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def q_match_inputs(spark, d):
    """Projections for matching: full name (missing part = ''), team name default 'Unknown'."""
    return _match_inputs(spark, d)


@query("snapshot_counts", """SELECT (SELECT count(*) FROM customer) AS n_players,
  (SELECT count(*) FROM nation) AS n_teams,
  (SELECT count(DISTINCT (year(o_orderdate) - 1995) * 12 + month(o_orderdate)) FROM orders) AS n_gws,
  (SELECT count(*) FROM lineitem) AS n_fixtures,
  (SELECT CAST(count_if(l_linestatus = 'F') AS BIGINT) FROM lineitem) AS n_finished""")
def q_snapshot_counts(spark, d):
    """Snapshot summary counts, each a one-row aggregate attached as a scalar subquery."""
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    o, li = an.history(spark, d), read_table(spark, d, "lineitem")
    return spark.range(1).select(
        c.agg(F.count(F.lit(1))).scalar().alias("n_players"),
        n.agg(F.count(F.lit(1))).scalar().alias("n_teams"),
        o.agg(F.countDistinct("gw")).scalar().alias("n_gws"),
        li.agg(F.count(F.lit(1))).scalar().alias("n_fixtures"),
        li.agg(F.count_if(F.col("l_linestatus") == "F")).scalar().alias("n_finished"))


AS_OF = datetime(2024, 1, 31)
FRESH_SQL = """SELECT user_id AS entity_id FROM events GROUP BY user_id
HAVING date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31 00:00:00') / 8.64e10 < 1.0"""


def _plan(spark, d):
    req = read_table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    log = read_table(spark, d, "events").select(F.col("user_id").alias("entity_id"),
                                                F.col("ts").alias("fetched_at"))
    return rf.refresh_plan(req, log, AS_OF, rf.TTL_DAYS["current"])


@query("refresh_plan_fresh", f"SELECT DISTINCT c_custkey AS entity_id FROM customer WHERE c_custkey IN ({FRESH_SQL})")
def q_refresh_plan_fresh(spark, d):
    """Requested ids whose newest fetch is within the TTL (semi join)."""
    return _plan(spark, d)[0]


@query("refresh_plan_stale", f"SELECT DISTINCT c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN ({FRESH_SQL})")
def q_refresh_plan_stale(spark, d):
    """Requested ids to fetch again: absent or stale (anti join)."""
    return _plan(spark, d)[1]


def _name_sides(spark, d):
    p = read_table(spark, d, "part")
    left = p.groupBy(F.col("p_name").alias("fpl_name")).agg(F.min("p_partkey").alias("fpl_id"))
    toks = F.split("p_name", " ")
    rev = F.array_join(F.reverse(toks), " ")
    # one letter removed: the second character of the reversed name
    altered = F.concat(F.substring(rev, 1, 1), F.substr(rev, F.lit(3)))
    right = p.groupBy(altered.alias("understat_name")).agg((F.min("p_partkey") + 1000000).alias("understat_id"))
    return left, right


def _tskey_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda x: x <> '')), ' ')"


def _lcs_sql(a: str, b: str) -> str:
    """LCS length as a dynamic program over list_reduce (one DP row per character of a)."""
    return f"""list_reduce(string_split({a}, ''),
      lambda prev, ch: list_reduce(list_zip(range(1, length({b}) + 1), string_split({b}, '')),
          lambda cur, jc: list_append(cur, CASE WHEN jc[2] = ch THEN prev[jc[1]] + 1
                                           ELSE greatest(prev[jc[1] + 1], cur[jc[1]]) END), [0]),
      list_transform(range(0, length({b}) + 1), lambda x: 0))[length({b}) + 1]"""


def _ratio_sql(a: str, b: str) -> str:
    return (f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 100.0 ELSE "
            f"CAST(200 * {_lcs_sql(a, b)} AS DOUBLE) / (length({a}) + length({b})) END")


_ALTERED_SQL = ("substring(array_to_string(list_reverse(string_split(p_name, ' ')), ' '), 1, 1) || "
                "substring(array_to_string(list_reverse(string_split(p_name, ' ')), ' '), 3)")

TSR_SQL = f"""SELECT p_partkey, p_name, altered, {_ratio_sql('ka', 'kb')} AS score FROM (
  SELECT p_partkey, p_name, altered, {_tskey_sql('p_name')} AS ka, {_tskey_sql('altered')} AS kb
  FROM (SELECT p_partkey, p_name, {_ALTERED_SQL} AS altered FROM part) AS x) AS y"""

FUZZY_SQL = f"""WITH l AS (SELECT p_name AS fpl_name, min(p_partkey) AS fpl_id FROM part GROUP BY p_name),
r AS (SELECT altered AS understat_name, min(p_partkey) + 1000000 AS understat_id
      FROM (SELECT p_partkey, {_ALTERED_SQL} AS altered FROM part) AS x GROUP BY altered),
lk AS (SELECT fpl_id, {_tskey_sql('fpl_name')} AS k FROM l),
rk AS (SELECT understat_id, understat_name, {_tskey_sql('understat_name')} AS k FROM r),
pairs AS (SELECT lk.fpl_id, rk.understat_id, rk.understat_name, {_ratio_sql('lk.k', 'rk.k')} AS score FROM lk, rk),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fpl_id ORDER BY score DESC, understat_id) AS rn
                        FROM pairs WHERE score >= 70) AS z WHERE rn = 1)
SELECT l.fpl_name, l.fpl_id, b.understat_id, b.understat_name,
  round_even(coalesce(b.score, 0.0), 1) AS match_score, coalesce(b.score >= 95, false) AS verified,
  CASE WHEN b.score IS NULL THEN 'NO_MATCH' ELSE '' END AS notes
FROM l LEFT JOIN best b ON b.fpl_id = l.fpl_id"""


@query("token_sort_ratio", sql_out(TSR_SQL, doubles=["score"]))
def q_token_sort_ratio(spark, d):
    """token-sort ratio of every part name against its altered spelling (one pair per row)."""
    p = read_table(spark, d, "part")
    rev = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    altered = F.concat(F.substring(rev, 1, 1), F.substr(rev, F.lit(3)))
    return p.select("p_partkey", "p_name", altered.alias("altered"),
                    mt.token_sort_ratio(F.col("p_name"), altered).alias("score"))


@query("fuzzy_best_match", sql_out(FUZZY_SQL, doubles=["match_score"]))
def q_fuzzy_best_match(spark, d):
    """Best token-sort partner per name (cut-off 70, verified >= 95), sorted by score."""
    left, right = _name_sides(spark, d)
    out = mt.fuzzy_best_match(left, right)
    return out.orderBy(F.col("match_score").desc(), "fpl_id")
