"""Queries: mapping build from landed player and league lists, its score report, and fuzzy matching of all customers.

Second-source names are spellings of the customers' own: the same, tokens swapped, a letter left out
or put in; every fifth customer has a name on the first side that nothing resembles.  So the best
partner of each is known: its own customer at 100, or at one letter's distance, as any other name is two steps
away or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import matching as mt
from tessera.plans import analogue as an
from tessera.plans import jobs
from tessera.plans.q_dataset import SECOND
from tessera.plans.registry import query, sql_out
from tessera.session import scratch_path
from tessera.sources import documents as dc
from tessera.sources import landing as ld
from tessera.sources.tables import read_table

YEARS = (2023, 2024, 2025)
_STRANGE = "Qwxyz hgjk"


def _customers(spark, d) -> DataFrame:
    c = read_table(spark, d, "customer")
    kind, number = F.col("c_custkey") % 5, F.split_part("c_name", F.lit("#"), F.lit(2))
    word = F.split_part("c_name", F.lit("#"), F.lit(1))
    spelled = (F.when(kind == 1, F.concat(number, F.lit("  "), word)).when(kind == 2, F.concat(F.replace(word, F.lit("o"), F.lit("")), F.lit(" "), number))
               .when(kind == 3, F.concat(word, F.lit("x "), number)).otherwise(F.concat(word, F.lit(" "), number)))
    own = F.when(kind == 4, F.lit(_STRANGE)).otherwise(F.concat(word, F.lit(" "), number))
    return c.select("c_custkey", "c_nationkey", own.alias("own"), spelled.alias("spelled"))


def _landed(spark, d) -> str:
    c, path = _customers(spark, d), scratch_path(spark, "raw-names")
    players = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.collect_list(F.struct(
        F.col("c_custkey").alias("id"), F.split_part("own", F.lit(" "), F.lit(1)).alias("first_name"),
        F.split_part("own", F.lit(" "), F.lit(2)).alias("second_name"), F.when(F.col("c_custkey") % 11 != 3, F.col("c_nationkey")).alias("team"))
    ).alias("elements"))  # at most 500 a document
    teams = an.teams(spark, d).agg(F.collect_list(F.struct("id", "name")).alias("x")).scalar()  # a dimension
    boot = players.select(F.concat(F.lit("bootstrap_"), F.col("part"), F.lit(f"_{SECOND}.json")).alias("file"), F.to_json(F.struct(
        "elements", F.when(F.col("part") == 0, teams).alias("teams")), {"pretty": "true"}).alias("value"))
    # a season's league list is one document, as it is one page at the source, in parts
    years = c.select("*", F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year")).filter((F.col("c_custkey") + F.col("year")) % 3 != 0)
    league = years.groupBy("year", F.coalesce(F.floor(F.col("c_custkey") / 20_000), F.lit(0)).alias("part")).agg(F.collect_list(F.struct((F.col("c_custkey") + an.US_ID_OFFSET).cast("string").alias("id"), F.when(
        F.col("year") == F.greatest(*[F.when((F.col("c_custkey") + y) % 3 != 0, F.lit(y)) for y in YEARS]), F.col("spelled"))
        .otherwise(F.lit("Old Name")).alias("player_name"), F.concat(F.lit("T"), F.col("year")).alias("team_title"))).alias("x"))
    dc.write_documents(boot, path)
    dc.write_documents(league.select(F.concat(F.lit("league_"), F.col("year"), F.lit(".json")).alias("file"), "part",
                                     F.to_json("x", {"pretty": "true"}).alias("value")), path)
    return path


_BEST_SQL = f"""SELECT c_custkey, c_nationkey, c_custkey % 5 AS kind, split_part(c_name, '#', 1) AS word, split_part(c_name, '#', 2) AS number,
  CASE WHEN c_custkey % 5 = 4 THEN '{_STRANGE}' ELSE split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) END AS own,
  CASE c_custkey % 5 WHEN 0 THEN 100.0 WHEN 1 THEN 100.0 WHEN 4 THEN 0.0
    WHEN 2 THEN round_even(200.0 * (length(c_name) - 1) / (2 * length(c_name) - 1), 1)
    ELSE round_even(200.0 * length(c_name) / (2 * length(c_name) + 1), 1) END AS match_score,
  CASE c_custkey % 5 WHEN 0 THEN replace(c_name, '#', ' ') WHEN 1 THEN split_part(c_name, '#', 2) || '  ' || split_part(c_name, '#', 1)
    WHEN 2 THEN replace(split_part(c_name, '#', 1), 'o', '') || ' ' || split_part(c_name, '#', 2)
    WHEN 3 THEN split_part(c_name, '#', 1) || 'x ' || split_part(c_name, '#', 2) END AS partner
FROM customer"""


@query("fuzzy_customers", sql_out(f"""SELECT c_custkey AS fpl_id, own AS fpl_name,
  CASE WHEN kind <> 4 THEN c_custkey + {an.US_ID_OFFSET} END AS understat_id, partner AS understat_name, match_score,
  match_score >= 95 AS verified, CASE WHEN kind = 4 THEN 'NO_MATCH' ELSE '' END AS notes
FROM ({_BEST_SQL}) b""", doubles=["match_score"]))
def q_fuzzy_customers(spark, d):
    """Best partner of every customer's name among all respelled names."""
    c = _customers(spark, d)
    return mt.fuzzy_best_match(c.select(F.col("c_custkey").alias("fpl_id"), F.col("own").alias("fpl_name")), c.filter("c_custkey % 5 <> 4").select(
        (F.col("c_custkey") + an.US_ID_OFFSET).alias("understat_id"), F.col("spelled").alias("understat_name")))


# A customer of the last kind is in the league lists under its usual name, but not under it in the players'.
_FILE_SQL = f"""SELECT c_custkey AS fpl_id, own AS fpl_name,
  CASE WHEN c_custkey % 11 <> 3 THEN coalesce(n_name, 'Unknown') ELSE 'Unknown' END AS fpl_team,
  CASE WHEN kind <> 4 THEN c_custkey + {an.US_ID_OFFSET} END AS understat_id, partner AS understat_name,
  CASE WHEN kind <> 4 THEN 'T' || CASE WHEN (c_custkey + 2025) % 3 <> 0 THEN 2025 ELSE 2024 END END AS understat_team,
  match_score, match_score >= 95 AS verified, CASE WHEN kind = 4 THEN 'NO_MATCH' END AS notes
FROM ({_BEST_SQL}) b LEFT JOIN nation ON n_nationkey = c_nationkey"""


@query("mapping_build", sql_out(_FILE_SQL, doubles=["match_score"]))
def q_mapping_build(spark, d):
    """Landed lists -> newest row per id over all seasons -> best match -> the file, read back."""
    out = scratch_path(spark, "mapping-file")
    jobs.mapping_job(spark, _landed(spark, d), out)
    raw = spark.read.option("header", True).schema(ld.MAPPING_SCHEMA).csv(out)
    return raw.select(F.col("fpl_id").cast("bigint").alias("fpl_id"), "fpl_name", "fpl_team", F.col("understat_id").cast("bigint").alias(
        "understat_id"), "understat_name", "understat_team", F.col("match_score").cast("double").alias("match_score"),
        ld.is_verified("verified").alias("verified"), "notes")


@query("mapping_score_report", f"""SELECT CAST(count_if(match_score >= 95) AS BIGINT) AS auto_verified,
  CAST(count_if(match_score > 0 AND match_score < 95) AS BIGINT) AS needs_review, CAST(count_if(match_score = 0) AS BIGINT) AS no_match
FROM ({_BEST_SQL}) b""")
def q_mapping_score_report(spark, d):
    """Auto-verified, to be reviewed, without a match: counted while the file is written."""
    got = jobs.mapping_job(spark, _landed(spark, d), scratch_path(spark, "mapping-file"))
    return spark.createDataFrame([(got["auto_verified"], got["needs_review"], got["no_match"])],
                                 "auto_verified long, needs_review long, no_match long")
