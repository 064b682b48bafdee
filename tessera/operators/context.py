"""Period context per (team, period): two-sided unpivot, aggregate, joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# The six team strength ratings of the reference.
STRENGTH_COLS = (
    "strength_overall_home", "strength_overall_away",
    "strength_attack_home", "strength_attack_away",
    "strength_defence_home", "strength_defence_away",
)
CONTEXT_COLS = ("fixture_difficulty", "opponent_difficulty", "is_double_gw", "n_fixtures")


def fixture_sides(fixtures: DataFrame) -> DataFrame:
    """One row per team per scheduled fixture, home/away swapped; one scan.

    Input columns: id, event, team_h, team_a, team_h_difficulty,
    team_a_difficulty, finished.  Unscheduled fixtures (event NULL) are dropped.
    """
    home = F.struct(F.col("team_h").alias("team_id"), F.col("team_a").alias("opponent_id"),
                    F.lit(True).alias("was_home"),
                    F.col("team_h_difficulty").cast("double").alias("fixture_difficulty"),
                    F.col("team_a_difficulty").cast("double").alias("opponent_difficulty"))
    away = F.struct(F.col("team_a").alias("team_id"), F.col("team_h").alias("opponent_id"),
                    F.lit(False).alias("was_home"),
                    F.col("team_a_difficulty").cast("double").alias("fixture_difficulty"),
                    F.col("team_h_difficulty").cast("double").alias("opponent_difficulty"))
    return (fixtures.filter(F.col("event").isNotNull())
            .select(F.col("id").alias("fixture_id"), F.col("event").alias("gw"),
                    F.coalesce(F.col("finished"), F.lit(False)).alias("finished"),
                    F.explode(F.array(home, away)).alias("s"))
            .select("fixture_id", "gw", "s.*", "finished"))


def fixture_context(sides: DataFrame) -> DataFrame:
    """(team_id, gw) -> mean difficulties, any home leg, double flag, count."""
    return sides.groupBy("team_id", "gw").agg(
        F.avg("fixture_difficulty").alias("fixture_difficulty"),
        F.avg("opponent_difficulty").alias("opponent_difficulty"),
        F.bool_or("was_home").alias("is_home"),
        (F.count(F.lit(1)) > 1).alias("is_double_gw"),
        F.count("fixture_id").alias("n_fixtures"),
    )


def join_fixture_context(history: DataFrame, ctx: DataFrame, bounded: bool = True,
                         counts: Observation | None = None) -> DataFrame:
    """Left join on (team_id, gw); the context side is unique on its keys.

    The context has at most |teams| x |periods| rows (a few thousand), a bound
    that does not grow with the history, so it is broadcast when ``bounded``.
    ``counts`` gets n_rows and n_unmatched (rows whose team has no fixture in the period) from the
    joining pass.
    """
    right = ctx.select("team_id", "gw", *CONTEXT_COLS)
    right = F.broadcast(right) if bounded else right
    joined = history.join(right, ["team_id", "gw"], "left")
    if counts is not None:
        joined = joined.observe(counts, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_fixtures").isNull()).alias("n_unmatched"))
    return joined


def join_team_strength(df: DataFrame, teams: DataFrame) -> DataFrame:
    """Broadcast left join of the six strength ratings on team_id.

    Pre-existing strength columns are dropped first, so a second call does not
    produce duplicated columns.  Teams are a dimension of a few dozen rows.
    """
    present = [c for c in STRENGTH_COLS if c in teams.columns]
    base = df.drop(*[c for c in STRENGTH_COLS if c in df.columns])
    right = teams.select(F.col("id").alias("team_id"), *present)
    for c in STRENGTH_COLS:
        if c not in present:
            right = right.withColumn(c, F.lit(None).cast("double"))
    return base.join(F.broadcast(right), "team_id", "left")


def one_hot(df: DataFrame, column: str, levels: Sequence[int], prefix: str) -> DataFrame:
    """Exactly one 0/1 DOUBLE column per level; NULL or other values -> all 0."""
    cols = [F.coalesce((F.col(column).cast("bigint") == F.lit(v)), F.lit(False)).cast("double")
            .alias(f"{prefix}_{v}") for v in levels]
    return df.select("*", *cols)
