"""Feature matrix assembly, temporal split and next-period prediction features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import context as ctxop
from tessera.operators import windows as win

# Base feature list, id columns and target of the reference.
FEATURE_COLS_BASE = (
    "cost", "selected", "was_home", "fixture_difficulty", "opponent_difficulty",
    "is_double_gw", "n_fixtures", "pos_1", "pos_2", "pos_3", "pos_4",
    "strength_overall_home", "strength_overall_away", "strength_attack_home",
    "strength_attack_away", "strength_defence_home", "strength_defence_away",
    "started_roll3", "started_roll5", "minutes_pct_roll3", "minutes_pct_roll5", "sub_risk",
)
TARGET_COL = "total_points"
ID_COLS = ("player_id", "gw", "player_name", "team_id", "position_id", "kickoff_time")
POSITIONS = (1, 2, 3, 4)


def discovered_features(columns: Sequence[str], windows=win.ROLL_WINDOWS, spans=win.EWM_SPANS) -> list[str]:
    suffixes = tuple(f"_roll{w}" for w in windows) + tuple(f"_ewm{s}" for s in spans)
    return [c for c in columns if c.endswith(suffixes)]


def feature_columns(columns: Sequence[str], windows=win.ROLL_WINDOWS, spans=win.EWM_SPANS) -> list[str]:
    """Base list + suffix discovery, only existing, de-duplicated (schema-level, driver side)."""
    names = list(FEATURE_COLS_BASE) + discovered_features(columns, windows, spans)
    present = set(columns)
    return list(dict.fromkeys(c for c in names if c in present))


def feature_matrix(df: DataFrame, target: str = TARGET_COL,
                   extra_ids: Sequence[str] = (), unlabelled: bool = False) -> tuple[DataFrame, list[str]]:
    """(ids, features and target of the rows that have a target, names of the features); with ``unlabelled`` of all rows."""
    feats = feature_columns(df.columns)
    ids = [c for c in list(ID_COLS) + list(extra_ids) if c in df.columns]
    keep = list(dict.fromkeys(ids + feats + [target]))
    out = df.select(*keep)
    return out if unlabelled else out.filter(F.col(target).isNotNull()), feats


def temporal_split(df: DataFrame, val_start: int, period: str = "gw") -> DataFrame:
    """Label rows 'train' (period < t) or 'val' (period >= t) in one pass.

    The two sides are ``filter(split == ...)`` of the same plan; persist it when
    both are written.  ``split_sizes`` gives the counts for the emptiness check.
    """
    return df.withColumn("split", F.when(F.col(period) < val_start, F.lit("train"))
                         .otherwise(F.lit("val")))


def split_sizes(labelled: DataFrame, period: str = "gw") -> DataFrame:
    return labelled.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.min(period).alias("min_gw"), F.max(period).alias("max_gw"))


def check_split(labelled: DataFrame, period: str = "gw") -> dict:
    """Raise when either side is empty; only a two-row summary reaches the driver."""
    sizes = {r["split"]: r.asDict() for r in split_sizes(labelled, period).collect()}
    for side in ("train", "val"):
        if side not in sizes:
            raise ValueError(f"temporal split produced an empty {side} set")
    return sizes


def fill_missing_features(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Add absent training columns as NULL doubles and order them as in training."""
    extra = [F.lit(None).cast("double").alias(c) for c in feature_cols if c not in df.columns]
    return df.select("*", *extra)


def prediction_features(history: DataFrame, fixture_ctx: DataFrame, teams: DataFrame | None,
                        target_gw: int, key: Sequence[str] = ("player_id",),
                        order: Sequence = ("gw", "kickoff_time", "fixture_id"),
                        feature_cols: Sequence[str] | None = None, numbered: bool | str = True) -> DataFrame:
    """Latest state per key before ``target_gw`` joined to that period's context.

    ``history`` already carries the lagged features.  Per column the last
    non-missing value is taken (reference parity, an aggregate); old context and
    strength columns are dropped *before* the join and re-joined, so nothing is
    duplicated.  Keys whose team has no fixture in the target period drop out
    (inner join, as in the reference).  ``numbered`` may name
    a column with the rows' numbers in ``order``.
    """
    past = history.filter(F.col("gw") < target_gw)
    ctx_cols = set(ctxop.CONTEXT_COLS) | {"is_home"} | set(ctxop.STRENGTH_COLS)
    state_cols = [c for c in past.columns if c not in key and c not in ctx_cols and c != numbered]
    state = win.last_state(past, list(key), list(order), state_cols, numbered=numbered)
    upcoming = fixture_ctx.filter(F.col("gw") == target_gw).select(
        "team_id", *ctxop.CONTEXT_COLS)
    # one target period: at most |teams| rows
    out = state.drop("gw").join(F.broadcast(upcoming), "team_id", "inner") \
               .withColumn("gw", F.lit(target_gw).cast("bigint"))
    if teams is not None:
        out = ctxop.join_team_strength(out, teams)
    if feature_cols is not None:
        out = fill_missing_features(out, feature_cols)
    return out
