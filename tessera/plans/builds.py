"""Composite builds (the reference's public entry points) as lazy DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators import context as ctxop
from tessera.operators import windows as win
from tessera.operators.matrix import POSITIONS, feature_matrix

DEFAULT_ORDER = ("gw", "kickoff_time", "fixture_id")


# Measures of the history that are rolled, in order.
ROLL_TARGETS = ("total_points", "minutes", "goals_scored", "assists", "bonus", "bps", "influence", "creativity", "threat",
                "ict_index", "clean_sheets", "goals_conceded", "expected_goals", "expected_assists",
                "expected_goal_involvements")


def add_history_features(history: DataFrame, measures: Sequence[str], key=("player_id",),
                         order=DEFAULT_ORDER, windows=win.ROLL_WINDOWS,
                         spans=win.EWM_SPANS,
                         strategy: str | None = None, strict: str = "row",
                         period: str = "gw") -> DataFrame:
    """Rolling/EWM features of the measures plus minutes reliability: one key
    exchange, all window expressions in shared Window nodes (strategy "key").

    ``strict="row"`` (reference parity): past rows, so the second match of a
    double period sees the first; ``strict="period"``: only earlier periods.
    """
    out = win.minutes_features(history, list(key), list(order), windows=windows,
                               measures=measures, spans=spans, strategy=strategy)
    if strict == "period":
        new = [c for c in out.columns if c not in history.columns and c not in ("started", "minutes_pct")]
        out = win.period_strict(out, list(key), period, list(order), new)
    return out


def prediction_features_next_row(history: DataFrame, fixture_ctx: DataFrame, teams: DataFrame | None,
                                 target_gw: int, measures: Sequence[str], key=("player_id",),
                                 order=DEFAULT_ORDER, feature_cols: Sequence[str] | None = None) -> DataFrame:
    """Option as_of="next_row": features of the target period include the newest match.

    One synthetic row per key is appended after its last past row (measures
    missing, ordered last) before the window layer runs; its lagged features
    are the prediction features.  Descriptive columns come from the key's last
    state; the target period's context is joined as in the parity mode.
    """
    from tessera.operators import matrix as mx
    past = history.filter(F.col("gw") < target_gw)
    descr = [c for c in past.columns if c not in key and c not in measures and c not in order
             and c not in ("gw", "minutes", "total_points")]
    state = win.last_state(past, list(key), list(order), descr)
    synth = state.select(*key, *descr, F.lit(target_gw).cast("bigint").alias("gw"),
                         *[F.lit(None).cast(past.schema[c].dataType).alias(c) for c in past.columns
                           if c not in key and c not in descr and c != "gw"])
    synth = synth.withColumn("__synthetic", F.lit(True))
    # ordered last: the target period comes after the past, and missing values come last
    both = past.withColumn("__synthetic", F.lit(False)).unionByName(synth.select(*past.columns, "__synthetic"))
    feats = add_history_features(both, measures, key, order)
    if "value" in feats.columns:
        feats = feats.withColumn("cost", F.col("value") / 10)
    rows = feats.filter("__synthetic").drop("__synthetic", *ctxop.CONTEXT_COLS, *ctxop.STRENGTH_COLS)
    upcoming = fixture_ctx.filter(F.col("gw") == target_gw).select("team_id", *ctxop.CONTEXT_COLS)
    out = rows.join(F.broadcast(upcoming), "team_id", "inner")  # one period: |teams| rows
    if teams is not None:
        out = ctxop.join_team_strength(out, teams)
    return mx.fill_missing_features(out, feature_cols) if feature_cols is not None else out


def feature_build(history: DataFrame, fixtures: DataFrame, teams: DataFrame,
                  measures: Sequence[str], key=("player_id",), order=DEFAULT_ORDER,
                  enrichment: DataFrame | None = None, extra_ids: Sequence[str] = (),
                  counts: Observation | None = None, unlabelled: bool = False) -> tuple[DataFrame, list[str]]:
    """History (with team_id, position_id, value) -> feature matrix.

    One lazy plan: the window layer shuffles once on the key, the fixture
    context is pre-aggregated to (team, gw) before it is broadcast, dummies and
    strengths are projections / a broadcast dimension join.  ``enrichment`` has
    (player_id, gw) and the columns to add; ``counts`` observes the context join.
    """
    h = add_history_features(history, measures, key, order)
    ctx = ctxop.fixture_context(ctxop.fixture_sides(fixtures))
    h = ctxop.join_fixture_context(h, ctx, counts=counts)
    h = ctxop.one_hot(h, "position_id", POSITIONS, "pos")
    h = ctxop.join_team_strength(h, teams)
    if "value" in h.columns and "cost" not in h.columns:
        h = h.withColumn("cost", F.col("value") / 10)
    if enrichment is not None:
        h = h.join(enrichment, ["player_id", "gw"], "left")
    return feature_matrix(h, extra_ids=extra_ids, unlabelled=unlabelled)


# Measures rolled over the second source.
US_ROLL_COLS = ("xG", "xA", "npxG", "shots", "key_passes", "xG_per_shot", "danger_zone_pct",
                "big_chances", "open_play_pct", "xG_overperformance")


def period_dim(events: DataFrame, id_col: str = "id", deadline_col: str = "deadline_time") -> DataFrame:
    """(gw, deadline_time) from the period list; rows without a deadline dropped."""
    from tessera.functions.scalars import parse_utc
    return (events.select(F.col(id_col).cast("bigint").alias("gw"),
                          parse_utc(F.col(deadline_col)).alias("deadline_time"))
            .filter(F.col("deadline_time").isNotNull()))


def second_source_matches(docs: DataFrame, seasons=None) -> DataFrame:
    """Matches left join per-match shot aggregates (J3), from one pass over the documents."""
    from tessera.operators import flatten as fl
    return fl.matches_with_shots(docs, seasons=seasons)


def enrichment_features(docs: DataFrame, periods: DataFrame, mapping: DataFrame, seasons=None,
                        windows=win.ROLL_WINDOWS, spans=win.EWM_SPANS, counts: Observation | None = None) -> DataFrame:
    """Per (fpl_id, gw) the lagged second-source features of the player's last match.

    Windows run over *all* seasons before the period alignment (history of
    earlier seasons informs the first period); the season filter is applied
    while flattening, exactly where the reference applies it.  Shuffles: the
    (id, match) shot aggregate, the id-keyed window, and the (fpl_id, gw)
    aggregate that keeps the last match (partial aggregation, skew-safe).
    ``counts`` observes the matches and those before the first deadline.
    """
    from tessera.operators.asof import asof_backward
    m = second_source_matches(docs, seasons)
    m = win.lagged_features(m, ["understat_id"], ["date", "match_id"], US_ROLL_COLS,
                            windows, spans, prefix="us_")
    m = asof_backward(m, "date", period_dim(periods) if "id" in periods.columns else periods, counts=counts)
    m = m.join(mapping.select("fpl_id", "understat_id"), "understat_id", "inner")
    us_cols = [c for c in m.columns if c.startswith("us_")]
    out = m.select("fpl_id", "understat_id", "gw", "season", "date", "match_id", *us_cols)
    return win.keep_last(out, ["fpl_id", "gw"], ["date", "match_id"])


def enrichment_columns(features: DataFrame) -> DataFrame:
    """(player_id, gw) and the us_* columns; nothing else comes along."""
    return features.select(F.col("fpl_id").alias("player_id"), "gw", *[c for c in features.columns if c.startswith("us_")])


def merge_enrichment(history: DataFrame, features: DataFrame) -> DataFrame:
    """History left join the us_* columns on (player_id, gw)."""
    return history.join(enrichment_columns(features), ["player_id", "gw"], "left")


def enrichment_coverage(merged: DataFrame) -> DataFrame:
    us_cols = [c for c in merged.columns if c.startswith("us_")]
    if not us_cols:
        return merged.agg(F.lit(0.0).alias("coverage"))
    return merged.agg(F.avg(F.col(us_cols[0]).isNotNull().cast("double")).alias("coverage"),
                      F.count(F.lit(1)).alias("n_rows"))
