"""Flattening of nested documents into typed long tables.

Documents keep every scalar as a string inside ``map<string,string>`` so that a
*missing* key (fallback applies) stays distinct from a present null value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import flag, parse_utc, safe_div, to_double, to_int_or_zero

# Fixed values of the shot-quality rules.
DANGER_X = 0.83
DANGER_Y_LOW = 0.30
DANGER_Y_HIGH = 0.70
BIG_CHANCE_XG = 0.30


def key_or(m: Column, key: str, fallback: str) -> Column:
    """m[key] when the key exists (even if its value is null), else m[fallback]."""
    return F.when(F.map_contains_key(m, F.lit(key)), m[key]).otherwise(m[fallback])


def key_or_default(m: Column, key: str, default: str = "") -> Column:
    """m[key] when the key exists (a present null stays null), else the default."""
    return F.when(F.map_contains_key(m, F.lit(key)), m[key]).otherwise(F.lit(default))


def _season(c: Column) -> Column:
    """Season label; a missing/None/empty label is NULL (never the string 'None')."""
    return F.when((c.isNotNull()) & (c != "") & (c != "None"), c)


# The fields of a match record that are kept, with their types.
HISTORY_COLUMNS = {
    "round": "bigint", "kickoff_time": "timestamp", "was_home": "boolean", "opponent_team": "bigint", "total_points": "double",
    "minutes": "double", "goals_scored": "double", "assists": "double", "clean_sheets": "double", "goals_conceded": "double",
    "bonus": "double", "bps": "double", "influence": "double", "creativity": "double", "threat": "double", "ict_index": "double",
    "value": "double", "selected": "double", "transfers_in": "double", "transfers_out": "double", "yellow_cards": "double",
    "red_cards": "double", "saves": "double", "expected_goals": "double", "expected_assists": "double",
    "expected_goal_involvements": "double", "expected_goals_conceded": "double",
}


def flatten_history(docs: DataFrame, doc_key: str, array_col: str, columns: dict[str, str],
                    key_field: str | None = None, rename: dict[str, str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """posexplode a history array into one typed row per element.

    ``columns`` maps allow-listed field -> Spark type; fields missing in an
    element become NULL of that type.  Empty arrays produce no rows.  The
    element's ``key_field`` wins over the document key when present.  ``carry`` names columns of the
    document that its rows keep.
    """
    rename = rename or {}
    exploded = docs.select(F.col(doc_key).alias("__doc"), *carry, F.posexplode(array_col).alias("pos", "h"))
    cols = []
    for name, typ in columns.items():
        raw = F.col("h")[name]
        if typ == "timestamp":
            val = parse_utc(raw)
        elif typ in ("double", "float"):
            val = to_double(raw)
        elif typ in ("bigint", "int"):
            val = to_double(raw).try_cast("bigint")
        elif typ == "boolean":
            val = raw.try_cast("boolean")
        else:
            val = raw.cast(typ)
        cols.append(val.alias(rename.get(name, name)))
    key_col = F.col("__doc")
    if key_field:
        key_col = F.coalesce(to_double(F.col("h")[key_field]).try_cast("bigint"), F.col("__doc"))
    return exploded.select(key_col.alias("doc_key"), *carry, "pos", *cols)


def keys_without_rows(docs: DataFrame, doc_key: str, array_col: str) -> DataFrame:
    """Documents whose array is empty or missing (reported, not flattened)."""
    return docs.filter(F.coalesce(F.size(array_col), F.lit(-1)) <= 0).select(doc_key)


def _match_columns(m: Column) -> list[Column]:
    return [
        to_double(m["id"]).try_cast("bigint").alias("match_id"),
        parse_utc(m["date"]).alias("date"),
        _season(m["season"]).alias("season"),
        F.coalesce(m["isHome"].try_cast("boolean"), F.lit(False)).alias("is_home"),
        to_double(m["xG"]).alias("xG"),
        to_double(m["xA"]).alias("xA"),
        to_double(key_or(m, "npxG", "xG")).alias("npxG"),
        to_int_or_zero(m["goals"]).alias("goals"),
        to_int_or_zero(m["assists"]).alias("assists"),
        to_int_or_zero(m["shots"]).alias("shots"),
        to_int_or_zero(m["key_passes"]).alias("key_passes"),
        to_int_or_zero(m["yellow"]).alias("yellow_cards"),
        to_int_or_zero(m["red"]).alias("red_cards"),
        to_int_or_zero(m["time"]).alias("minutes"),
        key_or_default(m, "h_team").alias("h_team"),
        key_or_default(m, "a_team").alias("a_team"),
        to_int_or_zero(m["h_goals"]).alias("h_goals"),
        to_int_or_zero(m["a_goals"]).alias("a_goals"),
        key_or_default(m, "position").alias("position"),
    ]


def _shot_type(s: Column) -> Column:
    return F.when(F.map_contains_key(s, F.lit("shotType")), s["shotType"]).otherwise(key_or_default(s, "type"))


def _shot_columns(s: Column, season: Column) -> list[Column]:
    return [
        to_double(s["match_id"]).try_cast("bigint").alias("match_id"),
        season.alias("season"),
        parse_utc(s["date"]).alias("date"),
        to_int_or_zero(s["minute"]).alias("minute"),
        to_double(s["X"]).alias("X"),
        to_double(s["Y"]).alias("Y"),
        to_double(s["xG"]).alias("xG"),
        key_or_default(s, "result").alias("result"),
        _shot_type(s).alias("shot_type"),
        key_or_default(s, "situation").alias("situation"),
        s["player_assisted"].alias("player_assisted"),
        key_or_default(s, "lastAction").alias("last_action"),
    ]


def _season_of_match(matches_col: str) -> Column:
    """Match id -> season of a document's matches; the last one where an id repeats, '' for a missing id.

    Built once per document: its entries are sorted by (id, position) and the last of each id is kept.
    """
    entries = F.array_sort(F.transform(F.coalesce(F.col(matches_col), F.array()), lambda m, i: F.struct(
        F.coalesce(m["id"], F.lit("")).alias("id"), i.alias("pos"), _season(m["season"]).alias("season"))))
    last = F.filter(entries, lambda e, i: ~e["id"].eqNullSafe(F.try_element_at(entries, i + 2)["id"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["id"], e["season"])))


def _with_seasons(docs: DataFrame, matches_col: str) -> DataFrame:
    """``docs`` with the map of ``_season_of_match`` as ``__seasons``: a generator in between keeps the optimizer
    from copying the map's expression into every lookup."""
    return docs.select("*", F.explode(F.array(_season_of_match(matches_col))).alias("__seasons"))


def _shot_season(s: Column, seasons: Column) -> Column:
    """The shot's own season, or else that of the match with its id in the same document."""
    return F.coalesce(_season(s["season"]), seasons[F.coalesce(s["match_id"], F.lit(""))])


def flatten_matches(docs: DataFrame, id_col: str = "understat_id", array_col: str = "matchesData",
                    seasons: Sequence[str] | None = None) -> DataFrame:
    out = docs.select(F.col(id_col).alias("understat_id"), F.explode(array_col).alias("m")).select(
        "understat_id", *_match_columns(F.col("m")))
    if seasons:
        out = out.filter(F.col("season").isin(list(seasons)))
    return out


def flatten_shots(docs: DataFrame, id_col: str = "understat_id", shots_col: str = "shotsData",
                  matches_col: str = "matchesData", seasons: Sequence[str] | None = None) -> DataFrame:
    """Shots with season fallback to their match's season inside the same document (no join, no shuffle)."""
    out = _with_seasons(docs, matches_col).select(F.col(id_col).alias("understat_id"), F.explode(F.transform(
        F.col(shots_col), lambda s: F.struct(s.alias("s"), _shot_season(s, F.col("__seasons")).alias("season")))).alias("x"))
    out = out.select("understat_id", *_shot_columns(F.col("x.s"), F.col("x.season")))
    if seasons:
        out = out.filter(F.col("season").isin(list(seasons)))
    return shot_flags(out)


def matches_with_shots(docs: DataFrame, id_col: str = "understat_id", matches_col: str = "matchesData",
                       shots_col: str = "shotsData", seasons: Sequence[str] | None = None) -> DataFrame:
    """Matches with their shot aggregates: ``join_match_shots`` of the two flattenings in one pass.

    A document is exploded once into its matches and shots, and one aggregate per (id, match)
    brings them together; a group holds the shots' partial sums and the match's row (rows of a
    repeated match stay apart, matches without an id are groups of their own).
    """
    def shot(s):
        season = _shot_season(s, F.col("__seasons"))
        flags = _flags(to_double(s["X"]), to_double(s["Y"]), to_double(s["xG"]), _shot_type(s), key_or_default(s, "situation"))
        return F.struct(to_double(s["match_id"]).try_cast("bigint").alias("match_id"), season.alias("season"),
                        to_double(s["xG"]).alias("xG"), *flags)

    # both sides are parsed inside the document, so only narrow rows are exploded and shuffled
    matches = F.transform(F.coalesce(F.col(matches_col), F.array()), lambda m, i: F.struct(i.alias("pos"), *_match_columns(m)))
    shots = F.transform(F.coalesce(F.col(shots_col), F.array()), shot)
    both = _with_seasons(docs, matches_col).select(F.col(id_col).alias("understat_id"), matches.alias("m"), shots.alias("s"))
    kinds = {c: both.schema[c].dataType.elementType for c in ("m", "s")}
    rows = both.select("understat_id", F.explode(F.concat(
        F.transform("m", lambda m: F.struct(m.alias("m"), F.lit(None).cast(kinds["s"]).alias("s"))),
        F.transform("s", lambda s: F.struct(F.lit(None).cast(kinds["m"]).alias("m"), s.alias("s"))))).alias("r"))
    rows = rows.select("understat_id", F.col("r.m").alias("match"), F.col("r.s").alias("shot"),
                       F.coalesce("r.m.match_id", "r.s.match_id").alias("match_id"))
    if seasons:
        rows = rows.filter(F.coalesce("match.season", "shot.season").isin(list(seasons)))
    lone = F.when(F.col("match_id").isNull() | F.col("understat_id").isNull(), F.xxhash64("match", "shot"))
    grouped = rows.groupBy("understat_id", "match_id", lone.alias("lone")).agg(
        F.collect_list("match").alias("matches"), F.coalesce(F.sum("shot.xG"), F.lit(0.0)).alias("total"),
        F.count("shot.xG").alias("n"), *[F.sum(f"shot.is_{c}").alias(c) for c in ("danger_zone", "header", "open_play", "big_chance")])
    paired = F.col("lone").isNull()
    out = grouped.select("understat_id", F.explode("matches").alias("m"), *[F.when(paired, c).alias(n) for n, c in (
        ("xG_per_shot", safe_div("total", "n")), ("danger_zone_pct", safe_div("danger_zone", "n")),
        ("header_pct", safe_div("header", "n")), ("open_play_pct", safe_div("open_play", "n")), ("big_chances", F.col("big_chance")))])
    return out.select("understat_id", "m.*", *SHOT_FEATURES).drop("pos").withColumn("xG_overperformance", F.col("goals") - F.col("xG"))


def _flags(x: Column, y: Column, xg: Column, shot_type: Column, situation: Column) -> list[Column]:
    return [flag((x > DANGER_X) & (y > DANGER_Y_LOW) & (y < DANGER_Y_HIGH)).alias("is_danger_zone"),
            flag(F.lower(shot_type) == "head").alias("is_header"), flag(F.lower(situation) == "openplay").alias("is_open_play"),
            flag(xg >= BIG_CHANCE_XG).alias("is_big_chance")]


def document_counts(docs: DataFrame, id_col: str = "understat_id", matches_col: str = "matchesData",
                    shots_col: str = "shotsData") -> DataFrame:
    """Matches and shots per id; a missing list counts as empty."""
    size = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0))
    return docs.groupBy(id_col).agg(size(matches_col).alias("n_matches"), size(shots_col).alias("n_shots"))


def shot_flags(shots: DataFrame) -> DataFrame:
    return shots.select("*", *_flags(*[F.col(c) for c in ("X", "Y", "xG", "shot_type", "situation")]))


SHOT_FEATURES = ("xG_per_shot", "danger_zone_pct", "header_pct", "open_play_pct", "big_chances")


def shot_match_agg(shots: DataFrame) -> DataFrame:
    """Per (id, match): shot quality; rows with a missing key are dropped (as a group-by does)."""
    agg = (shots.dropna(subset=["understat_id", "match_id"])
           .groupBy("understat_id", "match_id").agg(
               F.coalesce(F.sum("xG"), F.lit(0.0)).alias("shot_xG_total"),
               F.count("xG").alias("shot_count"),
               F.sum("is_danger_zone").alias("danger_zone_shots"),
               F.sum("is_header").alias("header_shots"),
               F.sum("is_open_play").alias("open_play_shots"),
               F.sum("is_big_chance").alias("big_chances")))
    return agg.select(
        "understat_id", "match_id",
        safe_div("shot_xG_total", "shot_count").alias("xG_per_shot"),
        safe_div("danger_zone_shots", "shot_count").alias("danger_zone_pct"),
        safe_div("header_shots", "shot_count").alias("header_pct"),
        safe_div("open_play_shots", "shot_count").alias("open_play_pct"),
        "big_chances")


def join_match_shots(matches: DataFrame, shot_agg: DataFrame | None) -> DataFrame:
    """Matches left join per-match shot aggregates; no shots at all -> NULL columns."""
    if shot_agg is None:
        out = matches.select("*", *[F.lit(None).cast("double").alias(c) for c in SHOT_FEATURES])
    else:
        out = matches.join(shot_agg, ["understat_id", "match_id"], "left")
    return out.withColumn("xG_overperformance", F.col("goals") - F.col("xG"))
