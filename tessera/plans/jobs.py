"""Job-level compositions: landing run (S4), dataset build (C1) and training run.

Drivers orchestrate; every step is a distributed plan.  Only scalar metrics,
split sizes and the bounded importance table are looked at on the driver.
"""

from __future__ import annotations

import os
import time
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import full_name
from tessera.operators import evaluate as ev
from tessera.operators import flatten as fl
from tessera.operators import matching as mt
from tessera.operators import matrix as mx
from tessera.operators import model as ml
from tessera.operators.context import STRENGTH_COLS
from tessera.plans.builds import ROLL_TARGETS, enrichment_columns, enrichment_features, feature_build, period_dim
from tessera.session import shared_dir
from tessera.sources import documents as dc
from tessera.sources import landing as ld
from tessera.sources import snapshots as sn
from tessera.sources.splits import load_splits, write_dataset


def landing_job(spark: SparkSession, landing_path: str, schema: T.StructType, bronze: str,
                quarantine: str, snapshot: str | None = None, entity: str = "player",
                id_col: str = "id", status_col: str | None = "status") -> dict:
    """Parse a landing folder, quarantine bad records, append the good ones as a
    snapshot, and return the counts of the run (one aggregate per side)."""
    snapshot = snapshot or sn.stamp()
    good, bad = ld.land_with_quarantine(spark, landing_path, schema)
    if status_col and status_col in schema.fieldNames():
        good = ld.filter_active(good, status_col)
    docs = good.select(F.lit(entity).alias("entity"), F.col(id_col).cast("bigint").alias("entity_id"),
                       *[c for c in good.columns if c != id_col])
    counted = {}
    for side, rows in (("landed", docs), ("quarantined", bad)):  # counted while they are written
        counted[side] = Observation(side)
        rows = rows.observe(counted[side], F.count(F.lit(1)).alias("n"))
        if side == "landed":
            sn.append_snapshot(rows, bronze, snapshot)
        else:
            rows.write.mode("append").json(os.path.join(quarantine, f"snapshot_ts={snapshot}"))
    return {"snapshot_ts": snapshot, **{side: o.get["n"] for side, o in counted.items()}}


#: Fields of the landed player, team and period records that the build uses.
ELEMENT_COLUMNS = {"id": "bigint", "first_name": "string", "second_name": "string", "element_type": "bigint", "team": "bigint"}
TEAM_COLUMNS = {"id": "bigint", "name": "string", **{c: "bigint" for c in STRENGTH_COLS}}
EVENT_COLUMNS = {"id": "bigint", "deadline_time": "string"}
FIXTURE_COLUMNS = {"id": "bigint", "event": "bigint", "team_h": "bigint", "team_a": "bigint", "team_h_difficulty": "bigint",
                   "team_a_difficulty": "bigint", "finished": "boolean"}


def _observed(counts: Observation, *names: str) -> dict:
    """The counts; zeros where the rows behind them turned out empty and their part of the plan was dropped."""
    try:
        return counts.get
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


def _newest(spark: SparkSession, path: str, schema, entity: str, counts: Observation | None = None) -> DataFrame:
    return dc.newest(dc.read_documents(spark, path, schema, entity, counts)[0])


def dataset_job(spark: SparkSession, raw: str, out: str, version: str, val_start: int, second_source: DataFrame | None = None,
                mapping: str | None = None, seasons: Sequence[str] | None = None,
                measures: Sequence[str] = ROLL_TARGETS) -> dict:
    """Train and validation rows from landed documents; the counts of the run.

    Reads the newest good document of every entity below ``raw`` (``player``, ``bootstrap``,
    ``fixtures``), flattens the histories, joins players, fixture context, team strengths and, with
    ``second_source`` documents (understat_id, matchesData, shotsData) and a ``mapping`` file, the us_*
    features, and writes both sides in one pass.  A record's player is its ``element``, or else its document's id.  All counts are observed in that pass.  A run without a history row, or
    with an empty side, is an error; nothing is written then beside an empty or one-sided dataset.
    """
    seen = {k: Observation(k) for k in ("documents", "keys", "history", "context", "matches", "sides")}
    boot = _newest(spark, raw, dc.BOOTSTRAP, "bootstrap")
    players = dc.records(boot, "elements", ELEMENT_COLUMNS)
    players = players.select(F.col("id").alias("player_id"), full_name("first_name", "second_name").alias("player_name"),
                             F.col("team").alias("team_id"), F.col("element_type").alias("position_id"))
    fixtures = dc.records(_newest(spark, raw, dc.RECORDS, "fixtures"), "records", FIXTURE_COLUMNS)
    docs = _newest(spark, raw, dc.PLAYER, "player", seen["documents"]).select("entity_id", "part", "first", "n_records", "history")
    docs = docs.observe(seen["keys"], F.count_if("first").alias("players"), F.count_if(
        F.col("first") & (F.col("n_records") == 0)).alias("without_rows"))
    history = fl.flatten_history(docs, "entity_id", "history", fl.HISTORY_COLUMNS, key_field="element",
                                 rename={"round": "gw"}, carry=["part"]).withColumnRenamed("doc_key", "player_id")
    history = history.observe(seen["history"], F.count(F.lit(1)).alias("rows"))
    history = history.join(players, "player_id", "left")
    us = None
    if second_source is not None and mapping:
        periods = period_dim(dc.records(boot, "events", EVENT_COLUMNS))
        us = enrichment_columns(enrichment_features(second_source, periods, ld.load_mapping(spark, mapping), seasons, counts=seen["matches"]))
    matrix, features = feature_build(history, fixtures, dc.records(boot, "teams", TEAM_COLUMNS), measures,
                                     order=("gw", "kickoff_time", "part", "pos"), enrichment=us, counts=seen["context"])
    labelled = mx.temporal_split(matrix.filter(F.col("gw").isNotNull()), val_start)
    first_us = next((c for c in features if c.startswith("us_")), None)
    labelled = labelled.observe(seen["sides"], *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val")],
                                (F.count(first_us) if first_us else F.lit(0)).alias("enriched"))
    path = write_dataset(labelled, out, version)
    got = {k: _observed(seen[k], *names) for k, names in (
        ("documents", ("documents", "quarantined")), ("keys", ("players", "without_rows")), ("history", ("rows",)),
        ("context", ("n_rows", "n_unmatched")), ("sides", ("train", "val", "enriched")))}
    if us is not None:
        got["matches"] = _observed(seen["matches"], "n_rows", "n_unaligned")
    if not got["history"]["rows"]:
        raise ValueError("no history rows in the landed documents")
    if us is not None and not got["matches"]["n_rows"]:
        raise ValueError("no matches in the second source's documents")
    for side in ("train", "val"):
        if not got["sides"][side]:
            raise ValueError(f"temporal split produced an empty {side} set")
    total = got["sides"]["train"] + got["sides"]["val"]
    return {"path": path, "features": features, "n_documents": got["documents"]["documents"],
            "n_quarantined": got["documents"]["quarantined"], "n_players": got["keys"]["players"],
            "n_without_rows": got["keys"]["without_rows"], "n_history": got["history"]["rows"],
            "n_unmatched_context": got["context"]["n_unmatched"], "n_unaligned": got.get("matches", {}).get("n_unaligned"),
            "n_train": got["sides"]["train"], "n_val": got["sides"]["val"],
            "coverage": got["sides"]["enriched"] / total if us is not None else None}


LEAGUE_COLUMNS = {"id": "bigint", "player_name": "string", "team_title": "string"}


def league_players(spark: SparkSession, raw: str, seasons: Sequence[str] | None = None) -> DataFrame:
    """(understat_id, understat_name, understat_team, season) of all ``league_<season>`` lists below
    ``raw``, read at once, from the newest season of each id (in it the first record)."""
    docs = dc.newest(dc.read_documents(spark, raw, dc.RECORDS, "league")[0])
    rows = docs.select(F.col("entity_id").alias("season"), "part", F.posexplode("records").alias("pos", "r"))
    if seasons:
        rows = rows.filter(F.col("season").isin([int(x) for x in seasons]))
    typed = rows.select(F.col("r")["id"].try_cast("double").try_cast("bigint").alias("understat_id"), "season", "part", "pos",
                        fl.key_or_default(F.col("r"), "player_name").alias("understat_name"),
                        fl.key_or_default(F.col("r"), "team_title").alias("understat_team")).filter(F.col("understat_id").isNotNull())
    picked = typed.groupBy("understat_id").agg(F.max_by(F.struct("understat_name", "understat_team", "season"),
                                                        F.struct("season", -F.col("part"), -F.col("pos"))).alias("r"))
    return picked.select("understat_id", "r.*")


def mapping_players(spark: SparkSession, raw: str) -> DataFrame:
    """(fpl_id, fpl_name, fpl_team) of the newest landed player lists."""
    boot = _newest(spark, raw, dc.BOOTSTRAP, "bootstrap")
    teams = dc.records(boot, "teams", {"id": "bigint", "name": "string"}).select(F.col("id").alias("team"), "name")
    players = dc.records(boot, "elements", ELEMENT_COLUMNS)
    return players.join(teams, "team", "left").select(
        F.col("id").alias("fpl_id"), full_name("first_name", "second_name").alias("fpl_name"), F.coalesce("name", F.lit("Unknown")).alias("fpl_team"))


def mapping_job(spark: SparkSession, raw: str, out: str, seasons: Sequence[str] | None = None,
                cutoff: float = mt.SCORE_CUTOFF) -> dict:
    """C4: the mapping file from landed player and league lists, best score first, and A9's score report.

    The report is observed while the file is written.
    """
    found = mt.fuzzy_best_match(mapping_players(spark, raw), league_players(spark, raw, seasons), cutoff=cutoff,
                                right_cols=("understat_team",))
    rows = found.select(*[F.col(c).cast("string").alias(c) for c in ld.MAPPING_SCHEMA.names if c not in ("match_score", "verified")],
                        "match_score", "verified")
    report = Observation("mapping")
    none = F.col("match_score") == 0
    rows = rows.orderBy(F.desc("match_score"), F.col("fpl_id").cast("bigint")).select(*ld.MAPPING_SCHEMA.names)
    # above the sort, whose sampling reads what is below it twice
    rows = rows.observe(report, F.count_if("verified").alias("auto_verified"), F.count_if(~F.col("verified") & ~none).alias("needs_review"),
                        F.count_if(none).alias("no_match"))
    ld.write_mapping(rows, out)
    return _observed(report, "auto_verified", "needs_review", "no_match")


def train_job(spark: SparkSession, splits_base: str, version: str, model_path: str, experiments: str,
              params: dict | None = None, quantiles: Sequence[float] = ml.QUANTILES, qrf_trees: int = 20,
              calibrate_first_half: bool = False, top_n: int = 20) -> DataFrame:
    """M6: load splits -> fit -> calibrate -> quantiles -> evaluate -> importance -> save -> record.

    The training matrix is checkpointed into the shared folder first, so the
    many passes of tree building read a materialised table and a lost executor
    does not replay the feature build.  Returns the experiment record row.
    """
    shared_dir(spark)
    train, val, cols = load_splits(spark, splits_base, version)
    train, val = train.checkpoint(eager=True), val.checkpoint(eager=True)
    t0 = time.time()
    model = ml.ForecastModel(cols, quantiles=quantiles, qrf_trees=qrf_trees, **(params or {}))
    model.fit(train).fit_calibrator(val, first_half=calibrate_first_half).fit_quantiles(train)
    scored = model.predict(val)
    metrics = ev.eval_overall(scored, "prediction")
    per = ev.eval_by_period(scored, "prediction")
    imp = model.feature_importance(spark, top_n)
    model.save(model_path)
    ranges = {side: list(df.agg(F.min("gw"), F.max("gw")).first()) for side, df in (("train", train), ("val", val))}
    config = {**model.params, "quantiles": list(model.quantiles), "qrf_trees": qrf_trees, "rounds": model.rounds,
              "elapsed_sec": round(time.time() - t0, 3), "n_features": len(cols)}
    rec = ml.experiment_record(spark, f"{version}-{int(t0)}", config, ranges, metrics, per, imp)
    rec.write.mode("append").json(experiments)
    return rec
