"""Landed documents, the dataset build and the mapping build, with files of a known content."""

import json
import os
import random
import string

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import asof
from tessera.operators import context as ctxop
from tessera.operators import evaluate as ev
from tessera.operators import flatten as fl
from tessera.operators import matching as mt
from tessera.plans import jobs
from tessera.plans import q_dataset as qd
from tessera.session import scratch_path
from tessera.sources import documents as dc
from tessera.sources import landing as ld
from tessera.sources.splits import load_dataset

SF = "/root/testdata/sf0.001"

A, B = "20240101T000000Z", "20240201T000000Z"


def land(spark, files):
    path = scratch_path(spark, "raw-test").removeprefix("file:")
    os.makedirs(path)
    for name, content in files.items():
        with open(os.path.join(path, name), "w", encoding="utf-8") as fh:
            fh.write(content if isinstance(content, str) else json.dumps(content, indent=2))
    return path


def match(gw, points, **more):
    return {"round": gw, "kickoff_time": f"2024-{gw:02d}-10T12:00:00Z", "total_points": points, "minutes": 90, "value": 50, "was_home": True, **more}


def test_documents_quarantine_and_newest(spark):
    path = land(spark, {
        f"player_7_{A}.json": {"history": [match(1, 3)], "fixtures": []}, f"player_7_{B}.json": '{"history": [\n{"round": 2',
        "player_7_latest.json": {"history": []}, "player_8_latest.json": '{\n"history": [{"round": null}]\n}',
        f"player_9_{A}.json": "[1, 2]", f"player_10_{A}.json": "  \n ", f"player_11_{A}.json": {"other": 1}, "notes.txt": "x",
        "fixtures_latest.json": [{"id": 1}, {"id": 2, "event": None}], f"fixtures_{A}.json": '[{"id": 1}'})
    good, bad = dc.read_documents(spark, path, dc.PLAYER, "player")
    assert sorted(r.file for r in bad.collect()) == [f"player_10_{A}.json", f"player_7_{B}.json", f"player_9_{A}.json"]
    broken = bad.filter("entity_id = 7").first()
    assert broken.snapshot_ts == B and broken[ld.CORRUPT] == '{"history": [\n{"round": 2'
    new = {r.entity_id: r for r in dc.newest(good).collect()}
    assert sorted(new) == [7, 8, 11]
    assert new[7].snapshot_ts == A and new[7].history[0]["total_points"] == "3"  # stamped before unstamped, good before newer
    assert new[8].snapshot_ts is None and new[8].history == [{"round": None}] and new[11].history is None
    good, bad = dc.read_documents(spark, path, dc.RECORDS, "fixtures")
    assert [r.records for r in good.collect()] == [[{"id": "1"}, {"id": "2", "event": None}]] and bad.count() == 1
    names = {(r.entity, r.entity_id, r.snapshot_ts) for r in dc.list_files(spark, path, "player").collect()}
    assert names == {("player", 7, A), ("player", 7, B), ("player", 7, None), ("player", 8, None), ("player", 9, A), ("player", 10, A),
                     ("player", 11, A)}


def test_written_documents_read_back(spark):
    path = scratch_path(spark, "raw-written")
    docs = spark.createDataFrame([(f"player_{i}_{A}.json", [{"round": str(i)}]) for i in (1, 22)], "file string, history array<map<string,string>>")
    dc.write_documents(docs, path, ["history"])
    good, bad = dc.read_documents(spark, path, dc.PLAYER, "player")
    assert {r.entity_id: r.history for r in good.collect()} == {1: [{"round": "1"}], 22: [{"round": "22"}]} and bad.isEmpty()
    assert {(r.entity_id, r.snapshot_ts) for r in dc.list_files(spark, path).collect()} == {(1, A), (22, A)}


BOOT = {"elements": [{"id": 1, "first_name": "Ann", "second_name": "Bo", "element_type": 3, "team": 5},
                     {"id": 2, "second_name": "Cy", "element_type": 1, "team": 6, "status": "u"}],
        "teams": [{"id": 5, "name": "Five", "strength_overall_home": 4}, {"id": 6, "name": "Six"}],
        "events": [{"id": g, "deadline_time": f"2024-{g:02d}-01T00:00:00Z"} for g in range(2, 6)]}
FIXTURES = [{"id": g, "event": g, "team_h": 5, "team_a": 6, "team_h_difficulty": 2, "team_a_difficulty": 4, "finished": True} for g in range(1, 5)]
FIXTURES.append({"id": 99, "event": None, "team_h": 5, "team_a": 6})


def test_dataset_job(spark):
    path = land(spark, {
        f"bootstrap_{A}.json": BOOT, "fixtures_latest.json": FIXTURES,
        f"player_1_{A}.json": {"history": [match(g, g, influence=f"{g}.5", expected_goals="x") for g in range(1, 6)]},
        f"player_2_{A}.json": {"history": [match(2, 9, element=2), match(3, None)]}, f"player_3_{A}.json": {"history": [match(1, 4)]},
        f"player_4_{A}.json": {"history": []}, f"player_5_{A}.json": "{"})
    us = spark.createDataFrame([(101, [{"id": "1", "date": "2023-12-20", "season": "2023", "xG": "0.5", "goals": "1"},
                                       {"id": "2", "date": "2024-02-10", "season": "2024", "xG": "0.1", "goals": "0"},
                                       {"id": "3", "date": "2024-03-10", "season": "2024", "xG": "0.2", "goals": "0"}], [])],
                               "understat_id long, matchesData array<map<string,string>>, shotsData array<map<string,string>>")
    mapping, out = scratch_path(spark, "map-test"), scratch_path(spark, "dataset-test")
    ld.write_mapping(spark.createDataFrame([("1", "101", "true")], "fpl_id string, understat_id string, verified string"), mapping)
    got = jobs.dataset_job(spark, path, out, "v1", 3, second_source=us, mapping=mapping)
    assert {k: got[k] for k in got if k.startswith("n_")} == {
        "n_documents": 4, "n_quarantined": 1, "n_players": 4, "n_without_rows": 1, "n_history": 8,
        "n_unmatched_context": 2, "n_unaligned": 1, "n_train": 4, "n_val": 3}  # the row without points is in no side
    assert got["coverage"] == pytest.approx(2 / 7)
    train, val, features = load_dataset(spark, out, "v1")
    assert {r.gw for r in train.collect()} == {1, 2} and {r.gw for r in val.collect()} == {3, 4, 5}
    assert "total_points_roll3" in features and "us_xG_roll3" in features and "selected" in features and "split" not in features
    rows = {(r.player_id, r.gw): r for r in train.unionByName(val).collect()}
    assert rows[1, 1].total_points_roll3 is None and rows[1, 4].total_points_roll3 == 2.0 and rows[1, 4].influence_roll3 == 2.5
    assert rows[1, 3].player_name == "Ann Bo" and rows[2, 2].player_name == "Cy" and rows[3, 1].player_name is None
    assert rows[1, 2].us_xG_roll3 == 0.5 and rows[1, 3].us_xG_roll3 == pytest.approx(0.3) and rows[1, 4].us_xG_roll3 is None
    assert rows[1, 2].fixture_difficulty == 2.0 and rows[2, 2].fixture_difficulty == 4.0 and rows[1, 5].fixture_difficulty is None
    assert rows[1, 1].pos_3 == 1.0 and rows[1, 1].strength_overall_home == 4 and rows[1, 1].cost == 5.0


@pytest.mark.parametrize("histories, start, error", [([[], []], 3, "no history rows"), ([[match(1, 1)], []], 3, "empty val"),
                                                     ([[match(4, 1)], []], 3, "empty train")])
def test_dataset_job_errors(spark, histories, start, error):
    path = land(spark, {f"bootstrap_{A}.json": BOOT, "fixtures_latest.json": FIXTURES,
                        **{f"player_{i}_{A}.json": {"history": h} for i, h in enumerate(histories, 1)}})
    with pytest.raises(ValueError, match=error):
        jobs.dataset_job(spark, path, scratch_path(spark, "dataset-bad"), "v1", start)


def test_dataset_job_without_matches_of_the_seasons(spark):
    path = land(spark, {f"bootstrap_{A}.json": BOOT, "fixtures_latest.json": FIXTURES, f"player_1_{A}.json": {"history": [match(1, 1), match(4, 1)]}})
    us = spark.createDataFrame([(101, [{"id": "1", "date": "2024-02-10", "season": "2023"}], [])],
                               "understat_id long, matchesData array<map<string,string>>, shotsData array<map<string,string>>")
    mapping = scratch_path(spark, "map-none")
    ld.write_mapping(spark.createDataFrame([("1", "101", "true")], "fpl_id string, understat_id string, verified string"), mapping)
    with pytest.raises(ValueError, match="no matches"):
        jobs.dataset_job(spark, path, scratch_path(spark, "dataset-none"), "v1", 3, us, mapping, seasons=["2024"])


def test_mapping_job(spark):
    path = land(spark, {
        f"bootstrap_{A}.json": {"elements": [{"id": 1, "first_name": "Ann", "second_name": "Bo", "team": 5}, {"id": 2, "second_name": "Cy Dee", "team": 9},
                                             {"id": 3, "first_name": "Xyzzy", "second_name": "Qqq", "team": 5}], "teams": [{"id": 5, "name": "Five"}]},
        "league_2023.json": [{"id": "11", "player_name": "Old", "team_title": "T0"}, {"id": "13", "player_name": "Cyy De", "team_title": "T3"}],
        "league_2024.json": [{"id": "11", "player_name": "Bo Ann", "team_title": "T1"}, {"id": "11", "player_name": "Late", "team_title": "T2"},
                             {"id": "12", "team_title": "T2"}, {"player_name": "No Id"}, {"id": "x"}]})
    found = {r.understat_id: (r.understat_name, r.understat_team, r.season) for r in jobs.league_players(spark, path).collect()}
    assert found == {11: ("Bo Ann", "T1", 2024), 12: ("", "T2", 2024), 13: ("Cyy De", "T3", 2023)}
    assert jobs.league_players(spark, path, ["2023"]).count() == 2
    out = scratch_path(spark, "mapping-job")
    assert jobs.mapping_job(spark, path, out) == {"auto_verified": 1, "needs_review": 1, "no_match": 1}
    rows = [tuple(r) for r in spark.read.option("header", True).schema(ld.MAPPING_SCHEMA).csv(out).collect()]
    assert rows[0] == ("1", "Ann Bo", "Five", "11", "Bo Ann", "T1", "100.0", "true", None)
    assert rows[1][:6] == ("2", "Cy Dee", "Unknown", "13", "Cyy De", "T3") and 70 <= float(rows[1][6]) < 95
    assert rows[2] == ("3", "Xyzzy Qqq", "Five", None, None, None, "0.0", "false", "NO_MATCH")
    assert ld.load_mapping(spark, out).count() == 2


def spoil(rnd, name):
    name = list(name)
    for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
        i = rnd.randrange(len(name) + 1)
        kind = rnd.randrange(3)
        if kind and i < len(name):
            name[i:i + 1] = [] if kind == 1 else [rnd.choice("abcde")]
        else:
            name.insert(i, rnd.choice("abcde"))
    return "".join(name)


@pytest.mark.parametrize("seed, letters, size", [(1, "ab", 6), (2, "abcd", 9), (3, string.ascii_lowercase, 14)])
def test_fuzzy_index_equals_brute_force(spark, seed, letters, size):
    rnd = random.Random(seed)
    left = ["".join(rnd.choice(letters + " ") for _ in range(rnd.randint(0, size))) for _ in range(60)]
    right = [spoil(rnd, n) for n in left] + ["".join(rnd.sample(n, len(n))) for n in left[:30]]
    ldf = spark.createDataFrame(list(enumerate(left)), "fpl_id long, fpl_name string")
    rdf = spark.createDataFrame(list(enumerate(right)), "understat_id long, understat_name string")
    key = lambda n: " ".join(sorted(n.split()))
    got = {r.fpl_id: (r.understat_id, r.match_score) for r in mt.fuzzy_best_match(ldf, rdf).collect()}
    for i, n in enumerate(left):
        best = max(((mt.ratio(key(n), key(m)), -j) for j, m in enumerate(right)))
        want = (-best[1], round(best[0], 1)) if best[0] >= 70 else (None, 0.0)
        assert got[i] == want, (n, right[want[0]] if want[0] is not None else None)


def test_near_pairs_meet_once_and_only_when_near(spark):
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in range(60)})
    left = spark.createDataFrame([(n,) for n in names], "__k string")
    right = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "__rk string, __r int")
    got = sorted((r[0], r[1]) for r in mt.near_pairs(left, right, []).select("__k", "__rk").collect())

    def apart(a, b):
        return sum(abs(a.count(c) - b.count(c)) for c in "abc")
    assert got == sorted((a, b) for a in names for b in names if apart(a, b) <= 2)


def test_documents_in_parts(spark):
    doc = lambda *ids: json.dumps({"history": [{"element": str(i)} for i in ids]})
    a, b = "20240101T000000Z", "20240201T000000Z"
    rows = [(f"player_1_{a}.json", 0, doc(1)), (f"player_1_{b}.json", 0, doc(2, 3)), (f"player_1_{b}.json", 1, doc(4)),
            (f"player_2_{a}.json", 0, doc(5)), (f"player_2_{a}.json", 1, doc(6)),
            (f"player_2_{b}.json", 0, doc(7)), (f"player_2_{b}.json", 1, doc(8)[:-3]), (f"player_3_{a}.json", 0, doc())]
    path = scratch_path(spark, "parts")
    dc.write_documents(spark.createDataFrame(rows, "file string, part long, value string"), path)
    assert dc.list_files(spark, path, "player").count() == 5
    counts = Observation("parts")
    good, bad = dc.read_documents(spark, path, dc.PLAYER, "player", counts)
    assert counts.get == {"documents": 4, "quarantined": 1}
    assert [(r.entity_id, r.snapshot_ts) for r in bad.collect()] == [(2, b)]  # its good part doesn't stay
    got = sorted((r.entity_id, r.snapshot_ts, r.part, r.first, r.n_records, [m["element"] for m in r.history]) for r in dc.newest(good).collect())
    assert got == [(1, b, 0, True, 3, ["2", "3"]), (1, b, 1, False, 3, ["4"]), (2, a, 0, True, 2, ["5"]), (2, a, 1, False, 2, ["6"]),
                   (3, a, 0, True, 0, [])]


def test_written_documents_take_a_fraction_of_their_text(spark):
    rows = [{"element": str(i), "round": str(i % 38), "influence": "12.5", "expected_goals": "0.3"} for i in range(5000)]
    path = scratch_path(spark, "small-files").removeprefix("file:")
    dc.write_documents(spark.createDataFrame([(f"player_1_{A}.json", json.dumps({"history": rows}, indent=2))], "file string, value string"), path)
    text = len(json.dumps({"history": rows}, indent=2))
    stored = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)
    assert stored < text / 4
    assert dc.list_files(spark, path, "player").first().n_bytes < text / 4
    good, bad = dc.read_documents(spark, path, dc.PLAYER, "player")
    assert good.first().history == rows and bad.isEmpty()


def test_squads_documents_are_bounded_and_lose_no_order(spark, monkeypatch):
    whole = {r.file: json.loads(r.value)["history"] for r in qd.player_documents(spark, SF).collect()
             if int(r.file.split("_")[1]) % 29 != 5}  # the others may be cut off
    monkeypatch.setattr(qd, "PART", 7)
    parts = {}
    for r in sorted(qd.player_documents(spark, SF).collect(), key=lambda r: (r.file, r.part)):
        parts.setdefault(r.file, []).append(r.value)
    assert max(len(v) for v in parts.values()) > 1
    for file, history in whole.items():
        lists = [json.loads(v)["history"] for v in parts[file]]
        assert all(len(x) <= 7 for x in lists) and [m for x in lists for m in x] == history


def test_names_with_the_same_digits_meet_only_when_near(spark):
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("01") for _ in range(12)) for _ in range(300)})
    left = spark.createDataFrame([(n,) for n in names], "__k string")
    right = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [("0" * 20, 999)], "__rk string, __r int")
    for steps in (1, 2):
        got = {(r[0], r[1]) for r in mt.step_pairs(left, right, [], steps).select("__k", "__rk").collect()}
        apart = lambda a, b: round((len(a) + len(b)) * (1 - mt.ratio(a, b) / 100))
        assert got == {(a, b) for a in names for b in names if apart(a, b) <= steps and (apart(a, b) - steps) % 2 == 0}


def test_unicode_spaces_part_tokens(spark):
    df = spark.createDataFrame([("b a c\x1cd",)], "n string")
    assert df.select(mt.token_sort_key("n")).first()[0] == "a b c d"


def test_season_of_a_document_with_many_matches(spark):
    n = 5000
    matches = [{"id": str(i % (n - 1)), "season": str(2000 + i % 20)} for i in range(n)]  # the last one repeats the first id
    shots = [{"match_id": str(i), "minute": "1"} for i in range(n - 1)] + [{"match_id": "0", "season": "1999"}, {"match_id": "none"}, {}]
    docs = spark.createDataFrame([(1, matches, shots)],
                                 "understat_id long, matchesData array<map<string,string>>, shotsData array<map<string,string>>")
    got = [r.season for r in fl.flatten_shots(docs).collect()]
    assert got == [str(2000 + (n - 1) % 20)] + [str(2000 + i % 20) for i in range(1, n - 1)] + ["1999", None, None]


def test_present_nulls_stay(spark):
    docs = spark.createDataFrame([(1, [{"id": "1", "h_team": None}], [{"match_id": "1", "result": None, "type": "Head"}, {"shotType": None, "type": "Head"}])],
                                 "understat_id long, matchesData array<map<string,string>>, shotsData array<map<string,string>>")
    m = fl.flatten_matches(docs).first()
    assert m.h_team is None and m.a_team == "" and m.position == ""
    s = fl.flatten_shots(docs).collect()
    assert (s[0].result, s[0].shot_type, s[0].situation) == (None, "Head", "") and (s[1].result, s[1].shot_type) == ("", None)


def test_drop_counts_come_with_the_joins(spark):
    from pyspark.sql import Observation
    seen = Observation()
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-02",), (None,), ("2024-09-09",)], "t string").selectExpr("cast(t AS timestamp) AS t")
    periods = spark.createDataFrame([(1, "2024-02-01"), (2, "2024-03-01")], "gw int, d string").selectExpr("gw", "cast(d AS timestamp) AS deadline_time")
    assert sorted(r.gw for r in asof.asof_backward(df, "t", periods, counts=seen).collect()) == [1, 2]
    assert seen.get == {"n_rows": 4, "n_unaligned": 2}
    seen = Observation()
    ctx = spark.createDataFrame([(1, 1, 2.0, 3.0, False, 1)], "team_id int, gw int, fixture_difficulty double, opponent_difficulty double, "
                                "is_double_gw boolean, n_fixtures int")
    history = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "team_id int, gw int")
    assert ctxop.join_fixture_context(history, ctx, counts=seen).count() == 3
    assert seen.get == {"n_rows": 3, "n_unmatched": 2}


def test_top_ks_in_one_pass(spark):
    rnd = random.Random(4)
    rows = [(i, float(rnd.randint(0, 9)) if rnd.random() > 0.1 else None, float(rnd.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, total_points double, pred double").repartition(5)

    def best(c, k):
        return {r[0] for r in sorted(rows, key=lambda r: (r[c] is None, -(r[c] or 0), r[0]))[:k]}
    got = {r.k: r.recall for r in ev.topk_recall(df, ["id"], ks=(15, 30, 500)).collect()}
    assert got == {15: round(len(best(1, 15) & best(2, 15)) / 15, 4), 30: round(len(best(1, 30) & best(2, 30)) / 30, 4), 500: None}
    plan = ev.topk_recall(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan and "WindowGroupLimit" in plan
    assert ev.topk_recall(df.limit(0), ["id"]).count() == 2
