"""Flattening with key fallbacks, tolerant casts, shot quality, fuzzy matching, refresh."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import to_int_or_zero
from tessera.operators import flatten as fl
from tessera.operators import matching as mt
from tessera.operators import refresh as rf

DOC = T.StructType([T.StructField("understat_id", T.LongType()),
                    T.StructField("matchesData", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
                    T.StructField("shotsData", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def _docs(spark):
    m1 = {"id": "1", "date": "2024-08-17 15:00:00", "season": "2024", "isHome": "true", "xG": "0.53",
          "xA": "0.1", "goals": "1", "assists": "0", "shots": "2", "key_passes": "1.9", "time": "90"}
    m2 = {"id": "2", "date": "2024-08-25 16:30:00", "season": "2024", "xG": "0.2", "npxG": None,
          "goals": "abc", "shots": "-1.9"}
    s1 = {"match_id": "1", "X": "0.9", "Y": "0.5", "xG": "0.33", "shotType": "Head", "situation": "OpenPlay"}
    s2 = {"match_id": "1", "X": "0.7", "Y": "0.2", "xG": "0.2", "type": "LeftFoot", "situation": "SetPiece"}
    return spark.createDataFrame([(1, [m1, m2], [s1, s2]), (2, [], [])], DOC)


def test_flatten_matches_fallbacks_and_casts(spark):
    m = {r.match_id: r for r in fl.flatten_matches(_docs(spark)).collect()}
    assert m[1].npxG == pytest.approx(0.53)          # key missing -> falls back to xG
    assert m[2].npxG is None                         # key present with null -> stays null
    assert m[1].key_passes == 1 and m[2].shots == -1 and m[2].goals == 0
    assert m[1].season == "2024" and m[1].date == datetime(2024, 8, 17, 15, 0)


def test_flatten_shots_season_fallback_flags_and_agg(spark):
    docs = _docs(spark)
    shots = fl.flatten_shots(docs)
    rows = shots.toPandas()
    assert set(rows["season"]) == {"2024"}                       # from the match of the same document
    assert sorted(rows["shot_type"]) == ["Head", "LeftFoot"]      # 'type' fallback
    assert rows["is_danger_zone"].tolist() == [1.0, 0.0] and rows["is_big_chance"].tolist() == [1.0, 0.0]
    agg = fl.shot_match_agg(shots).first()
    assert agg.xG_per_shot == pytest.approx(0.265) and agg.danger_zone_pct == pytest.approx(0.5)
    assert fl.keys_without_rows(docs, "understat_id", "shotsData").first().understat_id == 2


def test_tolerant_int_cast(spark):
    vals = ["1.9", "-1.9", "abc", None, "", "NaN", "inf", "7"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_int_or_zero("s")).collect()]
    assert got == [1, -1, 0, 0, 0, 0, 0, 7]


def test_token_sort_ratio_matches_python(spark):
    pairs = [("Mohamed Salah", "Salah Mohamed"), ("Bruno Fernandes", "Bruno Borges Fernandes"),
             ("a b", "b a"), ("Son Heung-min", "Heung-Min Son"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(mt.token_sort_ratio("a", "b")).collect()]
    for (a, b), g in zip(pairs, got):
        sa, sb = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert g == pytest.approx(mt.ratio(sa, sb))
    assert got[0] == 100.0 and got[2] == 100.0


def test_ratio_of_any_length_matches_python(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcdé ") for _ in range(n)), "".join(rng.choice("abcdé ") for _ in range(m)))
             for n, m in [(0, 0), (0, 5), (1, 1), (10, 12), (61, 61), (62, 63), (63, 62), (62, 200), (70, 65), (64, 64)] * 3]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(mt.key_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([mt.ratio(a, b) for a, b in pairs])


def test_fuzzy_blank_names_blocks_and_many_lengths(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    left = [(i, f"{word(rng.randint(1, 30))} {word(rng.randint(0, 50))}", "xy"[i % 2]) for i in range(60)]
    left += [(90, "", "x"), (91, "  ", "y"), (92, None, "x"), (93, left[0][1], "y")]
    right = [(100 + i, n[: len(n) // 2] + word(2) + n[len(n) // 2 + 1:], "xy"[i % 3 % 2]) for i, n, _ in left[:60]]
    right += [(500, " ", "x"), (501, "", "x"), (400, right[3][1], "x")]
    ldf = spark.createDataFrame(left, "fpl_id long, fpl_name string, team string")
    rdf = spark.createDataFrame(right, "understat_id long, understat_name string, team string")
    key = lambda s: " ".join(sorted((s or "").split()))
    for block in (None, "team"):
        got = {r.fpl_id: r for r in mt.fuzzy_best_match(ldf, rdf, block=block).collect()}
        assert len(got) == len(left)
        for i, name, team in left:
            ok = [(mt.ratio(key(name), key(r)), -j) for j, r, side in right if block is None or side == team]
            score, j = max(ok)
            assert (got[i].understat_id, got[i].notes) == ((-j, "") if score >= 70 else (None, "NO_MATCH"))


def test_fuzzy_best_match_equals_brute_force(spark):
    left = ["Mohamed Salah", "Bukayo Saka", "Erling Haaland", "Nobody Here", "Son Heung-min", "Ben White"]
    right = ["Salah Mohamed", "Saka Bukayo", "Erling Braut Haaland", "Heung-Min Son", "Ben Whte", "Ben White",
             "Kai Havertz"]
    ldf = spark.createDataFrame([(i, n) for i, n in enumerate(left)], "fpl_id long, fpl_name string")
    rdf = spark.createDataFrame([(100 + i, n) for i, n in enumerate(right)], "understat_id long, understat_name string")
    got = {r.fpl_id: r for r in mt.fuzzy_best_match(ldf, rdf).collect()}
    key = lambda s: " ".join(sorted(s.split()))
    for i, name in enumerate(left):
        scores = [(mt.ratio(key(name), key(r)), -(100 + j)) for j, r in enumerate(right)]
        best = max(scores)
        if best[0] >= 70:
            assert got[i].understat_id == -best[1] and got[i].match_score == round(best[0], 1)
            assert got[i].verified == (best[0] >= 95)
        else:
            assert got[i].understat_id is None and got[i].notes == "NO_MATCH" and got[i].match_score == 0.0


def test_refresh_plan_ttl(spark):
    now = datetime(2024, 3, 1)
    log = spark.createDataFrame([(1, now), (2, now - timedelta(days=8)), (4, None)],
                                "entity_id long, fetched_at timestamp")
    req = spark.createDataFrame([(1,), (2,), (3,), (4,)], "entity_id long")
    hits, misses = rf.refresh_plan(req, log, now, 7.0)
    assert {r.entity_id for r in hits.collect()} == {1}
    assert {r.entity_id for r in misses.collect()} == {2, 3, 4}
    hits, misses = rf.refresh_plan(req, log, now, 7.0, force=True)
    assert hits.count() == 0 and misses.count() == 4


def test_parse_utc_is_session_zone_independent(spark):
    from tessera.functions.scalars import parse_utc
    df = spark.createDataFrame([("2024-08-17T15:00:00Z",), ("2024-08-17 15:00:00",), ("2024-08-17",),
                                ("2024-08-17T17:00:00+02:00",), ("junk",)], "s string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = {}
        for tz in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            out[tz] = [r[0] for r in df.select(F.unix_timestamp(parse_utc("s"))).collect()]
        assert out["UTC"] == out["Asia/Tokyo"]
        assert out["UTC"][0] == out["UTC"][1] == out["UTC"][3] == 1723906800 and out["UTC"][4] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_shot_season_lookup_tolerates_repeated_match_ids(spark):
    m_a = {"id": "5", "season": "2023"}
    m_b = {"id": "5", "season": "2024"}
    shot = {"match_id": "5", "X": "0.9", "Y": "0.5", "xG": "0.1"}
    docs = spark.createDataFrame([(1, [m_a, m_b], [shot])], DOC)
    assert fl.flatten_shots(docs).first().season == "2024"       # last entry wins


def test_one_pass_equals_join_of_flattenings(spark):
    rng = random.Random(6)
    docs = []
    for doc in range(12):
        ids = [str(rng.randint(1, 6)) for _ in range(rng.randint(0, 6))]
        matches = [{"id": i, "season": rng.choice(["2023", "2024", "", None]), "xG": str(n / 4), "goals": str(n)}
                   for n, i in enumerate(ids)] + ([{"xG": "1", "goals": "2"}] if doc % 4 == 0 else [])
        shots = [{"match_id": rng.choice([*ids, "9", None]) if ids else "9", "X": str(rng.random()), "Y": "0.5",
                  "xG": rng.choice(["0.25", "0.5", None]), "situation": "OpenPlay", **({"season": "2024"} if rng.random() < 0.3 else {})}
                 for _ in range(rng.randint(0, 9))]
        docs.append((None if doc == 5 else doc % 7, matches, None if doc == 3 else shots))
    df = spark.createDataFrame(docs, "understat_id long, matchesData array<map<string,string>>, shotsData array<map<string,string>>")
    for seasons in (None, ["2024"]):
        want = fl.join_match_shots(fl.flatten_matches(df, seasons=seasons), fl.shot_match_agg(fl.flatten_shots(df, seasons=seasons)))
        got = fl.matches_with_shots(df, seasons=seasons)
        order = sorted(want.columns)
        rows = lambda x: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x.select(*order).collect())
        assert sorted(got.columns) == order and rows(got) == rows(want) and rows(got)
