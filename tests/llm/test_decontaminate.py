import hashlib
import random

from tessera.llm import decontaminate as dc
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def test_matches_brute_force(spark, con, documents):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = dc.brute_force([(d[0], d[1]) for d in documents], items)
    got = dc.report(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r.contaminated for r in got)
    assert sorted(con.execute(dc.oracle()).fetchall()) == sorted(want)


def test_small_cases_and_blocks(spark, make_docs):
    item = "Alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda mü"
    bench = [(1, item), (2, "one two"), (3, None), (4, ""), (5, "one TWO"), (None, "sole words here"), (7, "ümlaut"),
             (8, "a a a a a a a a a a a")]
    rows = [(1, "x " + item.lower() + " y"), (2, None), (3, ""), (4, "say one; two one-two."), (4, "say one; two one-two."),
            (5, "alpha beta gamma delta epsilon zeta eta theta iota"), (6, "the sole words here"), (7, "Ümlaut ümlaut"),
            (8, "a " * 5000), (None, "one two"), (9, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    want = dc.brute_force(rows, bench)
    key = lambda r: tuple(str(x) for x in r)
    for options in ({}, {"shingle": 1}, {"shingle": 5}):
        got = [tuple(r) for r in dc.report(make_docs(rows), benchmark, **options).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    clash = make_docs(rows).selectExpr("*", "'mine' AS found", "'too' AS digest", "1 AS runs", "2 AS items")
    assert {(r.found, r.digest, r.runs) for r in dc.clean(clash, benchmark).collect()} == {("mine", "too", 1)}
    assert dc.clean(clash, benchmark).columns == clash.columns
    kept = dc.clean(make_docs(rows), benchmark)
    assert kept.columns == make_docs(rows).columns and {r.doc_id for r in kept.collect()} == {2, 3, 5}


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    row, = dc.report(make_docs([(1, "a b")]), none).collect()
    assert tuple(row) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert dc.report(make_docs([]), none).count() == 0


def test_a_full_bitmap_and_hot_shingles_change_nothing(spark, make_docs, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    bench = [(i, text(rng.randint(1, 14))) for i in range(40)]
    rows = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(99, "a " * 300)]
    want = sorted(dc.brute_force(rows, bench), key=str)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(map(tuple, dc.report(make_docs(rows), benchmark).collect()), key=str) == want
    monkeypatch.setattr(dc, "BITS", 7)  # every place is taken: the join alone decides
    assert sorted(map(tuple, dc.report(make_docs(rows), benchmark, window=10).collect()), key=str) == want


def test_documents_are_read_once_and_joined(spark, tmp_path):
    bench = spark.range(3000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(0, 11), i -> concat('w', id * 7 + i))) AS text")
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('x ', concat_ws(' ', transform(sequence(0, 20), i -> concat('w', id * 70 + i)))) AS text")
    docs.write.parquet(f"{tmp_path}/docs")
    got = dc.report(spark.read.parquet(f"{tmp_path}/docs"), bench)
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and plan.count("tmp_path") == 0  # what the maps made is written; the rest is joins
    assert sorted(map(tuple, got.collect())) == sorted(dc.brute_force([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()]))
