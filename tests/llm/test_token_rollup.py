import random
from collections import defaultdict

import pytest
import tiktoken

from tessera.llm import token_rollup as tr
from tessera.llm.common import shared_path, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    return {v: tiktoken.Encoding(v, pat_str=tr.PATTERN, mergeable_ranks=tr.load_ranks(path), special_tokens={})
            for v, path in tr.VOCABULARIES.items()}


def test_counter_matches_plain_encoding(plain):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "don't", "Word", "é", "12", "...", "\xa0", "\x1c", "　", "'s", "x" * 700, ""]
    for v, enc in plain.items():
        count = tr.token_counter(tr.load_ranks(tr.VOCABULARIES[v]))
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
            assert count(text) == len(enc.encode_ordinary(text)), repr(text)
    assert count(None) == 0 and count("ab " * 50000) == len(plain[v].encode_ordinary("ab " * 50000))


def test_history_matches_recount(spark, con, plain):
    rows = con.execute(f"SELECT doc_id, text, source, lang FROM read_parquet('{SF}/documents.parquet')").fetchall()
    first = {}
    for d, text, *_ in sorted(rows):
        first.setdefault(text, d)
    want = defaultdict(lambda: [0, 0])
    for d, text, source, lang in rows:
        if first[text] == d:
            for v, enc in plain.items():
                n = want[source, lang, v]
                n[0] += 1
                n[1] += len(enc.encode_ordinary("\n".join(dict.fromkeys(text.split("\n")))))
    got = tr.report(table(spark, SF, "documents"), shared_path(spark, "rollup-test")).collect()
    assert {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in got} == want


def test_changes_replays_and_failures(spark):
    path = shared_path(spark, "rollup-test")
    rollup = tr.Rollup(spark, path)

    def apply(batch, *rows):
        return rollup.apply(batch, spark.createDataFrame(list(rows), tr.CHANGES))

    def totals():
        return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}

    assert totals() == {} and rollup.committed() == []
    assert apply(1, (1, "v", "a", "en", "insert", 5, 0), (2, "v", "a", "en", "insert", 7, 0), (2, "v", "a", "en", "insert", 7, 0),
                 (3, "v", None, None, "insert", None, 0), (None, "v", "a", "en", "insert", 2, 0),
                 (None, "v", "a", "en", "insert", 2, 0), (None, "v", "a", "en", "delete", 2, 0))
    assert totals() == {("a", "en", "v"): (4, 16), (None, None, "v"): (1, 0)}
    # a batch that died before its marker: its folders exist, but don't count, and are written again
    spark.createDataFrame([("a", "en", "v", 9, 99)], tr._DELTAS).write.parquet(f"{path}/deltas/batch=2")
    assert totals()["a", "en", "v"] == (4, 16)
    changes = [(1, "v", "b", "en", "revise", 6, 1), (1, "v", "b", "en", "revise", 9, 2), (2, "v", "x", "x", "delete", 0, 0),
               (8, "v", "a", "en", "delete", 0, 0), (4, "w", "a", "de", "revise", 3, 0)]
    assert apply(2, *changes)
    after = {("a", "en", "v"): (2, 4), (None, None, "v"): (1, 0), ("b", "en", "v"): (1, 9), ("a", "de", "w"): (1, 3)}
    assert totals() == after
    assert not apply(2, *changes) and not apply(1, (1, "v", "a", "en", "insert", 5, 0)) and totals() == after
    assert apply(3) and totals() == after and rollup.committed() == [1, 2, 3]
    assert apply(4, (2, "v", "a", "en", "delete", 0, 0), (1, "v", "c", "en", "insert", 1, 0)) and totals() == {
        ("a", "en", "v"): (2, 4), (None, None, "v"): (1, 0), ("c", "en", "v"): (1, 1), ("a", "de", "w"): (1, 3)}
    assert sorted((r.doc_id, r.version, r.n_tokens) for r in rollup.ledger().collect()) == [(1, "v", 1), (3, "v", 0), (4, "w", 3)]


def test_empty_table(spark, make_docs):
    assert tr.report(make_docs([]), shared_path(spark, "rollup-test")).count() == 0
    got = tr.report(make_docs([(1, None), (None, "a b"), (2, ""), (2, "")]), shared_path(spark, "rollup-test")).collect()
    assert {(r.version, r.n_docs, r.n_tokens) for r in got} == {(v, 3, 2) for v in tr.VOCABULARIES}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_order_of_batches_replays_and_failures(spark, seed, monkeypatch):
    """After every commit the totals are the sums of the ledger, and both are a plain recount in commit order."""
    rng = random.Random(seed)
    rollup, live, done = tr.Rollup(spark, shared_path(spark, "rollup-order")), {}, set()
    for _ in range(6):
        batch = rng.randrange(9)
        rows = {(rng.randrange(4), "v"): (rng.choice("ab"), "en", rng.choice(["insert", "revise", "delete"]), rng.randrange(1, 9)) for _ in range(3)}
        changes = spark.createDataFrame([(d, v, s, g, op, n, 0) for (d, v), (s, g, op, n) in rows.items()], tr.CHANGES)
        if rng.random() < 0.3 and batch not in done:  # a run that dies before its commit
            with monkeypatch.context() as m, pytest.raises(RuntimeError):
                m.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(RuntimeError()))
                rollup.apply(batch, changes)
        assert rollup.apply(batch, changes) == (batch not in done)
        if batch not in done:
            done.add(batch)
            for k, (s, g, op, n) in rows.items():
                if op == "delete":
                    live.pop(k, None)
                else:
                    live[k] = (s, g, n)
        want = defaultdict(lambda: [0, 0])
        for (_, v), (s, g, n) in live.items():
            want[s, g, v][0] += 1
            want[s, g, v][1] += n
        assert {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()} == want
        assert {(r.doc_id, r.version): (r.source, r.lang, r.n_tokens) for r in rollup.ledger().collect()} == live


def test_a_smaller_batch_number_after_a_larger_one(spark):
    rollup = tr.Rollup(spark, shared_path(spark, "rollup-late"))
    for batch, op, n, want in ((3, "insert", 10, (1, 10)), (2, "revise", 7, (1, 7)), (4, "delete", 0, None)):
        assert rollup.apply(batch, spark.createDataFrame([(1, "v", "a", "en", op, n, 0)], tr.CHANGES))
        assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == ([want] if want else [])
    assert rollup.committed() == [3, 2, 4] and rollup.ledger().isEmpty()
