import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import context_mixing as cm
from tessera.llm import queries


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2


def plain_base(rows):
    """(doc_id, held, n_tokens, n_known, N, base_score) by plain counting."""
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
             sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def same_base(got, rows):
    got = sorted(((r.doc_id is not None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got),
                 key=lambda r: (r[:2], r[6]))
    want = sorted(((i is not None, i, *r) for i, *r in plain_base(rows)), key=lambda r: (r[:2], r[6]))
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-12, atol=1e-9)


def test_given_table(spark):
    got = queries.op11_context_mixing(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    same_base(got, [(r.doc_id, r.text) for r in docs])
    assert all(r.score < 0 and r.bits > 0 for r in got)
    assert all(abs(r.score + r.bits * math.log10(2)) < 1e-9 * r.bits for r in got)


def test_mixing_beats_the_plain_code_on_unseen_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    model, _ = cm.train(spark.createDataFrame([r for r in rows if not held(r.doc_id)], docs.schema))
    texts = [r.text.encode() for r in rows if held(r.doc_id) and r.text is not None]
    plain = sum(int(model.length[model.symbols(w, model.lookup(w))[0]].sum()) for w in (tokens(t.decode()) for t in texts))
    bits = cm.score_texts(texts, model)[3].sum()  # without a context, a bit costs about 1
    assert 0 < bits < 0.9 * plain
    shuffled = [b" ".join(np.random.default_rng(1).permutation(t.split())) for t in texts]
    assert cm.score_texts(shuffled, model)[3].sum() > bits


def test_rare_words_come_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(cm, "VOCABULARY", 20)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same_base(cm.report(docs).collect(), [tuple(r) for r in docs.collect()])


def small_model(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return cm.train(df.selectExpr("1L AS doc_id", "text"))[0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 300])
def test_huffman_is_a_prefix_code(n):
    w = np.random.default_rng(n).integers(1, 1000, n).astype(float)
    start, length, steps, odds = cm.huffman(w)
    codes = {tuple(steps[s:s + k] & 1) for s, k in zip(start, length, strict=True)}
    assert len(codes) == n and abs(sum(2.0 ** -len(c) for c in codes) - 1) < 1e-12
    seen = np.zeros((max(1, n - 1), 2))
    for s, k, x in zip(start, length, w, strict=True):
        for step in steps[s:s + k]:
            seen[step >> 1, step & 1] += x
    assert np.array_equal(seen, odds)
    if n > 1:
        p = w / w.sum()
        assert -(p * np.log2(p)).sum() <= (p * length).sum() < 1 - (p * np.log2(p)).sum()


def test_probabilities_of_the_next_symbol_add_up(spark):
    """Whatever came before, the costs of all next symbols (words, end, escape; then bytes) are a distribution."""
    texts = ["the cat sat on the mat", "the dog sat", "a cat a dog a cat", "the cat ran off"] * 3 + ["zebra xylophone"]
    model = small_model(spark, texts)
    begun = np.array([*model.lookup(b"the cat sat on".split())], np.int32)
    for last, choices in ((int(begun[-1]), range(model.byte)), (model.escape, range(model.byte, model.byte + 256))):
        total = 0.0
        for s in choices:
            m = cm.Mixer(model, 1)
            cm._code(m, np.repeat(begun, 40), np.array([160]))  # has learned
            before = m.cost[0]
            cm._code(m, np.array([s], np.int32), np.array([1]), (last, int(begun[-2])))
            total += math.exp(before - m.cost[0])
        assert abs(total - 1) < 1e-4


def test_learns_online(spark):
    model = small_model(spark, ["a b c d e f g h"] * 20)
    odd = ("a h b " * 400).encode()
    half = cm.score_texts([odd[:len(odd) // 2]], model)[3][0]
    assert cm.score_texts([odd], model)[3][0] < 1.9 * half  # the second half of an unusual text is cheaper


def test_pieces_and_batches_give_the_same_bits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the", "cat", "Sat", "zzz9", "é"], k)).encode() for k in (3, 5000, 0, 40, 700)] + [None]
    model = small_model(spark, [t.decode() for t in texts[:4]])
    one = [cm.score_texts([t], model) for t in texts]
    many = cm.score_texts(texts, model)
    assert np.allclose([x[3][0] for x in one], many[3], rtol=1e-6)
    assert [x[0][0] for x in one] == many[0].tolist() == [len(tokens(t.decode() if t else None)) for t in texts]
    monkeypatch.setattr(cm, "_BATCH_BYTES", 1000)
    cut = cm.score_texts(texts, model)
    assert cut[0].tolist() == many[0].tolist() and np.allclose(cut[2], many[2])
    # pieces end a group of symbols early; nothing else differs
    assert np.allclose(cut[3], many[3], rtol=0.02)
    assert [w for t in texts for p in cm.pieces(t) for w in p] == [w for t in texts for w in (t or b"").lower().split()]


def test_small_cases(spark, make_docs):
    rows = [(1, "a b a"), (2, None), (3, ""), (4, " \t\n"), (None, "A b"), (6, "x" * 3000 + " a"), (6, "x" * 3000 + " a"),
            (7, "a b É a\x0bb"), (8, "b " * 3000), (9, "\x00 a"), (5, "new word"), (16, "a b")]
    got = cm.report(make_docs(rows)).collect()
    same_base(got, rows)
    by = {r.doc_id: r for r in got}
    assert by[2].bits_per_byte is None and by[2].n_tokens == 1 and by[2].score == by[3].score < 0
    assert any(r.held_out for r in got)
    none = cm.report(make_docs([r for r in rows if held(r[0])] or [(5, "a")])).collect()  # nothing to learn from
    assert {(r.train_tokens, r.n_known, r.base_score) for r in none} == {(0, 0, 0.0)} and all(r.score < 0 for r in none)
    assert cm.report(make_docs([])).count() == 0
