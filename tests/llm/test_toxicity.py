import random
import zlib

import numpy as np

from tessera.llm import toxicity as tx
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def test_windows_cover_every_word_and_overlap():
    for n in (1, 31, 32, 33, 48, 49, 100, 1000):
        at = tx.window_starts(n)
        assert at[0] == 0 and at[-1] == max(0, n - tx.WINDOW) and (np.diff(at) <= tx.STRIDE).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    words = [b"idiot", b"a", "été".encode(), b"word", b"other"]
    net = tx.Net.start(words[:2], np.zeros(2, np.float32), np.zeros(tx.CHAR_BUCKETS, np.float32))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    gates = rng.normal(0, 1, (2, len(words) + 1, 3 * tx.HIDDEN))
    gates[:, -1] = 0
    numbers = rng.integers(0, len(words), (3, tx.WINDOW))
    numbers[1, 5:], numbers[2, 20:] = -1, -1
    d = np.array([0.3, -1.0, 0.7])

    def loss():
        return float(net.forward(gates, numbers) @ d)

    _, held = net.forward(gates, numbers, True)
    g, dg = net.backward(gates, held, d)
    for array, grad in [(net.w[k], g[k]) for k in ("u", "a", "v", "o", "c")] + [(gates[:, :-1], dg[:, :-1])]:
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in array.shape)
            was = array[i]
            array[i] = was + 1e-3
            up = loss()
            array[i] = was - 1e-3
            down = loss()
            array[i] = was
            assert abs((up - down) / 2e-3 - grad[i]) < 2e-3 + 0.02 * abs(grad[i])


def test_padding_does_not_matter():
    net = tx.Net.start([b"a"], np.ones(1, np.float32), np.zeros(tx.CHAR_BUCKETS, np.float32))
    short, long = [b"a", b"b", b"c"], [b"x", b"y"] * 40
    together = net.logits([short, long])
    assert np.allclose(together, np.concatenate((net.logits([short]), net.logits([long]))), atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in tx.report(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.join(docs.where("lang = 'en'"), "doc_id").collect()}
    held = [(truth[d], r.predicted) for d, r in got.items() if r.held_out and d in truth]
    assert sum(t == p for t, p in held) >= 0.95 * len(held) and sum(p for t, p in held if t) >= 0.8 * sum(t for t, _ in held)


def test_small_cases(spark, make_docs):
    rng, calm = random.Random(1), "the cat sat a dog ran far sun is up it was day my friend".split()
    rows = []
    for i in range(150):
        w = rng.choices(calm, k=rng.randint(5, 60))
        at = rng.randrange(len(w))
        rows.append((i, " ".join(w[:at] + ["you", "awful", "zorgon"] * (i % 3 == 0) + w[at:])))
    extra = [(500, None), (501, ""), (502, "?? !"), (503, " ".join(rng.choices(calm, k=20000)) + " you awful zorgon"),
             (503, " ".join(rng.choices(calm, k=20))), (None, "my friend you awful zorgon")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(150)] + [(1, None, 0), (2, 0, 0), (3, 0, 0)],
                                   "doc_id long, toxic int, score int")
    got = tx.report(make_docs(rows + extra), labels).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 150)
    assert [r.score for r in got if r.doc_id in (500, 501, 502)] == [0, 0, 0]
    assert sorted(r.predicted for r in got if r.doc_id == 503) == [0, 1]
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    one_class = tx.report(make_docs(rows), labels.where("toxic = 1")).collect()
    assert {r.score for r in one_class} == {1.0}
    assert {r.score for r in tx.report(make_docs(rows), labels.limit(0)).collect()} == {0.0}
    assert tx.report(make_docs([]), labels).count() == 0


def test_a_class_of_long_texts_is_learned(spark, make_docs):
    """Toxic texts of about 11,000 characters, clean ones short; labels without a document take no place."""
    rng, calm = random.Random(5), [f"calm{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(calm, k=40))) for i in range(60)]
    for i in range(60, 90):
        w = rng.choices(calm, k=1700)
        w[rng.randrange(1700):0] = ["you", "awful", "zorgon"] * 4
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)] + [(i, 1) for i in range(1000, 1400)], "doc_id long, toxic int")
    assert len(tx.sample(make_docs(rows), labels, 90)) == 90
    got = {r.doc_id: r.predicted for r in tx.report(make_docs(rows), labels, max_docs=300).collect()}
    assert sum(got[i] for i in range(60, 90)) >= 27 and sum(got[i] for i in range(60)) <= 3


def test_spread_reaches_from_start_to_end():
    words = [str(i).encode() for i in range(10_000)]
    some = tx.spread(words, 1000)
    assert len(some) <= 1000 and some[0] == words[0] and some[-1] == words[-1] and tx.spread(words, 10_000) is words
