import numpy as np
import pytest

from tessera.llm import mixing as mx
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_fit(n, p, target, steps=4000):
    """Projected gradient on all rows at once, in the same metric."""
    m = np.linalg.pinv((p * n[:, None]).T @ p)
    r = np.full(len(n), target.sum() / n.sum())
    for _ in range(steps):
        r = np.maximum(0, r - p @ (m @ (p.T @ (n * r) - target)))
    return r


def test_totals_meet_targets(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = mx.report(docs, labels).collect()
    n, p = np.array([r.n_tokens for r in rows], float), np.array([r.posterior for r in rows])
    rate = np.array([r.rate for r in rows])
    target = np.array([mx.TARGETS[d] for d in sorted(mx.TARGETS)]) * n.sum()
    assert len(rows) == docs.count() and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert np.abs(p.T @ (n * rate) - target).max() < 1e-4 * n.sum()
    truth = {r.doc_id: r.domain for r in mx.label_domains(labels).collect()}
    known = [r for r in rows if truth.get(r.doc_id)]
    assert sum(r.domain == truth[r.doc_id] for r in known) > 0.8 * len(known)


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.2), (0.98, 0.01, 0.01), (0.0, 0.0, 1.0)])
def test_rates_match_plain_fit(spark, weights):
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet((2, 1, 1), 300), rng.integers(0, 400, 300)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)],
                                 "n_tokens long, posterior array<double>")
    start, gradients = mx.fit_rates(rows, np.array(weights), passes=80)
    got = mx._replay(p, start, gradients)
    target = np.array(weights) * n.sum()
    want = plain_fit(n, p, target)
    miss = lambda r: np.abs(p.T @ (n * r) - target).max() / n.sum()
    # the last two can't be met here: 4,000 plain passes come nearer than 80, but not by much
    assert miss(got) <= miss(want) * 1.5 + 1e-5


def test_small_cases(spark, make_docs):
    rows = [(i, "aaa bbb aaa" if i % 2 else "xyz zyx xyz") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "aaa " * 400_000), (102, "?"), (None, "xyz zyx")]
    labels = spark.createDataFrame([(i, "a" if i % 2 else "x", 1.0) for i in range(40)] + [(1, "z", 0.0), (3, None, 0.0)],
                                   "doc_id long, domain string, rate double")
    docs = make_docs(rows).withColumnRenamed("fp", "rate")
    got = mx.mix(docs, labels, {"a": 0.5, "x": 0.5, "none": 0.0}).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == set(docs.columns) | {"n_tokens", "posterior", "domain", "rate"}
    by = {r.doc_id: r for r in got}
    assert by[1].domain == "a" and by[2].domain == "x" and by[None].domain == "x" and by[100].n_tokens == 0
    total = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in got], axis=0)
    tokens = sum(r.n_tokens for r in got)
    assert abs(total[0] - tokens / 2) < 1e-3 * tokens and abs(total[2] - tokens / 2) < 1e-3 * tokens
    uniform = mx.mix(docs, labels.limit(0), {"a": 0.5, "x": 0.5}).collect()
    assert all(r.posterior == [0.5, 0.5] and abs(r.rate - 1) < 1e-9 for r in uniform)
    assert mx.mix(make_docs([]), labels, {"a": 1.0}).count() == 0


def test_a_domain_of_long_texts_is_learned(spark, make_docs):
    rows = [(i, "aaa bbb aaa " * 5) for i in range(30)] + [(i, "xyz zyx xyz " * 3000) for i in range(30, 50)]
    labels = spark.createDataFrame([(i, "a" if i < 30 else "x") for i in range(50)] + [(i, "x") for i in range(1000, 5000)],
                                   "doc_id long, domain string")
    got = {r.doc_id: r.domain for r in mx.mix(make_docs(rows), labels, {"a": 0.5, "x": 0.5}, max_docs=100).collect()}
    assert all(got[i] == ("a" if i < 30 else "x") for i in range(50))
