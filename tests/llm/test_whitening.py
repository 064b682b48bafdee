import math

import numpy as np
import pytest

from tessera.llm import queries, whitening

COLS = "vec_id long, embedding array<float>, label int, n long, x string, component double, deviation int"


def plain(vectors):
    """Brute force: {vec_id: (deviation, whitened by component)}, shares, n, from (vec_id, x) with exact integers."""
    fit = np.array(sorted({tuple(x) for _, x in vectors}), dtype=np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    mean = np.array([s / n for s in sums])
    v = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, int((e > 1e-12 * e.sum()).sum()))
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - mean) @ u[:, :k] / np.sqrt(e[:k])) for i, x in vectors]
    return out, e[:k] / e.sum(), n, k


def fixed(vec):
    return [math.floor(256 * float(np.float32(c))) for c in vec]


def compare(rows, vectors, tol=1e-9):
    want, shares, n, k = plain(vectors)
    assert len(rows) == k * len(want) and {r.n for r in rows} == {n}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for c in range(k):
        own = sorted(((r.vec_id is not None, r.vec_id, r.deviation, r.whitened, r.explained) for r in rows if r.component == c + 1),
                     key=lambda r: r[:3])
        ref = sorted(((i is not None, i, d, w[c]) for i, d, w in want), key=lambda r: r[:3])
        assert [r[:3] for r in own] == [r[:3] for r in ref]
        assert all(abs(r[4] - shares[c]) < 1e-12 * len(own) for r in own)
        a, b = np.array([r[3] for r in own]), np.array([r[3] for r in ref])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tol


def test_given_table(spark):
    rows = queries.op12_whitening(spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(rows, [(r.vec_id, fixed(r.embedding)) for r in table])


def test_small_cases(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [5, 1, 3, 2, .5] + 7], None, 1, "a", 2.0, 3) for i in range(40)]
    good += [good[0]] * 30 + [(None, *good[1][1:]), (99, *good[2][1:]), (100, [-0.0, 0.0, -1e-9, 1e4, -3.0], 1, 1, "", 0.0, 0)]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [math.nan] * 5), (203, [math.inf] * 5), (204, []), (205, [1.0, 2.0]),
           (206, [1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + [(*b, 1, 1, "a", 2.0, 3) for b in bad], COLS)
    compare(whitening.report(df).collect(), [(r[0], fixed(r[1])) for r in good], 1e-8)
    one = whitening.report(df.where("vec_id = 3"))
    assert one.collect() == [] and one.dtypes == whitening.report(df.where("vec_id < 3 or vec_id = 99")).dtypes
    assert whitening.report(df.limit(0)).collect() == []
    assert whitening.report(df.where("vec_id = 204")).collect() == []
    line = whitening.report(df.where("vec_id in (3, 5)")).collect()  # two vectors: one component, at +1 and -1
    assert len(line) == 2 and sorted(round(r.whitened, 9) for r in line) == [-1, 1] and line[0].explained == pytest.approx(1)


def test_exact_deviation_beyond_a_long():
    x = np.array([[3, -4], [2 ** 40, 2 ** 40]], np.int64)
    assert whitening.deviations(x[:1], 7, [5, 6]) == [(21 - 5) ** 2 + (-28 - 6) ** 2]
    assert whitening.deviations(x, 7, [5, 6]) == [(21 - 5) ** 2 + (-28 - 6) ** 2, None]


@pytest.mark.parametrize("seed", range(6))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(30, 30))
    a = a + a.T if seed % 2 else np.kron(np.eye(15), [[0, 1], [1, 0]]) * (1 + seed)
    e = np.linalg.eigvalsh(a)
    for s in (-3.3, 0.123, 2.71):
        assert whitening.count_above(a, s) == (e > s).sum()
    assert whitening.count_above(np.zeros((4, 4)), 0.0) == 0


@pytest.mark.parametrize("spectrum", [
    [9, 5, 5, 5, 5, 5, 5, 5, 5, 1], list(range(40, 0, -1)), [1e6, 1, 1e-2, 1e-4, 1e-9], [2.0] * 12, [1 + 1e-9 * i for i in range(9)],
    [3, 3 - 1e-13, 1, 0, 0, 0]])
def test_feast_against_dense(spark, spectrum):
    rng = np.random.default_rng(5)
    u, _ = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))
    v = (u * spectrum) @ u.T
    v = (v + v.T) / 2
    e, w = whitening.eigenpairs(spark, v, 4)
    want = np.sort([s for s in spectrum if s > 1e-12 * sum(spectrum)])[::-1][:4]
    assert len(e) == len(want) and np.abs(e - want).max() < 1e-12 * want[0]
    assert np.abs(w.T @ w - np.eye(len(e))).max() < 1e-13
    assert np.abs(v @ w - w * e).max() < 2e-11 * want[0]
