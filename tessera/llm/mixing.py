"""Mixing sources to target weights by soft domain membership.

A labelled table (doc_id, domain) trains a softmax regression over hashed byte
trigrams, on a sample with a documented bound (``max_docs``).  It gives every
document a posterior p over the domains of ``targets``.  With n tokens (runs
without ASCII white space) in a document, its expected domain tokens are n * p.

Rates r >= 0 of all documents are then fitted so that the expected domain
totals A r = sum(r * n * p) meet the targets T (weights x token budget):
projected-gradient least squares in the metric M of the inverse second moments
sum(n * p p'), r <- max(0, r - p . M (A r - T)), from one uniform rate.  In this
metric a full step has length 1, and long documents don't move more than short
ones.  A pass is one aggregate over the documents: each task replays the
gradients so far (one small vector each) on its rows and sends back one vector
of totals, so no rate is stored between passes, and a lost executor only costs
its tasks.

Cases: null and empty texts have no tokens and the average posterior; a label
with a null or unknown domain doesn't train; a document with several labels
trains with the smallest; domains without training rows get posterior 0, so
their totals stay 0; with no training rows at all posteriors are uniform; if
the targets can't be met with rates of 0 or more, the rates approach the
nearest fit as far as ``passes`` go; documents with equally likely domains are in
the first by name; an empty table gives no rows; repeated rows count and are rated once each; very long texts are taken
whole, in blocks; clashing extra columns (``posterior``, ``rate``, ``domain``,
``n_tokens``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import binary, cut, per_row

BUCKETS = 1 << 11
_CHUNK = 1 << 20


def features(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of the hashed byte trigrams; zeros without any."""
    counts = np.zeros(BUCKETS, np.int64)
    x = np.frombuffer((text or b"").lower(), np.uint8)
    for at in range(0, max(0, len(x) - 2), _CHUNK):
        p = x[at:at + _CHUNK + 2].astype(np.uint32)
        codes = (p[:-2] << 16 | p[1:-1] << 8 | p[2:]) * np.uint32(2654435761) >> np.uint32(21)
        counts += np.bincount(codes, minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def fit_classifier(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, ridge: float = 1e-4):
    """Weights (BUCKETS x classes) and offsets of a softmax regression, by accelerated gradient."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    seen = np.bincount(y, minlength=classes) > 0
    b[~seen] = -1e9
    hot = np.eye(classes, dtype=np.float32)[y]
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        d = (_softmax((x @ (w + 0.9 * vw)) + b + 0.9 * vb) - hot) / len(y)
        vw, vb = 0.9 * vw - 4 * (x.T @ d + ridge * w), 0.9 * vb - 4 * d.sum(axis=0) * seen
        w, b = w + vw, b + vb
    return w, b


def _softmax(z):
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, domains: list[str], max_docs: int = 3000):
    """(weights, offsets, average) from a sample of labelled documents, in the order of a hash of the
    id and of at most ``max_docs`` / len(domains) a domain.

    Only labels whose document is there and has text count.  The driver gets the sample's features,
    not its texts: max_docs x BUCKETS numbers, however long the texts.
    """
    there = docs.where("doc_id is not null and length(text) > 0").select("doc_id").distinct()
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(
        F.min("domain").alias("domain")).join(there, "doc_id", "left_semi")
    few = None
    for d in domains:
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // len(domains))
        few = part if few is None else few.unionByName(part)
    shares = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    texts = docs.where("length(text) > 0").select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(
        F.min("domain").alias("domain"), F.min("text").alias("text"))
    found = per_row(texts, [(c, F.col(c)) for c in ("doc_id", "domain")], [binary(F.col("text"))], "x binary",
                    lambda: lambda text: (features(text).tobytes(),))
    rows = sorted((r.doc_id, r.domain, bytes(r.x)) for r in found.collect())
    if not rows:
        return None, None, np.full(len(domains), 1 / len(domains))
    y = np.array([domains.index(d) for _, d, _ in rows])
    w, b = fit_classifier(np.stack([np.frombuffer(x, np.float32) for *_, x in rows]), y, len(domains))
    took = np.bincount(y, minlength=len(domains))
    share = np.array([shares.get(d, 0) for d in domains], float)
    with np.errstate(divide="ignore"):  # the sample is even over domains; the labels are not
        b = b + np.where(took > 0, np.log(share / np.maximum(1, took) * len(rows) / share.sum()), 0)
    return w, b, share / share.sum()


def posteriors(docs: DataFrame, keep: list, model) -> DataFrame:
    """The ``keep`` columns, n_tokens and posterior (array, in the order of the domains)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        w, b, average = held.value

        def f(text):
            n = len(text.split()) if text else 0
            if not n or w is None:
                return n, average.tolist()
            return n, _softmax(features(text) @ w + b).astype(float).tolist()
        return f

    return per_row(docs, keep, [binary(F.col("text"))], "n_tokens long, posterior array<double>", make)


def _columns(batch, k: int):
    p = np.array(batch.column("posterior").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, k)
    return batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float), p


def _replay(p: np.ndarray, start: float, gradients: list) -> np.ndarray:
    r = np.full(len(p), start)
    for g in gradients:
        r = np.maximum(0, r - p @ g)
    return r


def _totals(rows: DataFrame, k: int, value) -> np.ndarray:
    """Sum over all rows of value(n, p), a vector of a fixed length; one partial sum a task."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = value(*_columns(batch, k))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())],
                                             names=["i", "v"])

    parts = rows.select("n_tokens", "posterior").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    found = {r.i: r.v for r in parts.collect()}
    return np.array([found[i] for i in sorted(found)])


def fit_rates(rows: DataFrame, weights: np.ndarray, budget: float | None = None, passes: int = 60, close: float = 1e-6):
    """(first rate, gradients): with ``_replay`` they give the rate of any posterior.

    A step first takes the metric of the rows whose rate is not 0; if that doesn't lessen the
    loss, it is shortened, and at last the metric of all rows is taken, whose full step does.
    """
    k = len(weights)

    def at(gradients):
        """Expected totals, and the second moments of the rows with a rate over 0."""
        def value(n, p):
            r = _replay(p, start, gradients)
            on = p * (n * (r > 0))[:, None]
            return np.concatenate((p.T @ (n * r), (on.T @ p).ravel()))
        found = _totals(rows, k, value)
        return found[:k], found[k:].reshape(k, k)

    def inverse(moments):
        return np.linalg.pinv(moments, rcond=1e-9, hermitian=True)

    tokens = _totals(rows, k, lambda n, p: n.sum(keepdims=True))
    if not tokens.any():
        return 0.0, []
    target = weights / weights.sum() * (tokens[0] if budget is None else budget)
    start, done = target.sum() / tokens[0], []
    total, moments = at(done)
    whole = metric = inverse(moments)
    off, step = total - target, 1.0
    loss = off @ whole @ off
    for _ in range(passes):
        if np.abs(off).max() <= close * target.sum():
            break
        trial = [*done, step * (metric @ off)]
        total, moments = at(trial)
        new = (total - target) @ whole @ (total - target)
        if new < loss * (1 - 1e-9):
            done, off, loss, metric, step = trial, total - target, new, inverse(moments), 1.0
        elif step > 0.1 and metric is not whole:
            step /= 3
        elif metric is not whole:
            metric, step = whole, 1.0
        else:
            break
    return start, done


def with_rate(rows: DataFrame, start: float, gradients: list, domains: list[str]) -> DataFrame:
    """``rows`` (with posterior) and their likeliest domain and rate."""
    k = len(domains)

    def run(batches):
        for batch in batches:
            _, p = _columns(batch, k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([domains[i] for i in p.argmax(axis=1)], pa.string()),
                 pa.array(_replay(p, start, gradients), pa.float64())], names=[*batch.schema.names, "domain", "rate"])

    schema = T.StructType([*rows.schema.fields, T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None,
        keep: list[str] | None = None, **options) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default), n_tokens, posterior, domain and rate."""
    domains = sorted(targets)
    model = train(docs, labels, domains, **options)
    slim = cut(posteriors(docs, [], model), "posteriors")
    start, gradients = fit_rates(slim, np.array([targets[d] for d in domains], float), budget)
    kept = [(c, F.col(f"`{c}`")) for c in (docs.columns if keep is None else keep)
            if c not in ("n_tokens", "posterior", "domain", "rate")]
    rows = posteriors(docs, kept, model)
    return with_rate(rows, start, gradients, domains)


# Production parameters of the registered query and of the pipeline.
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels table: toxic, else poor (quality 0), else good."""
    return labels.select("doc_id", F.expr("case when toxic = 1 then 'toxic' when quality = 0 then 'poor' "
                                          "when quality = 1 and toxic = 0 then 'good' end").alias("domain"))


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    return mix(docs, label_domains(labels), targets, keep=["doc_id", "source"], **options)
