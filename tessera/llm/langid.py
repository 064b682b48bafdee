"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and every run of non-letters becomes one space; the code
point n-grams of lengths 1 to ``max_n`` are hashed into ``buckets`` counts.
Training sums these counts over all labelled training rows (one partial sum a
task, added up by Spark), so the model's size is languages x buckets whatever
the corpus size.  The smoothed log-probability matrix is broadcast; a batch of
texts is scored in numpy by gathering the matrix rows of the n-grams that occur
and summing them per text, a chunk of a text at a time (a large chunk is counted
first), so a task holds one chunk's n-grams, whatever the texts.

Cases: rows with a null text or lang don't train; a null text, and a text
without a letter, is ``und`` with score 0; with no training rows at all every
text is ``und``; ties go to the first language in sorted order; very long texts
are counted whole, ``_CHUNK`` code points at a time; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_ROWS, remainder

_CHUNK = 1 << 18
_PRIME = np.uint32(2654435761)


def letter_table() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str, letters: np.ndarray, buckets: int, max_n: int):
    """Chunks of hashed n-gram numbers of one text; nothing if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ok = letters[points]
    if not ok.any():
        return
    x = np.where(ok, points, np.uint32(32)).astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = ok[1:] | ok[:-1]  # one space for a run of others
    x = np.concatenate(([np.uint32(32)], x[keep], [np.uint32(32)])).astype(np.uint32)
    shift = np.uint32(32 - int(math.log2(buckets)))
    for at in range(0, len(x), _CHUNK):
        h = np.zeros(0, np.uint32)
        part = x[at:at + _CHUNK + max_n - 1]
        last = min(_CHUNK, len(x) - at)  # grams start before this
        for n in range(1, max_n + 1):
            size = min(last, len(part) - n + 1)
            if size <= 0:
                break
            h = (part[n - 1:n - 1 + size] + np.uint32(n)) if n == 1 else \
                h[:size] * np.uint32(0x01000193) ^ (part[n - 1:n - 1 + size] + np.uint32(n))
            yield (h * _PRIME) >> shift


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # buckets x langs, float32
    prior: np.ndarray
    buckets: int
    max_n: int


def train(rows: DataFrame, buckets: int = 1 << 15, max_n: int = 3, alpha: float = 0.5) -> Model:
    """Fit on all ``rows`` (text, lang) with both set."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")

    def run(batches):
        letters, counts, docs = letter_table(), {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if lang not in counts:
                        counts[lang], docs[lang] = np.zeros(buckets, np.int64), 0
                    docs[lang] += 1
                    for h in grams(text, letters, buckets, max_n):
                        if len(h) > buckets:
                            counts[lang] += np.bincount(h, minlength=buckets)
                        else:
                            np.add.at(counts[lang], h, 1)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)),
                 pa.array(np.append(c[at], docs[lang]))], names=["lang", "bucket", "n"])

    got = (rows.where("text is not null and lang is not null").select("text", "lang")
           .mapInArrow(run, "lang string, bucket int, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # languages x (buckets + 1) numbers at most, whatever the corpus size
    found = got.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")) \
        .orderBy("lang").collect()
    langs = [r.lang for r in found]
    counts, docs = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for i, r in enumerate(found):
        at, n = np.array(r.at), np.array(r.n, float)
        docs[i] = n[at == -1].sum()
        counts[at[at >= 0], i] = n[at >= 0]
    log_prob = np.log((counts + alpha) / (counts.sum(0) + alpha * buckets)) if langs else counts
    prior = np.log(docs / docs.sum()) if langs else docs
    return Model(langs, log_prob.astype(np.float32), prior, buckets, max_n)


def _summed(h: np.ndarray, model: Model) -> np.ndarray:
    """Log-probabilities of some n-grams, summed: for many of them their counts times the matrix."""
    if len(h) < model.buckets:
        return model.log_prob[h].sum(axis=0, dtype=np.float64)
    return np.bincount(h, minlength=model.buckets).astype(np.float64) @ model.log_prob


def score(texts: list, model: Model, letters: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and its posterior for every text of a batch."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return langs, scores
    total, seen = np.zeros((len(texts), len(model.langs))), []
    for i, text in enumerate(texts):
        for h in grams(text, letters, model.buckets, model.max_n) if text else ():
            total[i] += _summed(h, model)  # a chunk's codes are gone once they are summed
            if not seen or seen[-1] != i:
                seen.append(i)
    if not seen:
        return langs, scores
    logits = total[seen] + model.prior
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i, best, row in zip(seen, p.argmax(axis=1), p, strict=True):
        langs[i], scores[i] = model.langs[best], float(row[best])
    return langs, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches):
        letters, known = letter_table(), Model(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                langs, scores = score(part.column(1).to_pylist(), known, letters)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def report(docs: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """Train on the rows outside fold ``held`` and predict all rows."""
    model = train(docs.where(remainder(F.col("doc_id"), folds) != held), **options)
    return predict(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
