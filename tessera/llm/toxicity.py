"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z
lower-cased.  A word enters as two embeddings side by side: its own, if it is in
the training vocabulary, and the element-wise maximum of those of its hashed
character n-grams (3 to 5, word ends marked).  A GRU runs over each window of ``WINDOW`` words in both directions,
attention pools its states, and a linear unit gives the window's logit.  Every
text is covered by windows that overlap by half; its score is the calibrated
sigmoid of its largest window logit.

Training (driver, numpy): a sample of labelled documents with a documented
bound (``max_docs``; of documents of more than ``max_words`` words, windows spread over the whole
text).  Labels hold for documents, not
windows, so each pass first scores all windows and then learns from the highest
ones of each document.  The embeddings' first element starts from the smoothed
log-odds of the word or n-gram.  The last step fits the logistic calibration of document maxima.

Scoring: the model (fixed size, about 2.5 MB) is broadcast; tasks embed
each distinct word of a slice of documents once and run blocks of windows.

Cases: null and wordless texts score 0; documents with a null label don't
train; repeated labels of a document count as toxic if one is; with one class
only, or no labels, every score is the share of toxic labels (0 without any);
equally high windows give the same score, whichever is taken; repeated rows score
alike; an empty table of documents gives no rows; very long texts are scored
whole, in blocks; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binary, remainder
from tessera.llm.decontaminate import words_of

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, POOL = 8, 8, 8
CHAR_BUCKETS = 1 << 16  # and one more for n-grams that reach over a word's end
PSEUDO = 10  # documents at the average rate added to each word's or n-gram's
VOCABULARY = 8192  # at most; words in at least three training documents
THRESHOLD = 0.3

_BLOCK = 512  # windows run at once
_STEPS = 50  # batches a pass learns from, at least
_SLICE = 256  # documents embedded at once


# -- inputs ---------------------------------------------------------------------------------

def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text with n words; the last window ends the text."""
    last = max(0, n - WINDOW)
    at = np.arange(0, last + 1, STRIDE)
    return at if not last or at[-1] == last else np.append(at, last)


def _number(texts: list[list[bytes]]):
    """Distinct words of the texts, and each text's words as their numbers, end to end."""
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int32,
                       sum(map(len, texts)))
    return list(known), flat


def _ngrams(words: list[bytes]):
    """Hashed n-grams of <word>, three a character and end to end, and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    x = np.frombuffer(b"".join(b"<%b>" % w for w in words) + b"\0" * 4, np.uint8).astype(np.uint32)
    begin = np.concatenate(([0], sizes.cumsum()))
    n = begin[-1]
    left = np.repeat(begin[1:], sizes) - np.arange(n)  # characters up to the word's end
    h = x[:n] << 16 | x[1:n + 1] << 8 | x[2:n + 2]
    codes = np.empty((n, 3), np.uint32)
    for k in range(3):
        if k:
            h = h * np.uint32(0x01000193) ^ x[k + 2:n + k + 2]
        codes[:, k] = np.where(left >= k + 3, (h + np.uint32(k)) * np.uint32(2654435761) >> np.uint32(16), CHAR_BUCKETS)
    return codes.ravel(), 3 * begin[:-1], 3 * sizes


class Net:
    """The parameters, and the passes over them."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: list[bytes]):
        self.w, self.vocabulary = weights, vocabulary
        self.rows = {x: i for i, x in enumerate(vocabulary, 1)}  # row 0: any other word

    @staticmethod
    def start(vocabulary: list[bytes], odds: np.ndarray, char_odds: np.ndarray, seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        w = {"word": normal(len(vocabulary) + 1, EMBED) * 0.3, "char": normal(CHAR_BUCKETS + 1, EMBED) * 0.1,
             "x": normal(2, 2 * EMBED, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
             "u": normal(2, HIDDEN, 3 * HIDDEN), "a": normal(2 * HIDDEN, POOL), "v": normal(POOL),
             "o": normal(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        w["word"][0] = 0
        w["word"][1:, 0] = odds
        w["char"][:-1, 0] = char_odds
        w["char"][-1] = -100
        return Net(w, vocabulary)

    def embed(self, words: list[bytes]):
        rows = np.fromiter((self.rows.get(x, 0) for x in words), np.int64, len(words))
        codes, begin, sizes = _ngrams(words)
        each = self.w["char"][codes]
        chars = np.maximum.reduceat(each, begin, axis=0)
        return np.concatenate((self.w["word"][rows], chars), axis=1), (rows, codes, sizes, each)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of words, one block for each direction: (2, words, 3 * HIDDEN)."""
        return np.matmul(x[None], self.w["x"]) + self.w["b"]

    def forward(self, gates: np.ndarray, numbers: np.ndarray, keep: bool = False):
        """Logits of windows (windows x WINDOW word numbers, -1 beyond the text)."""
        n = len(numbers)
        idx = np.ascontiguousarray(numbers.T)
        mask = (idx >= 0).astype(np.float32) if (idx < 0).any() else None
        h = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        steps, u = [], self.w["u"]
        for t in range(WINDOW):
            both = (idx[t], idx[WINDOW - 1 - t])
            x = np.stack((gates[0][both[0]], gates[1][both[1]]))
            hu = np.matmul(h, u)
            zr = np.tanh(0.5 * (x[..., :2 * HIDDEN] + hu[..., :2 * HIDDEN])) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            new = np.tanh(x[..., 2 * HIDDEN:] + r * hu[..., 2 * HIDDEN:])
            after = new + z * (h - new)
            m = None
            if mask is not None:
                m = np.stack((mask[t], mask[WINDOW - 1 - t]))[..., None]
                after = h + m * (after - h)
            if keep:
                steps.append((h, hu, z, r, new, m, both))
            h = after
            out[t, :, :HIDDEN], out[WINDOW - 1 - t, :, HIDDEN:] = h[0], h[1]
        a = np.tanh(out @ self.w["a"])
        s = a @ self.w["v"]
        if mask is not None:
            s = np.where(mask > 0, s, np.float32(-1e9))
        p = np.exp(s - s.max(axis=0))
        p /= p.sum(axis=0)
        pooled = (p[..., None] * out).sum(axis=0)
        logit = pooled @ self.w["o"] + self.w["c"][0]
        return (logit, (out, a, p, pooled, steps)) if keep else logit

    def backward(self, gates, held, d_logit: np.ndarray):
        """Gradients of all parameters but the embeddings, and of the gate inputs."""
        out, a, p, pooled, steps = held
        g = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * self.w["o"]
        d_out = p[..., None] * d_pool
        dp = (out * d_pool).sum(axis=2)
        ds = p * (dp - (p * dp).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", ds, a)
        da = ds[..., None] * self.w["v"] * (1 - a * a)
        g["a"] = np.einsum("tnh,tnk->hk", out, da)
        d_out += da @ self.w["a"].T
        d_gates, du = np.zeros_like(gates), np.zeros_like(self.w["u"])
        dh = np.zeros_like(steps[0][0])
        for t in range(WINDOW - 1, -1, -1):
            h, hu, z, r, new, m, both = steps[t]
            dh = dh + np.stack((d_out[t, :, :HIDDEN], d_out[WINDOW - 1 - t, :, HIDDEN:]))
            through = 0
            if m is not None:
                through, dh = dh * (1 - m), dh * m
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * hu[..., 2 * HIDDEN:] * r * (1 - r)
            dx = np.concatenate((dz, dr, dn), axis=2)
            dhu = np.concatenate((dz, dr, dn * r), axis=2)
            du += np.matmul(h.transpose(0, 2, 1), dhu)
            for d in (0, 1):
                np.add.at(d_gates[d], both[d], dx[d])
            dh = dh * z + np.matmul(dhu, self.w["u"].transpose(0, 2, 1)) + through
        g["u"] = du
        return g, d_gates

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """Logits of all windows of the texts, which have words, end to end."""
        words, flat = _number(texts)
        gates = self.inputs(self.embed(words)[0])
        gates = np.concatenate((gates, np.zeros((2, 1, 3 * HIDDEN), np.float32)), axis=1)  # -1: beyond a text
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate(([0], sizes.cumsum()))[:-1]
        starts = [window_starts(n) for n in sizes]
        begin = np.concatenate([s + f for s, f in zip(starts, first, strict=True)])
        end = np.repeat(first + sizes, [len(s) for s in starts])
        out = [self.forward(gates, _numbers(flat, begin[i:i + _BLOCK], end[i:i + _BLOCK]))
               for i in range(0, len(begin), _BLOCK)]
        return np.concatenate(out)


def _numbers(flat, begin, end):
    at = begin[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], flat[np.minimum(at, len(flat) - 1)], -1)


# -- training -------------------------------------------------------------------------------

def _odds(counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smoothed log-odds, against the average, of what ``counts`` (.., 0 and 1) documents hold."""
    rate = labels.mean()
    p = (counts[:, 1] + PSEUDO * rate) / (counts.sum(axis=1) + PSEUDO)
    return (np.log(p / rate) / 2).astype(np.float32)


def _vocabulary(words, docs, labels):
    """Words in at least three documents, most frequent first, their log-odds and those of the n-grams."""
    held, char = np.zeros((len(words), 2)), np.zeros((CHAR_BUCKETS + 1, 2))
    codes, begin, sizes = _ngrams(words)
    of = np.split(codes, begin[1:])
    for own, y in zip(docs, labels, strict=True):
        own = np.unique(own)
        held[own, y] += 1
        char[np.unique(np.concatenate([of[i] for i in own])), y] += 1
    order = sorted(np.flatnonzero(held.sum(axis=1) >= 3).tolist(), key=lambda i: (-held[i].sum(), words[i]))[:VOCABULARY]
    return [words[i] for i in order], _odds(held[order], labels), _odds(char[:-1], labels)


def fit(texts: list[list[bytes]], labels: list[int], epochs: int = 8, seed: int = 0, rate: float = 0.01):
    """(net, slope, offset): trained on documents (lists of words, not empty) with labels 0 and 1."""
    labels = np.array(labels, np.int64)
    words, flat = _number(texts)
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate(([0], sizes.cumsum()))[:-1]
    vocabulary, odds, char_odds = _vocabulary(words, np.split(flat, first[1:]), labels)
    net, rng = Net.start(vocabulary, odds, char_odds, seed), np.random.default_rng(seed)
    starts = [window_starts(n) for n in sizes]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    begin, end = np.concatenate(starts) + first[owner], (first + sizes)[owner]
    bag = np.concatenate(([0], np.cumsum([len(s) for s in starts])))[:-1]
    embedded = net.embed(words)[0]
    word_odds = np.maximum(embedded[:, 0], embedded[:, EMBED])
    # before the first pass, a window stands as high as its highest word
    score = np.concatenate([np.where(i >= 0, word_odds[i], -9).max(axis=1)
                            for i in (_numbers(flat, begin[j:j + 4096], end[j:j + 4096])
                                      for j in range(0, len(begin), 4096))])
    adam, moment, step = {}, {}, 0
    for epoch in range(epochs):
        if epoch:
            score = net.logits(texts)
        order = np.lexsort((-score, owner))  # windows of a document, highest first
        top = order[bag]
        second = order[np.minimum(bag + 1, np.append(bag[1:], len(order)) - 1)]
        lucky = bag + (rng.random(len(bag)) * np.diff(np.append(bag, len(order)))).astype(np.int64)
        no = labels == 0
        pick = np.unique(np.concatenate((top, second[no], lucky[no])))
        y = labels[owner[pick]]
        weight = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum())) ** 0.5
        parts = max(1, len(pick) // 64)
        rounds = -(-_STEPS // parts)  # few documents are learned from several times
        for i in [x for _ in range(rounds) for x in np.array_split(rng.permutation(len(pick)), parts)]:
            step += 1
            _learn(net, words, flat, begin[pick[i]], end[pick[i]], y[i], weight[i], adam, moment, step,
                   rate * (0.5 if epoch >= epochs - 3 else 1), rng)
    high = np.maximum.reduceat(net.logits(texts), bag)
    return net, *_calibrate(high, labels)


def _learn(net, words, flat, begin, end, y, weight, adam, moment, step, rate, rng):
    numbers = _numbers(flat, begin, end)
    used, at = np.unique(numbers, return_inverse=True)
    at = at.reshape(numbers.shape)
    if used[0] < 0:
        used, at = used[1:], at - 1
    x, (rows, codes, sizes, each) = net.embed([words[i] for i in used])
    keep = np.ones_like(x)
    keep[rng.random(len(x)) < 0.1, :EMBED] = 0  # now and then only the characters are seen
    gates = net.inputs(x * keep)
    gates = np.concatenate((gates, np.zeros((2, 1, 3 * HIDDEN), np.float32)), axis=1)
    logit, held = net.forward(gates, at, True)
    d = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
    g, dg = net.backward(gates, held, d)
    dg = dg[:, :-1]
    g["b"], g["x"] = dg.sum(axis=1, keepdims=True), np.matmul((x * keep).T[None], dg)
    dx = np.matmul(dg, net.w["x"].transpose(0, 2, 1)).sum(axis=0) * keep
    g["word"], g["char"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["char"])
    np.add.at(g["word"], rows, dx[:, :EMBED])
    g["word"][0] = 0
    high = np.repeat(np.arange(len(x)), sizes)
    at, k = np.nonzero(each == x[high, EMBED:])  # the maximum's gradient goes to the n-gram that has it
    np.add.at(g["char"], (codes[at], k), dx[high[at], EMBED + k])
    g["char"][-1] = 0
    for k, v in g.items():
        v = v + 1e-5 * net.w[k]
        m = moment[k] = 0.9 * moment.get(k, 0) + 0.1 * v
        s = adam[k] = 0.99 * adam.get(k, 0) + 0.01 * v * v
        net.w[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)


def _calibrate(high: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (over 0) and offset of the logistic fit of labels to document maxima."""
    centre, scale = high.mean(), high.std() + 1e-6
    x, a, b = (high - centre) / scale, 1.0, 0.0
    for _ in range(500):
        d = 1 / (1 + np.exp(-(a * x + b))) - labels
        a, b = max(1e-3, a - 2 * (d * x).mean() - 2e-4 * a), b - 2 * d.mean()
    return float(a / scale), float(b - a * centre / scale)


# -- Spark ----------------------------------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame, max_docs: int):
    """A bounded set of labelled texts: up to a third toxic, in the order of a hash of the id.

    Only labels whose document is there and has text count, so none takes another's place.
    """
    there = docs.where("doc_id is not null and length(text) > 0").select("doc_id").distinct()
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).join(there, "doc_id", "left_semi")
    ids = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
           for y, n in ((1, max_docs // 3), (0, max_docs - max_docs // 3))]
    few = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.where("length(text) > 0").select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return sorted((r.doc_id, r.text, int(r.toxic)) for r in rows.toLocalIterator())


def spread(words: list[bytes], most: int, block: int = 8 * STRIDE) -> list[bytes]:
    """All words of a text, or for a longer one blocks of them, evenly spaced from its start to its end."""
    if len(words) <= most:
        return words
    n = max(1, most // block)
    starts = np.linspace(0, len(words) - block, n).astype(int)
    return [w for s in starts for w in words[s:s + block]]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_words: int = 6000, **options):
    """A scorer from ``labels`` (doc_id, toxic): what ``score`` takes.

    It learns from at most ``max_docs`` documents, and of documents of more than ``max_words`` words
    from windows spread over the whole text.
    """
    rows = [(spread(w, max_words), y) for _, text, y in sample(docs, labels, max_docs) if (w := words_of(text.encode()))]
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    if share in (0, 1):
        return share
    net, slope, offset = fit([w for w, _ in rows], [y for _, y in rows], **options)
    return net.w, net.vocabulary, slope, offset


def score_texts(texts: list, net: Net, slope: float, offset: float) -> np.ndarray:
    out = np.zeros(len(texts))
    words = [words_of(t) for t in texts]
    some = [i for i, w in enumerate(words) if w]
    if some:
        bag = np.concatenate(([0], np.cumsum([len(window_starts(len(words[i]))) for i in some])))[:-1]
        high = np.maximum.reduceat(net.logits([words[i] for i in some]), bag).astype(float)
        out[some] = 1 / (1 + np.exp(-np.clip(slope * high + offset, -50, 50)))
    return out


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, vocabulary, slope, offset = held.value
        net = Net(weights, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = score_texts(part.column(1).to_pylist(), net, slope, offset)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", binary(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """Learn from the labels outside fold ``held`` and score all rows."""
    model = train(docs, labels.where(remainder(F.col("doc_id"), folds) != held), **options)
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
