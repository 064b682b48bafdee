"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens: its lower-cased (A-Z) words, then one end.
Tokens become symbols: one for each of the ``VOCABULARY`` most frequent training
words (seen twice or more, so that words seen once teach how new words look),
one for the end, and for other words an escape and the word's bytes with a
terminator.  A symbol is a path of bits in a Huffman tree of the training
counts, and each bit is predicted from the node it is decided at:

* predictors: the log-odds of the bit at the node in all of the training rows,
  after the previous symbol, and after the previous two; contexts are hashed
  with the node into tables of bit counts;
* mixing: the log-odds are added with weights that a gate selects (how often
  either context was seen, word or byte tree); weights belong to the text, start
  from fixed shares and learn online by the gradient of the coding cost;
* refinement: the mixed log-odds are corrected by an adaptive map over their own
  size, learned in the same way.

Weights and corrections are updated after every ``GROUP`` symbols of the text,
which lets numpy step through many texts side by side; what is coded never
depends on symbols to come, so the sum of the bits' costs is the code length of
the text: ``bits``, per byte ``bits_per_byte``, and ``score`` = -bits * log10(2).

Spark counts words and contexts over all training rows.  Word counts are one
table, however many words there are.  Context counts are fixed-size tables: a
task sends blocks of them, which are added up in two steps, so no task gets
the blocks of all tasks at once.  The broadcast model is bounded by
``VOCABULARY`` and ``SLOTS``.  ``base_score`` needs the count of every word:
those of the vocabulary come with the model, others by a join on the word; as
frequent words are in the vocabulary, that join has no hot key.

Cases: null and empty texts are the end alone; rows with a null id are trained
on or held out by the crc32 of the empty text; repeated rows count and are
scored once each; without training rows every count is 0 and base_score is 0;
ties of frequency between words are broken by the word's bytes; long texts are
coded whole, piece by piece; words over ``_LONG`` bytes are counted by their
digest; bits_per_byte is null for texts without a byte; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_ROWS, binary, bounded_batches, cut, remainder

VOCABULARY = 1 << 18
SLOTS = 1 << 20
GROUP = 64
_BLOCK = 1 << 12
_SALTS = 16
_LONG = 64
_BATCH_BYTES = 1 << 20
_END = b" "  # no word holds a space
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_GATES, _MAP = 32, 24
_RATE = 0.03


def key(word: bytes) -> bytes:
    """The word, or for a long one a digest that no short word equals."""
    return word if len(word) <= _LONG else b"\x20" + hashlib.sha256(word).digest()


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, about ``_BATCH_BYTES`` of text at a time."""
    if text is None or len(text) <= _BATCH_BYTES:
        yield (text or b"").lower().split()
        return
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + _BATCH_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def _rows(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            part = whole.slice(at, SLICE_ROWS)
            yield part, part.column(column).to_pylist()


# --- words ------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows: every word's key, and the end."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "c"])
            seen.clear()
            return got
        for _, texts in _rows(batches, 0):
            for text in texts:
                for words in pieces(text):
                    seen.update(words)
            seen[_END] += len(texts)
            for w in [w for w in seen if len(w) > _LONG]:
                if w[:1] != _END:
                    seen[key(w)] += seen.pop(w)
            if len(seen) > VOCABULARY:
                yield out()
        if seen:
            yield out()

    counts = docs.select(binary(F.col("text"))).mapInArrow(run, "word binary, c long")
    return cut(counts.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def _frequent(words: DataFrame) -> int:
    """The least count, 2 or more, that at most ``VOCABULARY`` words reach, on a logarithmic scale of 32 steps a doubling."""
    step = F.floor(F.log2("c") * 32).cast("int")
    found = sorted(((r.step, r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    taken = 0
    for s, n in found:
        if s < 32:
            break
        if taken + n > VOCABULARY:
            return s + 1
        taken += n
    return 32


# --- code -------------------------------------------------------------------


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, steps, odds) of a Huffman code: symbol s is steps[start[s]:][:length[s]],
    each node * 2 + bit from the root; odds are the nodes' counts of bits 0 and 1."""
    n = len(weights)
    order = np.lexsort((np.arange(n), weights))
    leaf, made, parent = weights[order].tolist(), [], [0] * (2 * n - 1)
    odds = np.zeros((max(1, n - 1), 2))
    i = j = 0
    for node in range(n - 1):
        for bit in (0, 1):
            if i < n and (j >= len(made) or leaf[i] <= made[j]):
                child, w, i = i, leaf[i], i + 1
            else:
                child, w, j = n + j, made[j], j + 1
            parent[child] = node * 2 + bit
            odds[node, bit] = w
        made.append(odds[node].sum())
    up = np.array(parent, np.int32)
    climbs, at, live = [], np.arange(n), np.arange(n)
    while n > 1 and len(live):  # all leaves climb a step at a time
        climbs.append((live, up[at]))
        at = n + (up[at] >> 1)
        live, at = live[at != 2 * n - 2], at[at != 2 * n - 2]
    length = np.zeros(n, np.int32)
    for who, _ in climbs:
        length[who] += 1
    start = np.cumsum(length) - length
    steps = np.zeros(int(length.sum()), np.int32)
    for depth, (who, step) in enumerate(climbs):
        steps[start[who] + length[who] - 1 - depth] = step
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return start[back], length[back], steps, odds


def _log_odds(n0, n1) -> np.ndarray:
    """Log-odds of bit 1 in sixteenths, times 4, plus how often the context was seen (0 to 3), as one number of 16 bits."""
    n = n0 + n1
    odds = np.rint(np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8) * 16).astype(np.int16)
    return odds << 2 | np.digitize(n, [1, 3, 16]).astype(np.int16)


@dataclass
class Model:
    words: list[bytes]  # the vocabulary, by falling count
    counts: np.ndarray  # of the vocabulary, then of the end
    tokens: int
    distinct: int
    start: np.ndarray
    length: np.ndarray
    steps: np.ndarray
    plain: np.ndarray  # log-odds of the nodes
    tables: list[np.ndarray]  # log-odds of hashed (context, node), by order

    def __post_init__(self):
        self.end = len(self.words)
        self.escape, self.byte = self.end + 1, self.end + 2
        self.begin = self.byte + 256
        self.number = None

    def symbols(self, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the tokens, and how many each token has; ids < 0 are spelled."""
        spelled = ids < 0
        if not spelled.any():
            return ids, np.ones(len(ids), np.int64)
        text = np.frombuffer(b" ".join([words[i] for i in np.flatnonzero(spelled)]) + b" ", np.uint8)
        took = np.ones(len(ids), np.int64)
        took[spelled] = np.diff(np.concatenate(([-1], np.flatnonzero(text == 32)))) + 1
        out = np.full(int(took.sum()), -1, np.int32)
        out[np.cumsum(took) - took] = np.where(spelled, self.escape, ids)
        out[out < 0] = self.byte + text.astype(np.int32)
        return out, took

    def lookup(self, words: list[bytes]) -> np.ndarray:
        if self.number is None:
            self.number = {w: i for i, w in enumerate(self.words)}
            self.number[_END] = self.end
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))

    def bits(self, symbols: np.ndarray):
        """(node, bit, owner): the bits of the symbols and the symbol each belongs to."""
        n = self.length[symbols]
        ends = np.cumsum(n)
        at = np.repeat(self.start[symbols] - (ends - n), n)
        at += np.arange(len(at))
        step = self.steps.take(at)
        return step >> 1, step & 1, n


def _contexts(before: np.ndarray, before2: np.ndarray) -> list[np.ndarray]:
    """Hashes of the previous symbol and of the previous two."""
    one = before.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    two = before2.astype(np.uint32) * np.uint32(0x85EBCA6B) ^ one * np.uint32(0xC2B2AE35)
    return [one, two]


def _slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = context ^ node
    x *= np.uint32(0x165667B1)
    x >>= np.uint32(32 - (SLOTS.bit_length() - 1))
    return x


def _previous(symbols: np.ndarray, firsts: np.ndarray, begin: int, last: tuple[int, int] | None = None):
    """The symbol before each, and the one before that; texts start at ``firsts``."""
    one, two = np.empty_like(symbols), np.empty_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    one[firsts], two[firsts] = begin, begin
    second = firsts[np.diff(np.append(firsts, len(symbols))) > 1] + 1
    two[second] = begin
    if last is not None and len(symbols):
        one[0], two[0] = last
        two[1:2] = last[0]
    return one, two


def _gather(texts: list, lookup) -> Iterator[tuple[list[int], list[list[bytes]], bool, bool]]:
    """Batches of whole texts, or the pieces of a long one: (rows, words of each, starts here, ends here)."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        if text is not None and len(text) > _BATCH_BYTES:
            parts = pieces(text)
            part, first = next(parts), True
            for after in parts:
                yield [i], [part], first, False
                part, first = after, False
            yield [i], [[*part, _END]], first, True
            continue
        rows.append(i)
        held.append([*next(pieces(text)), _END])
        size += len(text or b"")
        if size > _BATCH_BYTES:
            yield rows, held, True, True
            rows, held, size = [], [], 0
    if rows:
        yield rows, held, True, True


# --- training ---------------------------------------------------------------


def _byte_counts(words: DataFrame, below: int) -> np.ndarray:
    """How often each byte is spelled in the words under a count, and the terminator, in training."""
    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if words:
                text = np.frombuffer(b" ".join(words) + b" ", np.uint8)
                total += np.bincount(text, np.repeat(c, [len(w) + 1 for w in words]), 256).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["b", "n"])

    few = words.where((F.floor(F.log2("c") * 32) < below) & (F.octet_length("word") <= _LONG))
    got = few.mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.ones(256)
    for r in got:
        out[r.b] += r.n
    return out


def _added(blocks: DataFrame, by: list) -> DataFrame:
    """Counts of equal blocks that meet in a task, added up; a task holds no more than the whole tables."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                b, data = batch.column(0)[at].as_py(), np.frombuffer(batch.column(2)[at].as_py(), np.uint32)
                if b in held:
                    held[b] += data
                else:
                    held[b] = data.astype(np.int64)
        for b, counts in held.items():
            counts = np.minimum(counts, 2 ** 32 - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()),
                                              pa.array([counts.tobytes()], pa.binary())], names=["block", "salt", "counts"])

    return blocks.repartition(*by).mapInArrow(run, "block int, salt int, counts binary")


def _context_counts(docs: DataFrame, held) -> list[np.ndarray]:
    """Log-odds tables of the hashed contexts of all rows."""
    def run(batches):
        model = Model(*held.value)
        counts = [np.zeros(2 * SLOTS, np.int64) for _ in range(2)]
        for _, texts in _rows(batches, 0):
            last = (model.begin, model.begin)
            for _, lists, fresh, _ in _gather(texts, model):
                words = [w for x in lists for w in x]
                symbols, took = model.symbols(words, model.lookup(words))
                if not len(symbols):
                    continue
                ends = np.cumsum([len(x) for x in lists])
                firsts = np.concatenate(([0], np.cumsum(took)[ends[:-1] - 1]))
                one, two = _previous(symbols, firsts, model.begin, None if fresh else last)
                last = (int(symbols[-1]), int(symbols[-2]) if len(symbols) > 1 else int(one[-1]))
                for at in range(0, len(symbols), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    node, bit, n = model.bits(symbols[part])
                    hashed = node.astype(np.uint32) * np.uint32(0x27D4EB2F)
                    for table, context in zip(counts, _contexts(one[part], two[part]), strict=True):
                        slot = _slots(np.repeat(context, n), hashed).astype(np.int64)
                        slot <<= 1
                        slot |= bit
                        table += np.bincount(slot, minlength=2 * SLOTS)
        for k, table in enumerate(counts):
            for b, block in enumerate(np.minimum(table, 2 ** 32 - 1).astype(np.uint32).reshape(-1, 2 * _BLOCK)):
                if block.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k * (SLOTS // _BLOCK) + b], pa.int32()), pa.array([salt()], pa.int32()),
                         pa.array([block.tobytes()], pa.binary())], names=["block", "salt", "counts"])

    def salt():
        from pyspark import TaskContext
        return TaskContext.get().partitionId() % _SALTS

    blocks = docs.select(binary(F.col("text"))).mapInArrow(run, "block int, salt int, counts binary")
    summed = _added(_added(blocks, ["block", "salt"]), ["block"])

    def odds(batches):
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = np.frombuffer(data, np.uint32).astype(float).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_log_odds(n[:, 0], n[:, 1]).tobytes()], pa.binary())],
                                                 names=["block", "odds"])

    tables = [np.zeros(SLOTS, np.int16) for _ in range(2)]
    for r in summed.mapInArrow(odds, "block int, odds binary").collect():  # 2 * SLOTS numbers of two bytes
        k, b = divmod(r.block, SLOTS // _BLOCK)
        tables[k][b * _BLOCK:(b + 1) * _BLOCK] = np.frombuffer(r.odds, np.int16)
    return tables


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the table of their word counts (word, c)."""
    bounded_batches(docs.sparkSession)
    words = word_counts(docs)
    total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                      F.max(F.when(F.col("word") == F.lit(_END), F.col("c"))).alias("ends")).first()
    below = _frequent(words)
    top = words.where((F.floor(F.log2("c") * 32) >= below) & (F.substring("word", 1, 1) != F.lit(_END)))  # words of _LONG bytes at most
    got = top.orderBy(F.desc("c"), "word").toArrow()
    vocabulary = got.column("word").to_pylist()
    counts = np.append(got.column("c").to_numpy(), total.ends or 0).astype(float)
    tokens = int(total.n or 0)
    spelled = np.append(np.maximum(1, counts), max(1, tokens - counts.sum()))
    codes = [huffman(spelled), huffman(_byte_counts(words, below))]
    nodes = len(spelled) - 1  # of the word tree
    steps = np.concatenate([codes[0][2], codes[1][2] + 2 * nodes])
    odds = np.concatenate([codes[0][3], codes[1][3]])
    model = [vocabulary, counts, tokens, int(total.v or 0),
             np.concatenate([codes[0][0], codes[1][0] + len(codes[0][2])]), np.concatenate([codes[0][1], codes[1][1]]),
             steps, _log_odds(odds[:, 0], odds[:, 1]), []]
    held = docs.sparkSession.sparkContext.broadcast(model)
    model[-1] = _context_counts(docs, held)
    held.unpersist()
    return Model(*model), words


# --- scoring ----------------------------------------------------------------


def _first_weights() -> np.ndarray:
    """Shares of the three predictors by gate: the more often a context was seen, the larger."""
    seen = np.arange(_GATES)
    raw = np.stack([np.ones(_GATES), np.array([0, .4, 1, 2.5])[seen & 3], np.array([0, .6, 1.5, 3])[seen >> 2 & 3]])
    return (raw / raw.sum(axis=0)).astype(np.float32)


class Mixer:
    """Online state of some texts: weights, corrections, and the bits so far (in nats)."""

    def __init__(self, model: Model, texts: int):
        self.model, self.cost = model, np.zeros(texts)
        self.weights = np.tile(_first_weights(), texts)
        self.pace = np.full(self.weights.shape, 1e-2)
        self.fix = np.zeros(texts * _MAP, np.float32)
        self.fix_pace = np.full(texts * _MAP, 1.0)

    def step(self, symbols: np.ndarray, text: np.ndarray, contexts: list[np.ndarray]) -> None:
        """Code some symbols of the first texts, then learn from them."""
        model, live = self.model, int(text[-1]) + 1
        node, bit, n = model.bits(symbols)
        hashed = node.astype(np.uint32) * np.uint32(0x27D4EB2F)
        scale = np.float32(1 / 64)  # the two bits of how often a context was seen are below a sixteenth
        owner = np.repeat(text.astype(np.int64), n)
        inputs, gate = [model.plain.take(node).astype(np.float32) * scale], owner * _GATES
        gate += (node > model.end) * np.int8(16)
        for k, (context, table) in enumerate(zip(contexts, model.tables, strict=True)):
            found = table.take(_slots(np.repeat(context, n), hashed).astype(np.int64))
            inputs.append(found.astype(np.float32) * scale)
            gate += (found & np.int16(3)) << np.int16(2 * k)
        odds = self.weights[0].take(gate) * inputs[0]
        for w, x in zip(self.weights[1:], inputs[1:], strict=True):
            odds += w.take(gate) * x
        place = (np.clip(odds, -7.9, 7.9) * np.float32(_MAP / 16) + np.float32(_MAP / 2)).astype(np.int64)
        place += owner * _MAP
        odds += self.fix.take(place)
        np.clip(odds, -12, 12, out=odds)
        sign = (1 - 2 * bit).astype(np.float32)
        right = 1 / (1 + np.exp(odds * sign))  # the probability of the bit
        last = np.flatnonzero(np.diff(text, append=live))  # a text's symbols are neighbours
        bounds = np.concatenate(([0], np.cumsum(n)[last[:-1]]))
        self.cost[text[last]] -= np.add.reduceat(np.log(right), bounds, dtype=np.float64)
        error = sign * (right - 1)
        for w, pace, x in zip(self.weights, self.pace, inputs, strict=True):
            self._learn(w[:live * _GATES], pace[:live * _GATES], np.bincount(gate, error * x, live * _GATES))
        self._learn(self.fix[:live * _MAP], self.fix_pace[:live * _MAP], np.bincount(place, error, live * _MAP))

    @staticmethod
    def _learn(values, pace, gradient):
        pace += gradient * gradient
        values += (_RATE * gradient / np.sqrt(pace)).astype(np.float32)


def _code(mixer: Mixer, symbols: np.ndarray, lengths: np.ndarray, last: tuple[int, int] | None = None) -> tuple[int, int]:
    """Code texts (of falling lengths) side by side, ``GROUP`` symbols of each at a step."""
    model = mixer.model
    firsts = np.cumsum(lengths) - lengths
    one, two = _previous(symbols, firsts[lengths > 0], model.begin, last)
    place = np.arange(len(symbols)) - np.repeat(firsts, lengths)
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    step = place // GROUP
    order = np.argsort(step, kind="stable")
    bounds = np.searchsorted(step[order], np.arange(int(step.max(initial=-1)) + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = order[a:b]
        mixer.step(symbols[part], text[part], _contexts(one[part], two[part]))
    return int(symbols[-1]), int(symbols[-2]) if len(symbols) > 1 else int(one[-1])


def score_texts(texts: list, model: Model):
    """Per text: tokens, known tokens, base (log10) and bits, and a Counter of its words' keys outside the vocabulary."""
    size = len(texts)
    tokens, known = np.zeros(size, np.int64), np.zeros(size, np.int64)
    base, bits, rest = np.zeros(size), np.zeros(size), [Counter() for _ in texts]
    share = np.log10((model.counts + 1) / (model.tokens + model.distinct + 1))
    mixer, last = None, None
    for rows, lists, fresh, done in _gather(texts, model):
        words = [w for x in lists for w in x]
        ids = model.lookup(words)
        count = np.array([len(x) for x in lists])
        owner = np.repeat(np.array(rows), count)
        tokens += np.bincount(owner, minlength=size)
        inside = ids >= 0
        known += np.bincount(owner[inside], weights=model.counts[ids[inside]] > 0, minlength=size).astype(np.int64)
        base += np.bincount(owner[inside], weights=share[ids[inside]], minlength=size)
        for i in np.flatnonzero(~inside):
            rest[owner[i]][key(words[i])] += 1
        symbols, took = model.symbols(words, ids)
        lengths = np.bincount(np.repeat(np.arange(len(rows)), count), weights=took, minlength=len(rows)).astype(np.int64)
        if not (fresh and done):  # pieces of one long text
            if fresh:
                mixer, last = Mixer(model, 1), (model.begin, model.begin)
            for at in range(0, len(symbols), 1 << 16):
                part = symbols[at:at + (1 << 16)]
                last = _code(mixer, part, np.array([len(part)]), last)
            if done:
                bits[rows[0]] = mixer.cost[0] / np.log(2)
            continue
        order = np.argsort(-lengths, kind="stable")  # the texts still running at a step are the first ones
        firsts = np.cumsum(lengths) - lengths
        falling = lengths[order]
        at = np.repeat(firsts[order] - (np.cumsum(falling) - falling), falling) + np.arange(len(symbols))
        mixer = Mixer(model, len(rows))
        _code(mixer, symbols[at], falling)
        bits[np.array(rows)[order]] = mixer.cost / np.log(2)
    return tokens, known, base, bits, rest


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, bits, bits_per_byte for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast([
        model.words, model.counts, model.tokens, model.distinct, model.start, model.length, model.steps, model.plain, model.tables])
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.struct([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        m = Model(*held.value)
        for part, texts in _rows(batches, 1):
            tokens, known, base, bits, rest = score_texts(texts, m)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(tokens), pa.array(known), pa.array(base), pa.array(bits),
                 pa.array([len(t or b"") for t in texts], pa.int64()),
                 pa.array([[{"word": w, "n": n} for w, n in x.items()] for x in rest], pa.list_(item))],
                names=["doc_id", "n_tokens", "known", "base", "bits", "n_bytes", "rest"])

    scored = docs.select("doc_id", binary(F.col("text"))).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, known long, base double, bits double, n_bytes long, rest array<struct<word:binary,n:bigint>>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "mixing-scores")
    space = float(model.tokens + model.distinct + 1)
    few = scored.select("row", F.inline("rest")).join(words, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(space))).alias("more_base"))
    return scored.drop("rest").join(few, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("bits") * F.lit(-float(np.log10(2)))).alias("score"), "bits",
        F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def report(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from the rows outside fold ``held`` and score all rows."""
    fold = remainder(F.col("doc_id"), folds)
    model, words = train(docs.where(fold != held))
    return score(docs, model, words).select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits", "bits_per_byte")
