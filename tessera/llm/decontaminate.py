"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A window is ``window`` consecutive words of a benchmark item (all words of a
shorter, non-empty item).  A document contains a window only if it contains
every shingle of it, so joining one necessary prefix shingle per window loses
nothing.  The prefix is the window's rarest shingle by its number of places in
the documents.  A prefix match at document word p, with the shingle at offset o
of the window, fixes the only possible occurrence: it must start at p - o >= 0
(positional bound) and end within the document (length bound); the words there
are then compared exactly.

Both sides are tables, so neither the benchmark nor the documents pass the
driver or meet in one task.  Documents are read once, whatever the benchmark's size: a bitmap of
fixed size (the benchmark's shingle hashes modulo 2 ** ``BITS``) leaves only runs of consecutive
shingles that may be the benchmark's and are as long as its shortest window, and only their words
are written.  Shingle places and prefixes then meet by an equi-join on the shingle hash and
a salt of the place, which splits shingles that are everywhere; items are joined last, by window.
Equal texts (by digest) are looked up once.

Cases: a null or empty text has no words (n_words 0, nothing hit); null and
empty items have no windows; items with equal windows are all reported; repeated
document rows give repeated result rows; a null item_id with windows marks
words as hit, but has no name to report; shingles that are equally rare are
taken in the order of their hash; very long texts are read whole; an empty
table of documents gives no rows, an empty benchmark no hits; other columns are
ignored (``clean`` carries them along).
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import binary, cut, flat_rows, free_name, per_row

#: Bits of the number of places in the bitmap of the benchmark's shingles: 2 ** 25 are 4 MB.
BITS = 25
#: Splits of a shingle's places in the join.
SALTS = 8

#: ASCII bytes that separate words once A-Z are lower-cased; all bytes from 0x80 belong to words.
_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_TO_WORDS = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    return text.translate(_TO_WORDS).lower().split() if text else []


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _hashes(words: list[bytes], known: _WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of ``width`` words, by their first word."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _windows(window: int):
    def make():
        def f(text):
            w = words_of(text)
            return [(b" ".join(x).decode("utf-8", "replace"), len(x))
                    for x in ([w[i:i + window] for i in range(max(1, len(w) - window + 1))] if w else [])]
        return f
    return make


def _window_shingles(shingle: int):
    def make():
        known = _WordHashes()

        def f(window):
            words = window.encode().split(b" ")
            k = min(shingle, len(words))
            return [(int(x), place, k) for place, x in enumerate(_shingles(_hashes(words, known), k))]
        return f
    return make


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """The shingles' places, as 2 ** BITS bits: at most 2 ** (BITS - 6) rows reach the driver."""
    slot = F.col("shingle").bitwiseAND(F.lit((1 << BITS) - 1))
    got = shingles.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shingle & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _runs(held):
    """n_words, and the runs of shingles that may be the benchmark's: (width, first word, words)."""
    def make():
        needs, bits = held.value
        known = _WordHashes()

        def f(text):
            words = words_of(text)
            h, found = _hashes(words, known), []
            for width, need in needs.items():
                slot = _shingles(h, width).view(np.uint64) & np.uint64((1 << BITS) - 1)
                hit = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
                edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if b - a >= need:
                        found.append({"width": width, "first": a, "words": b" ".join(words[a:b + width - 1]).decode("utf-8", "replace")})
            return len(words), found
        return f
    return make


def _places(window: int):
    """Shingles of a run with their place in the document and the words around them."""
    def make():
        known = _WordHashes()

        def f(width, first, text):
            words = text.encode().split(b" ")
            return [(int(x), first + i, min(i, window - 1), b" ".join(words[max(0, i - window + 1):i + window]).decode())
                    for i, x in enumerate(_shingles(_hashes(words, known), width))]
        return f
    return make


def _digest():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3,
             keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(digest, n_words and the ``keep`` columns of every row; digest, n_hit and items (sorted names) of
    the texts that hold a window)."""
    owned = flat_rows(benchmark, [("item", F.col("item_id").cast("string"))], [binary(F.col("text"))],
                      "window string, size int", _windows(window)).distinct()
    owned = cut(owned, "benchmark-windows")
    known = cut(flat_rows(owned.select("window", "size").distinct(), [(c, F.col(c)) for c in ("window", "size")], [binary(F.col("window"))],
                          "shingle long, place int, width int", lambda: lambda w, f=_window_shingles(shingle)(): f(w.decode())),
                "benchmark-shingles")
    needs = {r.width: r.need for r in known.groupBy("width").agg(F.min(F.col("size") - F.col("width") + 1).alias("need")).collect()}
    held = docs.sparkSession.sparkContext.broadcast((needs, _bitmap(known)))
    kept = [(c, F.col(f"`{c}`")) for c in keep or []]
    rows = cut(per_row(docs, [*kept, ("digest", _digest())], [binary(F.col("text"))],
                       "n_words long, runs array<struct<width: int, first: int, words: string>>", _runs(held)), "benchmark-runs")
    runs = rows.where(F.size("runs") > 0).dropDuplicates(["digest"]).select("digest", "n_words", F.inline("runs"))
    places = cut(flat_rows(runs, [(c, F.col(c)) for c in ("digest", "n_words", "width")], [F.col("width"), F.col("first"), F.col("words")],
                           "shingle long, at int, before int, around string", _places(window)), "benchmark-places")
    # the prefix: a window's rarest shingle; a window with a shingle that no document holds is in none
    seen = places.groupBy("shingle", "width").agg(F.count(F.lit(1)).alias("n"))
    prefix = known.join(seen, ["shingle", "width"], "left").groupBy("window", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place", "width")).alias("p")).where("p.n > 0")
    prefix = prefix.select("window", "size", "p.shingle", "p.place", "p.width", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = places.withColumn("salt", F.pmod(F.xxhash64("digest", "at"), F.lit(SALTS)).cast("int")).join(prefix, ["shingle", "width", "salt"])
    start = F.col("at") - F.col("place")
    inside = (F.col("before") >= F.col("place")) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.greatest(F.col("before") - F.col("place"), F.lit(0)) + 1, F.col("size")), " ") == F.col("window")
    hits = cut(met.where(inside & same).select("digest", start.alias("start"), (start + F.col("size")).alias("end"), "window"), "benchmark-hits")
    before = Window.partitionBy("digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = hits.select("digest", "start", "end").distinct().select("digest", F.greatest(new, F.lit(0)).alias("new")).groupBy("digest").agg(
        F.sum("new").alias("n_hit"))
    items = hits.select("digest", "window").distinct().join(owned.select("window", "item"), "window").groupBy("digest").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    # written, so that rows meet it in a join of their own, where copies of one text can be split
    return rows.drop("runs"), cut(n_hit.join(items, "digest"), "benchmark-found")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    rows, found = passages(docs.select("doc_id", "text"), benchmark, keep=["doc_id"], **options)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns."""
    _, found = passages(docs.select("text"), benchmark, **options)
    name = free_name(docs, "digest")
    return docs.withColumn(name, _digest()).join(found.select(F.col("digest").alias(name)), name, "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def brute_force(docs, benchmark, window: int = 10) -> list[tuple]:
    """Plain comparison of every window with every position, for tests on small inputs."""
    out = []
    for doc_id, text in docs:
        w = words_of(text.encode() if text is not None else None)
        hit, items = set(), set()
        for item, t in benchmark:
            v = words_of(t.encode() if t is not None else None)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[i:i + n]:
                        hit.update(range(p, p + n))
                        items.update([] if item is None else [str(item)])
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(items), digest, bool(hit)))
    return out


def oracle(window: int = 10) -> str:
    """DuckDB SQL for ``report`` over the views ``documents`` and ``benchmark`` with unique ids."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}')"
    return rf"""
WITH items AS (SELECT item_id, {words} AS w FROM benchmark),
spans AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 2, 2))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {window - 1}], ' ') AS g, least(len(w), {window}) AS k FROM spans),
sizes AS (SELECT DISTINCT k FROM windows),
docs AS (SELECT doc_id, {words} AS w FROM documents),
grams AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs JOIN sizes ON len(w) >= k),
hits AS (SELECT doc_id, item_id, i, windows.k FROM grams JOIN windows
    ON windows.k = grams.k AND windows.g = array_to_string(w[i:i + grams.k - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
