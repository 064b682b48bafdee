"""Quality rules: per-document base rules and cross-document line frequency.

Line frequency: lines (split at \\n) are normalised (A-Z lower-cased, white
space runs one space) and hashed; the distinct documents of each host that
hold a line are counted, as are the host's documents.  Documents with the same
text count once, so copies don't make their own lines look like boilerplate.
A line is above the limits of a host if it is in at least ``min_docs`` of its
documents, and also in at least ``min_share`` of them, or, whatever the host's size, in at least
``many`` different settings (``long_many`` for lines of ``long_words`` words or more, which
don't repeat by chance) that are ``own_share`` of its documents or more.
Settings are counted by the first and by the last, in the order of MD5, of a document's other
lines, and the smaller number counts: of near copies, which share a line
besides, those where that line is first and those where it is last both count once, so at most
about half of them count, while a line that stands in otherwise different documents has one
setting a document.  Such lines are removed from every document of the host.  A document whose removed lines hold more than
``max_removed`` of its words is depleted and rejected.

The first pass counts with partial sums over hashes, so a hot line or host is
summed up before it meets; settings are counted for lines of ``min_docs`` documents only.  The lines above the limits are broadcast while their
counted number is at most ``broadcast_lines``; beyond it the documents' lines are
joined with them and each document gets its own ones.  The second pass cleans each document in place.

Cases: a null text has no words (base_failed) and stays null; an empty one
likewise; a null host is a host of its own; repeated rows are one document in
the counts and each gets its result; lines without a word are never counted or
removed; counts at a limit are above it; an empty table gives no rows; very long
texts are counted whole; clashing extra columns are ignored (``clean`` carries
them along).
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binary, cut, flat_rows, free_name, per_row

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACE = b"\t\n\x0b\x0c\r "

MIN_DOCS, MIN_SHARE, MAX_REMOVED = 10, 0.05, 0.5
MANY, LONG_WORDS, LONG_MANY, OWN_SHARE = 25, 20, 10, 0.6

_LONG = 50_000  # words from which windows are numbers, not tuples


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of the normalised line; None if it has no word."""
    words = line.lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    letters = text.translate(None, SPACE)
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return (len(words), len(letters.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), _repeated(words))


def _repeated(words: list[bytes], size: int = 5) -> int:
    """Words inside a window of ``size`` words that occurs twice or more."""
    if len(words) > _LONG:
        windows = _numbered(words, size)
        _, of, times = np.unique(windows, return_inverse=True, return_counts=True)
        hit = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(times[of] > 1)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
        return int((hit.cumsum() > 0).sum())
    windows = list(zip(*[words[i:] for i in range(size)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    n = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + size - max(i, end)
            end = i + size
    return n


def _numbered(words: list[bytes], size: int) -> np.ndarray:
    """A number for each window, equal for equal windows only."""
    ids: dict = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code = one
    for i in range(1, size):
        code = code[:-1] * len(ids) + one[i:]
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    return code


def _host(host: str) -> Column:
    """The host as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit(""))


def _doc() -> Column:
    """A number of the text, equal for equal texts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _lines(long_words: int):
    """A document's lines (hash, hashes of the first and last other line, whether it is long), and one row for itself."""
    def make():
        def f(text):
            found: dict = {}
            for line in text.split(b"\n") if text else ():
                words = line.lower().split()
                if words:
                    line = b" ".join(words)
                    h = xxhash.xxh3_64_intdigest(line) - (1 << 63)
                    if h not in found:
                        found[h] = hashlib.md5(line, usedforsecurity=False).digest(), len(words) >= long_words
            order = sorted(found, key=lambda h: found[h][0])
            ends = [*order[:2], None, None], [*order[:-3:-1], None, None]
            return [(None, None, None, None), *((h, *(e[1] if e[0] == h else e[0] for e in ends), found[h][1]) for h in order)]
        return f
    return make


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE,
                   many: int = MANY, long_words: int = LONG_WORDS, long_many: int = LONG_MANY,
                   own_share: float = OWN_SHARE) -> DataFrame:
    """host (as ``_host``), line (hash), n_docs, n_settings, host_docs of the lines above the limits."""
    rows = flat_rows(docs, [("host", _host(host)), ("doc", _doc())], [binary(F.col("text"))],
                     "line long, lo long, hi long, long boolean", _lines(long_words))
    rows = cut(rows.groupBy("host", "line", "doc").agg(*[F.min(c).alias(c) for c in ("lo", "hi", "long")]), "host-lines")
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.max("long").alias("long"))
    hosts = counts.where("line is null").select("host", F.col("n_docs").alias("host_docs"))
    some = cut(counts.where((F.col("n_docs") >= min_docs) & F.col("line").isNotNull()).join(hosts, "host"), "host-counts")
    ends = rows.join(some.select("host", "line"), ["host", "line"]).select(
        "host", "line", F.inline(F.array(*[F.struct(F.lit(i).alias("end"), F.coalesce(c, F.lit(0)).alias("other"))
                                           for i, c in enumerate(("lo", "hi"))]))).distinct()
    settings = ends.groupBy("host", "line", "end").agg(F.count("*").alias("n")).groupBy("host", "line").agg(F.min("n").alias("n_settings"))
    enough = (F.col("n_settings") >= F.when(F.col("long"), long_many).otherwise(many)) & (
        F.col("n_settings") >= F.col("n_docs") * F.lit(own_share))
    return some.join(settings, ["host", "line"]).where((F.col("n_docs") >= F.col("host_docs") * F.lit(min_share)) | enough).select(
        "host", "line", "n_docs", "n_settings", "host_docs")


def judge(docs: DataFrame, host: str = "source", max_removed: float = MAX_REMOVED, broadcast_lines: int = 200_000,
          with_text: bool = False, out: str = "rules", **limits) -> DataFrame:
    """The rows of ``docs`` (all columns but ``out``) and ``out``: the base counts, the
    removed lines and words, base_failed, kept, and with ``with_text`` the cleaned text."""
    bad = cut(frequent_lines(docs, host, **limits).select("host", "line"), "frequent-lines")
    names = [c for c in docs.columns if c != out]
    of_host: dict = {}
    rows, own = docs, F.lit(None).cast("array<bigint>")
    if bad.count() <= broadcast_lines:
        for r in bad.toLocalIterator():
            of_host.setdefault(r.host, set()).add(r.line)
    else:
        found = flat_rows(docs, [("host", _host(host)), ("doc", _doc())], [binary(F.col("text"))],
                          "line long, lo long, hi long, long boolean", _lines(1)).where("line is not null").select("host", "doc", "line")
        h, d, b = (free_name(docs, x) for x in ("host", "doc", "bad"))
        found = found.distinct().join(bad, ["host", "line"]).groupBy(F.col("host").alias(h), F.col("doc").alias(d)).agg(
            F.collect_list("line").alias(b))  # a document's own lines
        rows, own = docs.withColumn(h, _host(host)).withColumn(d, _doc()).join(found, [h, d], "left"), F.col(b)
    held = docs.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in of_host.items()})

    def make():
        of = held.value

        def f(text, host, mine):
            n, chars, symbols, dup_lines, repeats = base_counts(text)
            failed = n < 10 or 100 * repeats > 20 * n
            lines = words = 0
            clean = text
            bad = of.get(host) or set(mine or ())
            if bad and text:
                rest = []
                for line in text.split(b"\n"):
                    if line_hash(line) in bad:
                        lines, words = lines + 1, words + len(line.split())
                    else:
                        rest.append(line)
                clean = b"\n".join(rest) if lines else text
            kept = not failed and words <= max_removed * n
            made = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
                    "n_repeat_words": repeats, "n_removed_lines": lines, "n_removed_words": words,
                    "base_failed": failed, "kept": kept}
            if with_text:
                made["text"] = clean.decode("utf-8", "replace") if clean is not None else None
            return made,
        return f

    fields = ("n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
              "n_removed_lines: bigint, n_removed_words: bigint, base_failed: boolean, kept: boolean"
              + (", text: string" if with_text else ""))
    return per_row(rows, [(c, F.col(f"`{c}`")) for c in names], [binary(F.col("text")), _host(host), own],
                   f"`{out}` struct<{fields}>", make)


def report(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    return judge(docs.select("doc_id", "text", host), host, **options).select("doc_id", "rules.*")


def clean(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """The kept documents, without the lines above the limits; ``n_chars``, if there, follows the text."""
    out = free_name(docs, "rules")
    found = judge(docs, host, with_text=True, out=out, **options).where(f"`{out}`.kept")
    changed = F.col(f"{out}.n_removed_lines") > 0
    cols = {"text": F.col(f"{out}.text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length(f"{out}.text").cast("long")).otherwise(
            F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns])


def oracle(min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_removed: float = MAX_REMOVED,
           table: str = "documents", many: int = MANY, long_words: int = LONG_WORDS, long_many: int = LONG_MANY,
           own_share: float = OWN_SHARE) -> str:
    """DuckDB SQL for ``report`` over a view with unique doc_id."""
    word = r"[^\x20\x09-\x0D]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source AS host FROM {table}),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words, string_split(text, chr(10)) AS raw FROM docs),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) AS gram,
    unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
reps AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r CROSS JOIN range(5) AS t(o) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(raw) AS line FROM w),
n AS (SELECT *, regexp_extract_all(line, '{word}') AS ws FROM l),
m AS (SELECT *, translate(array_to_string(ws, ' '), '{upper}', '{lower}') AS norm FROM n WHERE len(ws) > 0),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM docs GROUP BY host),
u AS (SELECT DISTINCT doc_id, host, text, norm, len(ws) >= {long_words} AS long, md5(norm) AS h FROM m),
v AS (SELECT *, min(h) OVER d AS lo, max(h) OVER d AS hi, nth_value(h, 2) OVER (d ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING
    AND UNBOUNDED FOLLOWING) AS lo2, nth_value(h, 2) OVER (d ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi2
    FROM u WINDOW d AS (PARTITION BY doc_id)),
bad AS (SELECT v.host, norm FROM v JOIN hosts g ON v.host IS NOT DISTINCT FROM g.host GROUP BY v.host, norm, g.docs, long
    HAVING count(DISTINCT text) >= {min_docs} AND (count(DISTINCT text) >= g.docs * CAST({min_share} AS DOUBLE)
        OR (least(count(DISTINCT coalesce(CASE WHEN h = lo THEN lo2 ELSE lo END, '')), count(DISTINCT coalesce(CASE WHEN h = hi THEN hi2
            ELSE hi END, ''))) >= greatest(CASE WHEN long THEN {long_many} ELSE {many} END, count(DISTINCT text) * CAST({own_share} AS DOUBLE))))),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(bad.norm) AS gone,
    coalesce(sum(len(ws)) FILTER (bad.norm IS NOT NULL), 0) AS gone_words
    FROM m LEFT JOIN bad ON m.host IS NOT DISTINCT FROM bad.host AND m.norm = bad.norm GROUP BY doc_id),
o AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(reps.n, 0) AS n_repeat_words, coalesce(gone, 0) AS n_removed_lines,
    CAST(coalesce(gone_words, 0) AS BIGINT) AS n_removed_words
    FROM w LEFT JOIN reps USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words <= {max_removed} * n_words AS kept
FROM o"""
