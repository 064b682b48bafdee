"""Line de-duplication by a deletion-neighbourhood join.

Lines (split at \\n) are compared as word sequences after lower-casing A-Z; a
line without a word is blank and never a duplicate.  Two different lines are
near duplicates if one word edit (insert, delete or replace) turns one into the
other and both have at least ``words_per_edit`` words.  A line occurrence stays
if no equal line occurs earlier and the line has no near duplicate that first
occurs earlier; earlier means smaller (doc_id, line number), null ids last.

Method, on distinct lines with their first occurrence:

* Anchors prune lines without a partner.  Two lines one edit apart agree on
  the front or the back half (halves of the shorter one), so a line that shares
  neither half with any line of its length or one less or more has none.
* Every other line emits its variants with one word deleted, as hashed keys.
  Where only one half is shared, the edit is in the other, so only these
  deletions are emitted.  A replaced word gives equal variants at the same
  place; an inserted word gives a variant equal to the shorter line itself.
* All lines of one key (length, place, variant) are one replacement apart, so
  the key's earliest line and its size, a partial aggregate, stand for all
  pairs: a key with a third of all rows is never expanded.
* The earliest candidate of each line is fetched and the edit distance verified.

Cases: null texts have no lines; repeated rows are the same document and share
their fate; ties can't occur but between such rows; very long texts and lines
are taken whole; empty tables give empty results; other columns are ignored
(``clean`` carries them along).
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binary, cut, flat_rows, per_row

WORDS_PER_EDIT = 10

# What a line must emit: replacements or deletions where the front or the back half is shared.
_REPLACE_FRONT, _REPLACE_BACK, _DELETE_FRONT, _DELETE_BACK, _SHORT = 1, 2, 4, 8, 16


def line_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _half(words: list[bytes], length: int, back: bool) -> int:
    """Hash of a half of a line that has, or would have without a word, ``length`` words."""
    h = length // 2
    part = words[len(words) - (length - h):] if back else words[:h]
    return xxhash.xxh3_64_intdigest(b" ".join(part), length << 1 | back) - (1 << 63)


def edits_within_one(a: list, b: list) -> bool:
    """Whether at most one insert, delete or replacement turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _occurrences(docs: DataFrame, words_per_edit: int) -> DataFrame:
    """doc_id, doc (hash of the text), line_no, line (key, null if blank), anchors."""
    def make():
        def f(text):
            out = []
            for i, raw in enumerate(text.lower().split(b"\n") if text is not None else ()):
                w = raw.split()
                n = len(w)
                anchors = [_half(w, m, back) for m in (n, n - 1) for back in (False, True)] \
                    if n >= words_per_edit else None
                out.append((i, line_key(w) if w else None, anchors))
            return out
        return f

    return flat_rows(docs, [("doc_id", F.col("doc_id")), ("doc", F.xxhash64(F.col("text")))],
                     [binary(F.col("text"))], "line_no int, line binary, anchors array<long>", make)


def _first() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "line_no", "doc").alias("first")


def _candidates(lines: DataFrame) -> DataFrame:
    """line, flags: the lines that share a half with another, and what they must emit."""
    keys = lines.where("anchors is not null").select("line", F.posexplode("anchors").alias("kind", "half"))
    sizes = (keys.groupBy("half").agg(F.count_if(F.col("kind") < 2).alias("own"),
                                      F.count_if(F.col("kind") >= 2).alias("longer"))
             .where("own > 1 or own > 0 and longer > 0"))
    front = F.col("kind") % 2 == 1  # the back half is shared, so the edit is in the front
    flags = (F.when(F.col("kind") >= 2, F.when(front, _DELETE_FRONT).otherwise(_DELETE_BACK))
             .otherwise(F.when(F.col("own") > 1, F.when(front, _REPLACE_FRONT).otherwise(_REPLACE_BACK)).otherwise(0)
                        .bitwiseOR(F.when(F.col("longer") > 0, _SHORT).otherwise(0))))
    return keys.join(sizes, "half").groupBy("line").agg(F.bit_or(flags).alias("flags"))


def _texts(docs: DataFrame, wanted: DataFrame, words_per_edit: int) -> DataFrame:
    """line, first, flags, words of the wanted lines, read from the text of their first occurrence."""
    per_doc = wanted.groupBy(F.col("first.doc_id").alias("d"), F.col("first.doc").alias("h")).agg(
        F.collect_list(F.struct("first.line_no", "flags", "line")).alias("lines"))  # lines of one document
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("doc")).join(
        per_doc, F.expr("doc_id <=> d and doc = h"))

    def make():
        def f(text, lines):
            raw, out = text.lower().split(b"\n"), []
            for x in lines:
                w = raw[x["line_no"]].split() if x["line_no"] < len(raw) else []
                if line_key(w) == x["line"]:
                    out.append((x["line_no"], x["line"], x["flags"], b" ".join(w)))
            return out
        return f

    return (flat_rows(rows, [("doc_id", F.col("doc_id")), ("doc", F.col("doc"))], [binary(F.col("text")), F.col("lines")],
                      "line_no int, line binary, flags int, words binary", make)
            .select("line", _first(), "flags", "words").dropDuplicates(["line"]))


def _variants(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, first) for replacements, and (shorter, line, first) for deletions."""
    def places(flags, n, front, back, half, upto):
        low = 0 if flags & front else half
        high = n if flags & back else upto
        return range(low, high)

    def replaced():
        def f(words, flags):
            w = words.split(b" ")
            n, h, at, out = len(w), len(w) // 2, 0, []
            span = places(flags, n, _REPLACE_FRONT, _REPLACE_BACK, h, h)
            for i, x in enumerate(w):
                end = at + len(x)
                if i in span:
                    out.append((xxhash.xxh3_64_intdigest(b"%d %d " % (n, i) + words[:at] + words[end:]) - (1 << 63),))
                at = end + 1
            return out
        return f

    def deleted():
        def f(words, flags):
            w = words.split(b" ")
            h = (len(w) - 1) // 2
            span = places(flags, len(w), _DELETE_FRONT, _DELETE_BACK, h, h + 1)
            return [(k,) for k in {line_key(w[:i] + w[i + 1:]) for i in span}]
        return f

    one = texts.where(F.col("flags").bitwiseAND(_REPLACE_FRONT | _REPLACE_BACK) != 0)
    two = texts.where(F.col("flags").bitwiseAND(_DELETE_FRONT | _DELETE_BACK) != 0)
    inputs = [F.col("words"), F.col("flags")]
    return (flat_rows(one, [("line", F.col("line")), ("first", F.col("first"))], inputs, "key long", replaced),
            flat_rows(two, [("line", F.col("line")), ("first", F.col("first"))], inputs, "shorter binary", deleted))


def near_lines(docs: DataFrame, lines: DataFrame, words_per_edit: int) -> DataFrame:
    """line, n_links (near duplicates), of (first occurrence of the earliest earlier one, or null)."""
    wanted = _candidates(lines).join(lines.select("line", "first"), "line")
    texts = cut(_texts(docs, wanted, words_per_edit), "candidate-lines")
    replaced, deleted = _variants(texts)
    keys = replaced.groupBy("key").agg(F.min(F.struct("first", "line")).alias("best"), F.count("*").alias("n")) \
        .where("n > 1")
    same = replaced.join(keys, "key").select("line", "first", "best", (F.col("n") - 1).alias("n"))
    shorts = texts.where(F.col("flags").bitwiseAND(_SHORT) != 0).select(
        F.col("line").alias("shorter"), F.struct("first", "line").alias("short"))
    pairs = deleted.join(shorts, "shorter").select(F.struct("first", "line").alias("long"), "short")
    both = pairs.select("long.line", "long.first", F.col("short").alias("best")).unionByName(
        pairs.select("short.line", "short.first", F.col("long").alias("best"))).withColumn("n", F.lit(1).cast("long"))
    earlier = F.when(F.col("best.first") < F.col("first"), F.col("best"))
    found = same.unionByName(both).groupBy("line").agg(F.min(earlier).alias("best"), F.sum("n").alias("n_links"))

    def verify():
        return lambda a, b: (edits_within_one(a.split(b" "), b.split(b" ")),)

    own = texts.select("line", F.col("words").alias("a"))
    other = texts.select(F.col("line").alias("best_line"), F.col("words").alias("b"))
    checked = found.where("best is not null").select("line", "best", F.col("best.line").alias("best_line")) \
        .join(own, "line").join(other, "best_line")
    checked = per_row(checked, [("checked", F.col("line")), ("of", F.col("best.first"))], [F.col("a"), F.col("b")],
                      "ok boolean", verify).where("ok").drop("ok")
    return found.select("line", "n_links").join(checked, F.col("line") == F.col("checked"), "left").drop("checked")


def judge(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """One row per line of every document: doc_id, doc, line_no, kind (blank, first, exact, near),
    kept, of_doc_id and of_line_no of the earlier line, n_links (near duplicates among other lines)."""
    seen = cut(_occurrences(docs.select("doc_id", "text"), words_per_edit), "lines")
    lines = cut(seen.where("line is not null").groupBy("line").agg(
        F.min(_first()).alias("first"), F.count("*").alias("n"), F.first("anchors").alias("anchors")), "distinct-lines")
    near = near_lines(docs, lines, words_per_edit)
    known = cut(lines.select("line", "first", "n").join(near, "line", "left").where("n > 1 or n_links is not null").select(
        "line", "first", "of", F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-verdicts")
    # a table of its own, so the join below starts from two shuffles and a hot line can be split
    at = F.struct("doc_id", "line_no", "doc")
    rows = seen.select("doc_id", "doc", "line_no", "line").join(known, "line", "left").withColumn(
        "kind", F.expr("""case when line is null then 'blank' when of is not null then 'near'
            when first is null or doc_id <=> first.doc_id and line_no = first.line_no and doc = first.doc then 'first'
            else 'exact' end"""))
    to = F.when(F.col("kind") == "near", F.col("of")).when(F.col("kind") == "exact", F.col("first"))
    return rows.select("doc_id", "doc", "line_no", "kind", F.col("kind").isin("blank", "first").alias("kept"),
                       to["doc_id"].alias("of_doc_id"), to["line_no"].alias("of_line_no"),
                       F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def report(docs: DataFrame, **options) -> DataFrame:
    return judge(docs, **options).drop("doc")


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the duplicate lines; a document that loses all its words is dropped.
    ``n_chars``, if there, follows the text."""
    gone = judge(docs, **options).where("not kept").groupBy(
        F.col("doc_id").alias("__d"), F.col("doc").alias("__h")).agg(F.collect_set("line_no").alias("__gone"))
    names = docs.columns
    rows = docs.withColumn("__doc", F.xxhash64("text")).join(gone, F.expr("doc_id <=> __d and __doc = __h"), "left")

    def make():
        def f(text, gone):
            if text is None or not gone:
                return text.decode("utf-8", "replace") if text is not None else None, False, False
            drop = set(gone)
            rest = [x for i, x in enumerate(text.split(b"\n")) if i not in drop]
            return b"\n".join(rest).decode("utf-8", "replace"), True, all(not x.split() for x in rest)
        return f

    out = per_row(rows, [(f"c{i}", F.col(f"`{c}`")) for i, c in enumerate(names)], [binary(F.col("text")), F.col("__gone")],
                  "new string, changed boolean, nothing boolean", make).where("not nothing")
    kinds = dict(docs.dtypes)
    cols = []
    for i, c in enumerate(names):
        if c == "text":
            cols.append(F.col("new").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("changed"), F.length("new")).otherwise(F.col(f"c{i}")).cast(kinds[c]).alias(c))
        else:
            cols.append(F.col(f"c{i}").alias(c))
    return out.select(*cols)
