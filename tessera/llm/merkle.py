"""Merkle manifest of a dataset by lag/lead windows, in built-in functions only.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its UTF-8 byte
count, a colon and the value.  The leaves of a group ascend by the order column;
every ``WIDTH`` consecutive nodes (the last run: fewer, even one) become the hash
of their hex texts, until one node is left, the group's subroot.  The subroots,
ordered by group (null first, UTF-8 bytewise), give the root in the same way.

Positions come from one range shuffle of slim rows (ids and digests): rows are
sorted inside their range and numbered there, and a table of one row per
(range, group) holds where each range starts.  The tree is climbed ``LEVELS``
levels a round.  A round's rows are dealt by (group, block of WIDTH ** LEVELS
nodes), so a group of any size is split evenly; inside a block a level is one
window whose fixed-offset ``lag`` and ``lead`` columns, masked by slot and run
length, are the siblings, and the first child's row hashes the parent.  All
levels of a round share the round's one shuffle.  The blocks' top nodes are the
rows of the next round, a ``WIDTH ** LEVELS``-th of them.  A row's proof is its
siblings inside the block, then its top node's proof, joined by (group, block);
the root's part of the proof enters at a group's single last row, so no join has
a hot key.

Cases: null groups are a group, ordered first; null order values come first in
their group and count as not tampered; ties in the order column are ordered by
leaf, and equal rows have equal leaves, so their order doesn't matter; a group
of one row has its leaf as subroot; a table of one group has its subroot as
root; an empty proof hashes the empty text; an empty table gives no rows; empty
and very long texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

WIDTH = 8
#: Levels climbed a round; a task's window holds WIDTH ** LEVELS slim rows.
LEVELS = 4


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return sha(*[field(c) for c in fields])


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``at`` (position in the group, from 0) and ``n`` (rows of the group).

    ``group`` must not be null.  The rows are written once, in ranges.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    # a row's number is its task's number and its place there; a task's rows of a group are neighbours
    ranged = cut(ranged.withColumn("_no", F.monotonically_increasing_id())
                 .withColumn("_range", F.spark_partition_id()), name)
    parts = ranged.groupBy("_range", group).agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(group)
    before = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_range", group, F.sum("_rows").over(w).alias("n"),
                          (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (ranged.join(starts, ["_range", group]).withColumn("at", F.col("_no") + F.col("_shift"))
            .drop("_range", "_no", "_shift"))


def _climb(nodes: DataFrame) -> DataFrame:
    """One round over (g, at, n, digest, ...): adds block, top (on a block's first row) and
    path, the siblings of the levels inside the block as (l, r) pairs of joined hex texts."""
    size = WIDTH ** LEVELS
    rows = nodes.withColumn("block", F.expr(f"at div {size}")).withColumn("_node0", F.col("digest"))
    for level in range(LEVELS):
        stride = WIDTH ** level
        first, node = F.expr(f"at % {stride} = 0"), F.col(f"_node{level}")
        w = Window.partitionBy("g", "block", F.expr(f"at % {stride} = 0")).orderBy("at")
        slot, count = F.expr(f"(at div {stride}) % {WIDTH}"), F.expr(f"(n + {stride - 1}) div {stride}")
        run = F.expr(f"least({WIDTH}, (n + {stride - 1}) div {stride} - (at div {stride} - (at div {stride}) % {WIDTH}))")
        left = F.concat_ws("", *[F.when(slot >= j, F.lag(node, j).over(w)) for j in range(WIDTH - 1, 0, -1)])
        right = F.concat_ws("", *[F.when(slot + j < run, F.lead(node, j).over(w)) for j in range(1, WIDTH)])
        rows = rows.select("*", F.when(first & (count > 1), F.struct(left.alias("l"), right.alias("r"))).alias(f"_step{level}"))
        rows = rows.withColumn(f"_node{level + 1}", F.when(first & (slot == 0), F.when(
            count > 1, sha(node, F.col(f"_step{level}.r"))).otherwise(node)))
    # a node's step stands on its first leaf's row: carry it to the rows below that node
    down = Window.partitionBy("g", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    steps = [F.col("_step0")] + [F.last(f"_step{k}", ignorenulls=True).over(down) for k in range(1, LEVELS)]
    drop = [f"_step{k}" for k in range(LEVELS)] + [f"_node{k}" for k in range(LEVELS + 1)]
    return rows.withColumn("path", F.array_compact(F.array(*steps))).withColumn("top", F.col(f"_node{LEVELS}")).drop(*drop)


def _fold_path(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]).cast("binary"), 256))


def _trees(nodes: DataFrame, ends) -> DataFrame:
    """``nodes`` (g, at, n, digest, ...) with block and path up to what ``ends`` gives.

    ``ends(last)`` takes one row per g (g, digest: the subroot) and returns (g, tail, ...): the
    proof from there on and columns to carry down.
    """
    size = WIDTH ** LEVELS
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number
    rounds = [nodes]
    while most > 1:
        up = _climb(rounds[-1]).where(F.col("top").isNotNull() & (F.col("at") % size == 0))
        rounds.append(cut(up.select("g", F.col("block").alias("at"), F.expr(f"(n + {size - 1}) div {size}").alias("n"),
                                    F.col("top").alias("digest")), "merkle-round"))
        most = -(-most // size)
    tails = ends(rounds[-1])
    if len(rounds) == 1:
        return nodes.join(tails, "g").withColumnRenamed("tail", "path")
    tails = tails.withColumn("at", F.lit(0).cast("long"))
    for rows in reversed(rounds[:-1]):
        upper = tails.withColumnRenamed("at", "block")
        tails = _climb(rows).drop("top").join(upper, ["g", "block"]).withColumn("path", F.concat("path", "tail")).drop(
            "tail", "block")
        if rows is not nodes:
            tails = cut(tails.drop("n", "digest").withColumnRenamed("path", "tail"), "merkle-tails")
    return tails


def proofs(rows: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """``rows`` with subroot, root and proof: (l, r) pairs of joined sibling digests, from the leaf to the root."""
    slim = rows.withColumnRenamed(digest, "digest").withColumn(
        "g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))  # null first, then bytewise
    # written first: the range shuffle samples its input, which would read and hash all texts a second time
    leaves = numbered(cut(slim, "merkle-slim"), "g", [order, "digest"], "merkle-leaves")

    def top_tree(last: DataFrame) -> DataFrame:
        """The groups' subroots as the leaves of one more tree."""
        subs = last.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
        subs = numbered(subs, "g", ["of"], "merkle-subroots")

        def end(top):
            return top.select("g", F.col("digest").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("tail"))
        got = _trees(subs, end)
        return got.select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root", F.col("path").alias("tail"))

    got = _trees(leaves, top_tree)
    return got.withColumnRenamed("path", "proof").withColumnRenamed("digest", digest).drop("g", "at", "n")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return _fold_path(start, proof)


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """order, leaf, subroot, root, proof and the ``carry`` columns, one row per row of ``docs``."""
    rows = docs.select(F.col(order).alias("_order"), F.col(group).alias("_group"), leaf(*[F.col(f) for f in fields]).alias("leaf"),
                       *[c.alias(k) for k, c in (carry or {}).items()])
    return proofs(rows, "_group", "_order", "leaf").withColumnRenamed("_order", order).drop("_group")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def report(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` by lang, and its check against rows that were tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = leaf(*[F.translate(F.col("text"), _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS])
    got = manifest(docs, FIELDS, "lang", "doc_id", {"found": F.when(tampered, other)})
    proof = F.aggregate("proof", F.lit(""), lambda acc, x: F.concat(acc, x["l"], x["r"]))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
                     folded(F.coalesce("found", "leaf"), F.col("proof")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8) -> str:
    """The same rows in SQL, for groups of at most WIDTH ** levels rows."""
    enc = {f: f"coalesce(strlen({c})::varchar || ':' || {c}, '-')" for f, c in
           {f: f"{f}::varchar" for f in FIELDS}.items()}
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    enc_low = enc | {"text": f"coalesce(strlen({lower})::varchar || ':' || {lower}, '-')"}
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), "
           "lambda ch: ascii(ch)::bigint)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))")
    ctes = [f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({' || '.join(enc[f] for f in FIELDS)}) AS leaf,
        CASE WHEN {crc} % 3 = 0 THEN sha256({' || '.join(enc_low[f] for f in FIELDS)}) END AS found FROM documents)""",
            """a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        '' AS proof, coalesce(found, leaf) AS fold FROM d)""",
            "t0 AS (SELECT g, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM a0)"]

    def climb(k: int, a: str, t: str) -> None:
        ctes.append(f"""r{t}{k} AS (SELECT g, pos // {WIDTH} AS pos, any_value(n) AS n, list(digest ORDER BY pos) AS run
            FROM {t}{k} GROUP BY g, pos // {WIDTH})""")
        ctes.append(f"""{t}{k + 1} AS (SELECT g, pos, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest,
            (n + {WIDTH - 1}) // {WIDTH} AS n FROM r{t}{k})""")
        ctes.append(f"""{a}{k + 1} AS (SELECT {a}{k}.* REPLACE ({a}{k}.pos // {WIDTH} AS pos,
            CASE WHEN n > 1 THEN proof || array_to_string(run[:{a}{k}.pos % {WIDTH}], '') || array_to_string(run[{a}{k}.pos % {WIDTH} + 2:], '')
                ELSE proof END AS proof,
            CASE WHEN n > 1 THEN sha256(array_to_string(run[:{a}{k}.pos % {WIDTH}], '') || fold
                || array_to_string(run[{a}{k}.pos % {WIDTH} + 2:], '')) ELSE fold END AS fold)
            FROM {a}{k} JOIN r{t}{k} ON {a}{k}.g = r{t}{k}.g AND {a}{k}.pos // {WIDTH} = r{t}{k}.pos)""")

    for k in range(levels):
        climb(k, "a", "t")
    ctes.append(f"""s AS (SELECT g AS of, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM t{levels})""")
    ctes.append("u0 AS (SELECT '' AS g, pos, subroot AS digest, count(*) OVER () AS n FROM s)")
    ctes.append(f"b0 AS (SELECT '' AS g, s.pos, doc_id, leaf, subroot, proof, fold FROM a{levels} JOIN s ON s.of = a{levels}.g)")
    for k in range(levels):
        climb(k, "b", "u")
    return f"""WITH {', '.join(ctes)}
        SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.digest AS verified
        FROM b{levels} CROSS JOIN u{levels} AS u"""
