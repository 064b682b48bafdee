"""SimHash near-duplicate classes with pigeonring candidate filtering.

Fingerprint: words are runs without ASCII white space after lower-casing A-Z;
every ``shingle``-word shingle (the whole sequence if shorter) is hashed with
XXH64, seed 42, and a bit of the fingerprint is 1 if set in more than half of
the hashes.  A text without words has fingerprint zero.

Linking works on distinct fingerprints, so exact copies never meet.  The 64
bits form a ring of ``segments`` m segments.  By the pigeonring principle, two
fingerprints within distance t have a segment from which every chain of l
consecutive segments differs in at most floor(l * t / m) bits.  While that
budget is 0 the chain must be equal: these bits, with the start, are the join
key.  Inside a key the remaining chain budgets are checked, and only pairs that
pass all of them reach the full Hamming check.

A key shared by many fingerprints is never compared all against all: when its
n members have more than ``n * wildcards`` pairs (n - 1 > 2 * wildcards), each
member instead emits its bits outside the key once for every choice of t bits
to ignore.  Members that agree on the rest differ in at most t bits, so a star
on the smallest of them carries all links.  Both ways are exact.

Classes are the connected components of the links.

Cases: null and empty texts have fingerprint zero and are linked like any
other; ties and repeated rows share a class; a null doc_id gets its
fingerprint's class; an empty table gives an empty result; clashing extra
columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binary, components, cut, per_row

_CHUNK = 1 << 14


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of a UTF-8 text as an unsigned number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    h64 = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = words[at:min(n, at + _CHUNK) + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(shingle)], strict=False)) \
            if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([h64(g, 42) for g in grams], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list, shingle: int) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""
    def make():
        return lambda text: (int(np.uint64(fingerprint(text, shingle)).astype(np.int64)),)
    return per_row(docs, keep, [binary(F.col("text"))], "fp long", make)


def _layout(segments: int, distance: int):
    """Segment edges, and the length of the chain whose budget is 0."""
    edges = [64 * i // segments for i in range(segments + 1)]
    zero = max(x for x in range(1, segments + 1) if x * distance // segments == 0)
    return edges, zero


def _masks(segments: int, distance: int):
    """For each start: the mask of every chain of 1..m segments with its budget."""
    edges, zero = _layout(segments, distance)
    seg = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(segments)]
    chains = []
    for s in range(segments):
        mask, row = 0, []
        for length in range(1, segments + 1):
            mask |= seg[(s + length - 1) % segments]
            row.append((mask, length * distance // segments))
        chains.append(row)
    return chains, zero


def link_fingerprints(prints: DataFrame, distance: int, segments: int = 5) -> DataFrame:
    """Edges (a, b) between the distinct longs ``fp`` of ``prints`` that connect every pair
    within ``distance`` bits, directly or through others within that distance."""
    if not 0 < distance < segments:
        raise ValueError("0 < distance < segments is needed for a chain without differences")
    chains, zero = _masks(segments, distance)
    key_masks = [row[zero - 1][0] for row in chains]
    limit = 2 * math.comb(min(64 - m.bit_count() for m in key_masks), distance) + 1
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in key_masks]))
                          .alias("start", "bits"))
    sizes = keyed.groupBy("start", "bits").agg(F.count("*").alias("n")).where("n > 1")
    busy = keyed.join(sizes, ["start", "bits"])
    few = busy.where(F.col("n") <= limit).groupBy("start", "bits").agg(F.collect_list("fp").alias("fps"))
    near = few.select("start", "fps").mapInArrow(_pairs(chains, zero, distance), "a long, b long")
    return near.unionByName(_wildcard_stars(busy.where(F.col("n") > limit), key_masks, distance))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(chains, zero, distance):
    def run(batches):
        for batch in batches:
            starts = batch.column(0).to_pylist()
            a, b = [], []
            for start, fps in zip(starts, batch.column(1).to_pylist(), strict=True):
                n = np.array(fps, np.int64)
                x = n.view(np.uint64)
                for i in range(len(x) - 1):
                    rest, at = x[i + 1:] ^ x[i], np.arange(i + 1, len(x))
                    for mask, budget in chains[start][zero:]:  # chains grow; the last is all 64 bits
                        ok = np.bitwise_count(rest & np.uint64(mask)) <= budget
                        rest, at = rest[ok], at[ok]
                    ok = np.bitwise_count(rest) <= distance
                    a += [int(n[i])] * int(ok.sum())
                    b += n[at[ok]].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _wildcard_stars(crowded: DataFrame, key_masks: list[int], distance: int) -> DataFrame:
    """Stars over the members of crowded keys that agree but for ``distance`` ignored bits."""
    def run(batches):
        choices = {}
        for batch in batches:
            for start, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if start not in choices:
                    bits = [i for i in range(64) if not key_masks[start] >> i & 1]
                    choices[start] = np.array([_signed(~sum(1 << i for i in c) & ((1 << 64) - 1))
                                               for c in combinations(bits, distance)], np.int64)
                k = len(choices[start])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, start, np.int32)), pa.array(np.arange(k, dtype=np.int32)),
                     pa.array(choices[start] & fp), pa.array(np.full(k, fp, np.int64))],
                    names=["start", "choice", "rest", "fp"])

    rows = crowded.select("start", "fp").mapInArrow(run, "start int, choice int, rest long, fp long")
    key = ["start", "choice", "rest"]
    centre = rows.groupBy(*key).agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(centre, key).where("fp <> a").select("a", F.col("fp").alias("b"))


def classes(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = 5) -> DataFrame:
    """doc_id, fp, component (its smallest fp) and component_id (its smallest doc_id) for every row of ``docs``."""
    rows = cut(with_fingerprint(docs, [("doc_id", F.col("doc_id"))], shingle), "simhash")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-prints")
    roots = components(link_fingerprints(nodes, distance, segments), "a", "b", "simhash-links")
    found = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("component"))
    first = found.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(found.join(first, "component").select("fp", "component", "component_id"), "fp")


def report(docs: DataFrame, **options) -> DataFrame:
    found = classes(docs.select("doc_id", "text"), **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, **options) -> DataFrame:
    """One row of each class: that of the smallest doc_id (the smallest fingerprint in the class, if it
    has several), or any one if all its ids are null."""
    found = cut(classes(docs.select("doc_id", "text"), shingle, **options), "simhash-classes")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    kept = docs.join(first, docs.doc_id == F.col("__first"), "left_semi").dropDuplicates(["doc_id"])
    keep = [(c, F.col(f"`{c}`")) for c in docs.columns]

    def rows_of(some):  # with fp; columns c0, c1, ...
        return with_fingerprint(some, [(f"c{i}", c) for i, (_, c) in enumerate(keep)], shingle)

    def named(rows):
        return rows.select(*[F.col(f"c{i}").alias(n) for i, (n, _) in enumerate(keep)])

    several = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("__id")
    if several.limit(1).count():  # an id with texts of its own in two classes
        chosen = found.where("doc_id = component_id").groupBy("component", F.col("doc_id").alias("__c")).agg(
            F.min("fp").alias("fp")).join(several, F.col("__c") == F.col("__id"), "left_semi")
        same = rows_of(docs.join(several, docs.doc_id == F.col("__id"), "left_semi")).withColumnRenamed("fp", "__fp")
        same = same.join(chosen, (F.col(f"c{docs.columns.index('doc_id')}") == F.col("__c")) & (F.col("__fp") == F.col("fp")))
        kept = kept.join(several, kept.doc_id == F.col("__id"), "left_anti").unionByName(
            named(same.dropDuplicates(["component"])))
    nameless = found.where("component_id is null").select("fp", "component").distinct()
    if nameless.limit(1).count() == 0:
        return kept
    others = rows_of(docs.where("doc_id is null")).join(nameless, "fp").dropDuplicates(["component"])
    return kept.unionByName(named(others))
