"""Delta-maintained token counts by source, language and tokenizer version.

A rollup lives in a folder of the shared store.  ``apply`` takes one batch of
changes (insert, revise, delete) and commits

* ``changes/batch=N``: the batch as delivered,
* ``ledger/batch=N``: what the batch made of each (doc_id, version) it touched,
* ``deltas/batch=N``: the signed change of documents and tokens per
  (source, lang, version), which is all that totals are made of,
* ``commits/batch=N``: the marker, written last by Spark's committer.

Only batches with a marker count.  A batch that is delivered again after its
commit changes nothing; one that died before it is written again from the
start, over its own folders.  Totals are the sum of the committed deltas, so
they cost groups x batches, not documents.

Within a batch the change with the largest ``seq`` of a (doc_id, version) wins
(ties: the largest row).  An insert of a known key and a revision of an unknown
one both set the key; a delete of an unknown key does nothing.  Old counts come
from the ledger by a join on the key, so no group is ever gathered.

Cases: null source, lang or version are groups of their own; a null doc_id
can't be addressed: its inserts are added row by row, other changes of it are
ignored; a null n_tokens counts 0; repeated rows of a key are one document; an
empty batch commits nothing but its marker; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera.llm.common import per_row

VOCABULARIES = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken",
                "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}

# Fixed value: the published split pattern of these vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHANGES = "doc_id long, version string, source string, lang string, op string, n_tokens long, seq long"
_LEDGER = (T.StructType().add("doc_id", "long").add("version", "string").add("source", "string").add("lang", "string")
           .add("n_tokens", "long").add("live", "boolean"))
_DELTAS = (T.StructType().add("source", "string").add("lang", "string").add("version", "string")
           .add("n_docs", "long").add("n_tokens", "long"))

_CACHE = 100_000  # words whose counts a task remembers
_RUNS = re.compile(r" (?:\s|\Z)")


def token_counter(ranks: dict[bytes, int]):
    """f(text) -> number of tokens, exact; counts of words in single spaces are remembered."""
    import tiktoken

    encode = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, int] = {}

    def word(w: str) -> int:
        n = known.get(w)
        if n is None:
            n = len(encode(" " + w))
            if len(known) >= _CACHE:
                known.clear()
            known[w] = n
        return n

    def count(text: str | None) -> int:
        if not text:
            return 0
        if _RUNS.search(text):  # a space before white space: pieces reach over it
            return len(encode(text))
        first, *rest = text.split(" ")
        return len(encode(first)) + sum(map(word, rest))

    return count


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, version: str, path: str) -> DataFrame:
    """doc_id, version, source, lang, n_tokens of every row; the vocabulary (under 2 MB) is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def make():
        count = token_counter(held.value)
        return lambda text: (count(text),)

    keep = [("doc_id", F.col("doc_id")), ("version", F.lit(version)), ("source", F.col("source")), ("lang", F.col("lang"))]
    return per_row(docs, keep, [F.col("text")], "n_tokens long", make)


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema) -> DataFrame:
        try:
            # listed by path: committed batches only
            found = [f"{self.path}/{part}/batch={b}" for b in self.committed()]
            rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option(
                "basePath", f"{self.path}/{part}").parquet(*found) if found else None
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = None
        return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")) if rows is None else rows

    def _commits(self) -> DataFrame:
        """(n, batch): the committed batches, numbered in the order of their commits."""
        try:
            return self.spark.read.schema("n long, batch long").parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "n long, batch long")

    def committed(self) -> list[int]:
        """Ids of the committed batches in the order of their commits: a list as long as the batches since the start."""
        return [r.batch for r in self._commits().orderBy("n").collect()]

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over all committed batches, without empty groups."""
        return (self._read("deltas", _DELTAS).groupBy("source", "lang", "version")
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))

    def ledger(self) -> DataFrame:
        """The live (doc_id, version) rows."""
        return self._latest().where("live").drop("live")

    def _latest(self) -> DataFrame:
        # the newest is the one committed last, whatever its batch number: deltas are taken against it
        rows = self._read("ledger", _LEDGER).join(self._commits(), "batch").groupBy("doc_id", "version").agg(
            F.max_by(F.struct("source", "lang", "n_tokens", "live"), "n").alias("s"))
        return rows.select("doc_id", "version", "s.*")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch of ``CHANGES`` on top of all committed ones; False if it was committed before.

        Batches may come in any order of their numbers; one writer commits at a time.
        """
        before = self.committed()
        if batch in before:
            return False
        rows = changes.select("doc_id", "version", "source", "lang", "op",
                              F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "seq")
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")  # counted once, read twice
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/changes/batch={batch}")
        kept = rows.where("doc_id is not null").groupBy("doc_id", "version").agg(
            F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("c")).select("doc_id", "version", "c.*")
        old = self._latest().select(F.col("doc_id").alias("d"), F.col("version").alias("v"),
                                    F.struct("source", "lang", "n_tokens", "live").alias("old"))
        joined = kept.join(old, F.expr("doc_id = d and version <=> v"), "left")
        new = joined.where("op <> 'delete' or old.live").select(
            "doc_id", "version", F.when(F.col("op") == "delete", F.col("old.source")).otherwise(F.col("source")).alias("source"),
            F.when(F.col("op") == "delete", F.col("old.lang")).otherwise(F.col("lang")).alias("lang"),
            F.when(F.col("op") == "delete", 0).otherwise(F.col("n_tokens")).cast("long").alias("n_tokens"),
            (F.col("op") != "delete").alias("live"), "old")
        new.write.mode("overwrite").parquet(f"{self.path}/staged/batch={batch}")
        staged = self.spark.read.schema(new.schema).parquet(f"{self.path}/staged/batch={batch}")
        staged.drop("old").write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        group = lambda at: [F.col(f"{at}source").alias("source"), F.col(f"{at}lang").alias("lang"), "version"]
        one = F.lit(1).cast("long")
        signed = staged.where("live").select(*group(""), one.alias("n_docs"), "n_tokens").unionByName(
            staged.where("old.live").select(*group("old."), (-one).alias("n_docs"), (-F.col("old.n_tokens")).alias("n_tokens"))
        ).unionByName(rows.where("doc_id is null and op = 'insert'").select(*group(""), one.alias("n_docs"), "n_tokens"))
        deltas = signed.groupBy("source", "lang", "version").agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.range(1).select(F.lit(len(before)).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/commits/batch={batch}")
        return True


def as_changes(counts: DataFrame, op: str, seq: int = 0) -> DataFrame:
    return counts.select("doc_id", "version", "source", "lang", F.lit(op).alias("op"), "n_tokens",
                         F.lit(seq).cast("long").alias("seq"))


def history(docs: DataFrame, vocabularies: dict[str, str]) -> list:
    """The life of a corpus as batches (id, function giving its changes).

    Every document is inserted with its count by each tokenizer version, a
    batch each; documents with repeated lines are revised to the count without
    the repeats; documents whose text an earlier document (smaller doc_id) has
    are deleted; at last the revisions are delivered a second time.
    """
    versions = list(vocabularies.items())
    lines = F.split(F.col("text"), "\n")
    repeated = docs.where(F.size(lines) > F.size(F.array_distinct(lines))).withColumn(
        "text", F.array_join(F.array_distinct(lines), "\n"))
    mark = F.sha2(F.col("text").cast("binary"), 256)
    firsts = docs.where("text is not null").groupBy(mark.alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = docs.select("doc_id", "source", "lang", mark.alias("h")).join(firsts.where("n > 1"), "h").where(
        "doc_id > first").select("doc_id", "source", "lang", F.explode(F.array(*[F.lit(v) for v, _ in versions])).alias("version"),
                                 F.lit(0).cast("long").alias("n_tokens"))

    def revisions():
        return reduce(DataFrame.unionByName, [as_changes(count_tokens(repeated, v, path), "revise", 1) for v, path in versions])

    inserts = [(i, lambda v=v, path=path: as_changes(count_tokens(docs, v, path), "insert"))
               for i, (v, path) in enumerate(versions, 1)]
    n = len(versions)
    return [*inserts, (n + 1, revisions), (n + 2, lambda: as_changes(copies, "delete", 2)), (n + 1, revisions)]


def report(docs: DataFrame, path: str, vocabularies: dict[str, str] = VOCABULARIES) -> DataFrame:
    """Totals after all batches of ``history``."""
    rollup = Rollup(docs.sparkSession, path)
    for batch, changes in history(docs, vocabularies):
        rollup.apply(batch, changes())
    return rollup.totals()
