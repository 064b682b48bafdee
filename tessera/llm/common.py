"""Helpers shared by the operators: shared-folder tables, row-wise Arrow maps, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handled between two output batches of an Arrow map; bounds a task's memory.
SLICE_ROWS = 256
#: Rows of an input batch, where the session has Spark's default: whole texts make rows large.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, unless the session chose a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a
    cluster the setting must name a folder that all executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _sources(df: DataFrame, keep: Sequence[tuple[str, Column]], inputs: Sequence[Column]) -> DataFrame:
    return df.select(*[c.alias(f"k{i}") for i, (_, c) in enumerate(keep)],
                     *[c.alias(f"i{i}") for i, c in enumerate(inputs)])


def per_row(df: DataFrame, keep: Sequence[tuple[str, Column]], inputs: Sequence[Column], out: str,
            make: Callable[[], Callable]) -> DataFrame:
    """One output row per input row: the ``keep`` columns, then the fields of ``out``.

    ``make()`` runs once a task and returns f(*inputs) -> tuple of the ``out`` values.
    """
    return _mapped(df, keep, inputs, out, make, False)


def flat_rows(df: DataFrame, keep: Sequence[tuple[str, Column]], inputs: Sequence[Column], out: str,
              make: Callable[[], Callable]) -> DataFrame:
    """Any number of output rows per input row; f(*inputs) gives a list of tuples."""
    return _mapped(df, keep, inputs, out, make, True)


def _mapped(df, keep, inputs, out, make, flat):
    bounded_batches(df.sparkSession)
    src = _sources(df, keep, inputs)
    n_keep = len(keep)
    fields = [T.StructField(name, src.schema[i].dataType) for i, (name, _) in enumerate(keep)]
    added = T._parse_datatype_string(out).fields
    schema = T.StructType(fields + [T.StructField(f.name, f.dataType) for f in added])
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches):
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                values = [batch.column(n_keep + i).to_pylist() for i in range(batch.num_columns - n_keep)]
                kept = [batch.column(i) for i in range(n_keep)]
                if flat:
                    took, rows = [], []
                    for i, row in enumerate(zip(*values, strict=True)):
                        made = f(*row)
                        took.extend([i] * len(made))
                        rows.extend(made)
                    at_rows = pa.array(took, pa.int64())
                    kept = [c.take(at_rows) for c in kept]
                else:
                    rows = [f(*row) for row in zip(*values, strict=True)]
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        kept + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return src.mapInArrow(run, schema)


def binary(c: Column) -> Column:
    return c.cast("binary")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node.

    Each pass first contracts the edges inside every task to a spanning forest
    (at most one edge a node), then joins each node with its smallest
    neighbour and moves the larger neighbours there (large-star), then the
    smaller ones (small-star).  Edges live in the shared folder between passes.
    Nodes without an edge don't appear.
    """
    now = cut(_forest(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")), name)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = cut(small, name)
        # a star forest: no root of an edge is itself the larger end of one
        if after.select(F.col("v").alias("u")).join(after, "u", "left_semi").limit(1).count() == 0 \
                and after.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
        now = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _forest(edges: DataFrame) -> DataFrame:
    """Keep, in every task, only edges that join two trees there; (u, v) with u > v."""
    def run(batches):
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
        rows = [(x, r) for x in up if (r := find(x)) != x]
        if rows:
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")
