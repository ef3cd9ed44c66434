"""Shared parts of the operators: words, tables cut out of the lineage, checked broadcasts, ranks and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: ASCII white space as a Java or RE2 pattern; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain_lines(text: Column) -> Column:
    """text with tabs, vertical tabs, form feeds and carriage returns as blanks. Looking for them first costs next to nothing; most texts have none."""
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def blanks(text: Column) -> Column:
    """text with every ASCII white-space character as a blank."""
    return F.replace(plain_lines(text), F.lit("\n"), F.lit(" "))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(blanks(F.coalesce(text, F.lit(""))), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bytes of values that a Python worker takes out of an Arrow batch together.
BATCH_BYTES = 1_000_000


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows that hold BATCH_BYTES together, or one row that holds more."""
    at = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and size + n > BATCH_BYTES:
            yield at, i - at
            at, size = i, 0
        size += n
    if len(sizes) > at:
        yield at, len(sizes) - at


def byte_slices(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose values in the columns (text or binary) hold BATCH_BYTES together, or one row that holds more."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns)
    for at, n in slices(sizes):
        yield batch.slice(at, n)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: The tables that the innermost settled() has cut so far; none outside of it.
_made: ContextVar[list | None] = ContextVar("made", default=None)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and later reads see the same rows whatever executors are lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """build() as a table of its own; the tables cut on the way there are deleted, as nothing reads them any more."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        df = build()
    finally:
        _made.reset(token)
    out = cut(df)
    release(*made)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by cut that nothing reads any more: all that was derived from them must have been cut or collected."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows up to which a side that has been cut and counted may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which must be cheap to count (as after cut), marked for broadcast if it has at most max_rows rows; else left to a shuffle join, whose skewed partitions Spark splits."""
    return F.broadcast(df) if df.count() <= max_rows else df


def running(df: DataFrame, keys: list[str], order: list[Column], amount: Column, bucket: Column, out: str) -> DataFrame:
    """Adds out: the sum of amount over the rows of the same keys before this row, in the order (bucket, order).

    bucket must rise with order. Sums by (keys, bucket) are made first and added up within keys; the rows themselves are only sorted within (keys, bucket), so no key needs all of its rows in one task.
    """
    d = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    per = d.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_in"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    joined = d.join(per, on, "inner").withColumn(out, F.col("_base") + F.col("_inside"))
    return joined.select(*df.columns, out)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges, which are pairs of longs; component is the smallest node reachable.

    Each round hooks every root to its smallest neighbour, flattens the chains by pointer jumping, and contracts the edges. Roots shrink at least by half among those that still have edges. Minima are combined before the shuffle, so a node with very many edges is no hot key. Every round is cut into the shared folder.
    """
    spark = edges.sparkSession
    if dict(edges.dtypes)[a] != "bigint":
        raise ValueError("nodes must be longs")
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        if left.isEmpty():
            return labels
        both = left.union(left.select("b", "a"))
        up = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("root"), F.least("a", "low").alias("up")))
        while True:
            nxt = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.root"), "left").select(F.col("x.root").alias("root"), F.coalesce("y.up", "x.up").alias("up"), (F.coalesce("y.up", "x.up") != F.col("x.up")).alias("moved"))
            nxt = cut(nxt)
            up = nxt.select("root", "up")
            if nxt.where("moved").isEmpty():
                break
        labels = cut(labels.join(up, labels.component == up.root, "left").select("node", F.coalesce("up", "component").alias("component")))
        to = lambda side: up.select(F.col("root").alias(f"r{side}"), F.col("up").alias(f"u{side}"))
        left = left.join(to("a"), F.col("a") == F.col("ra"), "left").join(to("b"), F.col("b") == F.col("rb"), "left")
        left = cut(left.select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")).where("a <> b").distinct())
    if left.isEmpty():
        return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds on {spark.sparkContext.applicationId}")
