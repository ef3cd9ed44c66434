"""Numbering without a single task, and lineage cut into the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(df: DataFrame, bucket: Column, order: list[str], out: str) -> DataFrame:
    """Adds out: the rows' numbers from 0 in the order (bucket, order). bucket must rise with order; rows are only sorted within a bucket, and buckets are counted first."""
    d = df.withColumn("_bucket", bucket)
    counts = d.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    base = counts.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_rows").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return d.withColumn("_inside", inside).join(base, F.col("_bucket").eqNullSafe(F.col("_b"))).withColumn(out, (F.col("_base") + F.col("_inside") - 1).cast("int")).select(*df.columns, out)


def by_id(column: str, width: int = 65_536) -> Column:
    """Buckets of whole-number ids."""
    return F.floor(F.col(column) / width)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the folder that the cluster names for checkpoints: lineage ends there, and so do the size estimates of the plan, which a checkpoint would carry on. Only a local session without such a folder gets one of its own."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of nodes (node): root is the smallest node reachable by edges (a, b), which may name other nodes too.

    Each round takes the least label of the neighbours and then the label of that label, so labels travel further each round; it ends only when no label moves.
    """
    e = cut(edges.unionAll(edges.select("b", "a")).where("a <> b").distinct())
    label = nodes.select("node", F.col("node").alias("root"))
    while True:
        near = e.join(label, e.b == label.node).groupBy("a").agg(F.min("root").alias("low"))
        hooked = label.join(near, label.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("root"))
        over = hooked.select(F.col("node").alias("via"), F.col("root").alias("far"))
        moved = cut(hooked.join(over, F.col("root") == F.col("via"), "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        label = moved.select("node", "root")
        if moved.where("root < old").isEmpty():
            return label
