"""Embedding near-dedup by sorted projection passes.

A pass orders all vectors by the concatenated sign bits of random projections, read as one number, and compares each
in double precision with all others of the same number: a window is a whole stretch of equal keys, however long it
is, so none ends early, at a partition's edge or elsewhere. Long stretches are compared in blocks. Pairs at or above
the threshold are united across passes.

Two vectors at an angle a agree in a sign bit with probability 1 - a / pi, and bits are independent. So bits and
passes follow from the number of distinct vectors, the threshold and the probability with which a pair at the
threshold may be missed; that bound holds for any vectors. Up to STRETCH vectors one pass without bits compares all.
Links are then counted inside each component in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, cut, small

#: MISS bounds the probability that no pass compares a pair at the threshold; stretches have STRETCH vectors at most on average.
THRESHOLD, MISS, STRETCH = 0.9, 1e-6, 1024
#: Vectors of a block in which vectors are compared and links are counted.
BLOCK = 1024


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS, stretch: int = STRETCH) -> tuple[int, int]:
    """(passes, bits) for n distinct vectors."""
    bits = min(62, max(0, ceil(log2(max(n, 1) / stretch))))
    met = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return (1 if met >= 1 else ceil(log(miss) / log1p(-met))), bits


def unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, v): vectors of finite components that aren't all 0, as bytes of doubles."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    d = rows.select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x, np.float64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in v], pa.int32()), pa.array([(x + 0.0).tobytes() for x in v], pa.binary())], names=["vec_id", "dim", "v"])

    return d.mapInArrow(run, "vec_id long, dim int, v binary")


def keyed(vectors: DataFrame, passes: int, bits: int, seed: int = 11) -> DataFrame:
    """(pass, dim, key, vec_id, v) for every pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for f in frames:
            for dim, g in f.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((passes, bits, dim))
                u = unit(unpacked(g["v"]))
                for p in range(passes):
                    key = ((u @ planes[dim][p].T) >= 0) @ weights
                    yield pd.DataFrame({"pass": np.int32(p), "dim": np.int32(dim), "key": key, "vec_id": g["vec_id"].to_numpy(), "v": g["v"].to_numpy()})

    return vectors.mapInPandas(run, "pass int, dim int, key long, vec_id long, v binary")


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with the symmetric matrix hit."""
    out, left = [], hit.any(axis=1)
    while len(starts := np.flatnonzero(left)[:1]):
        left[starts] = False
        front = starts
        while len(front):
            front = np.flatnonzero(hit[front].any(axis=0) & left)
            left[front] = False
            out += [(int(starts[0]), int(i)) for i in front]
    return out


def near(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each block of the rows (pass, dim, key, vec_id, v) of equal pass, dim and key."""
    at = ["pass", "dim", "key"]
    sizes = rows.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*[F.col(c).alias(f"_{c}") for c in at], (F.floor((F.col("n") - 1) / block) + 1).cast("int").alias("blocks"))
    m = rows.join(small(cut(sizes), 400_000), [F.col(c) == F.col(f"_{c}") for c in at]).drop(*[f"_{c}" for c in at])
    m = m.withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("blocks", "other")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        u, ids = unit(unpacked(f["v"])), f["vec_id"].to_numpy()
        hit = u @ u.T >= threshold
        np.fill_diagonal(hit, False)
        return pd.DataFrame([(ids[p], ids[q]) for p, q in forest(hit)], columns=["a", "b"], dtype="int64")

    return m.groupBy(*at, "i", "j").applyInPandas(run, "a long, b long")


def link_counts(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, links): for members (component, rep, weight, v) the summed weights of the other vectors of the component at or above the threshold."""
    sizes = members.groupBy("component").agg((F.floor((F.count("*") - 1) / block) + 1).alias("blocks")).withColumnRenamed("component", "_c")
    m = members.join(small(cut(sizes), 200_000), F.col("component") == F.col("_c")).drop("_c")
    m = m.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    m = m.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("blocks", "other")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        i, j = f["i"].iloc[0], f["j"].iloc[0]
        x, y = f[f["mine"] == i], f[f["mine"] == j]
        out = []
        if len(x) and len(y):
            u, v = unit(unpacked(x["v"])), unit(unpacked(y["v"]))
            hit = (u @ v.T >= threshold).astype(np.int64)
            if i == j:
                np.fill_diagonal(hit, 0)
            out.append(pd.DataFrame({"rep": x["rep"].to_numpy(), "links": hit @ y["weight"].to_numpy()}))
            if i != j:
                out.append(pd.DataFrame({"rep": y["rep"].to_numpy(), "links": hit.T @ x["weight"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})

    return m.groupBy("component", "i", "j").applyInPandas(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Null vectors, empty ones, those of zeros and those with null or non-finite components link with nothing, as do rows without vec_id (null component, kept). Only vectors of one length are compared. Equal vectors are one in the passes and count as links of each other. vec_id names a vector. Extra columns are left out.
    """
    vectors = cut(usable(rows, vec_id, embedding))
    reps = cut(vectors.groupBy("dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    passes, bits = plan(reps.count(), threshold, miss, stretch)
    keys = keyed(reps.select(F.col("rep").alias("vec_id"), "dim", "v"), passes, bits)
    links = cut(near(keys, threshold, block).distinct())
    found = components(links)
    members = found.join(reps, F.col("node") == F.col("rep")).select("component", "rep", "weight", "v")
    counts = link_counts(members, threshold, block)
    classes = reps.join(found, F.col("rep") == F.col("node"), "left").join(counts, "rep", "left").select("dim", "v", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    classes = cut(classes)
    each = vectors.join(classes, ["dim", "v"]).select(F.col("vec_id").alias("_id"), F.col("component").alias("_c"), F.col("links").alias("_n")).groupBy("_id").agg(F.min("_c").alias("_c"), F.max("_n").alias("_n"))
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id")).join(each, F.col("vec_id") == F.col("_id"), "left")
    out = out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
