"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words and pairs of neighbouring words of the lower-cased text are hashed into buckets. The raw model counts every
document, the target model those labelled good. A document's weight is the sum over its n-grams of
ln p_target - ln p_raw; adding Gumbel noise and keeping the k largest draws k documents without replacement with
probabilities in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, running, small

BUCKETS, SMOOTHING = 1 << 17, 1.0
#: Hashed words kept by a task; beyond it the table is emptied.
KEPT_WORDS = 500_000


class Hasher:
    """Buckets of the n-grams of texts, with the words' hashes kept between calls."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str) -> np.ndarray:
        ws = text.lower().split()
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        try:
            h = np.array([known[w] for w in ws], dtype=np.uint64)
        except KeyError:
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in ws], dtype=np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        pairs ^= pairs >> np.uint64(29)
        both = np.concatenate([h, pairs * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(7)])
        return (both % np.uint64(self.buckets)).astype(np.int64)


def models(docs: DataFrame, text: str, target: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of raw and target n-grams by bucket, over all rows; target names a boolean column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, raw, good = Hasher(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            names = batch.schema.names
            for t, y in zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index(target)).to_pylist(), strict=True):
                if t:
                    one = np.bincount(hashed(t), minlength=buckets)
                    raw += one
                    if y:
                        good += one
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(good)], names=["bucket", "raw", "good"])

    rows = docs.select(text, target).mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    # A row a bucket, however much text there is.
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    return raw, good


def log_ratio(raw: np.ndarray, good: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    p = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * len(c)))
    return p(good) - p(raw)


def scored(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """docs with log_weight; 0 for a null or empty text."""
    schema = docs.drop("log_weight").withColumn("log_weight", F.lit(0.0)).schema
    docs = docs.drop("log_weight")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(len(ratio))
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            w = [float(ratio[hashed(t)].sum()) if t else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.float64())], names=[*batch.schema.names, "log_weight"])

    return docs.mapInArrow(score, schema)


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_share: float | None = None, seed: int = 7) -> DataFrame:
    """doc_id, log_weight, key (with noise), rank (from 0) and kept of every document.

    labels holds doc_id, quality and toxic; good is quality 1 and not toxic. k is keep_share of the rows, rounded; by
    default the share of good rows among the labelled ones. With several labels of a document it is good if one is.
    Noise comes from a hash of doc_id and text, so reruns agree; rows equal in both are tied and ranked in any order.
    A null text weighs 0.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("_good"))
    good = cut(good)
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(small(good, 200_000), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("_good", F.lit(False)).alias("good"))
    raw, target = models(marked, "text", "good")
    share = keep_share if keep_share is not None else (good.agg(F.avg(F.col("_good").cast("double"))).first()[0] or 0.0)
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))), 1, 12), 16, 10).cast("double")
    noise = -F.ln(-F.ln((bits + 0.5) / float(1 << 48)))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("_noise", noise)
    d = cut(scored(d, log_ratio(raw, target)).withColumn("key", F.col("log_weight") + F.col("_noise")).drop("text", "_noise"))
    ends = d.agg(F.min("key"), F.max("key"), F.count("*")).first()
    low, high, n = ends[0] or 0.0, ends[1] or 0.0, ends[2]
    # Buckets of the asinh of the key, in falling order: weights spread over several magnitudes.
    f = lambda x: F.asinh(x)
    width = max((np.arcsinh(high) - np.arcsinh(low)) / 4096, 1e-12)
    d = running(d.withColumn("_all", F.lit(0)), ["_all"], [F.col("key").desc(), F.col("doc_id")], F.lit(1).cast("long"), F.floor((F.lit(float(np.arcsinh(high))) - f(F.col("key"))) / F.lit(float(width))), "rank")
    return d.select("doc_id", "log_weight", "key", "rank", (F.col("rank") < round(share * n)).alias("kept"))
