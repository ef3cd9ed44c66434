"""A corpus pipeline in five stages over the documents table; part of the subpackage gridloom.llm.

Each stage reads what its predecessor wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_frequency, line_templates, minhash, mixing, sentencepiece_model
from gridloom.llm.common import cut, read
from gridloom.llm.queries import MODEL


def with_text(d: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """d with another column as its text, and n_chars counted again where the table has it."""
    d = d.withColumn("text", F.col(text))
    if "n_chars" in columns:
        d = d.withColumn("n_chars", F.length("text").cast(dict(d.dtypes)["n_chars"]))
    return d.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail are left out; lines above their host's limit are removed from the others."""
    return with_text(line_frequency.quality_rules(docs).where("kept"), "clean_text", docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in their first document only."""
    return with_text(line_templates.line_dedup(docs), "clean_text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, of five words to a shingle and a similarity of 0.8: the one with the smallest doc_id; of rows equal in all columns all but one go.

    Rows are told apart by all of their columns, so different texts that share a doc_id are different rows here. Rows without doc_id link with nothing and all stay.
    """
    columns = [F.col(c) for c in docs.columns]
    # The hash passes over nulls, so which columns are null is hashed too.
    keyed = docs.where("doc_id is not null").withColumn("_key", F.xxhash64(*columns, *[c.isNull() for c in columns]))
    groups = minhash.near_duplicates(keyed, "_key").select("doc_id", "component_id").distinct().toDF("_k", "_group")
    ids = keyed.select("_key", F.col("doc_id").alias("_id")).distinct()
    first = ids.join(groups, F.col("_key") == F.col("_k")).groupBy("_group").agg(F.min(F.struct("_id", "_key"))["_key"].alias("_kept")).select("_kept")
    kept = keyed.dropDuplicates(["_key"]).join(first, F.col("_key") == F.col("_kept"))
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the part of a document that is taken once more is a row of its own."""
    mixed = mixing.mixed_documents(docs)
    return with_text(mixed, "text", docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each row, with their checks."""
    return sentencepiece_model.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(MODEL)).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL has no subword tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
