"""Quality rules: how often a host repeats a line across its documents (DataFrame functions only).

Lines are normalised (runs of white space become one blank, trimmed, lower case) and hashed to 64 bits. For each
host the operator counts in how many distinct documents a line occurs; equal texts are one document here, since
copies are not what makes a line boilerplate. Lines at or above the host's limit are removed, and a document that
loses more than max_lost of its words is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, n_words, plain_lines, small, words

#: A line is frequent on a host if it is in at least so many of its distinct documents, and in at least this share of them.
MIN_DOCS, MIN_SHARE = 20, 0.01
#: Share of its words that a document may lose to frequent lines.
MAX_LOST = 0.5


def normalised_lines(text: Column) -> Column:
    """The lines of a text, one for each that split by \\n gives: lower case, runs of white space as one blank; btrim is left to line_hashes."""
    t = plain_lines(text)
    t = F.when(t.contains("  "), F.regexp_replace(t, " +", " ")).otherwise(t)
    return F.split(F.lower(t), "\n")


def line_hashes(lines: Column) -> Column:
    """Hashes of normalised lines in their order; null for a line without words."""
    return F.transform(lines, lambda x: F.when(F.btrim(x) != "", F.xxhash64(F.btrim(x))))


def with_repeated_words(d: DataFrame, ws: str, out: str) -> DataFrame:
    """Adds out: words that lie in a window of three words found at least twice in the array ws; the first find counts too.

    Windows are hashed to 64 bits and sorted with their places, so the cost is n log n for any text; texts without a repeated window skip the sort. Each step is a column of its own, so that Spark compiles it.
    """
    names = ["_hash", "_twice", "_sorted", "_places"]
    after = lambda a: F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))
    w = F.col(ws)
    windows = F.slice(F.arrays_zip(w, after(w), F.slice(w, 3, F.greatest(F.size(w), F.lit(1)))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    d = d.withColumn("_hash", F.transform(windows, lambda z: F.xxhash64(z)))
    d = d.withColumn("_twice", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), F.col("_hash")).otherwise(F.array().cast("array<bigint>")))
    places = F.when(F.size("_twice") > 0, F.sequence(F.lit(0), F.size("_twice") - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_sorted", F.sort_array(F.arrays_zip(F.col("_twice").alias("x"), places.alias("i"))))
    d = d.withColumn("_sorted", F.col("_sorted").cast("array<struct<x:bigint,i:int>>"))
    pairs = F.filter(F.arrays_zip(F.col("_sorted").alias("a"), after(F.col("_sorted")).alias("b")).cast("array<struct<a:struct<x:bigint,i:int>,b:struct<x:bigint,i:int>>>"), lambda z: z["a"]["x"] == z["b"]["x"])
    d = d.withColumn("_places", pairs)
    d = d.withColumn("_places", F.sort_array(F.array_distinct(F.concat(F.transform("_places", lambda z: z["a"]["i"]), F.transform("_places", lambda z: z["b"]["i"])))))
    gaps = F.arrays_zip(F.col("_places").alias("a"), after(F.col("_places")).alias("b")).cast("array<struct<a:int,b:int>>")
    d = d.withColumn(out, F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, z: acc + F.least(F.lit(3), F.coalesce(z["b"] - z["a"], F.lit(3)))))
    return d.drop(*names)


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line_hash, n_docs) of the lines at or above their host's limit."""
    hashes = F.array_compact(F.array_distinct(line_hashes(normalised_lines(F.col(text)))))
    # Each document adds a null line as well, whose count is the number of the host's documents.
    marks = F.concat(F.array(F.lit(None).cast("long")), hashes)
    pairs = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("doc"), F.explode(marks).alias("line_hash")).distinct()
    counts = cut(pairs.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("line_hash").isNull() | (F.col("n_docs") >= min_docs)))
    hosts = counts.where("line_hash is null").select(F.col("host").alias("_host"), F.col("n_docs").alias("host_docs"))
    lines = counts.where("line_hash is not null").join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    return lines.where(F.col("n_docs") >= F.col("host_docs") * F.lit(min_share)).select("host", "line_hash", "n_docs")


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_lost: float = MAX_LOST) -> DataFrame:
    """docs with base counts, clean_text (frequent lines removed), n_left_words, base_failed and kept.

    A null text has no words and no clean_text; an empty one has no lines. A null host is a host of its own. Repeated rows get equal results. An empty table gives an empty result. Columns of docs of the same names as the added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_left_words", "clean_text", "base_failed", "kept"]
    docs = docs.drop(*[c for c in added if c in docs.columns])
    often = cut(frequent_lines(docs, host, text, min_docs, min_share))
    # At most lines-per-document / min_share of them a host.
    per_host = cut(often.groupBy("host").agg(F.sort_array(F.collect_set("line_hash")).alias("_often")).withColumnRenamed("host", "_host"))
    d = docs.join(small(per_host, 2_000), F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    t = F.coalesce(F.col(text), F.lit(""))
    d = d.withColumn("_words", words(F.col(text)))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
    d = d.withColumn("_lines", F.filter(F.split(plain_lines(t), "\n"), lambda x: F.btrim(x) != ""))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    d = with_repeated_words(d, "_words", "n_repeat_words").drop("_words")
    # Only documents that hold a frequent line are taken apart.
    d = d.withColumn("_hashes", F.when(F.col("_often").isNotNull(), line_hashes(normalised_lines(F.col(text)))))
    d = d.withColumn("_hit", F.coalesce(F.arrays_overlap("_hashes", "_often"), F.lit(False)))
    pairs = F.arrays_zip(F.split(F.col(text), "\n").alias("line"), F.col("_hashes").alias("hash")).cast("array<struct<line:string,hash:bigint>>")
    left = F.filter(pairs, lambda z: ~F.coalesce(F.array_contains(F.col("_often"), z["hash"]), F.lit(False)))
    d = d.withColumn("_left", F.when(F.col("_hit"), left))
    d = d.withColumn("n_lines_removed", F.when(F.col("_hit"), F.size("_hashes") - F.size("_left")).otherwise(0).cast("long"))
    d = d.withColumn("clean_text", F.when(F.col("_hit"), F.array_join(F.transform("_left", lambda z: z["line"]), "\n")).otherwise(F.col(text)))
    d = d.withColumn("n_left_words", F.when(F.col("_hit"), n_words(F.col("clean_text"))).otherwise(F.col("n_words")))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_left_words") >= F.col("n_words") * F.lit(1 - max_lost)))
    # Taken out of a generator, so that a filter on a result isn't pushed below it with a copy of all that it is made of.
    return d.select(*docs.columns, F.inline(F.array(F.struct(*added))))
