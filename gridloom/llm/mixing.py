"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

1. Targets: weights share total_share of all sizes; a target stops at max_repeats times its source's size and the
   excess is shared again by weight. This water level is found in closed form over the sources, one row each.
2. Blocks: each source's documents are shuffled by a hash of doc_id and text, laid end to end, and cut into blocks
   of equal size, about a millionth of all words but from 64 to 4096 words (block_words fixes another size).
3. Schedule: slot j has the point frac(j * golden ratio), which falls into one source's part of the cumulative
   weights; slots are ranked within their source and rank r takes block r modulo the number of blocks.
4. A document's taken words are the words that its blocks share with it, times the slots that take the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import cut, n_words, running, small

WEIGHTS, TOTAL_SHARE, MAX_REPEATS = (3.0, 1.0, 2.0), 1.5, 2
#: Bounds of a block's words, and into how many blocks all words go between them.
BLOCK_LOW, BLOCK_HIGH, BLOCKS = 64, 4096, 1 << 20
#: (sqrt(5) - 1) / 2; slots ranked together; pieces of [0, 1) by which points find their source.
GOLDEN, CHUNK, PIECES = 0.6180339887498949, 1 << 14, 1 << 10


def sources(sized: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS, block_words: int | None = None) -> DataFrame:
    """One row a source: source, source_size, weight, target, n_blocks, n_slots, lo and hi (its part of [0, 1)), slots (of all sources)."""
    every = W.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_place", F.row_number().over(every) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    # The level rises until all is shared: sources with a low cap for their weight fill up first.
    fill = W.orderBy(F.col("_cap") / F.col("weight"), "_place")
    below, above = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    whole = F.sum("source_size").over(W.partitionBy(F.lit(0))) * F.lit(total_share)
    s = s.withColumn("_level", (whole - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    s = s.withColumn("_full", F.col("_level") * F.col("weight") >= F.col("_cap"))
    open_level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("weight"), "_place", "_level"))).over(W.partitionBy(F.lit(0)))["_level"]
    s = s.withColumn("target", F.when(F.col("_full") | (F.col("source_size") == 0), F.col("_cap")).otherwise(open_level * F.col("weight")))
    total = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    block = F.lit(block_words) if block_words else F.least(F.lit(BLOCK_HIGH), F.greatest(F.lit(BLOCK_LOW), F.ceil(total / BLOCKS)))
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("_share", F.when(F.col("n_blocks") > 0, F.col("target") / F.col("source_size") * F.col("n_blocks")).otherwise(0.0))
    all_shares = F.sum("_share").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("slots", F.round(all_shares).cast("long"))
    s = s.withColumn("lo", F.coalesce(F.sum("_share").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / all_shares)
    s = s.withColumn("hi", F.sum("_share").over(every.rowsBetween(W.unboundedPreceding, 0)) / all_shares)
    last = F.max(F.when(F.col("_share") > 0, F.col("_place"))).over(W.partitionBy(F.lit(0)))
    s = s.withColumn("hi", F.when(F.col("_place") == last, F.lit(1.0)).otherwise(F.col("hi")))
    s = s.withColumn("n_slots", (F.col("n_blocks") * max_repeats))
    return s.select("source", "source_size", "weight", "target", "n_blocks", "n_slots", "_place", "lo", "hi", "slots")


def schedule(parts: DataFrame, chunk: int = CHUNK, pieces: int = PIECES) -> DataFrame:
    """(slot, place, rank, block): every slot's source and block. A source that has had all its repeats takes no more slots."""
    spark = parts.sparkSession
    slots = parts.agg(F.max("slots")).first()[0] or 0
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot"), F.expr(f"id * {GOLDEN}D - floor(id * {GOLDEN}D)").alias("point"))
    points = points.withColumn("piece", F.floor(F.col("point") * pieces))
    spans = parts.where("hi > lo").select("_place", "n_blocks", "n_slots", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * pieces), F.least(F.floor(F.col("hi") * pieces), F.lit(pieces - 1).cast("long")))).alias("piece"))
    met = points.join(spans, "piece").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    met = met.select("slot", F.col("_place").alias("place"), "n_blocks", "n_slots")
    ranked = running(met, ["place"], [F.col("slot")], F.lit(1).cast("long"), F.floor(F.col("slot") / chunk), "rank")
    return ranked.where("rank < n_slots").select("slot", "place", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))


def placed(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """(place, doc_id, key, size, start): every document's place in its source's shuffled row of words; those of size 0 are left out.

    The order is (key, doc_id); rows equal in both are alike. (place, start) is one row's own.
    """
    at = parts.select(F.col("source").alias("_source"), F.col("_place").alias("place"))
    d = keyed.where("size > 0").join(small(at, 10_000), F.col("source").eqNullSafe(F.col("_source"))).select("place", "doc_id", "key", "size")
    # The first 12 bits of the key, so that buckets rise with it.
    return running(d, ["place"], [F.col("key"), F.col("doc_id")], F.col("size"), F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), "start")


def pieces_of(row: DataFrame, parts: DataFrame) -> DataFrame:
    """(place, start, block, from_word, to_word): each document's part of each block, words counted from 0 in the document.

    Block i of a source covers the words from floor(i * size / n) to floor((i + 1) * size / n).
    """
    of = parts.select(F.col("_place").alias("place"), "n_blocks", "source_size")
    d = row.select("place", "start", "size").join(small(of, 10_000), "place")
    holds = lambda w: F.expr(f"(({w} + 1) * n_blocks - 1) div source_size")
    edge = lambda i: F.expr(f"(({i}) * source_size) div n_blocks")
    d = d.withColumn("block", F.explode(F.sequence(holds("start"), holds("start + size - 1"))))
    a, b = F.greatest("start", edge("block")), F.least(F.col("start") + F.col("size"), edge("block + 1"))
    return d.select("place", "start", "block", (a - F.col("start")).alias("from_word"), (b - F.col("start")).alias("to_word"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS, block_words: int | None = None) -> dict[str, DataFrame]:
    """sources, schedule, rows (doc_id, key, source, size, place, start) and takes (place, start, from_word, to_word, times).

    A null or empty text, or one of white space, has size 0 and is never taken. A null source is a source of its own, after all others. Rows with equal doc_id and text each have their own words in the row. An empty table gives empty results.
    """
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    keyed = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("key")))
    parts = cut(sources(keyed, weights, total_share, max_repeats, block_words))
    plan = schedule(parts)
    row = cut(placed(keyed, parts))
    times = plan.groupBy("place", "block").agg(F.count("*").alias("times"))
    takes = pieces_of(row, parts).join(times, ["place", "block"])
    return {"keyed": keyed, "sources": parts, "schedule": plan, "rows": row, "takes": takes.select("place", "start", "from_word", "to_word", "times")}


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    m = mixture(docs, **options)
    sums = m["takes"].groupBy("place", "start").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    at = m["sources"].select("_place", "source_size", "target", F.col("source").alias("_source"))
    live = m["rows"].join(sums, ["place", "start"], "left").select("place", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    live = live.join(small(at, 10_000), F.col("place") == F.col("_place"))
    idle = m["keyed"].where("size = 0").join(small(at, 10_000), F.col("source").eqNullSafe(F.col("_source"))).withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return live.select(*columns).unionByName(idle.select(*columns))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture as rows of docs: a document's text once for each time that it is taken whole, and once its part for words taken once more than the rest.

    Documents that the mix doesn't take are left out. Other columns are copied.
    """
    m = mixture(docs, doc_id, text, source, **options)
    # Within a document the blocks' times differ by one at most, and change once: the last pass over a source stops in one block.
    per = m["takes"].groupBy("place", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("met"), F.min("times").alias("low"), F.max("times").alias("high"), F.min(F.struct(F.col("times") * -1, "from_word"))["from_word"].alias("a"), F.max(F.struct("times", "to_word"))["to_word"].alias("b"))
    row = m["rows"].join(per, ["place", "start"])
    # Blocks that no slot takes are not met; then the lowest number is 0.
    row = row.withColumn("low", F.when(F.col("met") < F.col("size"), F.lit(0)).otherwise(F.col("low")))
    spans = F.concat(F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("low").cast("int")), F.array_repeat(F.struct("a", "b"), (F.col("high") - F.col("low")).cast("int")))
    at = m["sources"].select("_place", F.col("source").alias("_source"))
    row = row.join(small(at, 10_000), F.col("place") == F.col("_place")).withColumn("_row", row_key(F.col("key"), F.col("doc_id"), F.col("_source")))
    # Rows equal in doc_id, text and source are counted by span; but for the row in which a source's last pass stops all spans are whole, so a list has few.
    spans = row.select("_row", F.explode(spans).alias("span")).groupBy("_row", "span").agg(F.count("*").cast("int").alias("n"))
    spans = spans.groupBy("_row").agg(F.collect_list(F.struct("span", "n")).alias("_spans"))
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    # One key for both, so that the texts are shuffled once.
    d = docs.withColumn("_row", row_key(key, F.col(doc_id), F.col(source))).dropDuplicates(["_row"]).join(spans, "_row")
    d = d.withColumn("_span", F.explode(F.flatten(F.transform("_spans", lambda s: F.array_repeat(s["span"], s["n"])))))
    whole = (F.col("_span.a") == 0) & (F.col("_span.b") == n_words(F.col(text)))
    d = d.withColumn(text, F.when(whole, F.col(text)).otherwise(span_text(F.col(text), F.col("_span.a"), F.col("_span.b"))))
    return d.select(*docs.columns)


def row_key(key: Column, doc_id: Column, source: Column) -> Column:
    """Equal for rows with equal key, doc_id and source, nulls included."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("\n", key, part(doc_id), part(source)))


def span_text(text: Column, a: Column, b: Column) -> Column:
    """The words from a to b (not included) of a text with the white space between them."""
    parts = F.split(F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.rtrim(F.array_join(F.slice(parts, (a + 1).cast("int"), (b - a).cast("int")), ""), F.lit(" \t\n\x0b\x0c\r"))
