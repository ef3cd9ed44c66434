"""Line dedup by a log-template tree (DataFrame functions only).

A line's tokens are its words; a token with a digit is a variable field. The tree has a fixed depth: the root splits
by token count, the levels below by the leading tokens. A leaf's lines share a template in two steps: lines whose
tokens agree but for fields with digits have one exact template; leaves with several exact templates get general
ones: the dominant token at each place, which a line joins if it agrees with it at min_match of the places. The vote is
held over the leaf first. Templates that didn't join are voted on again in split leaves, those that also share all
tokens of a band of places: with one band more than places in which two lines may differ, two lines that agree at
min_match of the places share a band. That is repeated until none joins. A
template that is found in min_docs distinct texts recurs: its lines stay in the document with the smallest doc_id
that holds it (and in exact copies of that document) and are dropped from all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, let, n_words, plain_lines, release, small

#: Lines of fewer words are left alone; general templates need more, since short lines agree by chance.
MIN_TOKENS, MIN_GENERAL_TOKENS = 5, 8
#: Leading tokens below the level of token counts.
DEPTH = 3
#: Distinct texts in which a template recurs, and the share of places at which a line must agree with a general one.
MIN_DOCS, MIN_MATCH = 2, 0.8


def masked(line: Column) -> Column:
    """The words of a line, whose white space is blanks, with one blank between; those that hold a digit are one variable field."""
    m = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)
    return F.trim(F.when(m.contains("  "), F.regexp_replace(m, " +", " ")).otherwise(m))


def tokens(line: Column) -> Column:
    """The words of a masked line."""
    return F.split(line, " ")


def n_tokens(line: Column) -> Column:
    """The number of words of a masked line, without taking it apart."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def parsed_lines(docs: DataFrame, doc_id: str, text: str, min_tokens: int, depth: int, with_line: bool = False) -> DataFrame:
    """(doc_id, th, pos, n, leaf, template, and the masked line if asked for) of lines with at least min_tokens words; th is the hash of the whole text, leaf that of the number of words and the leading ones."""

    def placed(line: Column, pos: Column) -> Column:
        return let(masked(line), lambda m: F.struct(pos.alias("pos"), n_tokens(m).alias("n"), m.alias("line")))

    def hashed(x: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), x["n"].alias("n"), F.xxhash64(x["n"], F.substring_index(x["line"], " ", depth)).alias("leaf"), F.xxhash64(x["line"]).alias("template"), *[x["line"].alias("line")] * with_line)

    # Parsed inside the array, so that each line is masked once, and hashed only if it counts.
    lines = F.transform(F.filter(F.transform(F.split(plain_lines(F.col(text)), "\n"), placed), lambda x: x["n"] >= min_tokens), hashed)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.explode(lines).alias("_line"))
    return d.select("doc_id", "th", "_line.*")


def voted(rows: DataFrame, min_match: float) -> DataFrame:
    """(leaf, template, cluster): the templates of rows (leaf, template, tokens, cluster) that agree with the dominant tokens of their cluster."""
    each = rows.select("leaf", "cluster", "template", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    votes = each.groupBy("cluster", "place", "token").agg(F.count("*").alias("votes"))
    best = votes.groupBy("cluster", "place").agg(F.max(F.struct("votes", "token"))["token"].alias("best"))
    agree = each.join(best, ["cluster", "place"]).groupBy("leaf", "cluster", "template", "n").agg(F.sum((F.col("token") == F.col("best")).cast("int")).alias("same"))
    return agree.where(F.col("same") >= F.col("n") * F.lit(min_match)).select("leaf", "template", "cluster")


def bands(toks: Column, depth: int, min_match: float) -> Column:
    """For each band its number and the hash of the tokens at its places; one band more than places that may differ. The leading tokens, equal in a leaf, are in none."""
    n = F.size(toks)
    k = F.greatest(F.least(n - depth, n - F.ceil(n * F.lit(min_match)) + 1), F.lit(1)).cast("int")
    start = lambda i: (F.lit(depth) + F.floor(i * (n - depth) / k)).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(toks, start(i) + 1, F.greatest(start(i + 1) - start(i), F.lit(0)))).alias("hash")))


def both_join(lo: Column, hi: Column, min_match: float) -> Column:
    """Whether two templates join the vote of the two: the larger token wins a tie, so no votes need counting."""
    z = F.arrays_zip(lo.alias("x"), hi.alias("y"))
    need = F.size(lo) * F.lit(min_match)
    return (F.size(F.filter(z, lambda t: t["x"] >= t["y"])) >= need) & (F.size(F.filter(z, lambda t: t["y"] >= t["x"])) >= need)


def voted_pairs(pairs: DataFrame, one: DataFrame, min_match: float) -> DataFrame:
    """As voted for clusters (cluster, lo, hi) of two templates, where both join."""
    side = lambda c: one.select(F.col("template").alias(c), F.col("tokens").alias(f"t{c}"))
    both = pairs.join(side("lo"), "lo").join(side("hi"), "hi").where(both_join(F.col("tlo"), F.col("thi"), min_match))
    return both.select("cluster", F.explode(F.array("lo", "hi")).alias("template"))


def general_templates(lines: DataFrame, mixed: DataFrame, min_tokens: int, depth: int, min_match: float) -> DataFrame:
    """(template, cluster): the exact templates of mixed leaves (leaf, k), which hold k templates, that join a general template."""
    rows = lines.where(F.col("n") >= min_tokens).join(small(mixed, 400_000), "leaf")
    whole = cut(rows.groupBy("leaf", "template", "k").agg(F.first("line").alias("line")))
    # In a leaf of two templates the vote is a tie at each place, in the leaf as in any band: one comparison settles it.
    twos = whole.where("k = 2").groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    twos = twos.where(both_join(tokens(F.col("lo")), tokens(F.col("hi")), min_match))
    found = [cut(twos.select(F.explode(F.array(F.xxhash64("lo"), F.xxhash64("hi"))).alias("template"), F.col("leaf").alias("cluster")))]
    several = whole.where("k > 2").select("leaf", "template", tokens(F.col("line")).alias("tokens"))
    joined = cut(voted(several.withColumn("cluster", F.col("leaf")), min_match))
    # One template alone in a leaf's vote is still open.
    size = joined.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1").select("cluster")
    found.append(cut(joined.join(size, "cluster", "left_semi").select("template", "cluster")))
    left = several.join(found[1].select("template"), "template", "left_anti")
    split = left.select("leaf", "template", F.explode(bands(F.col("tokens"), depth, min_match)).alias("b")).select("leaf", "template", F.xxhash64("leaf", "b.band", "b.hash").alias("cluster"))
    split = cut(split)
    used = [joined, split]
    while True:
        shared = cut(split.groupBy("cluster").agg(F.count("*").alias("k"), F.min("template").alias("lo"), F.max("template").alias("hi")).where("k > 1"))
        split = cut(split.join(shared.select("cluster"), "cluster", "left_semi"))
        used += [shared, split]
        if split.isEmpty():
            break
        pairs = shared.where("k = 2").groupBy("lo", "hi").agg(F.min("cluster").alias("cluster"))
        many = split.join(shared.where("k > 2").select("cluster"), "cluster", "left_semi").join(several.select("template", "tokens"), "template")
        joined = cut(voted(many, min_match).select("cluster", "template").unionByName(voted_pairs(pairs, several, min_match)))
        size = joined.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1")
        # Each template takes the largest of its clusters; the largest of all keeps all of its templates, so there is progress.
        best = cut(joined.join(size, "cluster").groupBy("template").agg(F.max(F.struct("k", "cluster"))["cluster"].alias("cluster")))
        stays = best.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1").select("cluster")
        took = cut(best.join(stays, "cluster", "left_semi").select("template", "cluster"))
        used += [joined, best, took]
        if took.isEmpty():
            break
        # A later round's cluster of the same band is another one.
        found.append(cut(took.select("template", F.xxhash64("cluster", F.lit(len(found))).alias("cluster"))))
        # Only the vote of a cluster that lost a template, or whose joined templates were left over, can come out otherwise.
        again = split.join(took.select("template"), "template", "left_semi").select("cluster").union(size.select("cluster")).distinct()
        split = split.join(again, "cluster", "left_semi").join(took.select("template"), "template", "left_anti")
    out = cut(reduce(DataFrame.unionByName, found))
    release(whole, *used, *found)
    return out


def recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_tokens: int = MIN_TOKENS, min_general: int = MIN_GENERAL_TOKENS, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_match: float = MIN_MATCH) -> tuple[DataFrame, DataFrame]:
    """(templates, lines): template and the text hash of its holder for every recurring template; (doc_id, th, pos, template and more) of all parsed lines. Both are tables that the caller may release."""
    meta = cut(parsed_lines(docs, doc_id, text, min_tokens, depth))
    holder = F.min(F.struct("doc_id", "th")).alias("holder")
    if min_docs <= 2:
        found = meta.groupBy("leaf", "template").agg(F.first("n").alias("n"), holder, F.min("th").alias("low"), F.max("th").alias("high"))
        found = found.withColumn("n_docs", F.when(F.col("low") < F.col("high"), 2).otherwise(1)).drop("low", "high")
    else:
        once = meta.groupBy("leaf", "template", "th").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
        found = once.groupBy("leaf", "template").agg(F.first("n").alias("n"), holder, F.count("*").alias("n_docs"))
    found = cut(found)
    mixed = cut(found.where(F.col("n") >= min_general).groupBy("leaf").agg(F.count("*").alias("k")).where("k > 1"))
    joined = general_templates(parsed_lines(docs, doc_id, text, min_general, depth, True), mixed, min_general, depth, min_match)
    lines = meta.select("doc_id", "th", "pos", "template")
    of_cluster = lines.join(small(joined), "template").select("cluster", "template", "doc_id", "th")
    clusters = of_cluster.groupBy("cluster", "th").agg(F.min("doc_id").alias("doc_id")).groupBy("cluster").agg(F.min(F.struct("doc_id", "th")).alias("holder"), F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    general = joined.join(clusters, "cluster").select("template", F.col("holder.th").alias("keeper"), F.lit(0).alias("rank"))
    exact = found.where(F.col("n_docs") >= min_docs).select("template", F.col("holder.th").alias("keeper"), F.lit(1).alias("rank"))
    # A line that joins a general template follows that one's holder, whose documents include those of the exact template.
    templates = general.unionByName(exact).groupBy("template").agg(F.min(F.struct("rank", "keeper"))["keeper"].alias("keeper"))
    templates = cut(templates)
    release(found, mixed, joined)
    return templates, meta


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with clean_text, n_lines and n_dropped.

    A null text has no lines and a null clean_text; an empty text is one empty line. A null doc_id counts as the smallest. Rows with equal doc_id and text get equal results. Lines repeated within one document are no recurrence. A text all of whose lines are dropped becomes empty; its row stays. Columns of docs of the same names as the added ones are replaced.
    """
    docs = docs.drop(*[c for c in ("clean_text", "n_lines", "n_dropped") if c in docs.columns])
    templates, lines = recurring(docs, doc_id, text, **options)
    hits = lines.select("doc_id", "th", "pos", "template").join(small(templates), "template").where("th <> keeper")
    drops = cut(hits.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("_drop")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_drop"))
    release(templates, lines)
    d = docs.join(drops, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left").drop("_id", "_th")
    d = d.withColumn("n_lines", F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)).cast("long"))
    d = d.withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
    places = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("_drop"))
    left = F.transform(F.sort_array(places), lambda p: F.get(F.col("_all"), p))
    d = d.withColumn("_all", F.when(F.col("_drop").isNotNull(), F.split(F.col(text), "\n")))
    d = d.withColumn("clean_text", F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    return d.drop("_drop", "_all")


def digest(d: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return d.select(doc_id, "n_lines", "n_dropped", n_words(F.col("clean_text")).alias("n_words_left"), F.md5("clean_text").alias("clean_md5"))
