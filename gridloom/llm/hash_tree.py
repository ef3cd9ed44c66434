"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every leaf has a hash draw -ln(u) / weight for a key; a node's draw is the least of the leaves below it, which is
distributed as a draw of the node's whole weight. A key descends from the root to the child with the least draw, level by
level. A leaf that is added or gains weight lowers only its own draw and so those of the nodes above it: keys move
into that leaf and nowhere else, and subtrees whose weights stay keep their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, running

#: Shards of a rack and racks of a region; a leaf's weight is 1 unless given.
SHARDS_PER_RACK, RACKS_PER_REGION = 2, 2


def draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u from the first 48 bits of an MD5, in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key)), 1, 12), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 48)) / weight


def tree(n_shards: int, weights: dict[int, float] | None = None) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight)."""
    leaves = [(s, float((weights or {}).get(s, 1.0))) for s in range(n_shards)]
    if any(w <= 0 for _, w in leaves):
        raise ValueError("weights must be above 0")
    racks = [leaves[i : i + SHARDS_PER_RACK] for i in range(0, n_shards, SHARDS_PER_RACK)]
    return [racks[i : i + RACKS_PER_REGION] for i in range(0, len(racks), RACKS_PER_REGION)]


def shard_of(key: Column, n_shards: int, weights: dict[int, float] | None = None) -> Column:
    """The shard of a string key, by descent through the tree."""

    def least(options: list[tuple[Column, Column]]) -> Column:
        """The value of the option with the least draw; the first of equals."""
        best = F.least(*[d for d, _ in options]) if len(options) > 1 else options[0][0]
        out = F.coalesce(*[F.when(d == best, v) for d, v in options])
        return out

    def low(draws: list[Column]) -> Column:
        return F.least(*draws) if len(draws) > 1 else draws[0]

    # All leaves' draws once a row, as an array; the levels read from it.
    def descend(a: Column) -> Column:
        at = lambda s: F.get(a, s)
        regions = []
        for region in tree(n_shards, weights):
            racks = []
            for rack in region:
                shard = least([(at(s), F.lit(s)) for s, _ in rack])
                racks.append((low([at(s) for s, _ in rack]), shard))
            regions.append((low([d for d, _ in racks]), least(racks)))
        return least(regions)

    draws = F.array(*[draw(key, s, w) for region in tree(n_shards, weights) for rack in region for s, w in rack])
    return F.element_at(F.transform(F.array(draws), descend), 1)


def shards(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (with one more shard of weight 1) of every document.

    doc_id and the shard count decide. size is the text's UTF-8 bytes plus 1; a null text has no bytes and the CRC of none (0). A null doc_id is a key of its own. slot counts from 0 within a shard, in the order of a hash of doc_id, then doc_id, CRC and size; rows equal in these are alike. Extra columns are left out.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"), key.alias("_key"))
    d = d.withColumn("shard", shard_of(F.col("_key"), n_shards, weights)).withColumn("grown_shard", shard_of(F.col("_key"), n_shards + 1, weights))
    d = cut(d.withColumn("_bucket", F.conv(F.substring(F.md5("_key"), 1, 3), 16, 10).cast("int")).drop("_key").withColumnRenamed("_bucket", "_slot_bucket"))
    out = running(d, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.lit(1).cast("long"), F.col("_slot_bucket"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
