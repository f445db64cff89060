"""Weighted rendezvous sharding, in DataFrame expressions only.

Each record key draws one number per shard; the smallest ``-ln(u) / weight`` wins.
A key's draws depend on the key and that shard alone, so a new shard takes records
only into itself, in proportion to its weight, and a dropped shard gives up only its own.

Defined results: a null key counts as the empty key; repeated rows share a shard and
get different slots; an empty table gives an empty result; columns of the input beside
those named are never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Slots are numbered within (shard, bucket), so no task sorts a whole shard.
SLOT_BUCKETS = 1024


def _draw(text: Column) -> Column:
    """52 bits of an MD5 as a number inside (0, 1)."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard of ``key`` among ``weights`` (shard id: weight over 0)."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("at least one shard, each of a weight over 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    shards = F.array(*[F.struct(F.lit(int(i)).alias("id"), F.lit(float(w)).alias("w"))
                       for i, w in sorted(weights.items())])
    costs = F.transform(shards, lambda s: F.struct(
        (-F.ln(_draw(F.concat(key, F.lit(":"), s["id"].cast("string")))) / s["w"]).alias("cost"),
        s["id"].alias("id")))
    return F.array_min(costs)["id"]


def slot_bucket(key: Column, digest: Column) -> Column:
    """Fixed pseudo-random bucket of a row; ``digest`` parts the rows of a hot key."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), F.coalesce(digest.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"),
                  F.lit(SLOT_BUCKETS)).cast("int")


def number_slots(df: DataFrame, shard: str, bucket: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, by bucket and then ``order``.

    Rows are numbered in each (shard, bucket); the counts of those, at most
    shards x SLOT_BUCKETS rows whatever the input, give each bucket its start.
    """
    counts = df.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("start__"))
    inside = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*order)) - 1
    numbered = df.withColumn("in__", inside).join(F.broadcast(starts), [shard, bucket])
    return numbered.withColumn("slot", (F.col("start__") + F.col("in__")).cast("long")).drop("start__", "in__")


def shard_documents(docs: DataFrame, n_shards: int, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard among one more for every row.

    ``weights`` defaults to 1 for each of ``n_shards`` shards; the added shard has weight 1.
    """
    weights = weights or {i: 1.0 for i in range(n_shards)}
    grown = weights | {max(weights) + 1: 1.0}
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    rows = rows.select(
        "*", F.lit("key").alias("law"), rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
        slot_bucket(F.col("doc_id"), F.col("text_crc32")).alias("bucket__"))
    rows = written(rows, "shards")
    out = number_slots(rows, "shard", "bucket__", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
