"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C


def _cost(key: Column, shard: int, weight: float, seed: int) -> Column:
    """-ln(u) / weight for a uniform u of (key, shard); the shard with the least cost takes the key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard of a key. With one more shard at the end, a key either stays or goes to the new one. A null key is a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    # xxhash64 skips nulls, so a null key is hashed as a value no key has: a null flag goes in beside it
    key = F.struct(key.isNull(), key)
    return F.least(*(F.struct(_cost(key, i, w, seed).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)))["shard"] if len(weights) > 1 else F.lit(0)


def shard_rows(spark: SparkSession, docs: DataFrame, weights: list[float], *, new_weight: float = 1.0, text: str = "text", doc_id: str = "doc_id", buckets: int = 256, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 bytes of the text plus 8; a null text has none. Slots count from 0 without gaps within a shard, in
    order of a hash bucket, doc_id, size and checksum. Rows equal in all of these cannot be told apart: they are counted
    first and given a range of slots. Null doc_ids are one key. Other columns are ignored. No rows give no rows.
    """
    if len(weights) < 1:
        raise ValueError("at least one shard")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col("doc_id"), weights, seed)).withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, new_weight], seed))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    rows = C.stage(spark, rows.groupBy("shard", "_bucket", "doc_id", "size", "text_crc32", "grown_shard").agg(F.count(F.lit(1)).alias("_n")), "shards")
    # shards x buckets rows, however many records there are
    sums = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    rows = rows.join(sums, ["shard", "_bucket"]).withColumn("_first", F.col("_first") + F.col("_base"))
    slots = F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with its shard of 24 and its slot there.

    A null text has no bytes; null doc_ids are one key; rows equal in doc_id, size and checksum take a range of slots
    together; further columns are not read; no documents give no rows.
    """
    return shard_rows(spark, C.table(spark, sf_dir, "documents"), [1.0] * 24)
