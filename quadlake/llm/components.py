"""Connected components of links, by contracting stars; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, root for every node that has a link: the smallest node of its component. links: longs a and b.

    Alternates two steps (Kiveris et al. 2014) until nothing changes: every node hangs its larger neighbours, then its
    smaller ones and itself, under the smallest of its neighbourhood. The number of rounds grows with the logarithm of
    the longest path; links never outnumber those given. Each step groups by node, with partial minima that are staged,
    and joins back plain shuffles, so that AQE spreads a node with many links. Self-links and repeated links do no harm; no links give no rows.
    """
    w = C.stage(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = w.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        both = w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = C.stage(spark, both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        large = C.stage(spark, both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = C.stage(spark, large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = C.stage(spark, small, "links")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        C.unstage(spark, w, large, low, least)
        w = new
        if now == n:
            break
        n = now
    # every link now leads from a node to its root
    return w.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(w.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
