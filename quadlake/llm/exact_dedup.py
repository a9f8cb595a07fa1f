"""Exact deduplication by deterministic block naming.

Texts are cut into fixed-size byte blocks. Distinct blocks are sorted (by a 128-bit key, bucket by bucket) and get
integer names; then adjacent pairs of names are named in the same way, level by level, until one name stands for the
document. Two documents have the same (level, name) exactly when their bytes are equal: the block keys are verified
against the blocks themselves, and from there on names are compared as the integers they are.

Everything is DataFrame code. Each level shuffles rows of a few integers, half as many as the level before; texts are
shuffled once, already reduced to distinct blocks on the map side. A block or pair that a third of the corpus shares is
one row in the naming table, and the join that hands out its name is one that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C


def _named(pairs: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The distinct keys with integer names: rank in the sorted bucket, times the buckets, plus the bucket."""
    w = Window.partitionBy("_bucket").orderBy(*keys)
    return (
        pairs.select(*keys)
        .distinct()
        .withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        .withColumn("name", F.row_number().over(w) * F.lit(buckets) + F.col("_bucket"))
        .drop("_bucket")
    )


def _block_key(block: Column, salt: int, key_bits: int) -> Column:
    h1, h2 = F.xxhash64(block), F.xxhash64(F.lit(salt), block)
    if key_bits < 128:
        h1, h2 = F.pmod(h1, F.lit(1 << key_bits)), F.lit(salt).cast("long")
    return F.struct(h1.alias("h1"), h2.alias("h2"))


def identities(spark: SparkSession, docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), *, normalize=lambda c: c, block_bytes: int = 1024, buckets: int = 1 << 12, key_bits: int = 128) -> DataFrame:
    """A staged table with a row for every row of docs: keys, rid, text_sha256, level, name.

    Rows have equal (level, name) exactly if their normalised texts are equal; a null text counts as empty. rid numbers
    the rows, repeated ones too. Other columns of docs are ignored, whatever their names. An empty table gives an empty
    one. key_bits under 128 weakens the block keys and exists to test the verification.
    """
    src = docs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), normalize(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("_b"))
    src = src.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.length("_b") / F.lit(block_bytes))).cast("long"))
    cut = lambda i: F.substring("_b", (i * block_bytes + 1).cast("int"), F.lit(block_bytes))
    blocks = src.select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), cut)).alias("_block"))
    for salt in range(1, 64):
        keyed = blocks.select(_block_key(F.col("_block"), salt, key_bits).alias("k"), "_block").distinct()
        keyed = C.stage(spark, keyed.groupBy("k.h1", "k.h2").count(), "blocks")
        if not keyed.where("count > 1").head(1):
            break
        C.unstage(spark, keyed)  # two blocks share a key: name again under another salt
        key_bits = key_bits if key_bits == 128 else key_bits + 8
    else:
        raise RuntimeError("no collision-free block keys found")
    rows = src.select(
        F.monotonically_increasing_id().alias("rid"),
        *(F.col(f"_k{i}") for i in range(len(keys))),
        F.sha2("_b", 256).alias("text_sha256"),
        F.col("_n"),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: _block_key(cut(i), salt, key_bits)).alias("_hs"),
    )
    rows = C.stage(spark, rows, "rows")
    longest = rows.agg(F.max("_n")).first()[0] or 0

    at = rows.select("rid", F.col("_n").alias("n"), F.posexplode("_hs").alias("pos", "k")).select("rid", "n", F.col("pos").cast("long").alias("pos"), "k.h1", "k.h2")
    cur = C.stage(spark, at.join(_named(keyed, ["h1", "h2"], buckets), ["h1", "h2"]).select("rid", "n", "pos", "name"), "level0")
    C.unstage(spark, keyed)
    levels, level = [], 0
    while True:
        levels.append(cur.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        level, longest = level + 1, (longest + 1) // 2
        half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = cur.where("n > 1").groupBy("rid", F.expr("(n + 1) div 2").alias("n"), F.expr("pos div 2").alias("pos")).agg(half(0).alias("a"), F.coalesce(half(1), F.lit(-1)).alias("b"))
        cur = C.stage(spark, pairs.join(_named(pairs, ["a", "b"], buckets), ["a", "b"]).select("rid", "n", "pos", "name"), f"level{level}")
    named = levels[0]
    for x in levels[1:]:
        named = named.unionByName(x)
    out = rows.select("rid", *(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "text_sha256").join(named, "rid")
    return C.stage(spark, out, "identities")


def exact_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and rid for every row.

    Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any other, and of rows that
    also tie in doc_id one stays (the last in file order). Null and empty texts are equal.
    """
    named = identities(spark, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **how)
    # staged, so that both sides of the join are plain shuffles, which AQE splits where a group is large
    groups = C.stage(spark, named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256", "rid")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they were. Rows that agree in doc_id and text count once."""
    found = exact_duplicates(spark, docs).where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("sha"))
    return one_of_each(spark, docs, found)


def one_of_each(spark: SparkSession, docs: DataFrame, keep: DataFrame) -> DataFrame:
    """docs reduced to the pairs of doc_id and SHA-256 of the text that keep names (keep, sha); of rows equal in both, one.
    All columns of docs as they were, whatever their names."""
    cols = C.columns(docs.columns)
    k_, h_, s_, row_ = C.fresh(docs.columns, "keep", "kept_sha", "sha", "row")
    keep = C.stage(spark, keep.select(F.col("keep").alias(k_), F.col("sha").alias(h_)), "keep")
    d = docs.withColumn(s_, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    twice = C.stage(spark, d.select(F.col("doc_id").alias(k_), F.col(s_).alias(h_)).groupBy(k_, h_).count().where("count > 1").drop("count"), "twice")
    on = F.col("doc_id").eqNullSafe(F.col(k_)) & (F.col(s_) == F.col(h_))
    if not twice.head(1):
        return d.join(keep, on, "left_semi").select(*cols)
    same = lambda: keep[k_].eqNullSafe(twice[k_]) & (keep[h_] == twice[h_])
    once, more = keep.join(twice, same(), "left_anti"), keep.join(twice, same(), "left_semi")
    # Only rows that agree in both get grouped; of what else differs in them, the least as JSON stays.
    rest = d.join(more, on, "left_semi").groupBy("doc_id", s_).agg(F.min_by(F.struct(*cols), F.to_json(F.struct(*cols))).alias(row_)).select(f"{row_}.*")
    return d.join(once, on, "left_semi").select(*cols).unionByName(rest)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with the doc_id that stays of its group of equal texts.

    Null and empty texts are equal; of ties in doc_id one row is kept; a null doc_id is smaller than any other; further
    columns are not read; no documents give no rows.
    """
    return exact_duplicates(spark, C.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
