"""Mixing sources to target weights by entropy balancing.

A document of relative length x in source s is taken at the rate min(most, exp(lambda_s x)): the tilt of all-ones rates
that lies nearest to them in relative entropy while each source's expected words equal its target. The multipliers solve
a convex dual with one variable a source; its gradient and curvature are sums over documents, collected for all sources
at once in each of a few distributed Newton steps, over counts of equal (source, size) rather than over texts. A bracket
keeps the steps safe where the cap makes the curve flat.

Rates become copies by comparing their fractional part with a hash of the document, shifted by a phase. Of PHASES
candidate phases each source takes the one whose words come nearest to the target; they are all summed in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PHASES = 128


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, docs, target. Sources in code point order, null last, weigh weights, repeating.

    They share all words; a target stops at ``most`` times its source, and the excess is shared anew by weight. That is
    filling vessels of capacity most * size and width weight to one level: sorted by capacity / weight, the vessels that
    overflow are a prefix, and the level follows from running sums. One row a source goes through the window.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (i % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * float(most))
    w = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    up_to, everything = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.select("*", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)).alias("_c"), F.coalesce(F.sum("w").over(up_to), F.lit(0.0)).alias("_w"), F.sum("source_size").over(everything).alias("_t"), F.sum("w").over(everything).alias("_aw"))
    # the level if exactly the vessels before this one overflow
    by = by.withColumn("_level", (F.col("_t") - F.col("_c")) / (F.col("_aw") - F.col("_w")))
    level = F.max(F.when(F.col("_level") * F.col("w") < F.col("cap"), F.col("_level"))).over(everything)
    first = F.min(F.when(F.col("_level") * F.col("w") <= F.col("cap"), F.struct(F.col("_w"), F.col("_level")))).over(everything)
    return by.withColumn("_l", F.coalesce(first["_level"], level, F.lit(0.0))).select("source", "source_size", "docs", "cap", F.least("cap", F.col("_l") * F.col("w")).alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    return F.when(lam * x >= F.lit(0.0), F.least(F.lit(float(most)), F.exp(F.least(lam * x, F.lit(50.0))))).otherwise(F.exp(F.greatest(lam * x, F.lit(-50.0))))


def multipliers(spark: SparkSession, sizes: DataFrame, goal: DataFrame, most: float, steps: int, near: float) -> DataFrame:
    """source, x_unit, lam, full: Newton on the dual for all sources at once. A source whose target is its cap is full: rate ``most``."""
    sizes = sizes.where("size > 0")
    cur = goal.select("source", "target", (F.col("source_size") / F.col("docs")).alias("x_unit"), (F.col("target") >= F.col("cap") * (1 - 1e-9)).alias("full"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done"))
    cur = C.stage(spark, cur.withColumn("done", F.col("full")), "lambda")
    for _ in range(steps):
        x = F.col("size") / F.col("x_unit")
        rate = _rate(F.col("lam"), x, most)
        moved = (
            sizes.join(cur.where("NOT done").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy(F.col("_s"), "target", "lam", "lo", "hi")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("f"), F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("g"))
        )
        gap = F.col("f") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.when(F.col("g") > 0, F.col("g"))
        # outside its bracket a Newton step is replaced by the middle, or, while an end is open, by a doubling
        middle = F.when((F.abs(lo) < 1e6) & (F.abs(hi) < 1e6), (lo + hi) / 2).when(gap < 0, F.col("lam") * 2 + 1).otherwise(F.col("lam") * 2 - 1)
        moved = moved.select(F.col("_s"), F.when(F.abs(gap) <= near * F.col("target"), F.col("lam")).when((step > lo) & (step < hi), step).otherwise(middle).alias("lam2"), lo.alias("lo2"), hi.alias("hi2"), (F.abs(gap) <= near * F.col("target")).alias("done2"))
        was = cur
        cur = cur.join(moved, cur["source"].eqNullSafe(moved["_s"]), "left").select("source", "target", "x_unit", "full", F.coalesce("lam2", "lam").alias("lam"), F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), (F.col("done") | F.coalesce("done2", F.lit(True))).alias("done"))
        cur = C.stage(spark, cur, "lambda")
        C.unstage(spark, was)
        if not cur.where("NOT done").head(1):
            break
    return cur.select("source", "x_unit", "lam", "full")


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, steps: int = 40, near: float = 1e-4, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, text_hash for every row.

    size counts words; a null text has none. Copies are whole and at most ``most`` (a whole number); taken = copies *
    size. Documents without words are taken once, and cost nothing. A null source is a source, the last. Rows with equal
    doc_id and text get equal copies. An empty table gives an empty one. Reruns agree: nothing is drawn at random.
    """
    if most != int(most) or most < 1:
        raise ValueError("most must be a whole number of at least 1")
    th = F.xxhash64(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), C.n_words(F.col(text)).alias("size"), th.alias("text_hash"))
    rows = C.stage(spark, rows, "sizes")
    sizes = C.stage(spark, rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    goal = C.stage(spark, targets(sizes, weights, most), "targets")
    lam = multipliers(spark, sizes, goal, most, steps, near)
    plan = C.stage(spark, goal.join(lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "plan")
    named = plan.select(F.col("source").alias("_s"), "source_size", "target", "x_unit", "lam", "full")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")), 11).cast("double") / F.lit(float(1 << 53))
    rated = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("x_unit"), most))).withColumn("u", u)
    # rate + u may round up to a whole number more
    copies = lambda phase: F.least(F.floor(F.col("rate") + F.pmod(F.col("u") + phase, F.lit(1.0))), F.lit(int(most)))
    tried = rated.groupBy("_s", "target").agg(*(F.sum(F.col("size") * copies(F.lit(k / PHASES))).alias(f"p{k}") for k in range(PHASES)))
    best = F.least(*(F.struct(F.abs(F.col(f"p{k}") - F.col("target")).alias("off"), F.lit(k / PHASES).alias("phase")) for k in range(PHASES)))["phase"]
    phases = C.stage(spark, tried.select(F.col("_s").alias("_p"), best.alias("phase")), "phases")
    out = rated.join(phases, F.col("_s").eqNullSafe(F.col("_p")))
    out = out.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies(F.col("phase"))).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def take(spark: SparkSession, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, all columns as they were, whatever their names."""
    d_, s_, h_, n_, th_, i_ = C.fresh(docs.columns, "d", "s", "h", "copies", "th", "i")
    n = mix(spark, docs, text=text, doc_id=doc_id, source=source, **how).groupBy("doc_id", "source", "text_hash").agg(F.max("copies").alias("copies"))
    n = C.stage(spark, n.where("copies > 0").select(F.col("doc_id").alias(d_), F.col("source").alias(s_), F.col("text_hash").alias(h_), F.col("copies").alias(n_)), "copies")
    d = docs.withColumn(th_, F.xxhash64(text))
    d = d.join(n, F.col(doc_id).eqNullSafe(F.col(d_)) & F.col(source).eqNullSafe(F.col(s_)) & (F.col(th_) == F.col(h_)))
    return d.withColumn(i_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_)))).select(*C.columns(docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with the words that the mix takes of it.

    A null text has no words and is taken once, at no cost; a null source is one, the last; repeated rows are taken alike;
    further columns are not read; no documents give no rows.
    """
    return mix(spark, C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
