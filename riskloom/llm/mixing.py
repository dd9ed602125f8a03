"""Mixing sources to target weights by entropy balancing.

Document rates minimise the relative entropy to rate 1 under one token
constraint per source and the bound of ``MAX_COPIES``: the rate is
min(bound, exp(lambda * size / mean size)).  Newton iterations on the convex
dual solve each source's lambda over the histogram of (source, size), which is
summed up before anything moves; rates are then rounded to whole copies so that
each source's words come within less than a short document of its target.

Null text: size 0.  Null source: a source of its own, last in order.
Documents without a word are taken once.  Equal rows are documents of their
own.  An empty table gives an empty table.  Reruns agree: ties go by a hash of
doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, clean_text, packed, stored, table

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SPREAD = 256            # parts of a (source, size) group when copies are dealt
STEPS = 5               # Newton steps between two written states
MAX_BLOCKS = 40         # about ten steps are needed; beyond all blocks, it raises
TOLERANCE = 1e-9


def source_key(source: Column) -> Column:
    """Orders as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def share_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, bound: int = MAX_COPIES) -> DataFrame:
    """(key, total) -> (key, total, target): sources by key weigh ``weights``
    in turn and share the sum of totals; a target stops at ``bound`` times its
    total and the rest share the excess.  One row per source, so the windows
    over all sources are small."""
    nth = F.row_number().over(Window.orderBy("key")) - 1
    w = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    cap = (F.col("total") * bound).cast("double")
    by_level = Window.orderBy((cap / F.col("w")), "key")
    w = w.withColumn("capped", F.coalesce(F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("open", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))) \
        .withColumn("all", F.sum("total").over(Window.partitionBy()))
    w = w.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    # the level rises while sources below it are capped and falls after that
    w = w.withColumn("level", F.max("level").over(Window.partitionBy()))
    return w.select("key", "total", F.least(cap, F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def _newton_step(words: DataFrame, state: DataFrame, top: float) -> DataFrame:
    """One step for every key; the state travels through the aggregation, so
    a block of steps is a linear plan."""
    e = F.col("lam") * F.col("size") / F.col("mean")
    mass = F.col("n") * F.col("size") * F.exp(F.least(e, F.lit(top)))
    s = words.join(state, "key").groupBy(*state.columns).agg(
        F.sum(mass).alias("f"),
        F.sum(F.when(e < top, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("g"))
    f, goal, lam = F.col("f"), F.col("target"), F.col("lam")
    s = s.withColumn("lo", F.when(f < goal, lam).otherwise(F.col("lo"))) \
        .withColumn("hi", F.when(f > goal, lam).otherwise(F.col("hi"))) \
        .withColumn("done", F.col("done") | (F.abs(f - goal) <= TOLERANCE * goal)
                    | F.coalesce(F.col("hi") - F.col("lo") <= 1e-14 * F.abs(F.col("hi")), F.lit(False)))
    step = lam - F.when(F.col("g") > 0, F.log(f / goal) * f / F.col("g"))
    inside = (step < F.col("hi")) & (F.col("lo").isNull() | (step > F.col("lo")))
    middle = F.when(F.col("lo").isNull(), F.col("hi") * 2 - F.abs(F.col("hi")) - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
    return s.withColumn("lam", F.when(F.col("done"), lam).when(inside, step).otherwise(middle)).select(*state.columns)


def solve_rates(hist: DataFrame, goals: DataFrame, bound: int = MAX_COPIES) -> DataFrame:
    """hist (key, size, n), goals (key, total, target) -> hist with rate.
    Safeguarded Newton steps on the log of each source's token sum; a step that
    leaves the bracket is replaced by its middle."""
    top = math.log(bound)
    per = hist.where("size > 0").groupBy("key").agg(
        F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = goals.join(per, "key").select(
        "key", "target", (F.col("total") / F.col("docs")).alias("mean"),
        F.when(F.col("target") >= bound * F.col("total"), F.lit(1)).otherwise(0).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"),
        (F.lit(top) * F.col("total") / F.col("docs") / F.col("least") + 1e-9).alias("hi"))
    state = stored(state.withColumn("done", F.col("full") == 1), "mix")
    words = stored(hist.where("size > 0"), "mix")
    for _ in range(MAX_BLOCKS):
        for _ in range(STEPS):
            state = _newton_step(words, state, top)
        state = stored(state, "mix")
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"entropy balancing did not converge in {MAX_BLOCKS * STEPS} steps")
    e = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full") == 1, float(bound)) \
        .otherwise(F.round(F.exp(F.least(e, F.lit(top))), 9))
    return hist.join(state.select("key", "target", "mean", "full", "lam"), "key", "left").select(
        "key", "size", "n", "target", F.coalesce(F.least(rate, F.lit(float(bound))), F.lit(1.0)).alias("rate"))


def round_copies(rates: DataFrame, bound: int = MAX_COPIES, passes: int = 4) -> DataFrame:
    """(key, size, n, target, rate) -> (key, size, n, copies): running sums of
    rates by size are rounded, which leaves at most half the longest document;
    each pass then adds or removes copies of the largest size that still fits
    the remainder.  The windows hold one row per distinct size."""
    w = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    due = F.sum(F.col("n") * F.col("rate")).over(w)
    bins = rates.withColumn("due", due).withColumn("copies", (
        F.floor(F.round(F.col("due"), 6) + 0.5) - F.floor(F.round(F.col("due") - F.col("n") * F.col("rate"), 6) + 0.5)))
    bins = bins.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * bound)).cast("long")).drop("due")
    key, size, rest = Window.partitionBy("key"), F.col("size"), F.abs(F.col("rest"))
    for _ in range(passes):
        bins = bins.withColumn("rest", F.col("target") - F.sum(F.col("copies") * size).over(key))
        bins = bins.withColumn("room", F.when(F.col("rest") >= 0, F.col("n") * bound - F.col("copies")).otherwise(F.col("copies")))
        bins = bins.withColumn("pick", F.max(F.when((size > 0) & (size <= rest) & (F.col("room") > 0), size)).over(key))
        more = F.least(F.col("room"), F.floor(rest / size)) * F.signum("rest").cast("long")
        bins = bins.withColumn("copies", F.when(size == F.col("pick"), F.col("copies") + more).otherwise(F.col("copies")).cast("long"))
    return stored(bins.drop("rest", "room", "pick"), "mix")


def mix(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs (with ``id_col``, key, size) -> all its rows with source_size,
    target, rate and copies.  Copies of a (source, size) group are dealt over
    ``SPREAD`` parts of a hash of the id, so no window holds a large group."""
    hist = stored(docs.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix")
    goals = share_targets(hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("total")))
    goals = stored(goals, "mix")
    bins = round_copies(solve_rates(hist, goals))
    part = F.pmod(F.xxhash64(id_col), F.lit(SPREAD))
    d = docs.withColumn("_part", part)
    parts = d.groupBy("key", "size", "_part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("key", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(
        bins.select("key", "size", "n", "rate", "copies"), ["key", "size"])
    parts = parts.select("key", "size", "_part", "rate", F.expr("copies div n").alias("each"),
                         F.greatest(F.lit(0), F.least(F.col("m"), F.expr("copies % n") - F.col("before"))).alias("more"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "_part").orderBy(F.xxhash64(id_col, F.lit(1)), id_col))
    out = d.withColumn("_rank", rank).join(parts, ["key", "size", "_part"]) \
        .join(goals.withColumnRenamed("total", "source_size"), "key")
    return out.withColumn("copies", F.col("each") + F.when(F.col("_rank") <= F.col("more"), 1).otherwise(0)) \
        .drop("_part", "_rank", "each", "more")


def sized_columns() -> tuple[Column, Column]:
    return source_key(F.col("source")), F.regexp_count(clean_text(), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """The columns that mixing needs: doc_id, key, size."""
    key, size = sized_columns()
    return docs.select("doc_id", key.alias("key"), size.alias("size"))


def take_copies(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns.  Rows
    are known by a number that is written with them, so that repeated rows get
    their own copies."""
    key, size = sized_columns()
    rows = stored(packed(docs, F.monotonically_increasing_id().alias("row"), key.alias("key"), size.alias("size")), "mix")
    taken = mix(rows.select("row", "key", "size"), "row").where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    out = rows.select("row", "doc").join(taken, "row")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(stored(sized(table(spark, sf_dir, "documents")), "mix"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
                      F.col("copies").cast("long").alias("copies"), "rate")
