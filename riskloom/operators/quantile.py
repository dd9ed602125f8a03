"""Exact quantiles by selection by rank, for any number of columns and groups.

``percentile`` keeps the map of all distinct values of a column in one task.
Here the rows are reduced to (group, column, value) -> weight, range
partitioned and sorted by value, and written.  The weights of each partition
(one row per group, column and partition) say which partitions hold the wanted
ranks; only those are summed up value by value.  All columns and all
probabilities share the passes, nothing is collected, and a value that a third
of all rows share is one row after the first, map-side aggregation.

Semantics: linear interpolation between the two neighbouring ranks of
``p * (n - 1)``; nulls are left out; a column without values gets null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordinal import same
from riskloom.session import written


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str], weight: str | None) -> DataFrame:
    """(group, column number, value, weight) of the distinct values."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    rows = df.select(*keys, w.alias("_w"), F.posexplode(values).alias("_c", "_v"))
    names = [f"_k{i}" for i in range(len(by))] + ["_c"]
    return rows.filter(F.col("_v").isNotNull() & (F.col("_w") > 0)).groupBy(*names, "_v").agg(F.sum("_w").alias("_w"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              weight: str | None = None) -> DataFrame:
    """One row per group of ``by``, column and probability that has values:
    ``by`` columns, column, p, value.  ``weight``: how often a row counts."""
    keys = [f"_k{i}" for i in range(len(by))] + ["_c"]
    ranged = written(_long(df, cols, by, weight).repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v")
                     .withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy(*keys, "_part").agg(F.sum("_w").alias("_in"))
    group = Window.partitionBy(*keys)
    runs = runs.withColumns({"_before": F.sum("_in").over(group.orderBy("_part")) - F.col("_in"), "_n": F.sum("_in").over(group)})
    wanted = runs.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))) \
        .withColumn("_h", F.col("_p") * (F.col("_n") - 1)) \
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))) \
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in"))) \
        .select(*keys, "_part", "_p", "_h", "_rank", (F.col("_rank") - F.col("_before")).alias("_local"))
    ranks = wanted.groupBy(*keys, "_part").agg(F.collect_set(F.struct("_p", "_h", "_rank", "_local")).alias("_wanted"))
    named = ranks.select(*[F.col(c).alias("r" + c) for c in [*keys, "_part"]], "_wanted")
    at = Window.partitionBy(*keys, "_part").orderBy("_v")
    met = ranged.join(named, same([*keys, "_part"], "r"), "inner").withColumn("_cum", F.sum("_w").over(at)) \
        .select(*keys, "_v", F.explode(F.filter("_wanted", lambda x: (x["_local"] < F.col("_cum")) & (x["_local"] >= F.col("_cum") - F.col("_w")))).alias("_x"))
    g = met.groupBy(*keys, F.col("_x._p").alias("p")).agg(
        F.min(F.when(F.col("_x._rank") == F.floor("_x._h"), F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_x._rank") == F.ceil("_x._h"), F.col("_v"))).alias("_hi"), F.first("_x._h").alias("_h"))
    part = F.col("_h") - F.floor("_h")
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1)
    return g.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], name.alias("column"), "p",
                    F.when(part == 0, F.col("_lo")).otherwise(F.col("_lo") * (1 - part) + F.col("_hi") * part).alias("value"))


def _named(q: DataFrame, names: Mapping[str, tuple[str, float]]) -> list[Column]:
    return [F.max(F.when((F.col("column") == c) & (F.col("p") == float(p)), F.col("value"))).alias(n) for n, (c, p) in names.items()]


def quantile_row(df: DataFrame, names: Mapping[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """One row, one column per name: the quantile p of a column."""
    if not names:
        return df.sparkSession.range(1).select()
    cols = list(dict.fromkeys(c for c, _ in names.values()))
    probs = sorted({float(p) for _, p in names.values()})
    q = quantiles(df, cols, probs, weight=weight)
    return q.agg(*_named(q, names))


def quantile_table(df: DataFrame, names: Mapping[str, tuple[str, float]], by: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per group that has values: ``by`` and one column per name."""
    cols = list(dict.fromkeys(c for c, _ in names.values()))
    q = quantiles(df, cols, sorted({float(p) for _, p in names.values()}), by, weight)
    return q.groupBy(*by).agg(*_named(q, names))
