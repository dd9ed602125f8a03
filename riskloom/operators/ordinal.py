"""Exact global ordinals / prefix sums without a single-partition window.

1. ``repartitionByRange`` on the order key (hot keys split across partitions)
   and sort within partitions;
2. reliable checkpoint so both passes see identical partitions;
3. pass 1 (``mapInPandas``): one total per partition -> a table with one row
   per *partition* (bounded by the partition count, not the data);
4. pass 2 (``mapInPandas``): per-partition running sums plus the partition's
   offset.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import cut_lineage, written


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column],
    sum_cols: Sequence[str],
    num_partitions: int | None = None,
    prefix: str = "cum_",
) -> DataFrame:
    """Add inclusive running sums ``cum_<c>`` of ``sum_cols`` in ``order``
    (order must be total, e.g. end with a unique key).  ``sum_cols`` may be
    empty: ``cum__n`` (the 1-based ordinal) is always added."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = df.withColumn("_n", F.lit(1).cast("long"))
    cols = list(sum_cols) + ["_n"]
    # the range partition id is stored as a column before the checkpoint:
    # later stages may run these partitions inside a union, where the task's
    # own partition index is shifted
    ranged = cut_lineage(work.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id()))

    tot_schema = T.StructType([T.StructField("_pid", T.IntegerType())] +
                              [T.StructField(c, T.DoubleType()) for c in cols])

    def totals(batches):
        acc = np.zeros(len(cols))
        pid = None
        for pdf in batches:
            if len(pdf):
                pid = int(pdf["_pid"].iloc[0])
                acc += pdf[cols].astype("float64").fillna(0.0).sum().to_numpy()
        if pid is not None:
            yield pd.DataFrame([[pid, *acc]], columns=["_pid", *cols])

    rows = sorted(ranged.select("_pid", *cols).mapInPandas(totals, tot_schema).collect(), key=lambda r: r["_pid"])
    offsets: dict[int, np.ndarray] = {}
    run = np.zeros(len(cols))
    for r in rows:
        offsets[r["_pid"]] = run.copy()
        run = run + np.array([r[c] for c in cols])

    out_fields = list(ranged.schema.fields) + [T.StructField(prefix + c, T.DoubleType()) for c in cols]
    out_schema = T.StructType(out_fields)

    def running(batches):
        base = None
        for pdf in batches:
            if not len(pdf):
                continue
            if base is None:
                base = offsets.get(int(pdf["_pid"].iloc[0]), np.zeros(len(cols))).copy()
            vals = pdf[cols].astype("float64").fillna(0.0).to_numpy()
            cum = np.cumsum(vals, axis=0) + base
            if len(vals):
                base = cum[-1].copy()
            for i, c in enumerate(cols):
                pdf[prefix + c] = cum[:, i]
            yield pdf

    res = ranged.mapInPandas(running, out_schema)
    res = res.withColumn(prefix + "_n", F.col(prefix + "_n").cast("long"))
    return res.drop("_n", "_pid")


def same(cols: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of columns with their namesakes behind ``prefix``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(prefix + c))
    return cond


def ranks_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 0-based rank by ``order`` (a total order) within ``keys``: row
    numbers of sorted range partitions, written with the rows, minus the first
    one of the key in its partition, plus the key's rows in the partitions
    before.  The window sees one row per key and partition."""
    ranged = written(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                     .withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_in"))
    before = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_in")
    runs = runs.select(*[F.col(c).alias("r" + c) for c in [*keys, "_part"]], (before - F.col("_first")).alias("_shift"))
    return ranged.join(runs, same([*keys, "_part"], "r")).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
