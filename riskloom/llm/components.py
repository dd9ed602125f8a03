"""Distributed union-find: alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the remaining star edges
and is written to the shared folder; no list of links or labels reaches the
driver.  Rounds run until the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge between two different ids; the
    component is its smallest id.  Ids may be of any type with an order.  No
    edge: an empty table.  Null ends are ignored."""
    e = edges.where(F.col(a) != F.col(b)) \
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stored(e, "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    star = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
