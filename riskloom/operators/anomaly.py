"""Isolation-forest anomaly detector.

fit:
  * P6 feature subset, null -> 0; F21 robust scaling (median / IQR from one
    exact-percentile aggregate, IQR 0 -> 1);
  * per-tree samples of min(256, n) rows drawn by seeded hashes: a hash
    filter keeps ~2 x 256 x trees rows (never more than the data), each kept
    row gets candidate trees from further hashes, and each tree keeps its 256
    smallest hashes -- the sampled set is bounded by 256 x trees whatever N;
  * ``groupBy(tree).applyInPandas`` grows each tree on <= 256 rows -> a node
    table (tree, node, feature, threshold, left, right, size);
score:
  * the node table has at most trees x 511 rows (proven bound), so it is
    broadcast into an ``arrow_udf`` as full binary trees, which a batch of rows
    goes down level by level without asking who has ended;
  * raw = -2^(-E[h] / c(psi)) - offset (offset = contamination quantile of the
    training scores), anomaly score = 1 - minmax(raw) with training min / max,
    unclipped (T23).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import ANOMALY_FEATURES, ForestParams
from riskloom.operators.quantile import quantile_row
from riskloom.session import written

EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
])


def avg_path_length(n):
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


@dataclass
class Forest:
    features: list[str]
    center: list[float]
    scale: list[float]
    nodes: pd.DataFrame          # bounded: trees x (2 x 256 - 1) rows
    psi: int
    offset: float = 0.0
    score_min: float = -1.0
    score_max: float = 1.0


def select_features(df: DataFrame, names=ANOMALY_FEATURES) -> list[str]:
    """Available priority features."""
    return [c for c in names if c in df.columns]


def robust_stats(df: DataFrame, feats: list[str]) -> tuple[list[float], list[float]]:
    """median and IQR of every feature, null as 0, in one selection."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    row = quantile_row(filled, {f"{c}|{p}": (c, p) for c in feats for p in (0.25, 0.5, 0.75)}).first()
    center, scale = [], []
    for c in feats:
        q1, med, q3 = [row[f"{c}|{p}"] for p in (0.25, 0.5, 0.75)]
        iqr = q3 - q1
        center.append(float(med))
        scale.append(float(iqr) if iqr != 0 else 1.0)
    return center, scale


def _scaled(df: DataFrame, feats, center, scale) -> DataFrame:
    return df.select("*", F.array(*[((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s))
                                    for c, m, s in zip(feats, center, scale)]).alias("_x"))


def _grow(seed_base: int, max_depth: int, n_feat: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng(seed_base * 100003 + tree)
        X = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, n_feat))
        rows = []
        stack = [(0, np.arange(len(X)), 0)]
        next_id = 1
        while stack:
            nid, idx, depth = stack.pop()
            sub = X[idx]
            if depth >= max_depth or len(idx) <= 1:
                rows.append((tree, nid, -1, 0.0, -1, -1, len(idx)))
                continue
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if cand.size == 0:
                rows.append((tree, nid, -1, 0.0, -1, -1, len(idx)))
                continue
            f = int(rng.choice(cand))
            thr = float(rng.uniform(lo[f], hi[f]))
            go_left = sub[:, f] < thr
            left, right = next_id, next_id + 1
            next_id += 2
            rows.append((tree, nid, f, thr, left, right, len(idx)))
            stack.append((left, idx[go_left], depth + 1))
            stack.append((right, idx[~go_left], depth + 1))
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])
    return build


def heaps(nodes: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every tree as (feature, threshold) of a full binary tree's inner nodes,
    level by level, and the isolation depth of its leaves.  Where a tree ends
    early, rows go right down to its depth (no value lies below -inf)."""
    out = []
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("node")
        place = {0: (0, 0)}                 # node -> (level, number in the level); children follow their parents
        for at, left, right in zip(t["node"], t["left"], t["right"]):
            if left >= 0:
                level, k = place[at]
                place[left], place[right] = (level + 1, 2 * k), (level + 1, 2 * k + 1)
        levels = max(level for level, _ in place.values())
        feature, threshold, depth = np.zeros((1 << levels) - 1, np.intp), np.full((1 << levels) - 1, -np.inf), np.zeros(1 << levels)
        for at, f, x, size in zip(t["node"], t["feature"], t["threshold"], t["size"]):
            level, k = place[at]
            if f >= 0:
                feature[(1 << level) - 1 + k], threshold[(1 << level) - 1 + k] = f, x
            else:
                depth[((k + 1) << (levels - level)) - 1] = level + avg_path_length(np.array([size]))[0]
        out.append((feature, threshold, depth))
    return out


def mean_depths(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Mean isolation depth over all trees of the rows of ``x``, as many at a
    time as the processor's cache holds."""
    total = np.zeros(len(x))
    for start in range(0, len(x), rows):
        part = np.ascontiguousarray(x[start:start + rows].T)
        n, flat = part.shape[1], part.ravel()
        each = np.arange(n)
        cur, at, value, bound = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n), np.empty(n)
        left = np.empty(n, bool)
        for feature, threshold, depth in trees:
            cur[:] = 0
            offset = feature * n
            for level in range(len(depth).bit_length() - 1):
                here = slice((1 << level) - 1, (2 << level) - 1)
                np.take(offset[here], cur, out=at, mode="clip")
                at += each
                np.take(flat, at, out=value, mode="clip")
                np.take(threshold[here], cur, out=bound, mode="clip")
                np.less(value, bound, out=left)
                cur += cur
                cur += 1
                cur -= left
            total[start:start + n] += np.take(depth, cur, out=value, mode="clip")
    return total / max(len(trees), 1)


def _score_udf(forest: Forest, spark: SparkSession):
    bc = spark.sparkContext.broadcast((heaps(forest.nodes), forest.psi))
    width = len(forest.features)

    @F.arrow_udf(T.DoubleType())
    def raw_score(x: pa.Array) -> pa.Array:
        trees, psi = bc.value
        e = mean_depths(trees, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width))
        c = float(avg_path_length(np.array([psi]))[0]) or 1.0
        return pa.array(-np.power(2.0, -e / c))
    return raw_score


def fit(df: DataFrame, params: ForestParams = ForestParams(), feats: list[str] | None = None) -> Forest:
    feats = feats or select_features(df)
    center, scale = robust_stats(df, feats)
    x = _scaled(df, feats, center, scale).select("_x")
    n = df.count()
    psi = int(min(params.max_samples, n))
    trees = params.n_trees
    seed = params.seed
    want = psi * trees
    # keep ~2 x want rows by hash (all rows when the data is small)
    frac = min(1.0, 2.0 * want / max(n, 1))
    h = F.abs(F.xxhash64(F.col("_x"), F.lit(seed))) % F.lit(1 << 30)
    kept = x.withColumn("_rid", F.monotonically_increasing_id()).filter(h < F.lit(int(frac * (1 << 30))))
    m = max(1.0, n * frac)
    copies = int(min(trees, math.ceil(2.0 * want / m)))
    cand = kept.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
        "_tree", F.pmod(F.xxhash64(F.col("_rid"), F.col("_j"), F.lit(seed)), F.lit(trees)).cast("int")
    ).dropDuplicates(["_tree", "_rid"]).withColumn("_prio", F.xxhash64(F.col("_rid"), F.col("_tree"), F.lit(seed + 1)))
    # each tree keeps its psi smallest priorities (groups of ~2 x psi rows)
    ranked = cand.withColumn("_r", F.row_number().over(Window.partitionBy("_tree").orderBy("_prio", "_rid")))
    sample = ranked.filter(F.col("_r") <= psi).select("_tree", "_x")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    nodes = sample.groupBy("_tree").applyInPandas(_grow(seed, max_depth, len(feats)), NODE_SCHEMA).toPandas()
    forest = Forest(feats, center, scale, nodes, psi)
    # training score distribution: contamination offset and min / max of the decision values
    raw = written(_scaled(df, feats, center, scale).select(_score_udf(forest, df.sparkSession)(F.col("_x")).alias("s")))
    st = quantile_row(raw, {"off": ("s", params.contamination)}).crossJoin(
        raw.agg(F.min("s").alias("mn"), F.max("s").alias("mx"))).first()
    forest.offset = float(st["off"])
    forest.score_min = float(st["mn"]) - forest.offset
    forest.score_max = float(st["mx"]) - forest.offset
    return forest


def decision_function(df: DataFrame, forest: Forest) -> DataFrame:
    x = _scaled(df, forest.features, forest.center, forest.scale)
    raw = _score_udf(forest, df.sparkSession)(F.col("_x")) - F.lit(forest.offset)
    return x.withColumn("anomaly_raw", raw).drop("_x")


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """M5 + F20: anomaly_score in [0, 1] on training data (1 = most
    anomalous; unclipped elsewhere) and the +-1 prediction."""
    d = decision_function(df, forest)
    denom = forest.score_max - forest.score_min
    norm = (F.col("anomaly_raw") - F.lit(forest.score_min)) / F.lit(denom) if denom != 0 else F.lit(0.0)
    return d.withColumn("anomaly_score", F.lit(1.0) - norm).withColumn(
        "anomaly_pred", F.when(F.col("anomaly_raw") < 0, F.lit(-1)).otherwise(F.lit(1)))


def save(forest: Forest, spark, path: str) -> None:
    """Node table as Parquet plus one row of scaling / score parameters."""
    spark.createDataFrame(forest.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(forest.features, forest.center, forest.scale, forest.psi, forest.offset,
                            forest.score_min, forest.score_max)],
                          "features array<string>, center array<double>, scale array<double>, psi int, "
                          "offset double, score_min double, score_max double").write.mode("overwrite").parquet(
        f"{path}/params")


def load(spark, path: str) -> Forest:
    p = spark.read.parquet(f"{path}/params").first()
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()   # bounded: trees x 511 rows
    return Forest(list(p["features"]), list(p["center"]), list(p["scale"]), nodes, p["psi"], p["offset"],
                  p["score_min"], p["score_max"])
