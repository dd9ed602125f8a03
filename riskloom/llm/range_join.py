"""Exact range join of vectors by cosine, with pivots.

On unit vectors a cosine of 0.9 is a distance of sqrt(2 - 1.8), a metric.
Pivots part the vectors into cells (nearest pivot); the triangle inequality
says which other cells a vector must also visit: those whose pivot is within
its own pivot's distance plus twice the range, within the cell's radius plus
the range, and whose bisecting plane is within the range.  The vectors of a cell lie in
blocks of about ``BLOCK`` in shared files.  Each two blocks of cells that visit
each other meet once, in a task that maps both files, and give a row per linked
vector: its number of links, and its root in their union-find.  No vector is
copied per cell it visits, and a task holds two blocks, whatever the number of
cells.  Equal vectors are one vector with a multiplicity.

Null vectors, zero vectors and those with a null or non-finite component link
with nothing; vectors of different lengths never link.  Rows with equal vec_id
are vectors of their own.  An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import shared_folder, stored, table
from riskloom.llm.components import connected_components
from riskloom.llm.shared_files import open_arrays, write_arrays

COSINE = 0.9
BLOCK = 2048
MIN_PIVOTS = 16
MAX_PIVOTS = 512        # pivots are kept in memory; cells beyond BLOCK are split, not cut
SAMPLE = 4              # vectors sampled per pivot, by a hash, to choose pivots from
EPS = 1e-9
VISITS = 1 << 16        # visits that a task hands over at once
PARTS = 8               # parts of the blocks that meet another one, for different tasks


def matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def usable(v: str = "embedding"):
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (norm > 0), F.lit(False))


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice among sampled unit vectors."""
    chosen = [0]
    near = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)):
        k = int(near.argmax())
        if near[k] <= EPS:
            break
        chosen.append(k)
        near = np.minimum(near, np.linalg.norm(points - points[k], axis=1))
    return points[chosen]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ p.T), 0))


def _by_size(batch: pa.RecordBatch):
    size = np.diff(batch.column("embedding").offsets.to_numpy())
    for d in np.unique(size):
        yield int(d), batch.take(pa.array(np.flatnonzero(size == d)))


def assign(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim, cell and the distance to its pivot (cell -1: a length of
    which no pivot was sampled)."""
    def run(batches):
        for b in batches:
            for d, c in _by_size(b):
                n = c.num_rows
                cell, near = np.full(n, -1), np.zeros(n)
                if d in pivots:
                    dist = _distances(_unit(matrix(c.column("embedding"))), pivots[d])
                    cell = dist.argmin(axis=1)
                    near = dist[np.arange(n), cell]
                yield pa.RecordBatch.from_arrays([c.column("key"), c.column("m"), c.column("embedding"), pa.array(np.full(n, d, np.int32)),
                                                  pa.array(cell.astype(np.int32)), pa.array(near)],
                                                 ["key", "m", "embedding", "dim", "cell", "near"])

    return vectors.select("key", "m", "embedding").mapInArrow(
        run, f"key long, m long, embedding {dict(vectors.dtypes)['embedding']}, dim int, cell int, near double")


class Reach:
    """Pivots with the gaps between them and the radii of their cells: which
    cells a vector must visit."""

    def __init__(self, pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float], reach: float):
        self.pivots, self.reach = pivots, reach
        self.gap = {d: _distances(p, p) for d, p in pivots.items()}
        self.wide = {d: np.array([radii.get((d, j), -math.inf) for j in range(len(p))]) for d, p in pivots.items()}

    def visited(self, d: int, dist: np.ndarray, own: np.ndarray, home: np.ndarray, cells: slice = slice(None)) -> np.ndarray:
        """(rows, cells): by the distances to the cells' pivots, to the own one and the own cell."""
        own = own[:, None]
        return (dist <= own + 2 * self.reach + EPS) & (dist <= self.wide[d][None, cells] + self.reach + EPS) & \
            (dist * dist - own * own <= 2 * self.gap[d][home][:, cells] * self.reach + EPS)

    def meets(self, d: int, x: np.ndarray, near: np.ndarray, home: int, cell: int) -> np.ndarray:
        """Rows (unit vectors of a cell) that visit another cell."""
        if home == cell:
            return np.ones(len(x), bool)
        one = slice(cell, cell + 1)
        return self.visited(d, _distances(x, self.pivots[d][one]), near, np.full(len(x), home), one)[:, 0]


def visits_of(batch: pa.RecordBatch, reach: Reach):
    """The visits of a batch, at most ``VISITS`` or one vector's at a time."""
    for d, every in _by_size(batch):
        step = max(1, VISITS // len(reach.pivots[d])) if d in reach.pivots else VISITS
        for c in (every.slice(i, step) for i in range(0, every.num_rows, step)):
            key, home, block = (c.column(n).to_numpy() for n in ("key", "cell", "block"))
            if d not in reach.pivots:
                who, cell = np.arange(len(key)), home
            else:
                dist = _distances(_unit(matrix(c.column("embedding"))), reach.pivots[d])
                near = reach.visited(d, dist, dist[np.arange(len(key)), home], home)
                near[np.arange(len(key)), home] = True
                who, cell = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(key[who]), pa.array(np.full(len(who), d, np.int32)), pa.array(cell.astype(np.int32)),
                                              pa.array(home[who] == cell), pa.array(home[who]), pa.array(block[who])],
                                             ["key", "dim", "cell", "home", "own", "block"])


def visits(homes: DataFrame, reach: Reach) -> DataFrame:
    """(key, dim, cell, home, own, block) of every cell a vector belongs to or
    must visit; own and block: where the vector lies."""
    def run(batches):
        for b in batches:
            yield from visits_of(b, reach)

    return homes.select("key", "embedding", "cell", "block").mapInArrow(run, "key long, dim int, cell int, home boolean, own int, block int")


def compared_pairs(members: DataFrame) -> int:
    """How many pairs of visits the cells compare (all pairs: n * n)."""
    each = members.groupBy("dim", "cell").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("o"))
    return each.agg(F.coalesce(F.sum(F.col("h") * F.col("o")), F.lit(0))).first()[0]


def write_blocks(homes: DataFrame) -> DataFrame:
    """The vectors of each block in a shared file: (dim, cell, block, path)."""
    folder = shared_folder(homes.sparkSession, "range-blocks")

    def run(t: pa.Table) -> pa.Table:
        x = t.column("embedding").combine_chunks()
        path = write_arrays(folder, {"x": x.flatten().to_numpy(zero_copy_only=False), **{n: t.column(n).to_numpy() for n in ("key", "m", "near")}})
        return pa.table({"dim": t.column("dim")[:1], "cell": t.column("cell")[:1], "block": t.column("block")[:1], "path": pa.array([path])})

    return stored(homes.groupBy("dim", "cell", "block").applyInArrow(run, "dim int, cell int, block int, path string"), "range")


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y have that cosine: by single precision, and by
    double where that is not sure."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    ux, uy = (x / nx[:, None]).astype(np.float32), (y / ny[:, None]).astype(np.float32).T
    margin = (x.shape[1] + 16) * 2.0 ** -22
    near = np.zeros((len(x), len(y)), bool)
    for i in range(0, len(x), 256):
        s = ux[i:i + 256] @ uy
        part = near[i:i + 256]
        np.greater_equal(s, cosine + margin, out=part)
        a, b = np.nonzero((s >= cosine - margin) & ~part)
        if len(a) > 4096:
            part[:] = (x[i:i + 256] @ y.T) / (nx[i:i + 256, None] * ny[None, :]) >= cosine
        elif len(a):
            part[a, b] = (x[i + a] * y[b]).sum(axis=1) / (nx[i + a] * ny[b]) >= cosine
    return near


def roots(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest key that each row (keys a) and column (keys b) reaches over links."""
    la, lb, top = a.copy(), b.copy(), np.iinfo(np.int64).max
    while near.size:
        before = (la.copy(), lb.copy())
        for i in range(0, len(a), 256):
            low = np.where(near[i:i + 256], lb[None, :], top).min(axis=1)
            la[i:i + 256] = np.minimum(la[i:i + 256], low)
            lb = np.minimum(lb, np.where(near[i:i + 256], la[i:i + 256, None], top).min(axis=0))
        if (la == before[0]).all() and (lb == before[1]).all():
            break
    return la, lb


def join_blocks(members: DataFrame, blocks: DataFrame, reach: Reach, cosine: float) -> DataFrame:
    """(key, links, root): per vector that has links, itself too, and pair of
    blocks, the weight of its links and its root among the vectors linked there."""
    # as many rows as blocks visit cells; a block meets those of the cells it visits, the lower of both first
    cell = [F.col(n) for n in ("dim", "cell")]
    seen = members.select("dim", "own", "block", "cell").distinct()
    ends = blocks.select(*cell, F.col("block").alias("other"), F.col("path").alias("right"))
    at = blocks.select("dim", F.col("cell").alias("own"), "block", F.col("path").alias("left"))
    pairs = seen.join(at, ["dim", "own", "block"]).join(ends, ["dim", "cell"]).select(
        "dim", *[F.when(F.col("left") <= F.col("right"), F.struct(*one)).otherwise(F.struct(*two)).alias(n) for n, one, two in (
            ("a", (F.col("left").alias("path"), F.col("own").alias("cell")), (F.col("right").alias("path"), F.col("cell").alias("cell"))),
            ("b", (F.col("right").alias("path"), F.col("cell").alias("cell")), (F.col("left").alias("path"), F.col("own").alias("cell"))))]).distinct()
    # a number of its own: the rows are short, but each is work for a while
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = pairs.repartition(tasks, "a.path", F.pmod(F.xxhash64("b.path"), F.lit(PARTS))).sortWithinPartitions("a.path")

    def run(batches):
        held: dict[str, dict] = {}

        def block(path: str) -> dict:
            f = open_arrays(path)
            x = np.asarray(f["x"], np.float64).reshape(len(f["key"]), -1)
            return {"x": x, "unit": _unit(x), **{n: np.array(f[n]) for n in ("key", "m", "near")}}

        for batch in batches:
            for r in batch.to_pylist():
                d, (left, own), (right, other) = r["dim"], r["a"].values(), r["b"].values()
                if left not in held:
                    held = {left: block(left)}
                a, b = held[left], held[left] if left == right else block(right)
                i = np.flatnonzero(reach.meets(d, a["unit"], a["near"], own, other))
                j = np.flatnonzero(reach.meets(d, b["unit"], b["near"], other, own))
                near = linked(a["x"][i], b["x"][j], cosine)
                keep, also = near.any(axis=1), near.any(axis=0)
                near, i, j = near[keep][:, also], i[keep], j[also]
                if not near.size:
                    continue
                la, lb = roots(near, a["key"][i], b["key"][j])
                links = [np.rint(near[k:k + 256] @ b["m"][j].astype(np.float64)).astype(np.int64) for k in range(0, len(near), 256)]
                out = [(a["key"][i], np.concatenate(links), la)]
                if left != right:
                    back = [np.rint(a["m"][i].astype(np.float64) @ near[:, k:k + 256]).astype(np.int64) for k in range(0, len(j), 256)]
                    out.append((b["key"][j], np.concatenate(back), lb))
                for key, count, root in out:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count), pa.array(root)], ["key", "links", "root"])

    return work.mapInArrow(run, "key long, links long, root long")


def _reach(homes: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> Reach:
    radii = {(r["dim"], r["cell"]): r["r"] for r in homes.groupBy("dim", "cell").agg(F.max("near").alias("r")).collect()}
    return Reach(pivots, radii, math.sqrt(2 - 2 * cosine))


def parted(equal: DataFrame, cosine: float, block: int, max_pivots: int) -> tuple[DataFrame, Reach]:
    """Distinct vectors (key, m, embedding) -> the same with dim, cell, the
    distance to its pivot and block, written; and the cells they reach."""
    n = equal.count()
    wanted = min(max_pivots, max(MIN_PIVOTS, n // block))
    sample: dict[int, list] = {}
    for r in equal.orderBy(F.xxhash64("embedding")).limit(SAMPLE * wanted).select("embedding").collect():
        sample.setdefault(len(r["embedding"]), []).append(r["embedding"])
    pivots = {d: choose_pivots(_unit(np.array(v, np.float64)), wanted) for d, v in sample.items()}
    homes = stored(assign(equal, pivots), "range")
    size = homes.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))     # a row per cell: MAX_PIVOTS and the lengths without one
    homes = homes.join(F.broadcast(size), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("_n")).cast("int")).drop("_n")
    return homes, _reach(homes, pivots, cosine)


def cells(equal: DataFrame, cosine: float = COSINE, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Distinct vectors (key, m, embedding) -> the visits of all cells."""
    return visits(*parted(equal, cosine, block, max_pivots))


def range_join(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id per row."""
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "embedding", usable().alias("ok")), "range")
    equal = rows.where("ok").groupBy("embedding").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low"))
    equal = stored(equal.withColumn("key", F.monotonically_increasing_id()), "range")
    homes, reach = parted(equal, cosine, block, max_pivots)
    found = stored(join_blocks(visits(homes, reach), write_blocks(homes), reach, cosine), "range")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    each = equal.join(links, "key", "left").na.fill(0, ["links"]).join(comp.withColumnRenamed("id", "key"), "key", "left") \
        .select("embedding", "low", "links", F.coalesce("component", "key").alias("component"))
    each = stored(each, "range")
    lows = each.groupBy("component").agg(F.min("low").alias("component_id"))
    each = each.join(lows, "component").select(F.col("embedding").alias("_e"), (F.col("links") - 1).alias("n_links"), "component_id")
    out = rows.join(each, F.col("ok") & (F.col("embedding") == F.col("_e")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"))


def op10_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = range_join(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
