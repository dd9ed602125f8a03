"""Hard negatives by an STR-packed R-tree over integer vectors.

Vectors are sorted into slabs by their most varying coordinate, the slabs by
the next one (two range partitionings), and cut into tiles of ``TILE`` vectors;
a task packs its tiles by further coordinates into pages of ``PAGE`` vectors.
Tiles are files of the shared folder, with the minimum bounding box of each
page, and node files hold the boxes of up to ``FAN`` tiles.

A box bounds every inner product with an anchor: per coordinate the product
lies between those with the box's two sides.  Anchors, in blocks of ``ANCHORS``
that lie close together, search the tree best bound first: first for their
positives, then for the negatives of all their positives at once.  A box is
left out for an anchor if it lies outside of all its score windows or strictly
below the score of the last place; ties therefore stay exact.  A task holds one
block of anchors, one tile, and one number for each tile of the tree.

Rows without vec_id, label or vector, or with a null or non-finite component,
take no part.  Shorter vectors count as if zeros followed.  Rows with equal
vec_id are rows of their own: an anchor is not its own positive, but a row with
the same vec_id may be.  Inner products are 64-bit integers.  Other columns are
ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import shared_folder, stored, table
from riskloom.llm.shared_files import open_arrays, write_arrays
from riskloom.llm.words import run_positions

PAGE = 256
TILE = 4096
FAN = 256
ANCHORS = 512
SLAB_ROWS = 1 << 20         # vectors of a task that packs tiles
SCALE = 256
POSITIVES = NEGATIVES = 5
LOWEST, HIGHEST = 4, 5      # a negative's score is at least 4/5 of the positive's, and no higher
NONE = -(1 << 62)
EXACT = 1 << 53


def usable_vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, q (integer vector), row of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return stored(
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
        .select(F.col("vec_id").cast("long"), label.cast("long").alias("label"),
                F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long")).alias("q"),
                F.monotonically_increasing_id().alias("row")), "vectors")


def integers(col: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as a matrix, with zeros behind shorter ones."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), width), np.int64)
    out[np.repeat(np.arange(len(col)), size), run_positions(size)] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def coordinates(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Length of the longest vector, largest component, and the coordinates
    from the most varying to the least."""
    def moments(batches):
        for b in batches:
            size = np.diff(b.column("q").offsets.to_numpy())
            x = integers(b.column("q"), int(size.max(initial=0))).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], len(x), np.float64)), pa.array(x.sum(0)),
                 pa.array((x * x).sum(0)), pa.array(np.abs(x).max(0, initial=0))], ["at", "n", "s", "ss", "top"])

    rows = (vectors.select("q").mapInArrow(moments, "at long, n double, s double, ss double, top double")
            .groupBy("at").agg(F.max("top").alias("top"), (F.sum("ss") - F.sum("s") ** 2 / F.sum("n")).alias("spread")).collect())
    order = [r["at"] for r in sorted(rows, key=lambda r: (-r["spread"], r["at"]))]
    return max(len(rows), 1), int(max((r["top"] for r in rows), default=0)), order


def leading(order: list[int]) -> list[Column]:
    """The two most varying coordinates of a vector as columns."""
    return [F.coalesce(F.get("q", F.lit(j)), F.lit(0)) for j in (order + order)[:2]] or [F.col("row"), F.col("row")]


def pack_pages(q: np.ndarray, order: list[int]) -> list[np.ndarray]:
    """Sort-tile recursion in halves, one coordinate after the other."""
    def cut(at: np.ndarray, k: int) -> list[np.ndarray]:
        if len(at) <= PAGE:
            return [at]
        if order:
            at = at[np.argsort(q[at, order[k % len(order)]], kind="stable")]
        half = -(-len(at) // PAGE) // 2 * PAGE
        return cut(at[:half], k + 1) + cut(at[half:], k + 1)
    return cut(np.arange(len(q)), 2)


def packer(folder: str, width: int, order: list[int]):
    """Function of mapInArrow: sorted vectors to tile and node files; one row
    (node) a node file."""
    def tile_file(rows: pa.Table) -> tuple[str, np.ndarray, np.ndarray]:
        q = integers(rows.column("q"), width)
        pages = pack_pages(q, order)
        at = np.concatenate(pages)
        start = np.cumsum([0] + [len(p) for p in pages])
        low, high = (np.stack([f(q[p], axis=0) for p in pages]) for f in (np.min, np.max))
        arrays = {c: rows.column(c).to_numpy()[at] for c in ("vec_id", "label", "row")}
        name = write_arrays(folder, arrays | {"q": q[at].ravel(), "start": start, "low": low.ravel(), "high": high.ravel()})
        return name, low.min(0), high.max(0)

    def node_file(tiles: list) -> str:
        names = "\n".join(t[0] for t in tiles).encode()
        return write_arrays(folder, {"names": np.frombuffer(names, np.uint8), "low": np.concatenate([t[1] for t in tiles]),
                                     "high": np.concatenate([t[2] for t in tiles])})

    def run(batches):
        held, tiles, nodes = [], [], []
        waiting = 0
        for b in batches:
            held.append(b)
            waiting += b.num_rows
            if waiting >= TILE:
                rows = pa.Table.from_batches(held)
                whole = waiting // TILE * TILE
                tiles += [tile_file(rows.slice(k, TILE)) for k in range(0, whole, TILE)]
                held, waiting = rows.slice(whole).to_batches(), waiting - whole
            while len(tiles) >= FAN:
                nodes.append(node_file(tiles[:FAN]))
                tiles = tiles[FAN:]
        if waiting:
            tiles.append(tile_file(pa.Table.from_batches(held)))
        if tiles:
            nodes.append(node_file(tiles))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string())], ["node"])

    return run


def pack_tree(vectors: DataFrame, width: int, order: list[int]) -> list[str]:
    """Names of the node files of a new tree; one per FAN tiles and task."""
    spark = vectors.sparkSession
    tiles = max(1, math.ceil(vectors.count() / TILE))
    first, second = leading(order)
    slabs = vectors.repartitionByRange(math.ceil(math.sqrt(tiles)), first, "row").withColumn("slab", F.spark_partition_id())
    parts = max(1, math.ceil(tiles * TILE / SLAB_ROWS), min(tiles, spark.sparkContext.defaultParallelism))
    key = ["slab", second, "row"]
    packed = slabs.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("vec_id", "label", "row", "q")
    nodes = stored(packed.mapInArrow(packer(shared_folder(spark, "rtree"), width, order), "node string"), "nodes")
    return [r["node"] for r in nodes.collect()]


class Firsts:
    """The first k (score, id) of each of n lists; higher scores first, then
    smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def better(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (a row a list, a column an id) would enter a list."""
        last = self.score[lists, -1][:, None]
        return (score > last) | ((score == last) & (ids[None, :] < self.id[lists, -1][:, None]))

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        w = np.concatenate([np.repeat(touched, self.k), lists])
        s = np.concatenate([self.score[touched].ravel(), score.astype(np.int64)])
        i = np.concatenate([self.id[touched].ravel(), ids])
        by = np.lexsort((i, -s, w))
        w, s, i = w[by], s[by], i[by]
        at = run_positions(np.unique(w, return_counts=True)[1])
        keep = at < self.k
        self.score[w[keep], at[keep]] = s[keep]
        self.id[w[keep], at[keep]] = i[keep]


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every anchor with every box."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def best_first(anchors: np.ndarray, nodes: list[str], floor, wanted, take) -> None:
    """Opens tiles, and pages in them, by their best bound.  ``floor()``: the
    least score that any anchor still wants; ``wanted(low, high)``: a flag for
    each anchor; ``take(who, scores, tile, rows)`` gets the scores of a page."""
    kind, width = anchors.dtype, anchors.shape[1]
    queue = []
    for name in nodes:
        node = open_arrays(name)
        box = [node[c].reshape(-1, width).astype(kind) for c in ("low", "high")]
        top = bounds(anchors, *box)[1].max(0)
        queue += zip((-top).tolist(), bytes(node["names"]).decode().split("\n"))
    heapq.heapify(queue)
    while queue and -queue[0][0] >= floor():
        tile = open_arrays(heapq.heappop(queue)[1])
        low, high = bounds(anchors, *[tile[c].reshape(-1, width).astype(kind) for c in ("low", "high")])
        pages = list(zip((-high.max(0)).tolist(), range(high.shape[1])))
        heapq.heapify(pages)
        while pages and -pages[0][0] >= floor():
            p = heapq.heappop(pages)[1]
            who = np.flatnonzero(wanted(low[:, p], high[:, p]))
            if len(who):
                rows = slice(int(tile["start"][p]), int(tile["start"][p + 1]))
                q = tile["q"].reshape(-1, width)[rows].astype(kind)
                take(who, anchors[who] @ q.T, tile, rows)


def mine(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, anchors: np.ndarray, nodes: list[str]) -> list[np.ndarray]:
    """Columns of the result for one block of anchors."""
    n = len(ids)
    same = Firsts(n, POSITIVES)

    def take_same(who, score, tile, at):
        ok = (labels[who][:, None] == tile["label"][at][None, :]) & (rows[who][:, None] != tile["row"][at][None, :])
        i, j = np.nonzero(ok & same.better(who, score, tile["vec_id"][at]))
        same.add(who[i], score[i, j], tile["vec_id"][at][j])

    best_first(anchors, nodes, lambda: same.score[:, -1].min(), lambda low, high: high >= same.score[:, -1], take_same)

    has = same.score > NONE
    most = np.where(has, same.score, NONE)
    least = np.where(has, -((-LOWEST * np.where(has, same.score, 0)) // HIGHEST), -NONE)
    lists = np.arange(n * POSITIVES).reshape(n, POSITIVES)
    other = Firsts(n * POSITIVES, NEGATIVES)

    def need() -> np.ndarray:
        return np.maximum(least, other.score[:, -1].reshape(n, POSITIVES))

    def wanted(low, high):
        return ((high[:, None] >= need()) & (low[:, None] <= most) & (least <= most)).any(1)

    def take_other(who, score, tile, at):
        differs = labels[who][:, None] != tile["label"][at][None, :]
        for k in range(POSITIVES):
            ok = differs & (score <= most[who, k][:, None]) & (score >= least[who, k][:, None])
            i, j = np.nonzero(ok & other.better(lists[who, k], score, tile["vec_id"][at]))
            other.add(lists[who[i], k], score[i, j], tile["vec_id"][at][j])

    best_first(anchors, nodes, lambda: need()[least <= most].min(initial=-NONE), wanted, take_other)

    found = other.score > NONE
    at, rank = np.nonzero(found)
    who, k = at // POSITIVES, at % POSITIVES
    return [ids[who], same.id[who, k], (rank + 1).astype(np.int32), other.id[found], same.score[who, k], other.score[found]]


def hard_negatives(embeddings: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score of every anchor, positive and negative in the window.
    ``label`` over the columns of ``embeddings``, ``anchor`` over vec_id."""
    vectors = usable_vectors(embeddings, label)
    width, largest, order = coordinates(vectors)
    kind = np.float64 if width * largest * largest < EXACT else np.int64
    nodes = pack_tree(vectors, width, order)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def search(batches):
        held, waiting = [], 0

        def result(rows: pa.Table):
            columns = mine(*[rows.column(c).to_numpy() for c in ("vec_id", "label", "row")],
                           integers(rows.column("q"), width).astype(kind), nodes)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for b in batches:
            held.append(b)
            waiting += b.num_rows
            while waiting >= ANCHORS:
                rows = pa.Table.from_batches(held)
                yield result(rows.slice(0, ANCHORS))
                held, waiting = rows.slice(ANCHORS).to_batches(), waiting - ANCHORS
        if waiting:
            yield result(pa.Table.from_batches(held))

    chosen = vectors.filter(anchor)
    tasks = max(1, math.ceil(chosen.count() / ANCHORS), embeddings.sparkSession.sparkContext.defaultParallelism)
    near = [*leading(order), F.col("row")]
    return (chosen.repartitionByRange(tasks, *near).sortWithinPartitions(*near).select("vec_id", "label", "row", "q")
            .mapInArrow(search, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First negatives of every positive of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
