"""Entity graph as two DataFrames and its node metrics (G1-G12, J11, J15,
U2, U3, P14, A32, F14, F16).

  vertices(id STRING 'type:value', type STRING, value STRING)
  edges(src STRING, dst STRING, edge_type STRING, shared_device STRING)   src < dst, one row per pair

Co-device edges (J15 / T17): the distinct cards of a device, ordered by their
text value, each linked to the next 4.  The (device, card) pairs are range
partitioned and sorted, and a scan links each row with the rows in front of it;
what a partition needs of those before is their last 4 rows, so a device shared
by millions of cards spreads over all tasks instead of one window partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import ROLES
from riskloom.operators.quantile import quantile_row
from riskloom.session import cut_lineage, written

# fixed node-type prefixes
NODE_TYPES = (("card", ROLES.card), ("device", ROLES.device), ("email", ROLES.email), ("address", ROLES.addr))


LIST = 1024     # neighbours in a list of PageRank


class Graph:
    """Vertices and edges; edges are built on first use (the co-device step
    runs jobs of its own)."""

    def __init__(self, vertices: DataFrame, edges_fn):
        self.vertices = vertices
        self._edges_fn = edges_fn
        self._edges = None
        self.degree_table: DataFrame | None = None      # of a stored graph

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = self._edges_fn()
        return self._edges


def node_id(kind: str, col: Column) -> Column:
    """typed node id."""
    return F.concat(F.lit(kind + ":"), col.cast("string"))


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """P14 + A32: distinct non-null (a, b) pairs as text."""
    return df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) \
        .na.drop().dropDuplicates()


def device_cards(df: DataFrame, card: str = ROLES.card, device: str = ROLES.device) -> DataFrame:
    """(dev, card), distinct, in sorted range partitions, with their numbers."""
    pairs = _pairs(df, device, card).withColumnsRenamed({"a": "dev", "b": "card"})
    return cut_lineage(pairs.repartitionByRange("dev", "card").sortWithinPartitions("dev", "card")
                       .withColumn("_pid", F.spark_partition_id()))


def co_device_links(lists: DataFrame, next_k: int = 4) -> DataFrame:
    """(dev, c1, c2): every card of a device with each of the next ``next_k``."""
    def rows(batches: Iterator[pa.RecordBatch], held: pa.Table) -> Iterator[tuple[pa.Table, int]]:
        """Each batch behind the rows in front of it, and how many those are."""
        for batch in batches:
            if batch.num_rows:
                here = pa.concat_tables([held, pa.Table.from_batches([batch]).select(["dev", "card"])]).combine_chunks()
                yield here, held.num_rows
                held = here.slice(max(0, here.num_rows - next_k))

    def empty(batch_schema: pa.Schema) -> pa.Table:
        return pa.schema([batch_schema.field("dev"), batch_schema.field("card")]).empty_table()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pid = None, None
        for batch in batches:
            if batch.num_rows:
                pid = batch.column("_pid")[0].as_py()
                for here, _ in rows([batch], empty(batch.schema) if held is None else held):
                    held = here.slice(max(0, here.num_rows - next_k))
        if pid is not None:
            yield pa.RecordBatch.from_pydict({"_pid": pa.array([pid], pa.int32()), "dev": [held["dev"].to_pylist()], "card": [held["card"].to_pylist()]})

    ends = sorted(lists.mapInArrow(last, "_pid int, dev array<string>, card array<string>").collect(), key=lambda r: r["_pid"])
    before: dict[int, list[tuple[str, str]]] = {}
    run: list[tuple[str, str]] = []
    for r in ends:
        before[r["_pid"]] = run
        run = [*run, *zip(r["dev"], r["card"])][-next_k:]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                front = before[batch.column("_pid")[0].as_py()]
                schema = empty(batch.schema).schema
                held = pa.table({"dev": pa.array([d for d, _ in front], schema.field("dev").type),
                                 "card": pa.array([c for _, c in front], schema.field("card").type)}, schema=schema)
            for here, known in rows([batch], held):
                held = here.slice(max(0, here.num_rows - next_k))
                for k in range(1, next_k + 1):
                    start = max(known, k)
                    if start < here.num_rows:
                        new, old = here.slice(start), here.slice(start - k, here.num_rows - start)
                        links = pa.table({"dev": new["dev"], "c1": old["card"], "c2": new["card"]})
                        yield from links.filter(pc.equal(new["dev"], old["dev"])).to_batches()

    return lists.mapInArrow(link, "dev string, c1 string, c2 string")


def co_device_edges(df: DataFrame, card: str = ROLES.card, device: str = ROLES.device, next_k: int = 4) -> DataFrame:
    links = co_device_links(device_cards(df, card, device), next_k)
    # the cards of a device ascend, and so do their ids
    return links.select(node_id("card", F.col("c1")).alias("src"), node_id("card", F.col("c2")).alias("dst"),
                        F.col("dev").alias("shared_device"))


def build(df: DataFrame, next_k: int = 4) -> Graph:
    have = set(df.columns)
    # written once: every kind of vertex and edge reads it
    df = written(df.select(*[F.col(c).cast("string").alias(c) for _, c in NODE_TYPES if c in have]))
    verts = []
    for kind, col in NODE_TYPES:
        if col in have:
            v = df.select(F.col(col).cast("string").alias("value")).na.drop().distinct()
            verts.append(v.select(node_id(kind, F.col("value")).alias("id"), F.lit(kind).alias("type"), "value"))
    vertices = verts[0]
    for v in verts[1:]:
        vertices = vertices.unionByName(v)          # U2

    return Graph(vertices, lambda: _edges(df, have, next_k))


def _edges(df: DataFrame, have: set, next_k: int) -> DataFrame:
    card = ROLES.card
    parts = []
    lists = device_cards(df) if ROLES.device in have and card in have else None
    for kind, col, etype in (("device", ROLES.device, "card_device"), ("email", ROLES.email, "card_email"),
                             ("address", ROLES.addr, "card_address")):
        if col in have and card in have:
            p = lists.select(F.col("card").alias("a"), F.col("dev").alias("b")) if kind == "device" else _pairs(df, card, col)
            a, b = node_id("card", F.col("a")), node_id(kind, F.col("b"))
            parts.append(p.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"),
                                  F.lit(etype).alias("edge_type"), F.lit(None).cast("string").alias("shared_device")))
    if lists is not None:
        # One row per card pair; last writer in the reference -> keep the max device
        co = co_device_links(lists, next_k).groupBy("c1", "c2").agg(F.max("dev").alias("shared_device")) \
            .select(node_id("card", F.col("c1")).alias("src"), node_id("card", F.col("c2")).alias("dst"),
                    F.lit("co_device").alias("edge_type"), "shared_device")
        parts.append(co)
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)                # U3 (types never overlap on a pair)
    return edges


def stored(g: Graph) -> Graph:
    """The graph with its vertices, edges and degrees written, for plans that
    read them more than once."""
    if g.degree_table is not None:
        return g
    edges = written(g.edges)
    out = Graph(written(g.vertices), lambda: edges)
    out.degree_table = written(degrees(out))
    return out


def graph_counts(g: Graph) -> DataFrame:
    """G6."""
    return g.vertices.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(
        g.edges.agg(F.count(F.lit(1)).alias("n_edges")))


def adjacency(g: Graph) -> DataFrame:
    """Symmetrised edges (node, nbr)."""
    ways = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")),
                             F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"))))
    return g.edges.select(ways.alias("_e")).select("_e.*")


def degrees(g: Graph) -> DataFrame:
    """G7 + G11: degree and neighbours by type; isolated vertices get 0."""
    if g.degree_table is not None:
        return g.degree_table
    adj = adjacency(g)
    d = adj.groupBy("node").agg(
        F.count(F.lit(1)).alias("graph_degree"),
        F.count_if(F.col("nbr").startswith("device:")).alias("graph_n_device_neighbors"),
        F.count_if(F.col("nbr").startswith("email:")).alias("graph_n_email_neighbors"),
        F.count_if(F.col("nbr").startswith("card:")).alias("graph_n_co_device_cards"),
        F.count_if(F.col("nbr").startswith("address:")).alias("graph_n_address_neighbors"))
    out = g.vertices.select(F.col("id").alias("node"), "type").join(d, "node", "left")
    return out.na.fill(0, subset=[c for c in d.columns if c != "node"])


def clustering(g: Graph) -> DataFrame:
    """Local clustering 2T / (d (d - 1)), 0 when d < 2.  Triangles by the
    degree-ordered edge iterator: each edge points from the lower to the
    higher (degree, id) end, so a node only pairs its *higher* neighbours
    (out-degree <= sqrt(2E)); a wedge closes when its far pair is an edge.
    Where every edge has a card, only wedges with a card at a far end are made."""
    deg = degrees(g).select("node", "graph_degree")
    e = g.edges.select("src", "dst")
    ds = deg.select(F.col("node").alias("src"), F.col("graph_degree").alias("ds"))
    dd = deg.select(F.col("node").alias("dst"), F.col("graph_degree").alias("dd"))
    o = e.join(ds, "src").join(dd, "dst")
    lower_first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    oriented = o.select(F.when(lower_first, F.col("src")).otherwise(F.col("dst")).alias("u"),
                        F.when(lower_first, F.col("dst")).otherwise(F.col("src")).alias("v"),
                        F.when(lower_first, F.col("dd")).otherwise(F.col("ds")).alias("dv"))
    oriented = cut_lineage(oriented)
    card = lambda c: F.col(c).startswith("card:")
    may_close = card("v") | F.lit(not oriented.filter(~card("u") & ~card("v")).isEmpty())
    a = oriented.filter(may_close).select("u", F.col("v").alias("a"), F.col("dv").alias("da"))
    b = oriented.select("u", F.col("v").alias("b"), F.col("dv").alias("db"), may_close.alias("both"))
    # the pair (v1, v2) ordered the same way as the orientation; a pair that comes both ways is taken once
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    wedges = a.join(b, "u").where(F.when(F.col("both"), first).otherwise(F.lit(True))).select(
        "u", F.when(first, F.col("a")).otherwise(F.col("b")).alias("v1"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v2"))
    closing = oriented.select(F.col("u").alias("v1"), F.col("v").alias("v2"))
    tri = wedges.join(closing, ["v1", "v2"]).select("u", "v1", "v2")
    per_node = tri.select(F.explode(F.array("u", "v1", "v2")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("_t"))
    out = deg.join(per_node, "node", "left").na.fill(0, subset=["_t"])
    d = F.col("graph_degree")
    return out.select("node", F.when(d < 2, F.lit(0.0)).otherwise(
        2.0 * F.col("_t") / (d * (d - 1))).alias("graph_clustering"))


def components(g: Graph) -> DataFrame:
    """Min-label propagation with pointer jumping; label = smallest
    vertex id reachable.  A step takes the smallest label around each vertex,
    then the label of that label, so labels travel twice as far each round.
    Rounds end when no label changes; each is a reliable checkpoint."""
    adj = cut_lineage(adjacency(g))
    labels = g.vertices.select(F.col("id").alias("node"), F.col("id").alias("label"))
    while True:
        prop = adj.join(labels.withColumnRenamed("node", "nbr").withColumnRenamed("label", "nl"), "nbr") \
            .groupBy("node").agg(F.min("nl").alias("nl"))
        # written once: both sides of the next join read it
        near = cut_lineage(labels.join(prop, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("nl", "label")).alias("label")))
        up = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(near.join(up, "label").select(
            "node", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("_chg")))
        labels = new.select("node", "label")
        if not new.agg(F.count_if("_chg")).first()[0]:
            break
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("graph_component_size"))
    return labels.join(sizes, "label").select("node", "graph_component_size", F.col("label").alias("component"))


def pagerank(g: Graph, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6,
             check_every: int = 5) -> DataFrame:
    """PageRank on the undirected graph (each edge both ways), uniform
    teleport, dangling mass spread uniformly; stop once the L1 change of one
    step < N * tol.

    The only dangling vertices of an undirected graph are isolated ones; they
    all carry the same value, which follows a scalar recurrence kept on the
    driver, so each step reads the previous ranks once (a linear plan).
    Convergence is tested every ``check_every`` steps, each block ending in a
    reliable checkpoint."""
    g = stored(g)
    n = g.vertices.count()
    outdeg = degrees(g).filter(F.col("graph_degree") > 0).select("node", F.col("graph_degree").alias("deg"))
    k_iso = n - outdeg.count()
    # neighbours lie in lists of about LIST, so a step sorts and joins lists instead of edges
    adj = written(adjacency(g).join(outdeg, "node").withColumn(
        "_list", F.pmod(F.xxhash64("nbr"), F.ceil(F.col("deg") / F.lit(LIST)))).groupBy("node", "_list").agg(
        F.collect_list("nbr").alias("nbrs"), (F.lit(1.0) / F.first("deg")).alias("w")).drop("_list"))
    linked = outdeg.select("node")
    pr = cut_lineage(linked.withColumn("pr", F.lit(1.0 / n)))
    p_iso = 1.0 / n

    def step(cur: DataFrame, dangling_share: float) -> DataFrame:
        contrib = adj.join(cur, "node").select(F.explode("nbrs").alias("node"), (F.col("pr") * F.col("w")).alias("x")) \
            .groupBy("node").agg(F.sum("x").alias("s"))
        return contrib.select("node", (F.lit((1 - alpha) / n + dangling_share) + alpha * F.col("s")).alias("pr"))

    done = 0
    while done < max_iter:
        block = min(check_every, max_iter - done)
        prev, prev_iso = pr, p_iso
        for i in range(block):
            share = alpha * k_iso * p_iso / n
            # the last step reads the ranks before it twice: once to step, once to compare
            prev, prev_iso = cut_lineage(pr) if i == block - 1 and i else pr, p_iso
            pr = prev
            pr, p_iso = step(pr, share), (1 - alpha) / n + share
        done += block
        both = cut_lineage(pr.join(prev.withColumnRenamed("pr", "old"), "node"))
        err = both.agg(F.sum(F.abs(F.col("pr") - F.col("old")))).first()[0] + k_iso * abs(p_iso - prev_iso)
        pr = both.select("node", "pr")
        if err < n * tol:
            break
    else:
        raise RuntimeError(f"PageRank did not converge in {max_iter} steps")
    iso = g.vertices.select(F.col("id").alias("node")).join(linked, "node", "left_anti").withColumn("pr", F.lit(p_iso))
    return pr.unionByName(iso).select("node", F.col("pr").alias("graph_pagerank"))


def node_features(g: Graph, with_pagerank: bool = True) -> DataFrame:
    """Per-node feature table (card nodes get the hub flag, G12/T20)."""
    g = stored(g)
    deg = degrees(g)
    out = deg.join(clustering(g), "node").join(components(g).drop("component"), "node")
    if with_pagerank:
        out = out.join(pagerank(g), "node")
    p95 = quantile_row(deg.filter(F.col("type") == "card"), {"_p95": ("graph_degree", 0.95)})
    out = out.crossJoin(F.broadcast(p95)).withColumn(
        "graph_is_hub", F.coalesce((F.col("graph_degree") > F.col("_p95")).cast("int"), F.lit(0))).drop("_p95")
    return out


ZERO_FEATURES = {"graph_degree": 0, "graph_pagerank": 0.0, "graph_clustering": 0.0, "graph_component_size": 1,
                 "graph_n_device_neighbors": 0, "graph_n_email_neighbors": 0, "graph_n_co_device_cards": 0,
                 "graph_n_address_neighbors": 0, "graph_is_hub": 0}


def transaction_graph_features(df: DataFrame, feats: DataFrame, card: str = ROLES.card) -> DataFrame:
    """Rows joined with their card node's features; unknown card -> zero
    record (component size 1)."""
    cols = [c for c in ZERO_FEATURES if c in feats.columns]
    f = feats.filter(F.col("node").startswith("card:")).select(F.col("node").alias("_node"), *cols)
    out = df.join(f, node_id("card", F.col(card)) == F.col("_node"), "left").drop("_node")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(ZERO_FEATURES[c])) for c in cols})


def graph_score(df: DataFrame, g: Graph, card: str = ROLES.card) -> DataFrame:
    """min(degree / max degree over all nodes, 1); unknown card -> 0."""
    deg = degrees(g)
    mx = deg.agg(F.max("graph_degree").alias("_mx"))
    cd = deg.filter(F.col("type") == "card").select(F.col("node").alias("_node"), F.col("graph_degree").alias("_gdeg"))
    out = df.join(cd, node_id("card", F.col(card)) == F.col("_node"), "left").crossJoin(F.broadcast(mx))
    # least() skips nulls: guard the unknown-card case explicitly
    s = F.when((F.col("_mx") > 0) & F.col("_gdeg").isNotNull(), F.least(F.col("_gdeg") / F.col("_mx"), F.lit(1.0)))
    return out.withColumn("graph_score", F.coalesce(s, F.lit(0.0))).drop("_node", "_gdeg", "_mx")
