"""Merkle manifest of a table by nested-struct rollup.

Leaves get their rank within their group (here: language) and the rank is cut
into digits of base ``2 ** DIGIT``.  ``DIGITS`` digits make a block of 4096
leaves; blocks are dealt over the tasks by one shuffle of digests, and inside a
block the digits are grouped away one after the other, each step nesting the
child structs in the struct of their parent, with the hashes of the binary
levels between.  The tops of the blocks are the leaves of the next round, until
every group has one top; the tops of the groups form a tree of their own.  On
the way down a block is brought together with the path from its top to the root
by a union and a grouping on the block's number, and ``transform`` and
``explode`` emit the proofs of its children: no join, and no row holds more
than one block.

Ranks come from a range partitioning whose row numbers are written with the
rows, so a language that holds a third of all rows is spread over many tasks,
and so are equal rows.  The driver sees one number a round, the largest group.

Null doc_id and null languages come first; a null column is hashed as ``-``.
Rows with equal doc_id are ordered by their leaf, so equal rows are leaves of
their own with equal hashes.  A lone leaf is its group's subroot, a lone subroot
the root.  Other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.llm.common import stored, table

DIGIT = 4                        # bits of a rank digit
DIGITS = 3                       # digits of a block: 4096 leaves
BLOCK_BITS = DIGIT * DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")     # fixed value: order of the hashed columns
PATH = "array<struct<sibling:string,later:boolean>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated inputs."""
    return F.sha2(F.concat(*parts), 256)


def row_hash(**values: Column) -> Column:
    """Hash of ``FIELDS``: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = [values.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their rank within ``key`` (from 0, by ``order``) and the
    size n of the key.  Rows that are equal in ``order`` are spread by a hash."""
    salt = F.xxhash64(F.monotonically_increasing_id())
    ranged = (rows.withColumn("_salt", salt).repartitionByRange("key", *order, "_salt")
              .sortWithinPartitions("key", *order, "_salt").drop("_salt")
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = stored(ranged, "ranked").withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("key").orderBy("_part")
    runs = runs.select("key", "_part", "_first", (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"),
                       F.sum("_rows").over(Window.partitionBy("key")).alias("n"))
    return (ranged.join(runs, ["key", "_part"])
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"))


def height(n: str) -> str:
    """Levels of a tree over n leaves: the bits of n - 1."""
    return f"IF({n} > 1, length(bin({n} - 1)), 0)"


def group_away(nodes: DataFrame, keys: list[str], digit: str, below: int) -> DataFrame:
    """One digit less: the nodes of ``keys`` become the children of one node,
    which also holds the hashes of each binary level over them.  ``below``:
    levels of the tree under these nodes; levels above the root are left out."""
    inner = [c for c in ("kids", "levels", "item") if c in nodes.columns]
    own = F.struct(F.col(digit).cast("int").alias("d"), "node", *inner)
    up = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("kids"))
    return up.withColumn("levels", F.expr(f"""
        aggregate(filter(sequence(1, {DIGIT}), l -> {below} + l <= {height('n')}),
                  CAST(array(kids.node) AS array<array<string>>),
                  (done, l) -> concat(done, array(transform(
                      sequence(0, size(element_at(done, -1)) - 1, 2),
                      i -> sha2(concat(get(element_at(done, -1), i), coalesce(get(element_at(done, -1), i + 1), '')), 256)))))
        """)).withColumn("node", F.expr("element_at(element_at(levels, -1), 1)"))


def roll_up(nodes: DataFrame, level: int) -> DataFrame:
    """(key, n, block, node, levels, kids): one row a block of nodes (key, n,
    rank, node and item, if any) that lie ``level`` levels above the leaves."""
    base = 1 << DIGIT
    digits = [f"d{i}" for i in range(DIGITS)]
    work = nodes.select("key", "n", F.shiftright("rank", BLOCK_BITS).alias("block"),
                        *[F.shiftright("rank", DIGIT * i).bitwiseAND(base - 1).alias(d) for i, d in enumerate(digits)],
                        "node", *[c for c in ("item",) if c in nodes.columns]).repartition("key", "block")
    for i, d in enumerate(digits):
        work = group_away(work, ["key", "n", "block", *digits[:i:-1]], d, level + DIGIT * i)
    return work


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves up, until every key has one block."""
    out, level = [], 0
    while True:
        out.append(stored(roll_up(nodes, level), "merkle"))
        if (out[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return out
        level += BLOCK_BITS
        nodes = out[-1].select("key", "n", F.col("block").alias("rank"), "node")


def step(digit: int) -> str:
    """Path of a child through the levels of its parent."""
    return f"""transform(filter(sequence(0, {digit - 1}), l -> l < size(levels) - 1),
                         l -> struct(get(levels[l], shiftright(kid.d, l) ^ 1) AS sibling, (shiftright(kid.d, l) & 1) = 1 AS later))"""


def descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Children of the blocks with their paths to the root.  ``above``: key,
    block, top (a struct of roots) and path of every block."""
    both = blocks.select("key", "block", "levels", "kids").unionByName(above, allowMissingColumns=True)
    work = both.groupBy("key", "block").agg(*[F.first(c, True).alias(c) for c in ("levels", "kids", "path", "top")])
    rank = F.col("block")
    for i in range(DIGITS):
        work = work.select("key", "top", "path", "levels", rank.alias("rank"), F.explode("kids").alias("kid"))
        last = i == DIGITS - 1
        work = work.select("key", "top", (F.col("rank") * (1 << DIGIT) + F.col("kid.d")).alias("rank"),
                           F.concat(F.expr(step(DIGIT)).cast(PATH), "path").alias("path"), *(
                               [F.col("kid")] if last else [F.col("kid.levels").alias("levels"), F.col("kid.kids").alias("kids")]))
        rank = F.col("rank")
    return work.select("key", "top", "rank", "path", "kid.node", *[f"kid.{c}" for c in ("item",) if c in work.schema["kid"].dataType.names])


def paths(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Every leaf of ``tables`` with its path; ``top``: key, top and path of
    the last round's blocks."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tables[1:]):
        above = descend(blocks, above).select("key", F.col("rank").alias("block"), "top", "path")
    return descend(tables[0], above)


def merkle_proofs(leaves: DataFrame, order: list[str]) -> DataFrame:
    """(key, item, node, subroot, root, path) of every row of ``leaves`` (key
    not null, node, item and the columns of ``order``).  The path runs from the
    leaf to the root: the sibling of each level (null: a run of one) and whether
    the node is the later of the two."""
    low = rounds(ranked(leaves, order).select("key", "n", "rank", "node", "item"))
    tops = low[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "node")
    high = rounds(ranked(tops, ["group"]).select("key", "n", "rank", "node", F.struct("group").alias("item")))
    root = high[-1].select("key", F.struct(F.col("node").alias("root")).alias("top"), F.array().cast(PATH).alias("path"))
    groups = paths(high, root).select(F.col("item.group").alias("key"), F.struct(F.col("node").alias("subroot"), "top.root").alias("top"), "path")
    return paths(low, groups).select("key", "item", "node", "top.subroot", "top.root", "path")


def proof_digest(path: str = "path") -> Column:
    return F.expr(f"sha2(array_join(transform({path}, p -> coalesce(p.sibling, '')), ''), 256)")


def fold(leaf: str, path: str = "path") -> Column:
    """Root that a leaf and its path lead to."""
    return F.expr(f"""aggregate({path}, {leaf}, (own, p) -> sha2(
        IF(p.later, concat(p.sibling, own), concat(own, coalesce(p.sibling, ''))), 256))""")


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents: key of the language, doc_id, node, and the item of
    doc_id and, where 7 divides the id's crc32, the leaf with n_chars + 1."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit & F.col("n_chars").isNotNull(), row_hash(n_chars=F.col("n_chars") + 1))
    return (docs.select(*FIELDS)
            .select(F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("key"), "doc_id",
                    row_hash().alias("node"), F.struct("doc_id", tampered.alias("tampered")).alias("item")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all
    documents."""
    proofs = merkle_proofs(manifest_leaves(table(spark, sf_dir, "documents")), ["doc_id", "node"])
    return (proofs.select("item.doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"),
                          fold("coalesce(item.tampered, node)").alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


ORACLE_SQL = """
WITH RECURSIVE t AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
), d AS (
    SELECT doc_id, lang, n_chars,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
           coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
           || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
           coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
           xor(list_reduce(list_concat([4294967295], list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
               lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS crc
    FROM documents, t
), leaf AS (
    SELECT doc_id, coalesce('1' || lang, '0') AS k, pos,
           sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS h,
           sha256(head || coalesce(octet_length(encode((n_chars + (crc % 7 = 0)::INT)::VARCHAR)) || ':' || (n_chars + (crc % 7 = 0)::INT), '-') || tail) AS seen
    FROM d
), low AS (
    SELECT k, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY k) AS n FROM leaf
    UNION ALL
    SELECT k, any_value(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM low WHERE n > 1 GROUP BY k, pos // 2
), sub AS (
    SELECT k, h AS subroot, lvl AS low_height, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
    SELECT '' AS k, 0 AS lvl, pos, subroot AS h, n FROM sub
    UNION ALL
    SELECT k, any_value(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM high WHERE n > 1 GROUP BY k, pos // 2
), root AS (SELECT h AS root, lvl AS high_height FROM high WHERE n = 1),
walk AS (
    SELECT doc_id, leaf.k, leaf.pos, 0 AS lvl, seen AS h, '' AS proof, leaf.h AS leaf, subroot, root,
           low_height, high_height, sub.pos AS sub_pos
    FROM leaf JOIN sub ON leaf.k = sub.k, root
    UNION ALL
    SELECT w.doc_id, w.k, CASE WHEN w.lvl + 1 = w.low_height THEN w.sub_pos ELSE w.pos // 2 END, w.lvl + 1,
           sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(a.h, b.h) || w.h ELSE w.h || coalesce(a.h, b.h, '') END),
           w.proof || coalesce(a.h, b.h, ''), w.leaf, w.subroot, w.root, w.low_height, w.high_height, w.sub_pos
    FROM (SELECT doc_id, k, CASE WHEN low_height = 0 AND lvl = 0 THEN sub_pos ELSE pos END AS pos, lvl, h, proof, leaf, subroot, root,
                 low_height, high_height, sub_pos FROM walk) w
    LEFT JOIN low a ON w.lvl < w.low_height AND a.k = w.k AND a.lvl = w.lvl AND a.pos = xor(w.pos, 1)
    LEFT JOIN high b ON w.lvl >= w.low_height AND b.lvl = w.lvl - w.low_height AND b.pos = xor(w.pos, 1)
    WHERE w.lvl < w.low_height + w.high_height
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM walk WHERE lvl = low_height + high_height
"""
