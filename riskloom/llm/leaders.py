"""Linking within buckets without listing pairs.

Every bucket elects its smallest id as leader, and members that it does not
match elect again, ``ROUNDS`` times; each round verifies a pair a row.  The
links found part a bucket's members into components.  Then comes the exact
pass: members outside their bucket's largest component are compared with all
members of other components and of like size, in blocks of bounded rows and
bytes inside tasks.  A row goes once to each of its blocks, and buckets that
fit into a block are not cut by size.  Every text marks the bits of its items in
a short row; two texts differ in an item at least for every bit that one of them
lacks, so most pairs are known to be too far apart before they are compared.  A
block gives only links that join two components, so at most one a row.  No
member, pair or bucket is capped: the components are those of all verified
pairs that share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import stored
from riskloom.llm.components import connected_components

ROUNDS = 2
BLOCK = 2048                # rows of a side of a block
BLOCK_BYTES = 1 << 22       # bytes of text of a side of a block
SOME = 512                  # rows of small blocks that are compared together
CANDIDATES = 1 << 18        # pairs that are looked at together
MARKED = 1 << 23            # bits of texts that are marked together
PAIRS = 1 << 13             # pairs whose keys are compared together
NO_KEY = 0                  # in place of a key that a text lacks
STEP = 1.26                 # sizes of linked texts differ less than by this factor


class Rule(NamedTuple):
    """When two texts are linked."""
    items: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]      # hashes of all texts one after the other, how many of each
    far: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]     # no link between texts of so many items with so many or more not in common
    same: Callable[[np.ndarray, np.ndarray], bool]


def _led(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets with two and more, with the bucket's smallest id as
    ``lead`` and its number of rows as ``n``."""
    bucket = Window.partitionBy("bucket")
    return rows.select("id", "j", "bucket", F.min("id").over(bucket).alias("lead"), F.count(F.lit(1)).over(bucket).alias("n")).where("n > 1")


def bucket_rows(sketches: DataFrame) -> DataFrame:
    """(id, keys array<long>) -> (id, j, bucket, lead, n), buckets of two ids
    and more only."""
    return _led(sketches.select("id", F.posexplode("keys").alias("j", "bucket")).where(F.col("bucket") != NO_KEY))


def _marks(items: np.ndarray, size: np.ndarray, bits: int | None = None) -> np.ndarray:
    """A row of bits a text, in words of 64; every item sets one.  As many bits
    as four usual texts have items, or ``bits``."""
    bits = bits or mark_bits(items, size)
    out = np.empty((len(size), bits // 64), np.uint64)
    end, step = np.cumsum(size), max(MARKED // bits, 1)
    for p in range(0, len(size), step):
        q = min(p + step, len(size))
        seen = np.zeros((q - p, bits), bool)
        part = items[end[p] - size[p]:end[q - 1]]
        seen.ravel()[np.repeat(np.arange(q - p) * bits, size[p:q]) + (part & W.U(bits - 1)).astype(np.int64)] = True
        out[p:q] = np.packbits(seen, axis=1).view(np.uint64)
    return out


def mark_bits(items: np.ndarray, size: np.ndarray) -> int:
    return 1 << min(max(int(4 * len(items) // max(len(size), 1)).bit_length(), 9), 14)


def _apart(marks: np.ndarray, i: np.ndarray, others: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Bits that only one of two texts has."""
    return np.bitwise_count(marks[i] ^ others[k]).sum(axis=1, dtype=np.int64)


def verified(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts (a, x, b, y) -> (a, b, ok); the items of a text
    that stands in several rows in a row are made once."""
    for batch in batches:
        for c in W.chunks(batch, "x"):
            a = c.column("a").to_numpy()
            new = np.diff(a, prepend=a[0] ^ 1) != 0
            (x, m), (y, n) = rule.items(c.column("x").filter(pa.array(new))), rule.items(c.column("y"))
            i, k = np.cumsum(new) - 1, np.arange(len(a))
            bits = mark_bits(y, n)
            ok = ~rule.far(m[i], n, 0)
            mine, others, x_end, y_end = _marks(x, m, bits), _marks(y, n, bits), np.cumsum(m), np.cumsum(n)
            for p in range(0, len(a), PAIRS):
                q = slice(p, p + PAIRS)
                ok[q] &= ~rule.far(m[i[q]], n[q], _apart(mine, i[q], others, k[q]))
            for t in np.flatnonzero(ok).tolist():
                s = i[t]
                ok[t] = rule.same(x[x_end[s] - m[s]:x_end[s]], y[y_end[t] - n[t]:y_end[t]])
            yield pa.RecordBatch.from_arrays([c.column("a"), c.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs (a, b) and texts (id, text) -> (a, b, ok)."""
    def run(batches):
        return verified(batches, rule)

    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b") \
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, ok boolean")


def _blocks(batches) -> Iterator[pa.Table]:
    """Whole blocks, which lie one after the other; small ones together, up to
    SOME rows or the bytes of one side of a block."""
    held, last, rows, size = [], None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column("block").to_numpy()
        end = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        p = 0
        for q in [*([0] if held and block[0] != last else []), *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()]:
            if rows + q - p >= SOME or size + end[q] - end[p] >= BLOCK_BYTES:
                held.append(b.slice(p, q - p))
                yield pa.Table.from_batches(held).combine_chunks()
                held, p, rows, size = [], q, 0, 0
        held.append(b.slice(p))
        last, rows, size = block[-1], rows + b.num_rows - p, size + int(end[-1] - end[p])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dense(own: pa.ListArray) -> np.ndarray:
    """Lists of (j, bucket) as one row of keys each, NO_KEY between them."""
    j, bucket = (x.to_numpy() for x in own.flatten().flatten())
    keys = np.full((len(own), int(j.max(initial=-1)) + 1), NO_KEY, np.int64)
    keys[np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())), j] = bucket
    return keys


def _candidates(left: np.ndarray, code: np.ndarray, has: np.ndarray, has_at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a text on the left and one on the right of its block; all of a
    text's pairs together, about CANDIDATES at a time."""
    n = has_at[code + 1] - has_at[code]
    cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // CANDIDATES, prepend=-1)) if len(left) else []
    for p, q in zip(cuts, [*cuts[1:], len(left)]):
        yield np.repeat(left[p:q], n[p:q]), has[np.repeat(has_at[code[p:q]], n[p:q]) + W.run_positions(n[p:q])]


def join_block(t: pa.Table, rule: Rule) -> tuple[list[int], list[int]]:
    """Links (a, b) that join components, of one block or of several, told
    apart by ``block``.  A pair is left to the first bucket that both texts
    share."""
    left, right, main, low, j = (t.column(c).to_numpy() for c in ("left", "right", "main", "low", "j"))
    key = t.column("id").to_numpy()
    keys = _dense(t.column("own").combine_chunks())
    _, group = np.unique(t.column("component").to_numpy(), return_inverse=True)
    block = np.unique(t.column("block").to_numpy(), return_inverse=True)[1] if "block" in t.column_names else np.zeros(len(key), np.int64)
    items, size = rule.items(t.column("text"))
    end = np.cumsum(size)
    marks = _marks(items, size)
    # the texts on the right, block by block
    has = np.flatnonzero(right)
    has = has[np.argsort(block[has], kind="stable")]
    has_at = np.searchsorted(block[has], np.arange(int(block.max(initial=-1)) + 2))
    own = np.flatnonzero(left)
    a, b = [], []
    for i, k in _candidates(own, block[own], has, has_at):
        # of two members outside the largest component, the smaller id is on the left
        asked = (group[k] != group[i]) & (main[k] | (key[k] > key[i])) & ~(low[k] & low[i])
        i, k = i[asked], k[asked]
        asked = ~rule.far(size[i], size[k], 0)
        i, k = i[asked], k[asked]
        asked = np.zeros(len(i), bool)
        for p in range(0, len(i), PAIRS):
            x, y = i[p:p + PAIRS], k[p:p + PAIRS]
            near = np.flatnonzero(~rule.far(size[x], size[y], _apart(marks, x, marks, y)))
            m, n = keys[x[near]], keys[y[near]]
            asked[p + near] = ~((m == n) & (m != NO_KEY) & (np.arange(keys.shape[1]) < j[x[near], None])).any(axis=1)
        for x, y in zip(i[asked].tolist(), k[asked].tolist()):
            if group[y] != group[x] and rule.same(items[end[x] - size[x]:end[x]], items[end[y] - size[y]:end[y]]):
                group[group == group[y]] = group[x]
                a.append(int(key[x]))
                b.append(int(key[y]))
    return a, b


def by_size(m: DataFrame) -> DataFrame:
    """Buckets beyond a block are cut by ``class``, the number of items, where
    it is known: linked texts are at most one class apart, so a member goes to
    its class and, as ``low``, to the next one; two low members met one class
    lower."""
    bucket = Window.partitionBy("bucket")
    big = F.col("class").isNotNull() & ((F.count(F.lit(1)).over(bucket) > BLOCK) | (F.sum("bytes").over(bucket) > BLOCK_BYTES))
    m = m.withColumn("big", big) \
        .withColumn("low", F.explode(F.when(F.col("big"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return m.withColumn("bucket", F.when(F.col("big"), F.xxhash64("bucket", F.col("class") + F.col("low").cast("int"))).otherwise(F.col("bucket"))) \
        .drop("class", "big")


def block_places(rows: DataFrame, sketches: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component, own, at): a row for every id that the exact pass needs,
    with its keys and its places in blocks, which are lists of a few numbers a
    key.  Texts are joined to it once an id, not once a key."""
    of = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(np.log(STEP))).cast("int") if "size" in sketches.columns else F.lit(None).cast("int")
    ids = texts.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    ids = ids.join(sketches.select("id", of.alias("class")), "id") if "size" in sketches.columns else ids.withColumn("class", of)
    ids = ids.join(connected_components(known), "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))
    bucket = Window.partitionBy("bucket")
    m = rows.where("n > 2 and id != lead").select("id", "j", "bucket").join(stored(ids, "rows"), "id") \
        .withColumn("least", F.min("component").over(bucket)).withColumn("most", F.max("component").over(bucket)) \
        .where("least < most").drop("least", "most").withColumn("key", F.col("bucket"))
    m = stored(by_size(m), "rows")
    size = m.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("low").alias("low"))
    size = size.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.max(F.struct("n", "component", "bytes")).alias("top"),
                                      F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("low").alias("low")) \
        .where("parts > 1 and not low")
    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES, F.lit(1.0))).cast("int")
    size = size.select("bucket", "most", parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("nl"), parts(F.col("n"), F.col("bytes")).alias("nr"))
    m = m.join(size, "bucket").withColumn("main", F.col("component") == F.col("most"))
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    at = lambda lb, rb, left, right: F.struct(F.xxhash64("bucket", lb, rb).alias("block"), "j", "main", "low", left.alias("left"), right.alias("right"))
    m = m.withColumn("l", part(F.col("nl"), 1)).withColumn("r", part(F.col("nr"), 2))
    # on the left of its blocks l, on the right of its blocks r; on both sides of the block of both
    on_left = F.transform(F.filter(upto(F.col("nr")), lambda x: ~F.col("main")), lambda x: at(F.col("l"), x, F.lit(True), x == F.col("r")))
    on_right = F.transform(F.filter(upto(F.col("nl")), lambda x: F.col("main") | (x != F.col("l"))), lambda x: at(x, F.col("r"), F.lit(False), F.lit(True)))
    return m.select("id", "component", F.struct("j", F.col("key").alias("bucket")).alias("own"), F.concat(on_left, on_right).alias("at")) \
        .groupBy("id").agg(F.first("component").alias("component"), F.collect_set("own").alias("own"), F.flatten(F.collect_list("at")).alias("at"))


def rest(rows: DataFrame, sketches: DataFrame, known: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): the links within buckets that the links ``known`` do not imply.
    A bucket's smallest id has been compared with all members already, and
    members of one component need no link."""
    both = block_places(rows, sketches, known, texts).join(texts.select("id", "text"), "id") \
        .select("id", "component", "own", "text", F.explode("at").alias("at")) \
        .select("at.block", "id", "at.j", "component", "at.main", "at.low", "at.left", "at.right", "own", "text") \
        .repartition("block").sortWithinPartitions("block")

    def run(batches):
        for t in _blocks(batches):
            a, b = join_block(t, rule)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def link(rows: DataFrame, sketches: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """rows of ``bucket_rows`` and texts (id, text) -> verified links (a, b),
    whose components are those of all pairs of a bucket."""
    known, cur = None, rows
    for k in range(ROUNDS):
        if k:   # members that the leader does not match; there is no other in a bucket of two
            good = known.where("ok").select(F.col("b").alias("id"), F.col("a").alias("lead"))
            cur = stored(_led(cur.where("n > 2 and id != lead").join(good, ["id", "lead"], "left_anti")), "rows")
        pairs = cur.where("id != lead").select(F.col("id").alias("b"), F.col("lead").alias("a")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        new = stored(verify(pairs, texts, rule), "links")
        known = new if known is None else known.unionByName(new)
    found = known.where("ok").select("a", "b")
    return found.unionByName(stored(rest(rows, sketches, found, texts, rule), "links"))
