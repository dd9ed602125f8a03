"""Near-duplicate texts by Order MinHash.

A text is its lower-cased words; its k-mers are five words, each labelled with
how many equal ones came before.  Every sketch takes the ``MINIMA`` smallest
k-mers under its own hash and keeps them in text order; every two of them are a
key, so equal keys point to texts that agree in order as well: sensitive to edit
similarity, not only to sets.  Texts that share a key are verified by banded
alignment of whole texts: a link is 1 - edits / longer length of at least 0.8, in words.  Equal
texts are one class before any sketch is compared.

Texts shorter than five words have one k-mer, the whole text.  Texts without a
word (null, empty, blank) are equal texts.  Rows without doc_id link with
nothing.  Rows with
equal doc_id are one document if their texts are equal, and are linked as one
node otherwise.  An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import packed, stored, table
from riskloom.llm.components import connected_components
from riskloom.llm.leaders import NO_KEY, Rule, bucket_rows, link

K = 5
SKETCHES = 12
MINIMA = 4          # every two of a sketch's minima are a key
SIMILARITY = 0.8
BAND = 60            # edits that the first band allows
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(h: np.ndarray, n: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled k-mers of all texts in order, k-mers per text)."""
    per = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    begin = np.repeat(np.cumsum(n) - n, per) + W.run_positions(per)
    left = np.repeat(n, per) - W.run_positions(per)
    key = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            key = key * W.U(0x9FB21C651E98DF25) + np.where(i < left, h[np.minimum(begin + i, max(len(h) - 1, 0))], W.U(i + 1))
        doc = np.repeat(np.arange(len(n), dtype=np.uint64), per)
        both = W.mix(key + doc * W.U(0x9E3779B97F4A7C15))
        order = np.argsort(both, kind="stable")
        new = np.concatenate([[True], both[order][1:] != both[order][:-1]]) if len(both) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        nth = np.empty(len(both), np.int64)
        nth[order] = np.arange(len(both)) - np.repeat(first, np.diff(np.append(first, len(both))))
        return W.mix(key + nth.astype(np.uint64) * W.U(0xD6E8FEB86659FD93)), per


def sketch(h: np.ndarray, n: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """One row of keys per text with a word: for each sketch every two of its
    minima, in text order.  Texts with fewer k-mers than minima have NO_KEY in
    place of the pairs that they lack, and a lone k-mer stands as a pair."""
    x, per = kmers(h, n)
    per = per[per > 0]
    start = np.cumsum(per) - per
    pairs = [(p, q) for q in range(1, minima) for p in range(q)]
    out = np.empty((len(per), sketches * len(pairs)), np.uint64)
    if not len(per):
        return out
    text = np.repeat(np.arange(len(per)), per)
    with np.errstate(over="ignore"):
        for j in range(sketches):
            odd = W.mix(np.array([2 * j + 1], np.uint64))[0] | W.U(1)
            v = (x ^ (odd >> W.U(7))) * odd
            found = []
            for _ in range(minima):
                low = np.minimum.reduceat(v, start)
                at = np.flatnonzero(v == low[text])
                at = at[np.searchsorted(text[at], np.arange(len(per)))]
                found.append((np.where(low == NONE, NONE, x[at]), at))
                v[at] = NONE
            for k, (p, q) in enumerate(pairs):
                (a, at_a), (b, at_b) = found[p], found[q]
                swap = at_b < at_a
                key = W.mix(np.where(swap, b, a) * W.U(0x9FB21C651E98DF25) + W.mix(np.where(swap, a, b)) + W.U(j))
                out[:, j * len(pairs) + k] = key if k == 0 else np.where(b == NONE, NO_KEY, key)
    return out


def sketches_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, two hashes of the whole word sequence, sketch keys."""
    def run(batches):
        for b in batches:
            for c in W.chunks(b):
                h, n = W.word_hashes(c.column("text"))
                full = np.flatnonzero(n > 0)
                keys = sketch(h, n)
                seq = []
                at = (np.cumsum(n) - n)[full]
                for seed in (1, 2):
                    num = W.mix(np.arange(int(n.max(initial=0)), dtype=np.uint64) * W.U(0x9E3779B97F4A7C15) + W.U(seed))
                    with np.errstate(over="ignore"):
                        v = W.mix(h ^ num[W.run_positions(n)])
                        both = np.zeros(len(n), np.uint64)
                        if len(full):
                            both[full] = W.mix(np.add.reduceat(v, at) + n[full].astype(np.uint64))
                        seq.append(both)
                off = np.concatenate([[0], np.cumsum(n > 0)]).astype(np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(n.astype(np.int64)),
                     *(pa.array(s.view(np.int64)) for s in seq),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel().view(np.int64)))],
                    ["doc_id", "n_words", "h1", "h2", "keys"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return docs.mapInArrow(run, "doc_id long, n_words long, h1 long, h2 long, keys array<long>")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    same = ub[at] == ua
    return int(np.minimum(ca[same], cb[at[same]]).sum())


def _band(a: list[int], b: list[int], k: int) -> int | None:
    """Edit distance of two sequences if at most ``k``, else None: the band of
    2k + 1 diagonals is one column of bits, where bit t of column j is row
    j - k + t, and holds the steps of +1 and of -1 down the column."""
    m, n = len(a), len(b)
    width = 2 * k + 1
    full = (1 << width) - 1
    at: dict[int, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    many = max(16, m // 1000)       # words so frequent have their rows as one number: at most 1000 of them
    rows = {}
    for w, where in at.items():
        if len(where) > many:
            bits = np.zeros(m, np.uint8)
            bits[where] = 1
            rows[w] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    up = full & ~((1 << (k + 1)) - 1)
    down, low, stop = 0, k, k + n + k - m       # low: the distance on the lowest diagonal
    for j in range(1, n + 1):
        w, first = b[j - 1], j - k - 1
        same = 0
        if w in rows:
            same = (rows[w] >> first if first >= 0 else rows[w] << -first) & full
        elif w in at:
            where = at[w]
            where = where[bisect_left(where, first):bisect_right(where, first + width - 1)]
            if len(where) <= 16:
                for i in where:
                    same |= 1 << (i - first)
            else:
                bits = np.zeros(width, np.uint8)
                bits[np.array(where) - first] = 1
                same = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        up >>= 1
        down >>= 1
        up |= 1 << (width - 1)                  # below the band: one more than above
        still = ((((same & up) + up) ^ up) | same | down) & full
        more = ((down | ~(still | up)) << 1 | 1) & full
        less = ((still & up) << 1) & full
        low += 1 - (still >> (width - 1))
        if low > stop:
            return None
        up = (less | ~(still | more)) & full
        down = still & more
    under = n + k - m                           # rows of the band under the last row
    d = low - (up >> (width - under)).bit_count() + (down >> (width - under)).bit_count()
    return d if d <= k else None


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two word sequences if at most ``limit``, else None.
    Words and word pairs that the other text lacks bound the distance from
    below first; then the band widens until it holds the alignment."""
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    cut = int(diff[0]) if len(diff) else n
    a, b = a[cut:], b[cut:]
    n = min(len(a), len(b))
    if n:
        diff = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
        cut = int(diff[0]) if len(diff) else n
        a, b = a[:len(a) - cut], b[:len(b) - cut]
    long = max(len(a), len(b))
    if not len(a) or not len(b):
        return long if long <= limit else None
    apart = abs(len(a) - len(b))
    if apart > limit or long - _common(a, b) > limit:
        return None
    if min(len(a), len(b)) > 1:
        with np.errstate(over="ignore"):
            p, q = (x[:-1] * W.U(0x9FB21C651E98DF25) + x[1:] for x in (a, b))
        if -(-(long - 1 - _common(p, q)) // 2) > limit:
            return None
    x, y = a.tolist(), b.tolist()
    k = min(limit, max(apart, BAND))
    while True:
        d = _band(x, y, k)
        if d is not None or k == limit:
            return d
        k = min(limit, 4 * k)


def rule(similarity: float = SIMILARITY) -> Rule:
    """Texts are linked by the edit distance of their words."""
    def items(col):
        return W.word_hashes(col)

    def limit(long):
        return np.floor((1 - similarity) * long + 1e-9).astype(np.int64)

    def far(m, n, apart):
        long = np.maximum(m, n)
        return np.minimum(np.minimum(m, n), (m + n - apart) // 2) < long - limit(long)

    def same(a, b):
        return edits_within(a, b, int(limit(np.int64(max(len(a), len(b)))))) is not None

    return Rule(items, far, same)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every document in a class of two and more."""
    sk = stored(sketches_of(docs), "omh")
    equal = sk.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"))
    member = stored(sk.join(equal, ["h1", "h2"]).select("doc_id", "id").distinct(), "omh")
    one = sk.join(equal.select("id").distinct(), sk["doc_id"] == F.col("id"), "left_semi").dropDuplicates(["doc_id"]) \
        .select(F.col("doc_id").alias("id"), "keys", F.col("n_words").alias("size"))
    one = stored(one, "omh")
    rows = stored(bucket_rows(one), "omh")
    wanted = rows.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    links = link(rows, one, stored(texts, "omh"), rule())
    # a doc_id with several texts ties their classes together
    ties = member.where(F.col("doc_id") != F.col("id")).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    comp = connected_components(links.unionByName(ties))
    return comp.select(F.col("id").alias("doc_id"), F.col("component").alias("class_id"))


def first_of_classes(docs: DataFrame) -> DataFrame:
    """docs without the documents whose class has a smaller doc_id, and with
    one row of those that agree in doc_id and text."""
    gone = near_duplicates(docs).where("doc_id != class_id").select(F.col("doc_id").alias("gone"))
    out = packed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("twin"))
    again = stored(docs.groupBy(F.col("doc_id").cast("long").alias("again"), F.xxhash64("text").alias("twin"))
                   .count().where("count > 1 and again is not null").select("again", "twin"), "omh")
    out = out.join(gone, F.col("id") == F.col("gone"), "left_anti")
    twice = (F.col("id") == F.col("again")) & (out["twin"] == again["twin"])
    single = out.join(again, twice, "left_semi").groupBy("id", out["twin"]).agg(F.first("doc").alias("doc"))
    return out.join(again, twice, "left_anti").select("doc.*").unionByName(single.select("doc.*"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cls = stored(near_duplicates(docs), "omh")
    size = cls.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    cls = cls.join(size, "class_id").withColumnRenamed("doc_id", "_id")
    out = docs.select("doc_id").join(cls, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                      (F.coalesce("class_id", "doc_id") == F.col("doc_id")).alias("kept"))
