"""Fuzzy line deduplication: one line of each group stays in the corpus.

A line is trimmed and A-Z lowered; its shingles are runs of eight bytes of
characters.  Equal lines are one text.  MinHash bands of three put lines of
similarity 0.8 into a shared bucket with odds of 0.997; the lines of a bucket
are compared by the exact Jaccard similarity of shingles, and distributed
union-find joins the links.  The first line of a component (by doc_id, then
line number) stays, all others go.

Lines without a word stay and are never compared; shorter lines than eight
bytes have one shingle.  Null and empty texts have no line to remove.  Rows
without doc_id stay as they are and remove nothing.  Rows with equal doc_id
are one document: their lines are numbered alike and treated alike.  An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import packed, stored, table
from riskloom.llm.components import connected_components
from riskloom.llm.leaders import Rule, bucket_rows, link

SHINGLE = 8
BANDS = 8
ROWS = 3
SIMILARITY = 0.8
BLOCK = 1 << 16     # bytes of lines that are sketched at a time


def line_spans(buf: np.ndarray, off: np.ndarray):
    """(text, line number, start, end) of all lines with a word, trimmed."""
    start, doc = W.line_starts(buf, off)
    s, e = W.word_spans(buf, off)
    first, last = np.searchsorted(s, start[:-1]), np.searchsorted(s, start[1:])
    first = np.where(start[:-1] == start[1:], last, first)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    has = last > first
    return doc[has], number[has], s[first[has]], e[last[has] - 1]


def shingle_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole lines of about BLOCK bytes at a time, so that the arrays stay in a
    core's cache: first line, last line, the hash of the eight bytes from every
    position on, and where each line's shingles start and end there."""
    if not len(s):
        return
    stop = np.maximum(e - SHINGLE + 1, s + 1)
    short = np.flatnonzero(e - s < SHINGLE)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff((e - s[0]) // BLOCK)) + 1, [len(s)]])
    for p, q in zip(cuts, cuts[1:]):
        x = W.eight(buf)[s[p]:stop[q - 1]].copy()
        some = short[np.searchsorted(short, p):np.searchsorted(short, q)]
        x[s[some] - s[p]] &= (W.U(1) << ((e - s)[some].astype(np.uint64) * W.U(8))) - W.U(1)
        yield p, q, W.mix_within(x), s[p:q] - s[p], stop[p:q] - s[p]


def band_keys(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One row of band keys per line."""
    out = np.zeros((len(s), BANDS), np.uint64)
    if not len(s):
        return out
    seeds = [int(W.mix(np.array([j + 1], np.uint64))[0]) for j in range(BANDS * ROWS)]
    low = np.empty((BANDS * ROWS, len(s)), np.uint32)
    for p, q, x, start, stop in shingle_hashes(buf, s, e):
        part = (x >> W.U(32)).astype(np.uint32)
        v = np.empty_like(part)
        cuts = np.stack([start, stop], axis=1).ravel()[:-1]     # every other run is what lies between two lines
        for j, r in enumerate(seeds):
            np.multiply(part, np.uint32(r & 0xFFFFFFFF | 1), out=v)
            np.add(v, np.uint32(r >> 32), out=v)
            low[j, p:q] = np.minimum.reduceat(v, cuts)[::2]
    with np.errstate(over="ignore"):
        for j in range(BANDS * ROWS):
            out[:, j // ROWS] = W.mix(out[:, j // ROWS] * W.U(0x9FB21C651E98DF25) + low[j].astype(np.uint64) + W.U(j + 1))
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, twin (hash of the text), line_no, first byte of the trimmed line
    and its bytes, two hashes of the line and its band keys."""
    names = [f"b{j}" for j in range(BANDS)]

    def run(batches):
        for b in batches:
            for c in W.chunks(b):
                buf, off = W.text_bytes(c.column("text"))
                buf = W.lower_az(buf)
                doc, number, s, e = line_spans(buf, off)
                keys = band_keys(buf, s, e).view(np.int64)
                line, check = W.hashes_of_spans(buf, s, e, (0x9E3779B97F4A7C15, 7))
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id").take(pa.array(doc)), c.column("twin").take(pa.array(doc)), pa.array(number.astype(np.int32)),
                     pa.array((s - off[doc]).astype(np.int32)), pa.array((e - s).astype(np.int32)),
                     pa.array(line.view(np.int64)), pa.array(check.view(np.int64)),
                     *(pa.array(np.ascontiguousarray(keys[:, j])) for j in range(BANDS))],
                    ["doc_id", "twin", "line_no", "start", "length", "id", "check", *names])

    return identified(docs).where("doc_id is not null").mapInArrow(
        run, "doc_id long, twin long, line_no int, start int, length int, id long, check long, " + ", ".join(f"{n} long" for n in names))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, twin, text: a doc_id may stand for several texts, which the hash
    tells apart in every job alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")


def rule(similarity: float = SIMILARITY) -> Rule:
    """Lines are linked by the Jaccard similarity of their shingles."""
    def items(col):
        buf, off = W.text_bytes(col)
        buf = W.lower_az(buf)
        has = np.diff(off) > 0
        s, e = off[:-1][has], off[1:][has]
        n = np.zeros(len(col), np.int64)
        n[has] = np.maximum(e - s - SHINGLE + 1, 1)
        out, end = np.empty(int(n.sum()), np.uint64), np.cumsum(n[has])
        for p, q, x, start, stop in shingle_hashes(buf, s, e):
            inside = np.ones(len(x), bool)      # without the bytes between the shingles of two lines
            gap = start[1:] - stop[:-1]
            inside[np.repeat(stop[:-1], gap) + W.run_positions(gap)] = False
            out[end[p] - stop[0]:end[q - 1]] = x[inside]
        return out, n

    def far(m, n, apart):
        return m + n - apart < similarity * (m + n + apart) - 1e-6

    def kinds(x):
        x = np.sort(x)
        return len(x) - np.count_nonzero(x[1:] == x[:-1])

    def same(p, q):
        m, n = kinds(p), kinds(q)
        if min(m, n) < similarity * max(m, n):
            return False
        both = m + n - kinds(np.concatenate([p, q]))
        return both >= similarity * (m + n - both) - 1e-9

    return Rule(items, far, same)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, removed array<int>) of every document that loses a line."""
    lines = stored(lines_of(docs), "lines", hashes=True)
    names = [f"b{j}" for j in range(BANDS)]
    # one of a line's places: every first() takes the same row
    texts = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.first(n).alias(n) for n in ("doc_id", "twin", "start", "length", *names)])
    texts = stored(texts, "lines", hashes=True)
    sketches = texts.select("id", F.array(*names).alias("keys"))
    rows = stored(bucket_rows(sketches), "lines")
    wanted = rows.select("id").distinct()
    # hash joins: documents are not sorted, and a document with many wanted lines is not copied for each
    at = texts.select("id", "doc_id", "twin", "start", "length").join(wanted.hint("shuffle_hash"), "id", "left_semi")
    found = identified(docs).join(at.hint("shuffle_hash"), ["doc_id", "twin"]) \
        .select("id", F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("length")).cast("string").alias("text"))
    found = stored(found.repartition("id").dropDuplicates(["id"]), "lines")
    comp = connected_components(link(rows, sketches, found, rule()))
    # a line that stands once and is linked with none stays
    ids = texts.where("n > 1").select("id").join(comp, "id", "full_outer")
    where = lines.select("doc_id", "twin", "line_no", "id", "check").join(ids.hint("shuffle_hash"), "id") \
        .select("doc_id", "twin", "line_no", F.coalesce("component", "id").alias("group"),
                F.when(F.col("component").isNull(), F.col("check")).otherwise(F.lit(0)).alias("check"))
    where = stored(where, "lines")
    first = where.groupBy("group", "check").agg(F.min(F.struct("doc_id", "twin", "line_no")).alias("kept"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").drop("n")
    gone = where.join(first, ["group", "check"]).where(F.struct("doc_id", "twin", "line_no") != F.col("kept")) \
        .groupBy("doc_id", "twin").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the removed lines; n_chars follows where docs have it."""
    gone = removed_lines(docs)
    d = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin")).join(gone, ["doc_id", "twin"], "left")
    left = F.array_join(F.filter(F.split("doc.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(left)
    out = []
    for c, kind in docs.dtypes:
        col = F.col("doc")[c]
        if c == "text":
            col = text
        elif c == "n_chars":
            col = F.when(F.col("removed").isNull(), col).otherwise(F.length(left)).cast(kind)
        out.append(col.alias(c))
    return d.select(*out)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs).drop("text").join(removed_lines(docs), ["doc_id", "twin"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
