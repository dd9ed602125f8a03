"""Toxic passages by maximum-scoring segments.

Token log-odds between toxic and clean training texts have an informative
Dirichlet prior (the counts of both together); tokens that stand out make a
lexicon, all others lose a little.  A linear scan (Ruzzo and Tompa) finds every
maximal segment of a text, and extreme-value statistics turn segment scores
into expected numbers by chance, so that texts of all lengths compare.  A
one-dimensional logistic fit on held-back training rows gives the probability.

Training uses at most ``MAX_TRAIN`` labelled rows, chosen by a hash of doc_id.
Null and empty texts have no segment.  Without training rows of both kinds all
scores are the share of toxic training rows (0 if none).  Rows with equal
doc_id are scored one by one.  An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import stored, table, train_fold

MAX_TRAIN = 50_000       # labelled rows to learn from; so many ids are broadcast at most
MAX_LEXICON = 20_000     # words that stand out most
MIN_Z = 3.0
MIN_GAIN = 2.0           # log-odds; weaker words tell languages and topics apart rather than toxicity
PRIOR_SHARE = 0.1        # prior counts as a share of all counts
MIN_LOSS = 0.05
SIGNIFICANT = 0.01       # expected segments by chance in a text of its length
CAP = 60.0


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without trailing punctuation, its text)."""
    buf, off = W.text_bytes(col)
    buf = W.lower_az(buf)
    s, e = W.word_spans(buf, off)
    stop = np.zeros(256, bool)
    stop[list(b".,;:!?")] = True
    for _ in range(2):
        e = e - (stop[buf[e - 1]] & (e - s > 1))
    return W.hash_spans(buf, s, e), W.owner_of_words(off, s)


def count_words(train: DataFrame) -> DataFrame:
    """(word hash, n1, n0) over training rows (text, toxic), summed per batch first."""

    def run(batches):
        for b in batches:
            for c in W.chunks(b):
                h, doc = tokens(c.column("text"))
                y = c.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[doc]
                for kind in (True, False):
                    w, n = np.unique(h[y == kind], return_counts=True)
                    z = np.zeros(len(w), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n if kind else z),
                                                      pa.array(z if kind else n)], ["word", "n1", "n0"])

    return train.select("text", "toxic").mapInArrow(run, "word long, n1 long, n0 long") \
        .groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def maximal_segments(at: list[int], gain: list[float], loss: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, end) of a text whose
    words at ``at`` gain and whose other words lose ``loss`` each."""
    segs: list[list] = []       # left sum, right sum, first, end, index of the last segment with a lower left sum
    total, last = 0.0, -1
    for p, v in zip(at, gain):
        total -= loss * (p - last - 1)
        left, total, last, first = total, total + v, p, p
        j = len(segs) - 1
        while True:
            while j >= 0 and segs[j][0] >= left:
                j = segs[j][4]
            if j < 0 or segs[j][1] >= total:
                segs.append([left, total, first, p + 1, j])
                break
            left, first, nxt = segs[j][0], segs[j][2], segs[j][4]
            del segs[j:]
            j = nxt
    return [(r - a, s, e) for a, r, s, e, _ in segs]


def scan(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], loss: float, carry: list[str]) -> DataFrame:
    """The columns ``carry``, n_words and segments (array of score, first, end)."""
    kinds = dict(docs.dtypes)
    known, gain = lexicon
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "n_words long",
                        "segments array<struct<score:double,first:long,end:long>>"])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            for c in W.chunks(b):
                h, doc = tokens(c.column("text"))
                n = np.bincount(doc, minlength=c.num_rows)
                begin = np.cumsum(n) - n
                k = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[k] == h) if len(known) else np.zeros(0, np.int64)
                got, where = gain[k[hit]] if len(known) else np.zeros(0), doc[hit]
                cut = np.searchsorted(where, np.arange(c.num_rows + 1))
                out = []
                for i in range(c.num_rows):
                    x, y = cut[i], cut[i + 1]
                    out.append([] if x == y else [
                        {"score": s, "first": f, "end": e}
                        for s, f, e in maximal_segments((hit[x:y] - begin[i]).tolist(), got[x:y].tolist(), loss)])
                yield pa.RecordBatch.from_arrays([*(c.column(x) for x in carry), pa.array(n.astype(np.int64)), pa.array(out, kind)],
                                                 [*carry, "n_words", "segments"])

    return docs.select("text", *[c for c in carry if c != "text"]).mapInArrow(run, schema)


class Model:
    """Lexicon, loss per other word, extreme-value parameters, logistic fit."""

    def __init__(self, lexicon, loss, lam, k, bias, slope):
        self.lexicon, self.loss, self.lam, self.k, self.bias, self.slope = lexicon, loss, lam, k, bias, slope

    def surprise(self):
        """-log of the expected number of segments by chance as good as the best."""
        best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
        size = F.log(F.lit(self.k) * F.greatest(F.col("n_words"), F.lit(1)))
        return F.least(F.lit(CAP), F.greatest(F.lit(0.0), self.lam * best - size))

    def score(self):
        return 1 / (1 + F.exp(-(F.lit(self.bias) + self.slope * self.surprise())))


def chance_rate(gain: np.ndarray, p: np.ndarray, loss: float) -> float:
    """The positive root of sum p exp(x gain) + (1 - sum p) exp(-x loss) = 1."""
    f = lambda x: float((p * np.exp(x * gain)).sum() + (1 - p.sum()) * math.exp(-x * loss) - 1)
    low, high = 0.0, 1e-3
    while f(high) < 0 and high < 50:
        low, high = high, high * 1.5
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low or high


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """Learn from labelled rows outside the held-out fold.  A doc_id whose
    labels differ counts as toxic, so that reruns agree."""
    y = labels.where((train_fold(F.col("doc_id")) > 0) & F.col("toxic").isin(0, 1)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    train = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    train = stored(train.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).alias("aside")), "toxicity")
    share = dict(train.groupBy("toxic").count().collect())
    if len(share) < 2:
        return float(share.get(1, 0) > 0)
    c = stored(count_words(train.where("not aside")), "toxicity")
    n1, n0, _ = c.agg(F.sum("n1"), F.sum("n0"), F.count(F.lit(1))).first()
    if not n1 or not n0:
        return share[1] / (share[0] + share[1])
    prior = PRIOR_SHARE * (n1 + n0)
    a = PRIOR_SHARE * (F.col("n1") + F.col("n0"))
    odds = lambda n, total: F.log((F.col(n) + a) / (total + prior - F.col(n) - a))
    delta = odds("n1", n1) - odds("n0", n0)
    z = delta / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a))
    rows = c.select("word", "n1", "n0", delta.alias("delta"), z.alias("z"), a.alias("a")).where((F.col("z") >= MIN_Z) & (F.col("delta") >= MIN_GAIN)) \
        .orderBy(F.desc("z"), "word").limit(MAX_LEXICON).collect()
    word = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(word)
    gain = np.array([r["delta"] for r in rows], float)[order]
    p1 = np.array([(r["n1"] + r["a"]) / (n1 + prior) for r in rows], float)[order]
    p0 = np.array([(r["n0"] + r["a"]) / (n0 + prior) for r in rows], float)[order]
    loss = max(MIN_LOSS, -math.log(max(1 - p1.sum(), 1e-6) / max(1 - p0.sum(), 1e-6)))
    if not len(rows):
        return share[1] / (share[0] + share[1])
    # the lexicon's drift over clean text must be negative
    loss = max(loss, 2 * float((p0 * gain).sum()) / max(1 - float(p0.sum()), 1e-6))
    lam = chance_rate(gain, p0, loss)
    model = Model((word[order], gain), loss, lam, 1.0, 0.0, 1.0)
    aside = stored(scan(train.where("aside"), model.lexicon, loss, ["toxic"]), "toxicity")
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    m, mass = aside.where("toxic = 0").agg(
        F.count(F.lit(1)), F.sum(F.greatest(F.col("n_words"), F.lit(1)) * F.exp(-lam * best))).first()
    model.k = m / mass if m else 1.0
    hist = aside.groupBy("toxic", F.round(model.surprise(), 1).alias("x")).count().collect()
    x, t, w = (np.array([r[i] for r in hist], float) for i in ("x", "toxic", "count"))
    theta, ridge = np.zeros(2), np.array([1e-3, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta[0] + theta[1] * x, -50, 50)))
        grad = np.array([(w * (t - p)).sum(), (w * (t - p) * x).sum()]) - ridge * theta
        v = w * p * (1 - p) + 1e-9
        hess = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        theta = theta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    model.bias, model.slope = float(theta[0]), float(theta[1])
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, score, expected (segments by chance as good as the
    best one) and passages (significant segments, in word positions)."""
    model = fit(docs, labels)
    if not isinstance(model, Model):
        none = F.array().cast("array<struct<score:double,first:long,end:long>>")
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(model).alias("score"),
                           F.lit(1.0).alias("expected"), none.alias("passages"))
    found = scan(docs, model.lexicon, model.loss, ["doc_id"])
    limit = F.log(F.lit(model.k) * F.greatest(F.col("n_words"), F.lit(1)) / SIGNIFICANT) / model.lam
    return found.select("doc_id", "n_words", model.score().alias("score"), F.exp(-model.surprise()).alias("expected"),
                        F.filter("segments", lambda s: s["score"] >= limit).alias("passages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (train_fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
                      "passages")
