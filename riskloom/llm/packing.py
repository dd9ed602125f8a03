"""Packing documents into token sequences by cutting-stock column generation.

Tasks turn every whole text into ids and cut it into full sequences and one
remainder.  The histogram of piece lengths, in classes of ``UNIT`` tokens, is
all that the driver sees (at most ``CAPACITY / UNIT`` rows): a linear program
over sequence patterns is solved by column generation, where a knapsack dynamic
program prices new patterns; the rounded patterns then go to the pieces by
their rank within each class.  Ranks are dealt over a hash of the piece, in
parts whose number grows with the pieces, so a class that holds a third of all
pieces is spread over many tasks.

Null or empty text: the end id alone.  Equal rows are packed each.  Other
columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import stored, table

CAPACITY = 2048
UNIT = 8
END_ID = 1
SPREAD = 256             # parts of a class that are ranked apart, at least
PART_ROWS = 200_000      # pieces of a part if all were of one class, on average
GAP = 5e-4               # the plan is within this share of the linear program's best
CACHED_WORDS = 1_000_000 # pieces of text whose ids a worker keeps
GROUP = 256              # new words that are encoded as one text
SPECIAL = "<|endoftext|>"
SPACE = "\u0120"         # fixed value: how the vocabulary writes a space
# letters of the texts that the standard library's patterns split as the vocabulary asks
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(f"[\x00-\x1b\x20-\x7f{_LETTERS}]*")
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+", re.ASCII)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes; remembers the ids of each
    piece of text, as texts repeat their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocab.values(), default=0) + 1, bool)      # ids that begin with a space
        self.leads[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_words(self, words: list[str]) -> list[str]:
        """Words that begin with their only space are encoded as one text, which
        splits at the spaces again.  Returns the words of groups where it did not."""
        groups = [words[i:i + GROUP] for i in range(0, len(words), GROUP)]
        failed = []
        for g, x in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(x.ids, "<u4")
            start = 4 * np.flatnonzero(self.leads[ids])
            if len(start) != len(g) or start[0]:
                failed += g
                continue
            raw, start = ids.tobytes(), start.tolist()
            self.known.update(zip(g, [raw[i:j] for i, j in zip(start, [*start[1:], len(raw)])]))
        return failed

    def learn(self, new: set[str]) -> None:
        words = [p for p in new if " !" <= p < "!"]       # a space and then no space
        rest = list(new.difference(words)) + self.learn_words(words)
        ids = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        self.known.update((p, np.array(x.ids, "<u4").tobytes()) for p, x in zip(rest, ids))

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [None if SPECIAL in t or not PLAIN.fullmatch(t) else PIECES.findall(t) for t in texts]
        new: set[str] = set()
        for p in parts:
            new.update(p or ())
        unknown = new.difference(self.known)
        if len(self.known) + len(unknown) > CACHED_WORDS:
            self.known.clear()
            unknown = new
        self.learn(unknown)
        return [self.whole(t) if p is None else b"".join(map(self.known.__getitem__, p)) for t, p in zip(texts, parts)]


def worker_encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    kept = sys.modules["tokenizers"].__dict__.setdefault("_kept_encoders", {}) if "tokenizers" in sys.modules else None
    if kept is None:
        import tokenizers
        kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece.  The
    vocabulary is a file that every worker has; None: byte_bpe_50k.json."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary is None:
            import public_tokenizers
            path = public_tokenizers.path("byte_bpe_50k.json")
        else:
            path = vocabulary
        encode, end = worker_encoder(path), int(END_ID).to_bytes(4, "little")
        step = 4 * capacity
        for b in batches:
            for c in W.chunks(b):
                who, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in c.column("text").to_pylist()])):
                    ids += end
                    for k in range(0, len(ids), step):
                        part = ids[k:k + step]
                        who.append(i)
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id").take(pa.array(who, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = size <= c
        if fit.any():
            got = np.where(fit, best[np.maximum(c - size, 0)] + value, -np.inf)
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], take[c] = got[k], k
    count, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            count[take[c]] += 1
            c -= int(size[take[c]])
    return float(best[capacity]), count


def plan_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole patterns [(times, count of each size)] that use up the demand.
    Revised simplex over generated columns, run until no pattern is worth more
    than ``GAP`` above its cost.  Demands are raised by tiny, different amounts,
    so that every step gains and none comes twice.  The fractions left by
    rounding are packed first-fit by falling size (at most one pattern's pieces per size)."""
    m = len(size)
    if not m:
        return []
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // size[i]) for i in range(m)]
    inverse = np.diag(1.0 / np.array([c.max() for c in columns], float))
    x = inverse @ (demand + 1e-7 * np.random.default_rng(m).random(m))
    while True:
        worth, col = best_pattern(inverse.sum(axis=0), size, capacity)
        if worth <= 1 + GAP:
            break
        way = inverse @ col
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        r = int(ratio.argmin())
        columns[r] = col
        x = np.maximum(x - ratio[r] * way, 0)
        x[r] = ratio[r]
        row = inverse[r] / way[r]
        inverse -= np.outer(way, row)
        inverse[r] = row
    times = np.floor(x + 1e-6).astype(np.int64)
    rest = demand.copy()
    plan = []
    for t, c in zip(times, columns):
        t = int(min([t, *(rest[c > 0] // c[c > 0])]))
        if t > 0:
            plan.append((t, c.copy()))
            rest = rest - t * c
    room, bins = [], []
    for i in np.argsort(-size):
        for _ in range(int(rest[i])):
            at = next((k for k, free in enumerate(room) if free >= size[i]), None)
            if at is None:
                at = len(room)
                room.append(capacity)
                bins.append(np.zeros(m, np.int64))
            room[at] -= int(size[i])
            bins[at][i] += 1
    return plan + [(1, b) for b in bins]


def pack(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to the pieces of ``pieces`` (written once)."""
    spark = cut.sparkSession
    spread = max(SPREAD, cut.count() // PART_ROWS)
    cut = cut.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")) \
        .withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(spread)))
    counts = stored(cut.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("m")), "pack")
    hist = sorted((r["_class"], r["m"]) for r in counts.groupBy("_class").agg(F.sum("m").alias("m")).collect())
    size, demand = (np.array([h[i] for h in hist], np.int64) for i in (0, 1))
    rows, base, used = [], 0, dict.fromkeys(size.tolist(), 0)
    for times, col in plan_patterns(size, demand, capacity // unit):
        for i in np.flatnonzero(col):
            k, a = int(size[i]), int(col[i])
            rows.append((k, used[k], used[k] + a * times, base, a))
            used[k] += a * times
        base += times
    # one row per size of a pattern: bounded by the classes, not by the pieces
    runs = spark.createDataFrame(rows, "_class int, low long, high long, base long, each long")
    before = F.sum("m").over(Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("m")
    rank = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("doc_id", "start")) - 1
    ranked = cut.withColumn("rank", rank).join(counts, ["_class", "_part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), "_class").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))) \
        .withColumn("sequence_id", F.col("base") + F.expr("(rank - low) div each"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "rank").rowsBetween(
        Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))) \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(table(spark, sf_dir, "documents")), "pack"))
