"""Language-model scoring with an Elias-Fano n-gram trie (order 3).

Words are ranks in the sorted list of their hashes.  Level 2 holds, for each
word, its successors; level 3 holds, for each entry (a, b) of level 2, the
words c behind it as their rank among the successors of b, so that the numbers
stay small.  Each level is a monotone sequence: the start of every entry's
range (its pointer, Elias-Fano coded as well) plus the word within the range,
looked up by successor search.  Probabilities are interpolated with absolute
discounting and kept as 16-bit logarithms.  Levels are built by shards, one
shard a task, and lie in files of the shared folder that scoring tasks map.

All n-grams of the training rows are kept, those seen once too.  Training rows: crc32 of the doc_id's text modulo 5 is not 1.
Null text: empty, the end token alone.  Null doc_id: a training row.  Rows
with equal doc_id are counted and scored one by one.  An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import shared_folder, stored, table, train_fold
from riskloom.llm.elias_fano import Sequence, encode
from riskloom.llm.shared_files import open_arrays, write_arrays

HELD_OUT = 1
DISCOUNT = 0.75
END = 0x5EED0F0E17D0C0DE        # the end token's hash
SHARD_WORDS = 1 << 21           # words of a shard of level 1
SHARD_TOKENS = 1 << 21          # training tokens of a shard of levels 2 and 3, on average
HOLD = 1 << 20                  # keys that a task sums up before it passes them on
RANGE = 12.0                    # logarithms to base 10 down to -RANGE, in 65535 steps
REL = 40                        # bits of a rank among successors


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.where(p > 0, -np.log10(np.maximum(p, 1e-300)), RANGE)
    return np.clip(np.rint(x * (65535 / RANGE)), 0, 65535).astype(np.uint16)


LEVELS: dict[str, np.ndarray] = {}      # the 65536 probabilities, made once in each process


def restore(q: np.ndarray) -> np.ndarray:
    if "p" not in LEVELS:
        LEVELS["p"] = 10.0 ** (np.arange(65536) * (-RANGE / 65535))
        LEVELS["p"][65535] = 0.0
    return LEVELS["p"][q]


def text_tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes as int64 with the end token after each text, tokens per text)."""
    h, n = W.word_hashes(col)
    out = np.full(len(h) + len(n), END, np.int64)
    last = np.cumsum(n + 1) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = h.view(np.int64)
    return out, n + 1


class Sums:
    """Sums counts of int64 keys within a task; bounded by HOLD keys."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            k, n = np.unique(keys, return_counts=True)
            self.parts.append((k, n))
            self.size += len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, n = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        return add_up(k, n)


def add_up(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def squeeze(key: np.ndarray, n: np.ndarray, bits: int) -> bytes:
    """Ascending keys (parent << bits | item) and their counts as bytes: steps
    of the parent, steps of the item within a parent, counts; of each only the
    bytes in use, the lowest of all values first, compressed."""
    parent, item = key >> bits, key & ((1 << bits) - 1)
    up, step = np.diff(parent, prepend=0), np.diff(item, prepend=0)
    streams = [x.astype("<u8") for x in (up, np.where(up > 0, item, step) if len(key) else step, n)]
    streams[1][:1] = item[:1]
    used = [max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 0 for x in streams]
    body = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :u].T).tobytes() for x, u in zip(streams, used))
    return np.array([len(key), *used], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, *used = (int(x) for x in np.frombuffer(blob[:32], "<i8"))
    body = np.frombuffer(pa.decompress(blob[32:], n * sum(used), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for u in used:
        x = np.zeros((n, 8), np.uint8)
        x[:, :u] = body[at:at + n * u].reshape(u, n).T
        out.append(x.view("<u8").reshape(-1).astype(np.int64))
        at += n * u
    up, step, count = out
    # items are sums of steps that begin anew with each parent
    total = np.cumsum(step)
    begin = np.flatnonzero((up > 0) | (np.arange(n) == 0))
    before = (total - step)[begin]
    item = total - np.repeat(before, np.diff(np.append(begin, n)))
    return (np.cumsum(up) << bits) | item, count


def word_counts(train: DataFrame) -> DataFrame:
    def run(batches):
        sums = Sums()

        def flush():
            k, n = sums.merged()
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["word", "n"])
        for b in batches:
            for c in W.chunks(b):
                sums.add(text_tokens(c.column("text"))[0])
                if sums.size > HOLD:
                    yield flush()
        yield flush()

    return train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Level 1: word hash -> rank and count, over mapped shards in order."""

    def __init__(self, shards: list[tuple[int, int, str]], size: int):
        self.firsts = np.array([s[0] for s in shards], np.int64)
        self.starts = np.cumsum([0] + [s[1] for s in shards])
        self.names, self.size, self.open = [s[2] for s in shards], size, {}

    def shard(self, s: int) -> dict[str, np.ndarray]:
        if s not in self.open:
            self.open[s] = open_arrays(self.names[s])
        return self.open[s]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of every hash, -1 if unknown."""
        uniq, back = np.unique(h, return_inverse=True)
        out = np.full(len(uniq), -1, np.int64)
        if len(self.names):
            cut = np.searchsorted(uniq, self.firsts)
            for s, (a, b) in enumerate(zip(cut, [*cut[1:], len(uniq)])):
                if b > a:
                    known = self.shard(s)["words"]
                    at = np.minimum(np.searchsorted(known, uniq[a:b]), len(known) - 1)
                    out[a:b] = np.where(known[at] == uniq[a:b], at + self.starts[s], -1)
        return out[back]

    def counts(self, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        for s in range(len(self.names)):
            m = np.flatnonzero((rank >= self.starts[s]) & (rank < self.starts[s + 1]))
            out[m] = self.shard(s)["counts"][rank[m] - self.starts[s]]
        return out


def build_words(counts: DataFrame, total: int, folder: str) -> Words:
    """One file a shard; the driver sees a row per shard."""
    def run(batches):
        got = [(b.column("word").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if got:
            w, n = (np.concatenate(x) for x in zip(*got))
            yield pa.RecordBatch.from_pydict({"first": [int(w[0])], "size": [len(w)],
                                              "name": [write_arrays(folder, {"words": w, "counts": n})]})

    parts = -(-max(total, 1) // SHARD_WORDS)
    rows = counts.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(run, "first long, size long, name string").collect()
    return Words(sorted((r["first"], r["size"], r["name"]) for r in rows), total)


class Level:
    """A level of the trie: shard s has the parents from s * width on."""

    def __init__(self, shards: dict[int, tuple[int, str]], width: int):
        self.width, self.names, self.open = width, {s: x[1] for s, x in shards.items()}, {}
        self.starts, at = {}, 0
        for s in sorted(shards):
            self.starts[s] = at
            at += shards[s][0]
        self.size = at

    def shard(self, s: int):
        if s not in self.open:
            a = open_arrays(self.names[s])
            self.open[s] = (a, {k: Sequence(a, k) for k in ("items", "base", "first")})
        return self.open[s]

    def by_shard(self, parent: np.ndarray):
        """(shard, positions) of the parents >= 0 whose shard exists."""
        ask = np.flatnonzero(parent >= 0)
        s = parent[ask] // self.width
        order = np.argsort(s.astype(np.uint16) if len(s) and s.max() < 65536 else s, kind="stable")   # 16 bits: radix sort
        cut = np.flatnonzero(np.concatenate([[True], np.diff(s[order]) > 0])) if len(ask) else np.zeros(0, np.int64)
        for a, b in zip(cut, [*cut[1:], len(ask)]):
            if int(s[order[a]]) in self.names:
                yield int(s[order[a]]), ask[order[a:b]]

    def lookup(self, parent: np.ndarray, item: np.ndarray):
        """For every (parent, item): the entry's index (-1 if absent), its rank
        within the range, its probability and, of the parent, what it leaves to
        the lower order (1 where it has no range).  Each entry is looked up
        once, in order; parents without a range, known by what they leave, are
        not searched."""
        index, rank = np.full(len(parent), -1, np.int64), np.full(len(parent), -1, np.int64)
        kept, rest = np.zeros(len(parent)), np.ones(len(parent))
        for s, at in self.by_shard(parent):
            a, seq = self.shard(s)
            p = parent[at] - s * self.width
            left = a["rest"][p]
            some = left > 0
            at, p, left = at[some], p[some], left[some]
            rest[at] = restore(left)
            ask = item[at] >= 0
            at, p = at[ask], p[ask]
            both, back = np.unique((p << REL) | item[at], return_inverse=True)      # each entry once, in order
            p, want = both >> REL, both & ((1 << REL) - 1)
            new = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
            u, of = p[new], np.cumsum(new) - 1
            start, end = seq["base"].get(u)[of], seq["base"].get(u + 1)[of]
            i = seq["items"].find(np.where(start + want < end, start + want, -1))
            hit = i >= 0
            nth, value = np.full(len(i), -1, np.int64), np.zeros(len(i))
            nth[hit] = i[hit] - seq["first"].get(p[hit])
            value[hit] = restore(a["kept"][i[hit]])
            index[at] = np.where(hit, i + self.starts[s], -1)[back]
            rank[at], kept[at] = nth[back], value[back]
        return index, rank, kept, rest


def build_level(keys: DataFrame, shards: int, width: int, bits: int, context: str, model: "Trie", folder: str) -> Level:
    """keys (shard, runs of key = parent within the shard << bits | item) -> files.
    Counts are kept where the next level reads them, in level 2 only."""
    def run(batches):
        got: dict[int, list] = {}
        for b in batches:
            for s, blob in zip(b.column("shard").to_pylist(), b.column("run")):
                got.setdefault(s, []).append(unsqueeze(blob.as_py(), bits))
        for s in sorted(got):
            k, c = add_up(*(np.concatenate(x) for x in zip(*got.pop(s))))
            parent, item = k >> bits, k & ((1 << bits) - 1)
            first = np.searchsorted(parent, np.arange(width + 1))
            last = np.flatnonzero(np.concatenate([parent[1:] != parent[:-1], [True]]))
            span = np.zeros(width, np.int64)
            span[parent[last]] = item[last] + 1
            base = np.concatenate([[0], np.cumsum(span)])
            whole = model.context_counts(context, np.arange(width) + int(s) * width, parent)
            kept = np.maximum(c - DISCOUNT, 0) / whole[parent]
            rest = 1 - np.bincount(parent, kept, width)
            left = quantise(np.maximum(rest, 1e-9))
            left[parent] = np.maximum(left[parent], 1)       # 0 says that a parent has no range
            name = write_arrays(folder, {
                **encode(base[parent] + item, "items"), **encode(base, "base"), **encode(first.astype(np.int64), "first"),
                "kept": quantise(kept), "rest": left,
                **({"counts": c.astype(np.uint32 if c.max() < 1 << 32 else np.int64)} if context == "words" else {})})
            yield pa.RecordBatch.from_pydict({"shard": [int(s)], "size": [len(k)], "name": [name]})

    rows = keys.repartition(max(shards, 1), "shard").mapInArrow(run, "shard long, size long, name string").collect()
    return Level({r["shard"]: (r["size"], r["name"]) for r in rows}, width)


class Trie:
    """The model: names of files only, so it is small to ship."""

    def __init__(self, words: Words, tokens: int, texts: int):
        self.words, self.tokens, self.texts = words, tokens, texts
        self.two = self.three = None

    def context_counts(self, context: str, rank: np.ndarray, used: np.ndarray) -> np.ndarray:
        """How often each parent stands before a token, at least 1."""
        if context == "words":
            n = self.words.counts(rank)
            n[rank == self.words.size] = self.texts        # before the first word
        else:
            n = np.zeros(len(rank), np.int64)
            at = np.unique(used)
            for s, start in self.two.starts.items():
                c = self.two.shard(s)[0]["counts"]
                m = at[(rank[at] >= start) & (rank[at] < start + len(c))]
                n[m] = c[rank[m] - start]
        return np.maximum(n, 1)

    def pairs(self, rank: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word before, word) at every token; -1 where the word is unknown."""
        prev = np.empty(len(rank), np.int64)
        prev[1:] = rank[:-1]
        begin = np.cumsum(sizes) - sizes
        prev[begin] = self.words.size
        return prev, rank

    def contexts(self, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of level 2 that ends before every token."""
        out = np.empty(len(two), np.int64)
        out[1:] = two[:-1]
        out[np.cumsum(sizes) - sizes] = -1
        return out


def _ids(docs: DataFrame, words: Words, carry: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def run(batches):
        for b in batches:
            for c in W.chunks(b):
                h, n = text_tokens(c.column("text"))
                off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.column(k) for k in carry), pa.ListArray.from_arrays(off, pa.array(words.ranks(h).astype(np.int32)))],
                                                 [*carry, "ids"])

    return docs.select("text", *carry).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in carry), "ids array<int>"]))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("ids")
    return col.flatten().to_numpy().astype(np.int64), np.diff(col.offsets.to_numpy()).astype(np.int64)


def _slices(batch: pa.RecordBatch, size: int = 1 << 19):
    n = np.cumsum(np.diff(batch.column("ids").offsets.to_numpy())) // size
    cuts = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _keys(ids: DataFrame, width: int, bits: int, items) -> DataFrame:
    """Per shard, runs of the summed keys of what ``items`` gives for a batch:
    (parent, item).  A run holds at most about HOLD keys."""
    def run(batches):
        sums = {}, [0]

        def flush():
            for s, x in list(sums[0].items()):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([squeeze(*x.merged(), bits)], pa.binary())],
                                                 ["shard", "run"])
            sums[0].clear()
            sums[1][0] = 0
        for b in batches:
            for c in _slices(b):
                parent, item = items(*_arrays(c))
                shard = parent // width
                key = ((parent - shard * width) << bits) | item
                order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 65536 else shard, kind="stable")
                at = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(shard)]]) if len(shard) else []
                for x, y in zip(at, at[1:]):
                    s = sums[0].setdefault(int(shard[order[x]]), Sums())
                    was = s.size
                    s.add(key[order[x:y]])
                    sums[1][0] += s.size - was
                if sums[1][0] > HOLD:
                    yield from flush()
        yield from flush()

    return ids.select("ids").mapInArrow(run, "shard int, run binary")


def train(docs: DataFrame, is_training, carry: list[str]) -> tuple[Trie, DataFrame]:
    """The model and the ids of all documents (written once)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "trie")
    docs = docs.withColumn("_train", is_training)
    counts = stored(word_counts(docs.where("_train")), "lm")
    size, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size >= 1 << 31:
        raise OverflowError(f"{size} words: ranks are 32-bit integers")
    model = Trie(build_words(counts, size, folder), tokens, 0)
    ids = stored(_ids(docs, model.words, [*carry, "_train"]), "lm")
    rows = ids.where("_train")
    model.texts = rows.count()
    shards = -(-max(tokens, 1) // SHARD_TOKENS)
    width = -(-(size + 1) // shards)

    def bigrams(rank, sizes):
        prev, cur = model.pairs(rank, sizes)
        ok = (prev >= 0) & (cur >= 0)
        return prev[ok], cur[ok]

    model.two = build_level(_keys(rows, width, REL, bigrams), shards, width, REL, "words", model, folder)
    wide = max(1, -(-model.two.size // shards))

    def trigrams(rank, sizes):
        prev, cur = model.pairs(rank, sizes)
        two, nth, _, _ = model.two.lookup(prev, cur)
        parent = model.contexts(two, sizes)
        ok = (parent >= 0) & (two >= 0)
        return parent[ok], nth[ok]

    model.three = build_level(_keys(rows, wide, REL, trigrams), shards, wide, REL, "pairs", model, folder)
    return model, ids


def score(ids: DataFrame, model: Trie, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and n_tokens, n_known, base_score, score."""
    kinds = dict(ids.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in carry), "n_tokens long, n_known long, base_score double, score double"])
    below = model.tokens + 0.5 * (model.words.size + 1)

    def run(batches):
        for b in batches:
            for c in _slices(b):
                rank, sizes = _arrays(c)
                n = model.words.counts(rank)
                one = (n + 0.5) / below
                prev, cur = model.pairs(rank, sizes)
                two, nth, kept, rest = model.two.lookup(prev, cur)
                p = kept + rest * one
                _, _, kept, rest = model.three.lookup(model.contexts(two, sizes), nth)
                p = kept + rest * p
                begin = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x, begin)
                yield pa.RecordBatch.from_arrays(
                    [*(c.column(k) for k in carry), pa.array(sizes), pa.array(total((rank >= 0).astype(np.int64))),
                     pa.array(total(np.log10(one))), pa.array(total(np.log10(p)))],
                    [*carry, "n_tokens", "n_known", "base_score", "score"])

    return ids.select("ids", *carry).mapInArrow(run, schema)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (train_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    model, ids = train(docs, ~F.col("held_out"), ["doc_id", "held_out"])
    return score(ids, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
