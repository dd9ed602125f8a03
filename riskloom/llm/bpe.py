"""BPE encoding and decoding, with tree concatenation of long texts.

A text of at most ``BLOCK`` characters is encoded in one go: its words (runs
without ASCII white space, which the vocabulary's pre-tokenizer never crosses)
are looked up among those the worker has met, new ones go to the tokenizer.

A longer text is cut into blocks, which are dealt over the tasks and encoded in
parallel.  A cut lies behind white space or a digit, where the vocabulary splits
anyway, or inside a run of letters or of punctuation, which it does not split:
then the left block's last run is encoded without its word end.  Neighbouring
blocks are joined in a tree: where a run was cut, a window of ids around the
join is turned back to text and encoded again, and grows until its first id and
its last one are those that both sides had there.  As a sequence of ids is the
encoding of its text if every pair of neighbours is, the joined ids are exactly
those of the undivided run.

The vocabulary is a file that every worker has, of the form of
word_bpe_49k.json: it splits at white space, letters, digits and punctuation,
and marks word ends.  Null text is empty, and has no ids.  Rows with equal
doc_id are encoded each.  Other columns are ignored.  An empty table gives an
empty table.  Memory of a task: one text and its ids.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import WORD, stored, table

BLOCK = 1 << 14              # characters of a block
WINDOW = 4                   # ids on each side of a join that are encoded again at first
CACHED_WORDS = 1 << 18       # words whose ids a worker keeps
WORDS = re.compile(WORD)
# letters that the vocabulary puts in one run, whatever follows, and punctuation it does
_LETTER = "a-zà-öø-ÿа-я一-鿿ぁ-ゖァ-ヺ가-힣"
_MARK = r"!-/:-@\[-`{-~"
# behind a space or digit; within letters, three of which rule out the end of
# a contraction ('s 't 're 've 'm 'll 'd); within punctuation, not before the
# apostrophe that might begin one
CUT = re.compile(f"(?<=[ 0-9])|(?<=[{_LETTER}]{{3}})(?=[{_LETTER}])|(?<=[{_MARK}])(?=[{_MARK}])(?!')")


# words whose runs a plain expression finds as the vocabulary does
_PLAIN = "a-zà-öø-ÿ"
PLAIN = re.compile(f"[!-~{_PLAIN}]+")
RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_PLAIN}]+|[0-9]|[^0-9{_PLAIN}]+")
# fixed rule: bytes that the vocabulary writes as themselves; the others follow from 256 on
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SELF} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)).difference(_SELF)))}


def vocabulary_path(vocabulary: str | None) -> str:
    if vocabulary is None:
        import public_tokenizers
        return public_tokenizers.path("word_bpe_49k.json")
    return vocabulary


class Codec:
    """Tokenizer of one vocabulary file and the word ids met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.names[i] = t
        self.known = Known(self, self.tokenizer)

    @functools.cached_property
    def bare(self):
        """Tokenizer of normalised text without special strings."""
        from tokenizers import Tokenizer
        bare = Tokenizer.from_file(self.path)
        bare.normalizer = None
        bare.encode_special_tokens = True
        return bare

    @functools.cached_property
    def known_bare(self):
        return Known(self, self.bare)

    @functools.cached_property
    def inner(self):
        """Model of runs that go on behind the block."""
        from tokenizers import models
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        return models.BPE(vocab=model["vocab"], merges=merges)

    def by_words(self, text: str, bare: bool = False) -> np.ndarray:
        """Ids of a text."""
        known = self.known_bare if bare else self.known
        return np.frombuffer(b"".join(map(known.__getitem__, WORDS.findall(text))), "<i4")

    def run(self, text: str, open_end: bool) -> list[int]:
        """Ids of one run, as the pre-tokenizer writes it."""
        return [t.id for t in (self.inner if open_end else self.tokenizer.model).tokenize(text)]

    def again(self, ids: list[int]) -> list[int]:
        text = "".join([self.names[i] for i in ids])
        if self.suffix and text.endswith(self.suffix):
            return self.run(text[:-len(self.suffix)], False)
        return self.run(text, True)

    def block(self, text: str, open_start: bool, open_end: bool) -> Part:
        """Ids of a block of normalised text; its first and last run may be
        parts of runs that were cut."""
        words = WORDS.findall(text)
        if not words:
            return Part(np.zeros(0, np.int32), 0, 0, False)
        head = [s for s, _ in self.bare.pre_tokenizer.pre_tokenize_str(words[0])] if open_start else []
        if open_end:
            last = [s for s, _ in self.bare.pre_tokenizer.pre_tokenize_str(words[-1])]
            end = self.run(last[-1], True)
            rest = [i for s in last[:-1] for i in self.run(s, False)]
            before = self.by_words(" ".join(words[:-1]), bare=True)
            ids = np.concatenate([before, np.array(rest + end, np.int32)])
            if len(words) == len(last) == 1:
                return Part(ids, len(ids) if open_start else 0, len(ids), True)
        else:
            end = []
            ids = self.by_words(text, bare=True)
        single = open_start and len(words) == len(head) == 1
        return Part(ids, len(self.run(head[0], False)) if open_start else 0, len(end), single)

    def join(self, a: Part, b: Part, is_open: bool) -> Part:
        """Two neighbours as one, encoded anew around a join within a run."""
        if not is_open:
            return Part(np.concatenate([a.ids, b.ids]), a.head, b.tail, False)
        left, right, w = a.ids[len(a.ids) - a.tail:], b.ids[:b.head], WINDOW
        while True:
            x, y = left[max(len(left) - w, 0):], right[:w]
            mid = self.again(np.concatenate([x, y]).tolist())
            if (len(x) == len(left) or mid[0] == x[0]) and (len(y) == len(right) or mid[-1] == y[-1]):
                break
            w *= 2
        ids = np.concatenate([a.ids[:len(a.ids) - len(x)], np.array(mid, np.int32), b.ids[len(y):]])
        run = len(left) - len(x) + len(mid) + len(right) - len(y)
        return Part(ids, run if a.single and a.head else a.head, run if b.single and b.tail else b.tail, a.single and b.single)

    def cut(self, text: str, size: int) -> list[tuple[int | None, bool, str]]:
        """(special id, does the block go on with the run before, block)."""
        out: list[tuple[int | None, bool, str]] = []
        for part in re.split(f"({'|'.join(map(re.escape, self.specials))})", text) if self.specials else [text]:
            if part in self.specials:
                out.append((self.specials[part], False, ""))
                continue
            part = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            start, goes_on = 0, False
            while start < len(part):
                found = CUT.search(part, start + size)
                stop = found.start() if found else len(part)
                out.append((None, goes_on, part[start:stop]))
                goes_on = not (part[stop - 1] == " " or "0" <= part[stop - 1] <= "9")
                start = stop
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        if self.tokenizer.decoder is None:
            return [" ".join(map(self.names.__getitem__, i)) for i in ids]
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


class Known(dict):
    """Word to ids (bytes); a new word is encoded when it is first looked up."""

    def __init__(self, codec: Codec, tokenizer):
        super().__init__()
        self.codec, self.tokenizer = codec, tokenizer

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        low = word.lower()
        if PLAIN.fullmatch(low) and not any(s in word for s in self.codec.specials):
            ids = [i for r in RUNS.findall(low) for i in self.codec.run(r if r.isascii() else r.encode().decode("latin-1").translate(BYTES), False)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = out = np.array(ids, "<i4").tobytes()
        return out


class Part:
    """Ids of neighbouring blocks; head and tail: how many belong to a cut run
    at their start and end; single: all of them to one and the same."""

    def __init__(self, ids: np.ndarray, head: int, tail: int, single: bool):
        self.ids, self.head, self.tail, self.single = ids, head, tail, single


def worker_codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    kept = sys.modules.setdefault("_riskloom_bpe_codecs", types.ModuleType("_riskloom_bpe_codecs")).__dict__
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def id_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches):
        codec = worker_codec(vocabulary_path(vocabulary))
        for b in batches:
            for c in W.chunks(b):
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), id_lists([codec.by_words(t) for t in c.column("text").to_pylist()])], ["doc_id", "ids"])

    def cut(batches):
        codec = worker_codec(vocabulary_path(vocabulary))
        for b in batches:
            for i in range(b.num_rows):
                found, key = codec.cut(b.column("text")[i].as_py(), block), uuid.uuid4().hex
                for k in range(0, len(found), 256):
                    part = found[k:k + 256]
                    following = [f[1] for f in found[k + 1:k + 257]] + [False] * (k + 256 >= len(found))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array([i] * len(part))), pa.array([key] * len(part)),
                         pa.array(range(k, k + len(part)), pa.int32()), pa.array([f[0] for f in part], pa.int32()),
                         pa.array([f[1] for f in part]), pa.array(following), pa.array([f[2] for f in part])],
                        ["doc_id", "key", "at", "special", "open_start", "open_end", "text"])

    def blocks(batches):
        codec = worker_codec(vocabulary_path(vocabulary))
        for b in batches:
            for c in W.chunks(b):
                parts = [Part(np.array([s], np.int32), 0, 0, False) if s is not None else codec.block(t, o, e) for s, t, o, e in zip(
                    *[c.column(x).to_pylist() for x in ("special", "text", "open_start", "open_end")])]
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), c.column("key"), c.column("at"), c.column("open_start"), id_lists([p.ids for p in parts]),
                     pa.array([p.head for p in parts], pa.int32()), pa.array([p.tail for p in parts], pa.int32()), pa.array([p.single for p in parts])],
                    ["doc_id", "key", "at", "open_start", "ids", "head", "tail", "single"])

    def tree(rows: pa.Table) -> pa.Table:
        codec = worker_codec(vocabulary_path(vocabulary))
        rows = rows.sort_by("at")
        ids = [rows.column("ids")[i].values.to_numpy(zero_copy_only=False) for i in range(rows.num_rows)]
        parts = [Part(*p) for p in zip(ids, *[rows.column(c).to_pylist() for c in ("head", "tail", "single")])]
        is_open = rows.column("open_start").to_pylist()
        while len(parts) > 1:
            pairs = range(0, len(parts) - 1, 2)
            odd = len(parts) % 2
            parts = [codec.join(parts[i], parts[i + 1], is_open[i + 1]) for i in pairs] + parts[len(parts) - odd:]
            is_open = is_open[::2]
        return pa.table({"doc_id": rows.column("doc_id").slice(0, 1), "ids": id_lists([parts[0].ids])})

    short = F.length("text") <= block
    pieces = stored(texts.filter(~short).mapInArrow(
        cut, f"doc_id {kind}, key string, at int, special int, open_start boolean, open_end boolean, text string"), "bpe")
    out = f"doc_id {kind}, ids array<int>"
    joined = (pieces.repartition("key", "at")
              .mapInArrow(blocks, f"doc_id {kind}, key string, at int, open_start boolean, ids array<int>, head int, tail int, single boolean")
              .groupBy("key").applyInArrow(tree, out))
    return texts.filter(short).mapInArrow(whole, out).unionByName(joined)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text, special strings kept."""
    def run(batches):
        codec = worker_codec(vocabulary_path(vocabulary))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c = b.slice(k, 256)
                ends = c.column("ids").offsets.to_numpy()
                ids = c.column("ids").values.to_numpy()
                text = codec.decode([ids[i:j].tolist() for i, j in zip(ends, ends[1:])])
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("ids"), pa.array(text, pa.string())],
                                                 ["doc_id", "ids", "decoded"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    done = decode(encode(table(spark, sf_dir, "documents")))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
