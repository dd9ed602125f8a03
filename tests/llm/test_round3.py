"""BPE, Merkle manifest, hard negatives and quality verdicts against brute force on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, hard_negatives, merkle, ngram_lm, quality, range_join
from test_llm import DOCS, ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def in_blocks(codec, text, size):
    found = codec.cut(text, size)
    parts = [bpe.Part(np.array([s], np.int32), 0, 0, False) if s is not None else codec.block(t, o, i + 1 < len(found) and found[i + 1][1])
             for i, (s, o, t) in enumerate(found)]
    is_open = [f[1] for f in found]
    while len(parts) > 1:
        parts = [codec.join(parts[i], parts[i + 1], is_open[i + 1]) for i in range(0, len(parts) - 1, 2)] + parts[len(parts) - len(parts) % 2:]
        is_open = is_open[::2]
    return parts[0].ids.tolist() if parts else []


def test_bpe_blocks_and_words_equal_the_library(library):
    """Any cut of any text gives the ids of the undivided text."""
    rng, codec = random.Random(1), bpe.Codec(bpe.vocabulary_path(None))
    alphabet = ["a", "b", "th", "in", "er", "s", "'s", "'ll", "'", " ", "\n", "1", "22", "-", "==", "...", "<|endoftext|>", "<|", "É", "é",
                "ß", "漢字", "の", "İ", "ς", "Привет", "한국", "́", "👍🏽", "\x1c", " ", "हि", "ﬁ", "²", "</w>", "hello"]
    for n in range(1500):
        some = rng.sample(alphabet, rng.randint(1, 8)) if n % 2 else alphabet
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.by_words(text).tolist() == want
        assert codec.decode([want]) == [library.decode(want, skip_special_tokens=False)]
        for size in (1, 4, 17):
            assert in_blocks(codec, text, size) == want, (text, size)


def test_bpe_windows_grow(library):
    codec = bpe.Codec(bpe.vocabulary_path(None))
    for text in ("a" * 5000, "ha" * 3000, "=" * 4001, "mississippi" * 300):
        assert in_blocks(codec, text, 97) == library.encode(text, add_special_tokens=False).ids


def test_bpe_tables(spark, odd, library):
    more = odd.union(spark.createDataFrame([(9, "x" * 50_000 + "." + "Ab1" * 9000 + "<|endoftext|>" + "-" * 40_000, "en", "b", 1, "x", "y", 1)], DOCS))
    for d in (more, spark.read.parquet(f"{SF}/documents.parquet"), odd.limit(0)):
        got = bpe.decode(bpe.encode(d, block=2000)).collect()
        ids = {r["text"] or "": library.encode(r["text"] or "", add_special_tokens=False).ids for r in d.collect()}
        want = [(r["doc_id"], ids[r["text"] or ""]) for r in d.collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(want, key=key)
        assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in got)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i, own):
    siblings = []
    for level in levels[:-1]:
        run = level[i // 2 * 2:i // 2 * 2 + 2]
        other = run[:i % 2] + run[i % 2 + 1:]
        siblings += other
        own = H(*run[:i % 2], own, *run[i % 2 + 1:])
        i //= 2
    return siblings, own


def brute_manifest(rows):
    def leaf(r, more=0):
        values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])
    groups = {}
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(r, int(hit))))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = [tree_of([x[2] for x in sorted(groups[k])]) for k in keys]
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for g, k in enumerate(keys):
        for i, (known, doc_id, own, seen) in enumerate(sorted(groups[k])):
            low, mid = climb(trees[g], i, seen)
            high, root = climb(top, g, mid)
            out.append((doc_id if known else None, own, trees[g][-1][0], top[-1][0], H(*low, *high), root, root == top[-1][0]))
    return out


def manifest_rows(docs):
    p = merkle.merkle_proofs(merkle.manifest_leaves(docs), ["doc_id", "node"]).select(
        "item.doc_id", F.col("node").alias("leaf"), "subroot", "root", merkle.proof_digest().alias("proof"),
        merkle.fold("coalesce(item.tampered, node)").alias("folded"))
    return [(*r, r["folded"] == r["root"]) for r in p.collect()]


@pytest.mark.parametrize("bits", [(4, 3), (2, 1), (1, 2)])
def test_merkle_equals_brute_force(spark, odd, monkeypatch, bits):
    """Small blocks make several rounds; languages of one leaf, null ids and
    languages, equal rows."""
    monkeypatch.setattr(merkle, "DIGIT", bits[0])
    monkeypatch.setattr(merkle, "DIGITS", bits[1])
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits[0] * bits[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(70).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("lang")))
    docs = docs.union(docs.limit(5)).union(odd.select(docs.columns)).withColumn("node", F.lit("z")).withColumn("rank", F.lit(1))
    for d in ([docs, odd.filter("doc_id = 2"), odd.limit(0)] if bits == (4, 3) else [docs]):
        d = spark.createDataFrame(d.collect(), d.schema)
        key = lambda x: tuple((v is None, v or 0) if i == 0 else str(v) for i, v in enumerate(x))
        assert sorted(manifest_rows(d), key=key) == sorted(brute_manifest(d.collect()), key=key)


def brute_negatives(rows, anchor):
    usable = [(r["vec_id"], r["label"], [int(np.floor(256 * float(x))) for x in r["embedding"]]) for r in rows
              if None not in (r["vec_id"], r["label"], r["embedding"]) and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    out = []
    for a, (aid, alabel, av) in enumerate(usable):
        if not anchor(aid):
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label == alabel) for b, (i, label, v) in enumerate(usable) if b != a)
        for ps, pid, _ in [s for s in scored if s[2]][:5]:
            found = [s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(aid, pid, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("page,tile,fan", [(4, 16, 2), (256, 4096, 256)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, page, tile, fan):
    """Clustered vectors with ties, copies, repeated ids, short and broken ones."""
    for k, v in (("PAGE", page), ("TILE", tile), ("FAN", fan), ("ANCHORS", 7)):
        monkeypatch.setattr(hard_negatives, k, v)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).round(1).tolist(), int(rng.integers(3)), "x", 1) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, i % 2, "x", 1) for i in range(150)] + [(20, [0.5] * 8, 1, "x", 1)]
    rows += [(5000, None, 1, "x", 1), (5010, [1.0] * 8, None, "x", 1), (5020, [float("nan")] * 8, 1, "x", 1), (5030, [1.0, None], 1, "x", 1),
             (5040, [], 1, "x", 1), (5050, [1.0, 2.0], 1, "x", 1), (None, [1.0] * 8, 1, "x", 1), (5060, [float("inf")] * 8, 1, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, row int")
    for d in (table, table.filter("vec_id = 5040"), table.limit(0)):
        got = hard_negatives.hard_negatives(d, F.col("label"), F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == brute_negatives(d.collect(), lambda i: i % 10 == 0)


def test_boxes_prune_on_low_dimensions(spark, monkeypatch, tmp_path):
    """On vectors of three coordinates most vectors are never compared."""
    monkeypatch.setattr(hard_negatives, "PAGE", 16)
    monkeypatch.setattr(hard_negatives, "TILE", 128)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * 256).astype(np.int64)
    d = spark.createDataFrame([(i, [int(c) for c in v], i % 2, i) for i, v in enumerate(x)], "vec_id long, q array<long>, label long, row long")
    nodes = hard_negatives.pack_tree(d, 3, [0, 1, 2])
    compared = []
    best = hard_negatives.best_first
    monkeypatch.setattr(hard_negatives, "best_first", lambda a, n, f, w, take: best(a, n, f, w, lambda who, s, *r: (compared.append(s.size), take(who, s, *r))))
    ids = np.arange(0, 2000, 100)
    hard_negatives.mine(ids, ids % 2, ids, x[ids].astype(np.float64), nodes)
    assert sum(compared) < 2 * len(ids) * 2000 / 3


def test_license_findings_follow_their_documents(spark):
    """Rows behind a shuffle get the findings that they get from a file."""
    from riskloom.llm.license_scan import license_scan
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda df: {r["doc_id"]: [tuple(f) for f in r["findings"]] for r in df.collect()}
    want = key(license_scan(docs))
    got = key(license_scan(docs.groupBy("doc_id").agg(F.first("text").alias("text"))))
    assert got == want and sum(map(len, want.values())) > 0


def test_repeated_ids_lose_no_unique_line(spark):
    from riskloom.llm.line_dedup import dedup_lines
    rows = [(7, "a line that is seen twice here\nmore words stand in this one"), (7, "unique passage of the other text\nsecond unique line, quite different"),
            (8, "a line that is seen twice here\nand something else altogether")]
    got = sorted(r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    lines = [x for t in got for x in t.split("\n")]
    assert sorted(lines) == sorted({x for _, t in rows for x in t.split("\n")}) and len(got) == 3


def test_repeated_rows_take_their_own_copies(spark):
    from riskloom.llm.mixing import mix, sized, take_copies
    rows = [(1, "w " * 5, "a", "x")] * 40 + [(i, "w " * (3 + i % 7), "b", "x") for i in range(2, 60)] + [(100, "v " * 5, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    due = sum(r["copies"] for r in mix(sized(docs)).collect())
    got = take_copies(docs)
    assert got.columns == docs.columns and got.count() == due
    assert max(r["count"] for r in got.groupBy("doc_id").count().collect() if r["doc_id"] != 1) <= 3


def test_equal_rows_leave_one_document(spark):
    from riskloom.llm.order_minhash import first_of_classes
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (3, None), (3, None), (4, ""), (5, "other words altogether here"), (5, "not the same text at all"), (None, text)]
    got = sorted(map(str, first_of_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    one = [r for r in got if "word39" in r and "doc_id=None" not in r]
    assert len(one) == 1 and "doc_id=1" in one[0]
    assert sum("doc_id=5" in r for r in got) == 2


def test_packing_plan_ends_near_the_linear_program():
    """The plan uses up a histogram over all classes, and no pattern would
    improve it by more than GAP: the dual prices bound the sequences below."""
    import numpy as np

    from riskloom.llm import packing
    rng = np.random.default_rng(1)
    size = np.arange(1, 129)
    demand = (rng.pareto(1.0, 128) * 200).astype(np.int64) + 1
    prices = []
    real = packing.best_pattern

    def watched(value, *rest):
        prices.append(np.maximum(value, 0))
        return real(value, *rest)

    packing.best_pattern = watched
    try:
        plan = packing.plan_patterns(size, demand, 128)
    finally:
        packing.best_pattern = real
    assert (sum(t * c for t, c in plan) == demand).all()
    assert all((c * size).sum() <= 128 for _, c in plan)
    worth = real(prices[-1], size, 128)[0]
    bound = float(prices[-1] @ demand) / max(worth, 1)
    # rounding leaves less than a sequence a class
    assert sum(t for t, _ in plan) <= bound * (1 + packing.GAP) + 128


def quartile(values, r):
    v = sorted(values)
    return v[max(math.ceil(r * len(v)) - 1, 0)]


def test_quality_verdict_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in quality.judge(quality.features(docs)).collect()]
    for r in rows:
        w, ln = max(r["n_words"], 1), max(r["n_lines"], 1)
        r |= {"word_length": r["word_chars"] / w, "symbol_rate": r["n_symbols"] / w,
              "dup_line_rate": r["n_dup_lines"] / ln, "stutter_rate": r["n_stutter"] / w}
    ok = [r for r in rows if not r["base_failed"]]

    def blend(row, name, q):
        value, left = 0.0, 1.0
        for group in ([r for r in ok if (r["lang"], r["source"]) == (row["lang"], row["source"])],
                      [r for r in ok if r["lang"] == row["lang"]]):
            part = len(group) / (len(group) + quality.PRIOR)
            value, left = value + left * part * quartile([r[name] for r in group], q), left * (1 - part)
        return value + left * quartile([r[name] for r in ok], q)

    seen = set()
    for r in rows:
        good = not r["base_failed"]
        for name, (size, rate, below) in quality.FENCES.items() if good else ():
            low, mid, high = (blend(r, name, q) for q in (0.25, 0.5, 0.75))
            usual, has = max(blend(r, size, 0.5), 1.0), max(r[size], 1)
            short = math.sqrt(max(1.0, usual / has))
            spread = max((high - mid) * short, 1 / min(has, usual) if rate else 0.0)
            good &= r[name] <= mid + quality.SPREADS * spread
            good &= not below or r[name] >= mid - quality.SPREADS * (mid - low) * short
        assert r["kept"] == good, r
        seen.add((r["base_failed"], good))
    assert seen == {(True, False), (False, False), (False, True)}


def test_quality_fences_differ_between_groups(spark):
    limits = quality.corpus_fences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert limits.select("high_word_length").distinct().count() > limits.count() // 2
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op6_quality(spark, "/root/testdata/sf0.01").where("not base_failed").join(labels, "doc_id")
    wrong = got.where("(quality = 1) <> kept").count()
    assert wrong <= 0.01 * got.count()


def test_pivots_prune_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16))
    x = (centre[rng.integers(0, 40, 800)] + 0.1 * rng.normal(size=(800, 16))).astype(np.float32)
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)]
    members = range_join.cells(spark.createDataFrame(rows, "key long, m long, embedding array<float>"))
    assert members.select("cell").distinct().count() == range_join.MIN_PIVOTS
    assert members.where("home").count() == 800
    assert range_join.compared_pairs(members) < 800 * 800 / 2
    f = x.astype(float)
    near = (f @ f.T) / np.outer(np.linalg.norm(f, axis=1), np.linalg.norm(f, axis=1)) >= 0.9
    got = range_join.range_join(spark.createDataFrame([(i, v) for i, _, v in rows], "vec_id long, embedding array<float>"))
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {i: int(near[i].sum()) - 1 for i in range(800)}


def test_range_join_of_an_empty_table(spark):
    assert range_join.range_join(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_runs_of_keys_round_trip():
    rng = np.random.default_rng(8)
    for size, parents, items in ((0, 1, 1), (1, 1, 1), (1, 9, 1 << 39), (5000, 3, 1 << 30), (5000, 4000, 5), (20_000, 1 << 22, 1 << 39)):
        key = np.unique((rng.integers(0, parents, size) << ngram_lm.REL) | rng.integers(0, items, size))
        n = rng.integers(1, 1 << 33, len(key))
        got = ngram_lm.unsqueeze(ngram_lm.squeeze(key, n, ngram_lm.REL), ngram_lm.REL)
        assert (got[0] == key).all() and (got[1] == n).all() and len(got[0]) == len(key)


def test_exact_pass_sends_few_rows_and_compares_few_pairs(spark):
    """Texts that share a passage and little else: buckets of two ask once,
    and a block aligns no pair without a rare word in common."""
    from riskloom.llm import leaders, order_minhash
    from riskloom.llm.components import connected_components

    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(6))
    texts = {i: passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 24)) for i in range(60)}
    texts |= {100 + i: texts[i] + " end" for i in range(20, 30)}
    one = spark.createDataFrame([(i, [7, 1000 + i % 100], 30 + (i >= 100)) for i in texts], "id long, keys array<long>, size long")
    rows = leaders.bucket_rows(one)
    assert {(r["bucket"], r["n"], r["lead"]) for r in rows.collect()} == {(7, 70, 0)} | {(1000 + i, 2, i) for i in range(20, 30)}
    t = spark.createDataFrame(sorted(texts.items()), "id long, text string")
    got = {(r["id"], r["component"]) for r in connected_components(leaders.link(rows, one, t, order_minhash.rule())).collect()}
    assert got == {(i + add, i) for i in range(20, 30) for add in (0, 100)}
    # the block itself: every pair is asked about that could be linked, no other has its common items counted
    import pyarrow as pa
    ids = sorted(texts)
    own = pa.array([[{"j": 0, "bucket": 7}]] * len(ids), pa.list_(pa.struct([("j", pa.int32()), ("bucket", pa.int64())])))
    no = [False] * len(ids)
    block = pa.table({"id": ids, "j": [0] * len(ids), "component": ids, "main": no, "low": no, "left": [True] * len(ids),
                      "right": [True] * len(ids), "own": own, "text": [texts[i] for i in ids]})
    links = leaders.join_block(block, order_minhash.rule())
    assert sorted(zip(*links)) == [(i, i + 100) for i in range(20, 30)]


def test_only_level_two_keeps_counts(spark):
    df = spark.createDataFrame([(i, f"a b c d{i % 3} a b c e{i % 5}") for i in range(40)], "doc_id long, text string")
    model, _ = ngram_lm.train(df, F.lit(True), ["doc_id"])
    names = [[set(level.shard(s)[0]) for s in level.names] for level in (model.two, model.three)]
    assert all("counts" in x for x in names[0]) and names[1] and not any("counts" in x for x in names[1])


def test_exact_pass_joins_a_text_once(spark):
    """Texts in many shared buckets: a row an id meets the texts, whatever the
    number of its buckets, and its places are those of every bucket."""
    from riskloom.llm import leaders

    texts = {i: " ".join(f"w{i}x{k}" for k in range(20)) for i in range(40)}
    one = spark.createDataFrame([(i, [100 + k for k in range(6)], 20) for i in texts], "id long, keys array<long>, size long")
    t = spark.createDataFrame(sorted(texts.items()), "id long, text string")
    known = spark.createDataFrame([(1, 2)], "a long, b long")
    got = leaders.block_places(leaders.bucket_rows(one), one, known, t).collect()
    assert sorted(r["id"] for r in got) == list(range(1, 40))
    assert all(len(r["at"]) == len(r["own"]) == 6 and len({x["block"] for x in r["at"]}) == 6 for r in got)
    assert {(r["id"], r["component"]) for r in got} == {(i, max(i, 1) if i != 2 else 1) for i in range(1, 40)}


def test_blocks_together_give_the_links_of_each(monkeypatch):
    """Small blocks are compared in one go, whole, and only within a block."""
    import pyarrow as pa
    from riskloom.llm import leaders, order_minhash

    rng = np.random.default_rng(4)
    rows = []
    for block in range(40):
        for i in range(int(rng.integers(2, 9))):
            words = [f"a{block % 7}x{k}" for k in range(30)]
            for at in rng.choice(30, int(rng.integers(0, 9)), replace=False):
                words[at] = f"y{rng.integers(0, 1 << 40)}"
            key = block * 100 + i
            rows.append((block, key, 0, key, bool(rng.integers(0, 2)) and i > 0, False, i < 5, True, [{"j": 0, "bucket": 7 + block}], " ".join(words)))
    rows = [r[:6] + (r[6] and not r[4],) + r[7:] for r in rows]
    names = ["block", "id", "j", "component", "main", "low", "left", "right", "own", "text"]
    own = pa.list_(pa.struct([("j", pa.int32()), ("bucket", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(x, own) if n == "own" else pa.array(x) for n, x in zip(names, zip(*rows))], names)
    batches = [batch.slice(p, 13) for p in range(0, batch.num_rows, 13)]
    rule = order_minhash.rule()

    def classes(tables):
        comp = {r[1]: r[1] for r in rows}
        for t in tables:
            for a, b in zip(*leaders.join_block(t, rule)):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
        return comp

    monkeypatch.setattr(leaders, "SOME", 0)
    alone = list(leaders._blocks(batches))
    assert [set(t.column("block").to_pylist()) for t in alone] == [{b} for b in range(40)]
    monkeypatch.setattr(leaders, "SOME", 30)
    some = list(leaders._blocks(batches))
    assert 1 < len(some) < 40 and sum(t.num_rows for t in some) == len(rows)
    monkeypatch.setattr(leaders, "CANDIDATES", 50)
    monkeypatch.setattr(leaders, "PAIRS", 7)
    want = {r[1]: r[1] for r in rows}
    for r in rows:
        for s in rows:
            if r[0] == s[0] and r[6] and s[1] != r[1] and (s[4] or s[1] > r[1]):
                x, y = (v[-1].split() for v in (r, s))
                if sum(p != q for p, q in zip(x, y)) <= 6 and want[r[1]] != want[s[1]]:
                    low, high = sorted((want[r[1]], want[s[1]]))
                    want = {k: low if v == high else v for k, v in want.items()}
    assert classes(alone) == classes(some) == want
    assert len(set(want.values())) < len(want)
