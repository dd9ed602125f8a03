"""Steps of line dedup that compare few lines exactly: sketches of whole
batches, marks of shingles, places of lines."""

import numpy as np
import pyarrow as pa

from riskloom.llm import leaders, line_dedup
from riskloom.llm import words as W

TEXTS = ["a", "b\n\n  two words \r\n\tÄpfel und Öl, süß\n" + "x" * 300, "", "   ", "c", "aaaaaaaaaaaaaaaaaaaaaaaa\nshort\n1234567\n12345678", "日本語の行です\nlast line without end ", "z"]


def shingles(line):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in line.encode())
    return {b[k:k + 8] for k in range(max(1, len(b) - 7))}


def batch_of(pairs):
    a, b, x, y = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(x), pa.array(b, pa.int64()), pa.array(y)], ["a", "x", "b", "y"])


def test_keys_of_a_line_do_not_depend_on_its_batch(monkeypatch):
    buf, off = W.text_bytes(pa.array(TEXTS))
    buf = W.lower_az(buf)
    doc, _, s, e = line_dedup.line_spans(buf, off)
    lines = [bytes(buf[p:q]).decode() for p, q in zip(s, e)]
    assert lines == [x.strip(" \t\r").encode().lower().decode() for t in TEXTS for x in t.split("\n") if x.strip(" \t\r")]
    whole = line_dedup.band_keys(buf, s, e)
    for block in (1, 20, 1 << 16):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        assert (line_dedup.band_keys(buf, s, e) == whole).all()
    items, n = line_dedup.rule().items(pa.array(lines))
    end = np.cumsum(n)
    for k, x in enumerate(lines):
        one, at = W.text_bytes(pa.array([x]))
        assert (line_dedup.band_keys(one, at[:1], at[1:]) == whole[k]).all()
        alone, m = line_dedup.rule().items(pa.array([x]))
        assert m[0] == n[k] == max(len(x.encode()) - 7, 1) and (alone == items[end[k] - n[k]:end[k]]).all()
        assert len(np.unique(alone)) == len(shingles(x))
    assert len(np.unique(whole[:, 0])) == len(set(map(frozenset, map(shingles, lines))))


def test_places_of_lines_are_bytes_of_the_text(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in line_dedup.lines_of(d).collect():
        text = TEXTS[r["doc_id"]]
        line = text.encode()[r["start"]:r["start"] + r["length"]].decode()
        assert line == text.split("\n")[r["line_no"]].strip(" \t\r")


def test_pairs_far_apart_are_not_compared_exactly():
    """Unrelated lines are told apart by their marks; the verdicts are those of
    the exact similarity, at the threshold too."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    pairs = []
    for k in range(400):
        x = " ".join(word() for _ in range(int(rng.integers(1, 40))))
        if k % 2:
            y = " ".join(word() for _ in range(int(rng.integers(1, 40))))
        else:
            y = list(x)
            for at in rng.integers(0, len(y), int(rng.integers(0, 1 + len(y) // 40))):
                y[at] = "#"
            y = "".join(y) + " and" * int(rng.integers(0, 3))
        pairs += [(k, 1000 + k, x, y), (k, 2000 + k, x, word() * int(rng.integers(1, 30)))]
    pairs += [(900, 901, "a" * 50, "A" * 9), (900, 902, "a" * 50, "b"), (903, 904, "b", "B"), (905, 906, "", "b")]
    rule, asked = line_dedup.rule(), []
    counted = rule._replace(same=lambda p, q: asked.append(1) or rule.same(p, q))
    got = {(r["a"], r["b"]): r["ok"] for t in leaders.verified([batch_of(pairs)], counted) for r in t.to_pylist()}
    want = {(a, b): bool(x) and len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y)) - 1e-9 for a, b, x, y in pairs}
    assert got == want
    near = sum(len(shingles(x) & shingles(y)) >= 0.5 * len(shingles(x) | shingles(y)) for _, _, x, y in pairs)
    assert sum(want.values()) > 50 and len(asked) <= near + 20 < len(pairs) // 2


def test_marks_never_part_linked_word_sequences():
    from riskloom.llm import order_minhash
    rng = np.random.default_rng(2)
    rule, pairs = order_minhash.rule(), []
    for k in range(300):
        x = [f"w{v}" for v in rng.integers(0, int(rng.choice([3, 40, 10000])), int(rng.integers(1, 120)))]
        y = list(x)
        for at in rng.integers(0, len(y), len(y) // 5):
            y[at] = f"y{rng.integers(0, 5)}"
        pairs.append((k, 1000 + k, " ".join(x), " ".join(y)))
    (h, m), (g, n) = (rule.items(pa.array([p[i] for p in pairs])) for i in (2, 3))
    at, to = np.cumsum(m), np.cumsum(n)
    want = [rule.same(h[at[k] - m[k]:at[k]], g[to[k] - n[k]:to[k]]) for k in range(300)]
    for bits in (None, 512):
        bits = bits or leaders.mark_bits(h, m)
        apart = leaders._apart(leaders._marks(h, m, bits), np.arange(300), leaders._marks(g, n, bits), np.arange(300))
        assert not (rule.far(m, n, apart) & want).any()
    assert all(want)


def test_lines_of_repeated_documents_and_odd_characters(spark):
    """Removed lines are those of a plain loop over all lines."""
    docs = [*enumerate(TEXTS), (20, TEXTS[1]), (20, TEXTS[1]), (21, "  SHORT\nc\n" + "x" * 299 + "y"), (22, "Äpfel und Öl, süß"), (None, "a"), (23, None)]
    kept, want = [], set()
    for i, t in sorted({(i, t) for i, t in docs if i is not None and t is not None}):
        for k, x in enumerate(t.split("\n")):
            x = x.strip(" \t\r")
            if x and any(len(shingles(x) & y) >= 0.8 * len(shingles(x) | y) for y in kept):
                want.add((i, k))
            elif x:
                kept.append(shingles(x))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], k) for r in line_dedup.removed_lines(d).collect() for k in r["removed"]}
    assert got == want and len(want) >= 5
