"""Quality rules with adaptive thresholds.

One pass counts the features of every whole text; KLL quantile sketches per
(lang, source), which merge into those of the language and of the corpus, give
quartiles; those of a group are drawn to the wider ones' the more the smaller it
is.  Joined to the documents they fence each feature, in spreads around the
median; no bound on a feature is fixed.

Null or empty text: all counts 0, rejected by the word minimum.  Null lang or
source: a group of its own.  Rows with equal doc_id are judged one by one.  An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.llm.common import stored, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# fixed value: symbol characters
SYMBOLS = "#*$%&|<>"
PRIOR = 100             # documents that the wider group counts for beside a group's own
SPREADS = 8             # a fence is so many spreads from the median
# feature: (the count it is a mean over, whether it is a rate of whole events, whether low values fail too)
FENCES = {
    "word_length": ("n_words", False, True),
    "symbol_rate": ("n_words", True, False),
    "dup_line_rate": ("n_lines", True, False),
    "stutter_rate": ("n_words", True, False),
}
SIZES = ("n_words", "n_lines")
QUARTILES = {"low": 0.25, "mid": 0.5, "high": 0.75}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter")


def _repeated_in(key: np.ndarray) -> np.ndarray:
    """Mask of the values that occur more than once."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    eq = k[1:] == k[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def count_features(col: pa.Array) -> dict[str, np.ndarray]:
    n = len(col)
    buf, off = W.text_bytes(col)
    s, e = W.word_spans(buf, off)
    doc = W.owner_of_words(off, s)
    n_words = np.bincount(doc, minlength=n)
    size = int(off[-1])
    ahead = lambda mask: np.concatenate([[0], np.cumsum(mask[:size], dtype=np.int64)])
    body = ahead(~W.is_space(buf) & ((buf & 0xC0) != 0x80))
    table256 = np.zeros(256, bool)
    table256[list(SYMBOLS.encode())] = True
    sym = ahead(table256[buf])
    # lines
    ls, ldoc = W.line_starts(buf, off)
    le = np.maximum(ls[1:] - ((ls[1:] > ls[:-1]) & (buf[np.maximum(ls[1:] - 1, 0)] == 10)), ls[:-1])
    wordy = ahead(~W.is_space(buf))
    has = wordy[le] > wordy[ls[:-1]]
    lh, ld = W.hash_spans(buf, ls[:-1][has], le[has]), ldoc[has]
    with np.errstate(over="ignore"):
        lk = W.mix(lh + ld.astype(np.uint64) * W.U(0x9E3779B97F4A7C15))
    first = np.unique(lk, return_index=True)[1]
    lines = np.bincount(ld, minlength=n)
    dup = lines - np.bincount(ld[first], minlength=n)
    # repeated windows
    repeat = np.zeros(n, np.int64)
    h = W.hash_spans(buf, s, e)
    stutter = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    if len(s) >= WINDOW:
        m = len(h) - WINDOW + 1
        with np.errstate(over="ignore"):
            key = np.zeros(m, np.uint64)
            for k in range(WINDOW):
                key = key * W.U(0x9FB21C651E98DF25) + h[k:k + m]
            whole = doc[:m] == doc[WINDOW - 1:]
            at = np.flatnonzero(whole)
            key = W.mix(key[at] + doc[at].astype(np.uint64) * W.U(0x9E3779B97F4A7C15))
        at = at[_repeated_in(key)]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {"n_words": n_words, "word_chars": body[off[1:]] - body[off[:-1]], "n_symbols": sym[off[1:]] - sym[off[:-1]],
            "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "n_stutter": stutter}


def features(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``carry`` and the counts of each document."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"{c} long" for c in COUNTS])

    def run(batches):
        for b in batches:
            for c in W.chunks(b):
                f = count_features(c.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [c.column(k) for k in carry] + [pa.array(f[k].astype(np.int64)) for k in COUNTS], [*carry, *COUNTS])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def _rates(df: DataFrame) -> DataFrame:
    w, ln = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return df.withColumns({"word_length": F.col("word_chars") / w, "symbol_rate": F.col("n_symbols") / w,
                           "dup_line_rate": F.col("n_dup_lines") / ln, "stutter_rate": F.col("n_stutter") / w})


def fences(rated: DataFrame) -> DataFrame:
    """(lang, source) -> quartiles of each feature and the median sizes, from
    KLL sketches of the documents that pass the base rules.  The sketches of a
    group merge into those of its language and of the corpus; a group of n
    documents weighs n / (n + PRIOR) against its language, and that likewise
    against the corpus, so that small groups lean on the wider ones."""
    ok = rated.where(~F.col("base_failed"))
    names = [*FENCES, *SIZES]
    cells = ok.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(f).cast("double")).alias(f) for f in names])
    cells = stored(cells, "quality")
    lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_n"),
                                     *[F.kll_merge_agg_double(f).alias(f"lang_{f}") for f in names])
    corpus = cells.agg(*[F.kll_merge_agg_double(f).alias(f"all_{f}") for f in names])
    every = cells.join(lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))) \
        .crossJoin(F.broadcast(corpus))
    own, wide = F.col("n") / (F.col("n") + PRIOR), F.col("lang_n") / (F.col("lang_n") + PRIOR)

    def blend(name: str, r: float):
        q = lambda c: F.kll_sketch_get_quantile_double(F.col(c), F.lit(r))
        return own * q(name) + (1 - own) * (wide * q(f"lang_{name}") + (1 - wide) * q(f"all_{name}"))

    return every.select("lang", "source", *[blend(f, r).alias(f"{at}_{f}") for f in FENCES for at, r in QUARTILES.items()],
                        *[blend(z, 0.5).alias(f"usual_{z}") for z in SIZES])


def within(name: str):
    """Whether a document's feature lies within the fences of its group.  The
    spread is that between the median and a quartile, wider for texts shorter
    than usual as for any mean, and for a rate no finer than one event in a
    text of this size or, if that is shorter, of the usual size."""
    size, rate, below = FENCES[name]
    has, usual = F.greatest(F.col(size), F.lit(1)), F.greatest(F.col(f"usual_{size}"), F.lit(1.0))
    short = F.sqrt(F.greatest(F.lit(1.0), usual / has))
    mid, up, down = F.col(f"mid_{name}"), F.col(f"high_{name}") - F.col(f"mid_{name}"), F.col(f"mid_{name}") - F.col(f"low_{name}")
    spread = F.greatest(up * short, 1 / F.least(has.cast("double"), usual)) if rate else up * short
    inside = F.col(name) <= mid + SPREADS * spread
    return inside & (F.col(name) >= mid - SPREADS * down * short) if below else inside


def judge(counted: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Adds base_failed and kept to counted documents (see ``features``);
    limits: the fences of a whole corpus, else those of these documents."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rated = _rates(counted).withColumn("base_failed", failed)
    f = (fences(rated) if limits is None else limits).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = rated.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    good = ~F.col("base_failed")
    for name in FENCES:
        good &= F.coalesce(within(name), F.lit(True))
    return out.withColumn("kept", good).select(*counted.columns, "base_failed", "kept")


def corpus_fences(docs: DataFrame) -> DataFrame:
    """The fences of all documents, written once."""
    counted = features(docs, ("lang", "source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stored(fences(_rates(counted).withColumn("base_failed", failed)), "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.  A second pass counts
    again instead of storing the texts between the passes."""
    limits = corpus_fences(docs)
    rest = [c for c in docs.columns if c not in ("text", "lang", "source")]
    d = docs.select("text", "lang", "source", F.struct(*[docs[c] for c in rest]).alias("doc"))
    kept = judge(features(d, ("text", "lang", "source", "doc")), limits).where("kept")
    return kept.select(*[F.col(c) if c in ("text", "lang", "source") else F.col("doc")[c].alias(c) for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(features(table(spark, sf_dir, "documents")), "quality")
    return judge(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                 "base_failed", "kept")
