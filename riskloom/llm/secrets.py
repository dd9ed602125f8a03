"""Secret scans: spans of secrets and the corpus-wide ownership of each value.

Every text is scanned whole by JVM regular expressions.  The value of each
span is hashed; a hash that many owners or many repositories share is a copied
example, one that a single owner uses in few places and that looks random is a
live-looking credential.  The corpus names neither: the source stands in for
the owner, and the document (source, language, doc_id) for the repository.

Nulls and empty texts have no span.  Null owners and repositories count as
one owner or repository of their own.  Rows with equal doc_id are scanned and
returned one by one.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import clean_text, stored, table

# fixed values: base kinds in listed order, then the kinds that the scan adds:
# (kind, pattern, group that holds the value, least length of the value)
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("gh", r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 1),
)
N_BASE = 3
EXAMPLE_OWNERS = 3          # so many owners: an example that was copied widely
EXAMPLE_REPOSITORIES = 10   # so many repositories, of whatever owners: an example as well
LIVE_USES = 100             # so many uses are no longer live-looking
LIVE_DISTINCT_CHARS = 8     # so many different characters: looks random


def kind_spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping
    matches whose value is long enough; offsets in code points, end exclusive.
    The pieces between the matches give the offsets."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(between.alias("gap"), whole.alias("hit"), value.alias("value"))
    parts = F.slice(parts, F.lit(1), F.size(whole))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc, p):
        start = acc["pos"] + p["gap"]
        end = start + F.length(p["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), F.filter(found, lambda s: F.length(s["value"]) >= least)).otherwise(empty)


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: doc_id, owner, repository, spans (array of
    start, kind number, end, value, by start and kind) and a row number."""
    text = clean_text()
    every = F.concat(*[kind_spans(text, p, g, least, i) for i, (_, p, g, least) in enumerate(KINDS)])
    return docs.select("doc_id", F.coalesce(owner, F.lit("")).alias("owner"),
                       F.coalesce(repository, F.lit("")).alias("repository"),
                       F.array_sort(every).alias("spans"), F.monotonically_increasing_id().alias("row"))


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a value: uses, distinct owners and repositories, verdict
    (example, live or unclear).  Distinct (hash, owner, repository) first, so
    a value with a third of all uses is summed up before it moves."""
    one = found.select("owner", "repository", F.explode("spans").alias("s")) \
        .select(F.sha2(F.col("s.value"), 256).alias("value_hash"), "owner", "repository",
                F.size(F.array_distinct(F.split(F.col("s.value"), ""))).alias("chars"))
    places = one.groupBy("value_hash", "owner", "repository").agg(
        F.count(F.lit(1)).alias("uses"), F.max("chars").alias("chars"))
    per = places.groupBy("value_hash").agg(
        F.sum("uses").alias("uses"), F.countDistinct("owner").alias("owners"),
        F.count(F.lit(1)).alias("repositories"), F.max("chars").alias("chars"))
    verdict = F.when((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES), "example") \
        .when((F.col("owners") == 1) & (F.col("uses") < LIVE_USES) & (F.col("chars") >= LIVE_DISTINCT_CHARS), "live").otherwise("unclear")
    return per.withColumn("verdict", verdict)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """doc_id, spans with values, and how many spans are live-looking,
    examples or unclear by ownership over the whole corpus."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")) if repository is None else repository
    found = stored(scan(docs, owner, repository), "secrets")
    own = ownership(found).select("value_hash", "verdict")
    hits = found.select("row", F.explode("spans").alias("s")).select(
        "row", F.sha2(F.col("s.value"), 256).alias("value_hash"))
    n = hits.join(own, "value_hash").groupBy("row").agg(
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example", "unclear")])
    out = found.select("doc_id", "row", "spans").join(n, "row", "left")
    return out.na.fill(0, ["n_live", "n_example", "n_unclear"]).drop("row")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < N_BASE)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        "n_live", "n_example", "n_unclear")
