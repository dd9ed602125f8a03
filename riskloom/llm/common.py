"""Shared tables, shared files and small column helpers of the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir

# fixed value: the white space that separates words is \x20 and \x09-\x0D
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, hashes: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage in files that survive a lost executor.  Tables that are mostly
    ``hashes`` get no dictionaries, which would not shorten them."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.option("parquet.enable.dictionary", not hashes).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def train_fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5 (null id: -1)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)).cast("int"), F.lit(-1))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` next to a struct ``doc`` of all columns, so that
    no column of the input can clash with a working column."""
    return docs.select(*names, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
