"""J1 transaction / identity merge, J2 identity match rate, P17 drop-then-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import ROLES


def merge_identity(tx: DataFrame, identity: DataFrame, key: str = ROLES.id) -> DataFrame:
    """Left equi-join on the transaction id.  Both sides grow with the
    data, so this is a shuffle join that AQE may turn into a broadcast only
    when the identity side is measured small at run time."""
    clash = [c for c in identity.columns if c != key and c in tx.columns]
    return tx.join(identity.drop(*clash), on=key, how="left")


def identity_match(tx: DataFrame, identity: DataFrame, key: str = ROLES.id) -> DataFrame:
    """Identity rows whose id exists in the transaction table (semi join)."""
    n_tx = tx.agg(F.count(F.lit(1)).alias("n_transactions"))
    matched = identity.join(tx.select(key), on=key, how="left_semi").agg(
        F.count(F.lit(1)).alias("n_identity_matched"))
    n_id = identity.agg(F.count(F.lit(1)).alias("n_identity"))
    return n_tx.crossJoin(n_id).crossJoin(matched).select(
        "n_transactions", "n_identity", "n_identity_matched",
        F.try_divide(F.col("n_identity_matched").cast("double"), F.col("n_transactions")).alias("match_rate"),
    )


def safe_join(df: DataFrame, stats: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Drop columns of ``df`` that the stats table also produces, then join
    (idempotent re-fit on an already-augmented table)."""
    keys = [on] if isinstance(on, str) else list(on)
    clash = [c for c in stats.columns if c not in keys and c in df.columns]
    return df.drop(*clash).join(stats, on=keys, how=how)
