"""Time decomposition of ``TransactionDT`` (seconds from a reference point).

F1 tx_hour / tx_day_of_week are fractional (``pmod`` on doubles, T33),
F2 tx_day / tx_week truncate, F3 cyclical sin / cos, F4 log1p(amount),
F7 night / weekend flags on the fractional values (T8), F30 integer day of
week used only by profiling (T9).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import ROLES


def tx_hour(dt: Column) -> Column:
    return F.pmod(dt.cast("double") / F.lit(3600.0), F.lit(24.0))


def tx_day_of_week(dt: Column) -> Column:
    return F.pmod(dt.cast("double") / F.lit(86400.0), F.lit(7.0))


def add_time_features(df: DataFrame, time_col: str = ROLES.time, amount_col: str = ROLES.amount) -> DataFrame:
    """F1-F4 as one projection (single codegen stage, no shuffle)."""
    dt = F.col(time_col)
    hour = tx_hour(dt)
    dow = tx_day_of_week(dt)
    two_pi = 2 * math.pi
    return df.withColumns({
        "tx_hour": hour,
        "tx_day_of_week": dow,
        "tx_day": (dt.cast("double") / 86400.0).cast("bigint"),
        "tx_week": (dt.cast("double") / 604800.0).cast("bigint"),
        "tx_hour_sin": F.sin(F.lit(two_pi) * hour / 24),
        "tx_hour_cos": F.cos(F.lit(two_pi) * hour / 24),
        "tx_dow_sin": F.sin(F.lit(two_pi) * dow / 7),
        "tx_dow_cos": F.cos(F.lit(two_pi) * dow / 7),
        "tx_amount_log": F.log1p(F.col(amount_col)),
    })


def night_flag(hour: Column) -> Column:
    """hour in [22, 24] or [0, 6] on the fractional hour."""
    return (hour.between(22, 24) | hour.between(0, 6)).cast("int")


def weekend_flag(dow: Column) -> Column:
    return (dow >= 5).cast("int")


def int_hour(dt: Column) -> Column:
    """Integer hour used by profiling (floor of the fractional hour)."""
    return F.floor(tx_hour(dt)).cast("int")


def int_day_of_week(dt: Column) -> Column:
    """integer day of week, pmod(floor(dt / 86400), 7)."""
    return F.pmod(F.floor(dt / 86400), F.lit(7)).cast("int")
