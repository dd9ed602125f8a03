"""DuckDB reference SQL for the registered queries.

Every statement starts from the raw driver tables through the same
canonical-view CTEs (``CANON``), so the oracle shares no code with the Spark
plans.  Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

CANON = """
ev AS (
  SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
),
tx AS (
  SELECT CAST(event_id AS BIGINT) AS TransactionID,
         CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + 86400 AS TransactionDT,
         value AS TransactionAmt,
         event_type AS ProductCD,
         CAST(user_id AS BIGINT) AS card1,
         CASE WHEN k % 10 = 9 THEN NULL ELSE CAST(100 + k % 40 AS DOUBLE) END AS addr1,
         CASE k % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.com' WHEN 2 THEN 'hotmail.com' END AS P_emaildomain,
         CAST(CASE WHEN (event_type = 'error' AND value >= 60) OR k = 13 THEN 1 ELSE 0 END AS INTEGER) AS isFraud
  FROM ev
),
idn AS (
  SELECT CAST(event_id AS BIGINT) AS TransactionID,
         CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' END AS DeviceType,
         CASE WHEN k % 20 = 19 THEN NULL ELSE 'Device_' || CAST(1 + k % 20 AS VARCHAR) END AS DeviceInfo
  FROM ev WHERE event_id % 4 = 0
),
merged AS (
  SELECT tx.*, idn.DeviceType, idn.DeviceInfo FROM tx LEFT JOIN idn USING (TransactionID)
),
timed AS (
  SELECT *,
         (TransactionDT / 3600.0) % 24 AS tx_hour,
         (TransactionDT / 86400.0) % 7 AS tx_day_of_week,
         CAST(trunc(TransactionDT / 86400.0) AS BIGINT) AS tx_day,
         CAST(trunc(TransactionDT / 604800.0) AS BIGINT) AS tx_week,
         ln(1 + TransactionAmt) AS tx_amount_log,
         sin(2 * pi() * ((TransactionDT / 3600.0) % 24) / 24) AS tx_hour_sin,
         cos(2 * pi() * ((TransactionDT / 3600.0) % 24) / 24) AS tx_hour_cos,
         sin(2 * pi() * ((TransactionDT / 86400.0) % 7) / 7) AS tx_dow_sin,
         cos(2 * pi() * ((TransactionDT / 86400.0) % 7) / 7) AS tx_dow_cos
  FROM merged
)"""


def with_canon(body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + CANON + ",\n" + body.strip()


def r6(expr: str, alias: str | None = None) -> str:
    """Oracle side of ``round6``."""
    out = f"round(CAST({expr} AS DOUBLE) * (1.0 + 1e-11), 6)"
    return f"{out} AS {alias}" if alias else out
