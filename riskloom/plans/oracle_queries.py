"""Oracle SQL per registered query (DuckDB dialect)."""

from __future__ import annotations

from riskloom.plans.oracle_sql import r6, with_canon

PRODUCTS = ("click", "error", "purchase", "signup", "view")  # event types in the driver data

ORACLE: dict[str, str] = {}

_SHARES = ",\n".join(
    f"coalesce(sum(CASE WHEN ProductCD = '{p}' THEN p END), 0) AS card_freq_product_{p}" for p in PRODUCTS)
_STAT_COLS = (["card_tx_count", "card_tx_mean_amt", "card_tx_std_amt", "card_tx_max_amt", "card_tx_min_amt",
               "card_hour_mean"] + [f"card_freq_product_{p}" for p in PRODUCTS] + ["card_merchant_entropy"])
_MEDIANS = ",\n".join(f"median({c}) AS m_{c}" for c in _STAT_COLS)
_FILLED = ",\n".join(
    f"CAST(coalesce(j.{c}, m.m_{c}) AS DOUBLE) AS {c}" for c in _STAT_COLS)

BEHAVIOUR_BODY = f"""
cs AS (
  SELECT card1, count(TransactionAmt) AS card_tx_count, avg(TransactionAmt) AS card_tx_mean_amt,
         stddev_samp(TransactionAmt) AS card_tx_std_amt, max(TransactionAmt) AS card_tx_max_amt,
         min(TransactionAmt) AS card_tx_min_amt, median(tx_hour) AS card_hour_mean
  FROM timed WHERE card1 IS NOT NULL GROUP BY card1
),
pc AS (SELECT card1, ProductCD, count(*) AS n FROM timed
       WHERE card1 IS NOT NULL AND ProductCD IS NOT NULL GROUP BY card1, ProductCD),
pp AS (SELECT card1, ProductCD, n / sum(n) OVER (PARTITION BY card1) AS p FROM pc),
sh AS (SELECT card1, {_SHARES},
       -sum(p * ln(p + 1e-9)) AS card_merchant_entropy FROM pp GROUP BY card1),
j AS (SELECT t.*, cs.* EXCLUDE (card1), sh.* EXCLUDE (card1)
      FROM timed t LEFT JOIN cs USING (card1) LEFT JOIN sh USING (card1)),
m AS (SELECT {_MEDIANS} FROM j),
fm AS (SELECT avg(TransactionAmt) AS frame_mean FROM timed),
f AS (
  SELECT j.TransactionID, j.card1, j.TransactionDT, j.TransactionAmt, j.tx_hour, j.tx_day_of_week,
         j.tx_day, j.tx_week, j.tx_amount_log, {_FILLED}
  FROM j, m
),
g AS (
  SELECT f.*,
         coalesce(card_tx_mean_amt, fm.frame_mean) AS mean_fill,
         CASE WHEN card_tx_std_amt IS NULL OR card_tx_std_amt = 0 THEN 1.0 ELSE card_tx_std_amt END AS std_fill
  FROM f, fm
),
vel AS (
  SELECT a.TransactionID,
         count(b.TransactionID) FILTER (WHERE b.TransactionDT >= a.TransactionDT - 3600) AS c1h,
         count(b.TransactionID) FILTER (WHERE b.TransactionDT >= a.TransactionDT - 86400) AS c24h,
         count(b.TransactionID) FILTER (WHERE b.TransactionDT >= a.TransactionDT - 604800) AS c7d,
         coalesce(a.TransactionDT - max(b.TransactionDT), 0) AS since_last
  FROM timed a LEFT JOIN timed b
    ON a.card1 = b.card1
   AND (b.TransactionDT < a.TransactionDT
        OR (b.TransactionDT = a.TransactionDT AND b.TransactionID < a.TransactionID))
  GROUP BY a.TransactionID, a.TransactionDT
),
beh AS (
  SELECT g.* EXCLUDE (mean_fill, std_fill),
         (TransactionAmt - mean_fill) / std_fill AS amount_zscore,
         TransactionAmt / (mean_fill + 1e-9) AS card_amount_ratio,
         CAST(v.since_last AS DOUBLE) AS time_since_last_tx,
         CAST(v.c1h AS INTEGER) AS card_tx_count_1h,
         CAST(v.c24h AS INTEGER) AS card_tx_count_24h,
         CAST(v.c7d AS INTEGER) AS card_tx_count_7d,
         CAST(CASE WHEN tx_hour BETWEEN 22 AND 24 OR tx_hour BETWEEN 0 AND 6 THEN 1 ELSE 0 END AS INTEGER) AS tx_is_night,
         CAST(CASE WHEN tx_day_of_week >= 5 THEN 1 ELSE 0 END AS INTEGER) AS tx_is_weekend
  FROM g JOIN vel v USING (TransactionID)
)"""


BEHAVIOUR_INTS = ["TransactionID", "card1", "TransactionDT", "tx_day", "tx_week", "card_tx_count",
                  "card_tx_count_1h", "card_tx_count_24h", "card_tx_count_7d", "tx_is_night", "tx_is_weekend"]
BEHAVIOUR_DOUBLES = ["TransactionAmt", "tx_hour", "tx_day_of_week", "tx_amount_log", "card_tx_mean_amt",
                     "card_tx_std_amt", "card_tx_max_amt", "card_tx_min_amt", "card_hour_mean",
                     "card_merchant_entropy", "amount_zscore", "card_amount_ratio", "time_since_last_tx"] + \
                    [f"card_freq_product_{p}" for p in PRODUCTS]


def select_list(ints: list[str], doubles: list[str]) -> str:
    return ", ".join(ints + [r6(c, c) for c in doubles])


ORACLE["card_behaviour"] = with_canon(
    BEHAVIOUR_BODY + f"\nSELECT {select_list(BEHAVIOUR_INTS, BEHAVIOUR_DOUBLES)} FROM beh")


DEVICE_BODY = """
dstat AS (
  SELECT DeviceInfo, count(DISTINCT card1) AS device_user_count, count(card1) AS device_tx_count,
         avg(CAST(isFraud AS DOUBLE)) AS device_fraud_rate,
         least(count(DISTINCT card1) * avg(CAST(isFraud AS DOUBLE)), 10.0) / 10 AS device_risk_score
  FROM merged WHERE DeviceInfo IS NOT NULL GROUP BY DeviceInfo
),
estat AS (
  SELECT P_emaildomain, count(DISTINCT card1) AS email_user_count,
         avg(CAST(isFraud AS DOUBLE)) AS email_domain_fraud_rate
  FROM merged WHERE P_emaildomain IS NOT NULL GROUP BY P_emaildomain
),
astat AS (
  SELECT addr1, count(DISTINCT card1) AS addr_user_count, avg(CAST(isFraud AS DOUBLE)) AS addr_fraud_rate
  FROM merged WHERE addr1 IS NOT NULL GROUP BY addr1
),
cstat AS (
  SELECT card1, count(DISTINCT DeviceInfo) AS card_device_count, count(DISTINCT P_emaildomain) AS card_email_count
  FROM merged WHERE card1 IS NOT NULL GROUP BY card1
),
dj AS (
  SELECT m.TransactionID,
         coalesce(d.device_user_count, 0) AS device_user_count, coalesce(d.device_tx_count, 0) AS device_tx_count,
         coalesce(d.device_fraud_rate, 0) AS device_fraud_rate, coalesce(d.device_risk_score, 0) AS device_risk_score,
         coalesce(e.email_user_count, 1) AS email_user_count,
         coalesce(e.email_domain_fraud_rate, 0) AS email_domain_fraud_rate,
         coalesce(a.addr_user_count, 1) AS addr_user_count, coalesce(a.addr_fraud_rate, 0) AS addr_fraud_rate,
         coalesce(c.card_device_count, 1) AS card_device_count, coalesce(c.card_email_count, 1) AS card_email_count,
         CASE coalesce(lower(m.DeviceType), 'unknown') WHEN 'mobile' THEN 0.4 WHEN 'desktop' THEN 0.2
              WHEN 'unknown' THEN 0.6 ELSE 0.5 END AS device_type_risk
  FROM merged m
  LEFT JOIN dstat d USING (DeviceInfo) LEFT JOIN estat e USING (P_emaildomain)
  LEFT JOIN astat a USING (addr1) LEFT JOIN cstat c USING (card1)
),
dev AS (
  SELECT dj.*, 0.5 * ln(1 + card_device_count) + 0.5 * ln(1 + card_email_count) AS identity_mismatch_score,
         CAST(CASE WHEN device_user_count > (SELECT quantile_cont(device_user_count, 0.95) FROM dj)
              THEN 1 ELSE 0 END AS INTEGER) AS device_is_high_risk
  FROM dj
)"""

ORACLE["device_stats"] = with_canon(DEVICE_BODY + "\nSELECT DeviceInfo, device_user_count, device_tx_count, "
                                    + r6("device_fraud_rate", "device_fraud_rate") + ", "
                                    + r6("device_risk_score", "device_risk_score") + " FROM dstat")
ORACLE["email_stats"] = with_canon(DEVICE_BODY + "\nSELECT P_emaildomain, email_user_count, "
                                   + r6("email_domain_fraud_rate", "email_domain_fraud_rate") + " FROM estat")
ORACLE["addr_stats"] = with_canon(DEVICE_BODY + "\nSELECT " + r6("addr1", "addr1") + ", addr_user_count, "
                                  + r6("addr_fraud_rate", "addr_fraud_rate") + " FROM astat")
ORACLE["card_identity_counts"] = with_canon(DEVICE_BODY + "\nSELECT * FROM cstat")
DEVICE_INTS = ["TransactionID", "device_user_count", "device_tx_count", "email_user_count", "addr_user_count",
               "card_device_count", "card_email_count", "device_is_high_risk"]
DEVICE_DOUBLES = ["device_fraud_rate", "device_risk_score", "email_domain_fraud_rate", "addr_fraud_rate",
                  "device_type_risk", "identity_mismatch_score"]
ORACLE["device_features"] = with_canon(DEVICE_BODY + f"\nSELECT {select_list(DEVICE_INTS, DEVICE_DOUBLES)} FROM dev")

ORACLE["entity_risk"] = with_canon(BEHAVIOUR_BODY + "," + DEVICE_BODY + """,
cr AS (
  SELECT b.TransactionID, b.card_amount_ratio,
         d.device_fraud_rate * d.email_domain_fraud_rate AS device_x_email_risk,
         d.addr_fraud_rate * d.device_fraud_rate AS addr_x_device_risk,
         coalesce(d.device_fraud_rate, 0) + coalesce(d.email_domain_fraud_rate, 0) + coalesce(d.addr_fraud_rate, 0)
           AS total_entity_risk,
         greatest(d.device_fraud_rate, d.email_domain_fraud_rate, d.addr_fraud_rate) AS max_entity_risk
  FROM beh b JOIN dev d USING (TransactionID)
)
SELECT TransactionID, """ + ", ".join(r6(c, c) for c in (
    "card_amount_ratio", "device_x_email_risk", "addr_x_device_risk", "total_entity_risk", "max_entity_risk")) + ", "
    + r6("card_amount_ratio * max_entity_risk", "high_amt_x_entity_risk") + " FROM cr")


PREP_BODY = """
enc AS (
  SELECT col AS "column", value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS code
  FROM (
    SELECT DISTINCT 'ProductCD' AS col, coalesce(ProductCD, 'Unknown') AS value FROM fitset
    UNION SELECT DISTINCT 'P_emaildomain', coalesce(P_emaildomain, 'Unknown') FROM fitset
    UNION SELECT DISTINCT 'DeviceType', coalesce(DeviceType, 'Unknown') FROM fitset
    UNION SELECT DISTINCT 'DeviceInfo', coalesce(DeviceInfo, 'Unknown') FROM fitset
  )
),
med AS (SELECT median(addr1) AS m_addr1, median(TransactionAmt) AS m_amt, median(card1) AS m_card FROM fitset),
prep AS (
  SELECT t.TransactionID, t.isFraud,
    coalesce((SELECT code FROM enc WHERE "column" = 'ProductCD' AND value = coalesce(t.ProductCD, 'Unknown')), -1) AS ProductCD,
    coalesce((SELECT code FROM enc WHERE "column" = 'P_emaildomain' AND value = coalesce(t.P_emaildomain, 'Unknown')), -1) AS P_emaildomain,
    coalesce((SELECT code FROM enc WHERE "column" = 'DeviceType' AND value = coalesce(t.DeviceType, 'Unknown')), -1) AS DeviceType,
    coalesce((SELECT code FROM enc WHERE "column" = 'DeviceInfo' AND value = coalesce(t.DeviceInfo, 'Unknown')), -1) AS DeviceInfo,
    coalesce(t.addr1, med.m_addr1) AS addr1, coalesce(t.TransactionAmt, med.m_amt) AS TransactionAmt,
    coalesce(CAST(t.card1 AS DOUBLE), med.m_card) AS card1
  FROM timed t, med
)"""
PREP_SELECT = ("SELECT TransactionID, isFraud, CAST(ProductCD AS INTEGER) AS ProductCD, "
               "CAST(P_emaildomain AS INTEGER) AS P_emaildomain, CAST(DeviceType AS INTEGER) AS DeviceType, "
               "CAST(DeviceInfo AS INTEGER) AS DeviceInfo, " + r6("addr1", "addr1") + ", "
               + r6("TransactionAmt", "TransactionAmt") + ", card1 FROM prep")
ORACLE["label_encoders"] = with_canon("fitset AS (SELECT * FROM timed)," + PREP_BODY + "\nSELECT * FROM enc")
ORACLE["preprocessed"] = with_canon("fitset AS (SELECT * FROM timed)," + PREP_BODY + "\n" + PREP_SELECT)
ORACLE["encode_unseen"] = with_canon("fitset AS (SELECT * FROM timed WHERE TransactionDT < 20 * 86400),"
                                     + PREP_BODY + "\n" + PREP_SELECT)
_NUMS = ["TransactionDT", "TransactionAmt", "card1", "addr1", "tx_hour", "tx_day_of_week", "tx_day", "tx_week",
         "tx_hour_sin", "tx_hour_cos", "tx_dow_sin", "tx_dow_cos", "tx_amount_log"]
ORACLE["numeric_medians"] = with_canon("x AS (SELECT 1)\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r6(f'median({c})')} AS median FROM timed" for c in _NUMS))
ORACLE["time_features"] = with_canon("x AS (SELECT 1)\nSELECT TransactionID, " + ", ".join(
    r6(c, c) for c in ("tx_hour", "tx_day_of_week", "tx_hour_sin", "tx_hour_cos", "tx_dow_sin", "tx_dow_cos",
                       "tx_amount_log")) + """, tx_day, tx_week,
  CAST(CASE WHEN tx_hour BETWEEN 22 AND 24 OR tx_hour BETWEEN 0 AND 6 THEN 1 ELSE 0 END AS INTEGER) AS tx_is_night,
  CAST(CASE WHEN tx_day_of_week >= 5 THEN 1 ELSE 0 END AS INTEGER) AS tx_is_weekend FROM timed""")


def _q(body: str) -> str:
    return with_canon("x AS (SELECT 1)\n" + body)


ORACLE["class_balance"] = _q(
    "SELECT count(*) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS n_fraud, "
    "CAST(count(*) FILTER (WHERE isFraud = 0) AS BIGINT) AS n_legit, "
    + r6("avg(isFraud)", "fraud_rate") + ", "
    + r6("CASE WHEN sum(isFraud) = 0 THEN NULL ELSE count(*) FILTER (WHERE isFraud = 0) / sum(isFraud) END",
         "scale_pos_weight") + " FROM merged")
ORACLE["fraud_by_hour"] = _q(
    "SELECT CAST(floor((TransactionDT / 3600.0) % 24) AS INTEGER) AS hour, " + r6("avg(isFraud)", "fraud_rate")
    + ", count(*) AS n FROM merged GROUP BY 1")
ORACLE["fraud_by_day_of_week"] = _q(
    "SELECT CAST(floor(TransactionDT / 86400) % 7 AS INTEGER) AS day_of_week, " + r6("avg(isFraud)", "fraud_rate")
    + ", count(*) AS n FROM merged GROUP BY 1")
ORACLE["rolling_daily_fraud_rate"] = _q(
    "SELECT tx_day, " + r6("fraud_rate", "fraud_rate") + ", " + r6(
        "CASE WHEN count(*) OVER w >= 7 THEN avg(fraud_rate) OVER w END", "rolling_fraud_rate") + """
FROM (SELECT CAST(floor(TransactionDT / 86400) AS BIGINT) AS tx_day, avg(isFraud) AS fraud_rate
      FROM merged GROUP BY 1)
WINDOW w AS (ORDER BY tx_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
ORACLE["fraud_by_category"] = _q(
    "SELECT \"column\", value, " + r6("avg(isFraud)", "fraud_rate") + """, count(*) AS n FROM (
  SELECT 'ProductCD' AS "column", ProductCD AS value, isFraud FROM merged
  UNION ALL SELECT 'DeviceType', DeviceType, isFraud FROM merged) WHERE value IS NOT NULL GROUP BY 1, 2""")
DEVICE_TABLE = """devt AS (SELECT DeviceInfo, count(DISTINCT card1) AS n_cards, count(TransactionID) AS n_transactions,
  avg(isFraud) AS fraud_rate FROM merged WHERE DeviceInfo IS NOT NULL GROUP BY DeviceInfo)"""
ORACLE["device_table"] = with_canon(DEVICE_TABLE + "\nSELECT DeviceInfo, n_cards, n_transactions, "
                                    + r6("fraud_rate", "fraud_rate") + " FROM devt")
ORACLE["device_sharing_summary"] = with_canon(DEVICE_TABLE + """
SELECT (SELECT count(*) FROM devt) AS n_devices,
       (SELECT count(*) FROM devt WHERE n_cards > 1) AS n_devices_multi_card,
       (SELECT count(*) FROM devt WHERE n_cards > 5) AS n_devices_over_5_cards,
       """ + r6("(SELECT avg(m.isFraud) FROM merged m JOIN devt d USING (DeviceInfo) WHERE d.n_cards > 5)",
                "fraud_rate_high_device") + ", "
    + r6("(SELECT avg(isFraud) FROM merged)", "fraud_rate_overall"))
ORACLE["device_card_bucket_rate"] = with_canon(DEVICE_TABLE + """
SELECT card_bucket, """ + r6("avg(fraud_rate)", "mean_device_fraud_rate") + """, count(*) AS n_devices FROM (
  SELECT fraud_rate, CASE WHEN n_cards <= 0 THEN NULL WHEN n_cards <= 1 THEN '1' WHEN n_cards <= 2 THEN '2'
    WHEN n_cards <= 5 THEN '3-5' WHEN n_cards <= 10 THEN '6-10' WHEN n_cards <= 50 THEN '11-50'
    ELSE '50+' END AS card_bucket FROM devt) WHERE card_bucket IS NOT NULL GROUP BY 1""")
ORACLE["describe_by_class"] = _q(
    "SELECT isFraud, count(TransactionAmt) AS count, " + ", ".join([
        r6("avg(TransactionAmt)", "mean"), r6("stddev_samp(TransactionAmt)", "std"),
        r6("min(TransactionAmt)", "min"), r6("quantile_cont(TransactionAmt, 0.25)", "p25"),
        r6("quantile_cont(TransactionAmt, 0.5)", "p50"), r6("quantile_cont(TransactionAmt, 0.75)", "p75"),
        r6("max(TransactionAmt)", "max")]) + " FROM merged GROUP BY isFraud")
ORACLE["amount_percentiles"] = _q(" UNION ALL ".join(
    f"SELECT isFraud, {p} AS percentile, {r6(f'quantile_cont(TransactionAmt, {p / 100})')} AS value "
    f"FROM merged GROUP BY isFraud" for p in (25, 50, 75, 90, 95, 99)))
_MCOLS = ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "addr1", "P_emaildomain",
          "isFraud", "DeviceType", "DeviceInfo"]
_MISSING = "mr AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM merged"
    for c in _MCOLS) + ")"
ORACLE["missing_rates"] = with_canon(_MISSING + "\nSELECT \"column\", " + r6("missing_rate", "missing_rate")
                                     + " FROM mr")
ORACLE["missing_summary"] = with_canon(
    _MISSING + "\nSELECT count(*) FILTER (WHERE missing_rate > 0.5) AS n_over_half, "
    "count(*) FILTER (WHERE missing_rate > 0) AS n_any, count(*) AS n_columns FROM mr")
ORACLE["top_missing"] = with_canon(_MISSING + "\nSELECT \"column\", " + r6("missing_rate", "missing_rate")
                                   + " FROM mr ORDER BY missing_rate DESC, \"column\" LIMIT 50")
_CM = ["TransactionAmt", "isFraud", "card1", "addr1"]
ORACLE["correlation_matrix"] = _q(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr"
    f" FROM merged" for i, a in enumerate(_CM) for b in _CM[:i]))
_LC = ["TransactionDT", "TransactionAmt", "card1", "addr1", "tx_hour", "tx_day_of_week", "tx_day", "tx_week",
       "tx_hour_sin", "tx_hour_cos", "tx_dow_sin", "tx_dow_cos", "tx_amount_log", "device_user_count",
       "device_tx_count", "device_fraud_rate", "device_risk_score", "email_user_count", "email_domain_fraud_rate",
       "addr_user_count", "addr_fraud_rate", "card_device_count", "card_email_count", "device_type_risk",
       "identity_mismatch_score", "device_is_high_risk"]
_DEVFULL = DEVICE_BODY.replace("SELECT m.TransactionID,", "SELECT m.*,").replace(
    "FROM merged m\n  LEFT JOIN dstat", "FROM timed m\n  LEFT JOIN dstat")
ORACLE["label_correlations"] = with_canon(_DEVFULL.strip() + ",\nlc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(isFraud AS DOUBLE)) AS correlation FROM dev"
    for c in _LC) + ")\nSELECT feature, " + r6("correlation", "correlation") + """ FROM lc
WHERE correlation IS NOT NULL AND NOT isnan(correlation) ORDER BY abs(correlation) DESC, feature LIMIT 30""")


def _hist(src: str, value: str, bins: int, by: str = "isFraud") -> str:
    return f"""hx AS (SELECT {by} AS grp, CAST({value} AS DOUBLE) AS x FROM {src} WHERE {value} IS NOT NULL),
rg0 AS (SELECT grp, min(x) AS lo, max(x) AS hi, count(*) AS n FROM hx GROUP BY grp),
rg AS (SELECT grp, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi,
       n FROM rg0),
rw AS (SELECT grp, lo, hi, n, (hi - lo) / {bins} AS w FROM rg),
hb AS (SELECT hx.grp, CAST(least(floor((x - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w, n
       FROM hx JOIN rw USING (grp))
SELECT grp AS {by}, bin, {r6('any_value(lo) + bin * any_value(w)', 'bin_start')}, count(*) AS count,
       {r6('count(*) / (any_value(n) * any_value(w))', 'density')}
FROM hb GROUP BY grp, bin"""


ORACLE["amount_log_histogram"] = with_canon(_hist("merged", "ln(1 + TransactionAmt)", 50))
ORACLE["clipped_amount_histogram"] = with_canon(
    "qq AS (SELECT quantile_cont(TransactionAmt, 0.01) AS q1, quantile_cont(TransactionAmt, 0.99) AS q99 FROM merged),"
    "\nclipped AS (SELECT isFraud, least(greatest(TransactionAmt, q1), q99) AS amt FROM merged, qq),\n"
    + _hist("clipped", "amt", 40))
ORACLE["cards_per_device_histogram"] = with_canon(
    DEVICE_TABLE + ",\ndg AS (SELECT 0 AS grp0, least(n_cards, 20) AS nc FROM devt),\n"
    + _hist("dg", "nc", 20, by="grp0").replace("SELECT grp AS grp0", "SELECT grp AS \"group\""))
ORACLE["risk_bucket_fraud_rate"] = with_canon(DEVICE_BODY.strip() + """,
mm AS (SELECT min(device_risk_score) AS mn, max(device_risk_score) AS mx FROM dj),
rb AS (SELECT d.device_risk_score AS s, m.isFraud, mm.mn, (mm.mx - mm.mn) / 10 AS step
       FROM dj d JOIN merged m USING (TransactionID), mm)
SELECT CAST(""" + " + ".join(["0"] + [f"CASE WHEN s > mn + {k} * step THEN 1 ELSE 0 END" for k in range(1, 10)])
    + " AS INTEGER) AS bucket, " + r6("avg(isFraud)", "fraud_rate") + ", count(*) AS n FROM rb GROUP BY 1")
ORACLE["preview"] = _q("SELECT TransactionID, TransactionDT, " + r6("TransactionAmt", "TransactionAmt")
                       + ", ProductCD, card1, " + r6("addr1", "addr1")
                       + ", P_emaildomain, isFraud, DeviceType, DeviceInfo FROM merged ORDER BY TransactionID LIMIT 3")


SCORES = """sc AS (SELECT TransactionID, CASE WHEN TransactionAmt % 100 < 0 THEN (TransactionAmt % 100 + 100) % 100
                                 ELSE TransactionAmt % 100 END / 100 AS score, isFraud AS label FROM tx),
g AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM sc GROUP BY score),
cv AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp
       FROM g),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g),
cc AS (SELECT cv.*, P, N, tp / (tp + fp) AS prec, tp / P AS rec FROM cv, tot),
cf AS (SELECT *, 2 * prec * rec / (prec + rec + 1e-9) AS f1c FROM cc)"""


def _f1sql(tp: str, fp: str, fn: str) -> str:
    return f"coalesce(CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN NULL ELSE 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) END, 0.0)"


CONF = """conf AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS true_positives,
  count(*) FILTER (WHERE score >= 0.5 AND label <> 1) AS false_positives,
  count(*) FILTER (WHERE score < 0.5 AND label = 1) AS false_negatives,
  count(*) FILTER (WHERE score < 0.5 AND label <> 1) AS true_negatives FROM sc)"""

ORACLE["score_curve"] = with_canon(SCORES + "\nSELECT " + ", ".join(r6(c, c) for c in ("score", "pos", "neg", "tp", "fp"))
                                   + " FROM cv")
ORACLE["ranking_metrics"] = with_canon(SCORES + ",\n" + CONF + """,
best AS (SELECT score AS optimal_threshold FROM cf ORDER BY f1c DESC, score ASC LIMIT 1),
opt AS (SELECT count(*) FILTER (WHERE score >= optimal_threshold AND label = 1) AS a,
               count(*) FILTER (WHERE score >= optimal_threshold AND label <> 1) AS b,
               count(*) FILTER (WHERE score < optimal_threshold AND label = 1) AS c FROM sc, best)
SELECT """ + ", ".join([
    r6("(SELECT sum(pos * ((N - fp) + 0.5 * neg)) / (any_value(P) * any_value(N)) FROM cf)", "roc_auc"),
    r6("(SELECT sum(pos * prec) / any_value(P) FROM cf)", "pr_auc"),
    r6("(SELECT optimal_threshold FROM best)", "optimal_threshold"),
    r6("coalesce((SELECT rec FROM cf WHERE score >= 0.5 ORDER BY score LIMIT 1), 0.0)", "fraud_recall_at_threshold"),
    r6("(SELECT " + _f1sql("true_positives", "false_positives", "false_negatives") + " FROM conf)", "f1_at_threshold"),
    r6("(SELECT " + _f1sql("a", "b", "c") + " FROM opt)", "f1_optimal")]))
ORACLE["confusion_at_threshold"] = with_canon(SCORES + ",\n" + CONF + """
SELECT true_positives, false_positives, false_negatives, true_negatives, """ + ", ".join([
    r6("true_positives / (true_positives + false_positives + 1e-9)", "fraud_precision"),
    r6("true_positives / (true_positives + false_negatives + 1e-9)", "fraud_recall"),
    r6(_f1sql("true_positives", "false_positives", "false_negatives"), "f1"),
    r6("(true_positives + true_negatives) / (true_positives + true_negatives + false_positives + false_negatives)",
       "accuracy")]) + " FROM conf")


def _cls(name, t, fp, fn, sup):
    p = f"coalesce(CASE WHEN {t} + {fp} = 0 THEN NULL ELSE {t} / ({t} + {fp}) END, 0.0)"
    r = f"coalesce(CASE WHEN {t} + {fn} = 0 THEN NULL ELSE {t} / ({t} + {fn}) END, 0.0)"
    return f"SELECT '{name}' AS class, {p} AS precision, {r} AS recall, {_f1sql(t, fp, fn)} AS f1, {sup} AS support FROM cd"


ORACLE["classification_report"] = with_canon(SCORES + ",\n" + CONF + """,
cd AS (SELECT CAST(true_positives AS DOUBLE) AS tp, CAST(false_positives AS DOUBLE) AS fp,
       CAST(false_negatives AS DOUBLE) AS fn, CAST(true_negatives AS DOUBLE) AS tn FROM conf),
pc AS (""" + _cls("Legitimate", "tn", "fn", "fp", "tn + fp") + " UNION ALL " + _cls("Fraud", "tp", "fp", "fn", "tp + fn")
    + """),
allc AS (
  SELECT * FROM pc
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM pc)
SELECT class, """ + ", ".join(r6(c, c) for c in ("precision", "recall", "f1", "support")) + " FROM allc")
ORACLE["threshold_f1"] = with_canon(SCORES + "\nSELECT " + ", ".join(
    r6(_f1sql(f"count(*) FILTER (WHERE score >= {t} AND label = 1)",
              f"count(*) FILTER (WHERE score >= {t} AND label <> 1)",
              f"count(*) FILTER (WHERE score < {t} AND label = 1)"), "f1_at_" + str(t).replace(".", "_"))
    for t in (0.5, 0.6, 0.7, 0.8, 0.9)) + " FROM sc")
ORACLE["time_split"] = _q("""SELECT TransactionID,
  CAST(CASE WHEN row_number() OVER (ORDER BY TransactionDT, TransactionID) >
            count(*) OVER () - CAST(floor(count(*) OVER () * 0.2) AS BIGINT) THEN 1 ELSE 0 END AS INTEGER)
  AS is_validation FROM tx""")
ORACLE["stratified_fold_sizes"] = _q("""SELECT isFraud, CAST((rn - 1) % 5 AS INTEGER) AS fold, count(*) AS n
FROM (SELECT isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY TransactionID) AS rn FROM tx) GROUP BY 1, 2""")


def _graph_body(src: str) -> str:
    return f"""gsrc AS (SELECT CAST(card1 AS VARCHAR) AS card, CAST(DeviceInfo AS VARCHAR) AS device,
  {src}),
verts AS (
  SELECT DISTINCT 'card:' || card AS id, 'card' AS type, card AS value FROM gsrc WHERE card IS NOT NULL
  UNION SELECT DISTINCT 'device:' || device, 'device', device FROM gsrc WHERE device IS NOT NULL
  UNION SELECT DISTINCT 'email:' || email, 'email', email FROM gsrc WHERE email IS NOT NULL
  UNION SELECT DISTINCT 'address:' || addr, 'address', addr FROM gsrc WHERE addr IS NOT NULL),
pd AS (SELECT DISTINCT card, device FROM gsrc WHERE card IS NOT NULL AND device IS NOT NULL),
rk AS (SELECT device, card, row_number() OVER (PARTITION BY device ORDER BY card) AS rn FROM pd),
edges AS (
  SELECT least('card:' || card, 'device:' || device) AS src, greatest('card:' || card, 'device:' || device) AS dst,
         'card_device' AS edge_type, CAST(NULL AS VARCHAR) AS shared_device FROM pd
  UNION ALL SELECT DISTINCT least('card:' || card, 'email:' || email), greatest('card:' || card, 'email:' || email),
         'card_email', NULL FROM gsrc WHERE card IS NOT NULL AND email IS NOT NULL
  UNION ALL SELECT DISTINCT least('card:' || card, 'address:' || addr), greatest('card:' || card, 'address:' || addr),
         'card_address', NULL FROM gsrc WHERE card IS NOT NULL AND addr IS NOT NULL
  UNION ALL SELECT least('card:' || a.card, 'card:' || b.card), greatest('card:' || a.card, 'card:' || b.card),
         'co_device', max(a.device)
    FROM rk a JOIN rk b ON a.device = b.device AND b.rn BETWEEN a.rn + 1 AND a.rn + 4 GROUP BY 1, 2),
adj AS (SELECT src AS node, dst AS nbr FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (
  SELECT v.id AS node, v.type, count(a.nbr) AS graph_degree,
         count(*) FILTER (WHERE a.nbr LIKE 'device:%') AS graph_n_device_neighbors,
         count(*) FILTER (WHERE a.nbr LIKE 'email:%') AS graph_n_email_neighbors,
         count(*) FILTER (WHERE a.nbr LIKE 'card:%') AS graph_n_co_device_cards,
         count(*) FILTER (WHERE a.nbr LIKE 'address:%') AS graph_n_address_neighbors
  FROM verts v LEFT JOIN adj a ON a.node = v.id GROUP BY v.id, v.type)"""


GRAPH_BODY = _graph_body("P_emaildomain AS email, CAST(addr1 AS VARCHAR) AS addr FROM merged")
GRAPH_METRICS = GRAPH_BODY + """,
tri AS (SELECT x.node, count(*) AS t FROM adj x JOIN adj y ON x.node = y.node AND x.nbr < y.nbr
        JOIN adj z ON z.node = x.nbr AND z.nbr = y.nbr GROUP BY x.node),
reach(node, root) AS (SELECT id, id FROM verts UNION SELECT a.nbr, r.root FROM reach r JOIN adj a ON a.node = r.node),
lab AS (SELECT node, min(root) AS label FROM reach GROUP BY node),
csz AS (SELECT node, count(*) OVER (PARTITION BY label) AS graph_component_size FROM lab),
hub AS (SELECT quantile_cont(graph_degree, 0.95) AS p95 FROM deg WHERE type = 'card'),
nm AS (
  SELECT d.*, CASE WHEN graph_degree < 2 THEN 0.0 ELSE 2.0 * coalesce(t.t, 0) / (graph_degree * (graph_degree - 1))
              END AS graph_clustering, c.graph_component_size,
         CAST(coalesce(CASE WHEN graph_degree > hub.p95 THEN 1 ELSE 0 END, 0) AS INTEGER) AS graph_is_hub
  FROM deg d LEFT JOIN tri t USING (node) JOIN csz c USING (node), hub)"""
_NM_COLS = ("node, type, graph_degree, graph_n_device_neighbors, graph_n_email_neighbors, graph_n_co_device_cards, "
            "graph_n_address_neighbors, graph_component_size, graph_is_hub, "
            + r6("graph_clustering", "graph_clustering"))
ORACLE["graph_vertices"] = with_canon(GRAPH_BODY + "\nSELECT * FROM verts")
ORACLE["graph_edges"] = with_canon(GRAPH_BODY + "\nSELECT * FROM edges")
ORACLE["graph_counts"] = with_canon(GRAPH_BODY + "\nSELECT (SELECT count(*) FROM verts) AS n_nodes, "
                                    "(SELECT count(*) FROM edges) AS n_edges")
ORACLE["graph_node_metrics"] = with_canon(GRAPH_METRICS + f"\nSELECT {_NM_COLS} FROM nm", recursive=True)
ORACLE["graph_transaction_features"] = with_canon(GRAPH_METRICS + """
SELECT m.TransactionID, coalesce(graph_degree, 0) AS graph_degree, """ + r6("coalesce(graph_clustering, 0.0)",
                                                                           "graph_clustering") + """,
  coalesce(graph_component_size, 1) AS graph_component_size,
  coalesce(graph_n_device_neighbors, 0) AS graph_n_device_neighbors,
  coalesce(graph_n_email_neighbors, 0) AS graph_n_email_neighbors,
  coalesce(graph_n_co_device_cards, 0) AS graph_n_co_device_cards,
  coalesce(graph_n_address_neighbors, 0) AS graph_n_address_neighbors, coalesce(graph_is_hub, 0) AS graph_is_hub
FROM merged m LEFT JOIN nm ON nm.node = 'card:' || CAST(m.card1 AS VARCHAR) AND nm.type = 'card'""", recursive=True)
ORACLE["graph_score"] = with_canon(GRAPH_BODY + """
SELECT m.TransactionID, """ + r6("""coalesce(CASE WHEN (SELECT max(graph_degree) FROM deg) > 0 AND d.graph_degree IS NOT NULL THEN
  least(d.graph_degree / (SELECT max(graph_degree) FROM deg), 1.0) END, 0.0)""", "graph_score") + """
FROM merged m LEFT JOIN deg d ON d.node = 'card:' || CAST(m.card1 AS VARCHAR) AND d.type = 'card'""")
SUPPLIER_BODY = """sup AS (SELECT o.o_custkey AS card1, CAST(l.l_suppkey AS VARCHAR) AS DeviceInfo
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
""" + _graph_body("CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS addr FROM sup")
ORACLE["supplier_graph_degrees"] = with_canon(SUPPLIER_BODY + "\nSELECT * FROM deg")


def _pct(x: str) -> str:
    return f"CAST(CAST(round({x} * 100) AS BIGINT) AS VARCHAR) || '%'"


PRED_BODY = GRAPH_BODY + """,
mx AS (SELECT max(graph_degree) AS mx FROM deg),
comp AS (
  SELECT m.TransactionID, m.TransactionDT AS ts, m.DeviceInfo AS device, m.TransactionAmt, m.isFraud AS label,
         CAST(floor(m.TransactionID / 100) AS BIGINT) AS batch_id,
         CASE WHEN m.TransactionAmt % 100 < 0 THEN (m.TransactionAmt % 100 + 100) % 100 ELSE m.TransactionAmt % 100 END
           / 100 AS l,
         coalesce(CASE WHEN mx.mx > 0 AND d.graph_degree IS NOT NULL THEN least(d.graph_degree / mx.mx, 1.0) END, 0.0)
           AS g,
         CAST((m.TransactionID * 37) % 100 AS DOUBLE) / 100 AS a
  FROM merged m LEFT JOIN deg d ON d.node = 'card:' || CAST(m.card1 AS VARCHAR) AND d.type = 'card', mx),
bl AS (SELECT *, greatest(0.0, least(1.0, l * 0.6 + g * 0.25 + a * 0.15)) AS s FROM comp),
rs AS (
  SELECT *, list_filter([
      CASE WHEN l > 0.40 THEN 'High ML fraud probability (' || """ + _pct("l") + """ || ')' END,
      CASE WHEN g > 0.5 THEN 'Card appears in a high-risk device-sharing network (graph risk: ' || """ + _pct("g") + """ || ')' END,
      CASE WHEN a > 0.7 THEN 'Transaction pattern is statistically anomalous (anomaly score: ' || """ + _pct("a") + """ || ')' END,
      CASE WHEN coalesce(TransactionAmt, 0) > 5000 THEN 'Unusually large transaction amount ($' ||
           format('{:,}', CAST(round(TransactionAmt) AS BIGINT)) || ')' END], lambda x: x IS NOT NULL) AS rl
  FROM bl),
pred AS (
  SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, round(s, 4) AS fraud_score,
         CASE WHEN s >= 0.65 THEN 'CRITICAL' WHEN s >= 0.40 THEN 'HIGH' WHEN s >= 0.20 THEN 'MEDIUM' ELSE 'LOW' END
           AS risk_level,
         round(l, 4) AS lgbm, round(g, 4) AS graph, round(a, 4) AS anomaly,
         CASE WHEN len(rl) = 0 THEN ['No specific high-risk indicators detected'] ELSE rl END AS reasons,
         ts, device, TransactionAmt, label, batch_id
  FROM rs)"""

ORACLE["scored_fixed"] = with_canon(PRED_BODY + "\nSELECT transaction_id, risk_level, " + ", ".join(
    r6(c, c) for c in ("fraud_score", "lgbm", "graph", "anomaly")) + ", array_to_string(reasons, ' | ') AS reasons_text"
    " FROM pred")
ORACLE["risk_counts"] = with_canon(PRED_BODY + "\nSELECT risk_level, count(*) AS count FROM pred GROUP BY 1")
ORACLE["dashboard_kpis"] = with_canon(PRED_BODY + """
SELECT count(*) AS total_processed, count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS n_high,
  count(*) FILTER (WHERE risk_level = 'CRITICAL') AS n_critical, """ + r6("avg(fraud_score)", "avg_fraud_score") + ", "
    + r6("count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) / greatest(count(*), 1)", "alert_rate")
    + " FROM pred")
ORACLE["mean_component_scores"] = with_canon(PRED_BODY + "\n" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, {r6(f'avg({c})')} AS average_score FROM pred"
    for n, c in (("LightGBM", "lgbm"), ("Graph", "graph"), ("Anomaly", "anomaly"))))
ORACLE["batch_summary"] = with_canon(PRED_BODY + """
SELECT batch_id, count(*) AS total_processed, count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS high_risk_count,
  """ + r6("round(avg(fraud_score) * (1.0 + 1e-11), 4)", "avg_fraud_score") + " FROM pred GROUP BY batch_id")
ORACLE["latency_histogram"] = with_canon(PRED_BODY + """,
waits AS (SELECT CAST(max(ts) OVER (PARTITION BY batch_id) - ts AS DOUBLE) AS sec FROM pred),
bounds AS (SELECT * FROM (VALUES ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5),
  ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('+Inf', 1e300)) AS v(le, b))
SELECT le, count(*) FILTER (WHERE sec <= b) AS count, """ + r6("sum(sec)", "sum_seconds") + " FROM bounds, waits GROUP BY le")
ORACLE["request_counters"] = with_canon(PRED_BODY + """
SELECT '/predict/batch' AS endpoint, risk_level, count(*) AS requests,
  count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS alerts FROM pred GROUP BY risk_level""")
ORACLE["last_score"] = with_canon(PRED_BODY + "\nSELECT " + r6("arg_max(fraud_score, (ts, transaction_id))",
                                                               "last_fraud_score") + " FROM pred")
ORACLE["consumer_stats"] = with_canon(PRED_BODY + """
SELECT count(*) AS processed, count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS high_risk,
  (SELECT count(*) FROM tx WHERE TransactionAmt IS NULL OR NOT (TransactionAmt > 0)) AS errors,
  """ + r6("count(*) / greatest(max(ts) - min(ts), 1.0)", "tps") + " FROM pred")
ORACLE["top_alert_devices"] = with_canon(PRED_BODY + """
SELECT device, count(*) AS alert_count FROM pred WHERE risk_level IN ('HIGH', 'CRITICAL') AND device IS NOT NULL
GROUP BY device ORDER BY alert_count DESC, device LIMIT 8""")
ORACLE["latest_alerts"] = with_canon(PRED_BODY + """
SELECT transaction_id, """ + r6("fraud_score", "fraud_score") + """,
  CASE risk_level WHEN 'CRITICAL' THEN '🟣 CRITICAL' WHEN 'HIGH' THEN '🔴 HIGH' WHEN 'MEDIUM' THEN '🟠 MEDIUM'
       WHEN 'LOW' THEN '🟢 LOW' ELSE risk_level END AS badge,
  printf('%02d:%02d:%02d', CAST(((ts + 1703980800) % 86400) // 3600 AS INTEGER),
         CAST((((ts + 1703980800) % 86400) % 3600) // 60 AS INTEGER), CAST(((ts + 1703980800) % 86400) % 60 AS INTEGER))
    AS clock,
  array_to_string(reasons, ' | ') AS reasons_text
FROM pred WHERE risk_level IN ('HIGH', 'CRITICAL') ORDER BY ts DESC, transaction_id DESC LIMIT 20""")
ORACLE["alert_buffer"] = with_canon(PRED_BODY + "\nSELECT transaction_id, " + r6("fraud_score", "fraud_score")
                                    + ", risk_level, ts FROM pred ORDER BY ts DESC, transaction_id DESC LIMIT 200")
ORACLE["alert_filter"] = with_canon(PRED_BODY + "\nSELECT transaction_id, " + r6("fraud_score", "fraud_score")
                                    + ", risk_level FROM pred WHERE risk_level IN ('MEDIUM', 'HIGH', 'CRITICAL') "
                                      "AND fraud_score >= 0.3")
ORACLE["request_quarantine"] = _q("""SELECT count(*) FILTER (WHERE TransactionAmt > 0) AS n_valid,
  count(*) FILTER (WHERE TransactionAmt IS NULL OR NOT (TransactionAmt > 0)) AS n_quarantined FROM tx""")


ORACLE["batch_quarantine"] = with_canon("""
b AS (SELECT floor(TransactionDT / 3600.0) AS hour, count(*) AS n FROM tx GROUP BY ALL)
SELECT CASE WHEN n > 10 THEN 'batch of ' || n || ' requests, at most 10 allowed' ELSE '' END AS quarantine_reason,
  CAST(sum(n) AS BIGINT) AS n_requests, count(hour) AS n_batches FROM b GROUP BY 1""")

ORACLE["prediction_quarantine"] = with_canon("""
p AS (SELECT TransactionAmt / 100 AS s, CASE WHEN TransactionID % 10 = 0 THEN ProductCD ELSE 'LOW' END AS lv FROM tx)
SELECT CASE WHEN s IS NULL OR isnan(s) THEN 'missing score' WHEN s < 0 OR s > 1 THEN 'score outside [0, 1]'
  WHEN lv IS NULL OR lv NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN 'unknown risk level' ELSE '' END AS quarantine_reason,
  count(*) AS n_predictions FROM p GROUP BY 1""")


def _distinct_weeks(entity: str) -> str:
    return f"""SELECT {entity} AS entity, CAST(floor(TransactionDT / 604800.0) AS BIGINT) AS week,
  count(DISTINCT card1) AS n_cards, count(card1) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS n_labels, TRUE AS within_bound
FROM merged WHERE {entity} IS NOT NULL GROUP BY 1, 2"""


ORACLE["entity_distinct_weeks"] = _q(_distinct_weeks("DeviceInfo") + "\nUNION ALL\n" + _distinct_weeks("P_emaildomain"))


def _win(size: int, slide: int) -> str:
    return PRED_BODY + f""",
ws AS (SELECT p.*, s.k FROM pred p, range(0, {size // slide}) s(k)),
wb AS (SELECT *, (floor((ts + 1703980800) / {slide}) - k) * {slide} AS window_start FROM ws
       WHERE (floor((ts + 1703980800) / {slide}) - k) * {slide} + {size} > ts + 1703980800)
SELECT CAST(window_start AS BIGINT) AS window_start, count(*) AS processed,
  count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS alerts, """ + r6("avg(label)", "fraud_rate") + """
FROM wb GROUP BY window_start"""


ORACLE["alert_windows_10s"] = with_canon(_win(10, 10))
ORACLE["rolling_fraud_rate_60s"] = with_canon(_win(60, 10))
ORACLE["stream_alert_windows_10s"] = ORACLE["alert_windows_10s"]
ORACLE["stream_rolling_fraud_rate_60s"] = ORACLE["rolling_fraud_rate_60s"]
ORACLE["stream_consumer_stats"] = ORACLE["consumer_stats"]
ORACLE["message_log_offsets"] = _q("SELECT TransactionID AS transaction_id, TransactionDT AS ts, true AS once, true AS gapless FROM tx")


_VEL_ONLY = """
vel AS (
  SELECT a.TransactionID, a.card1,
         count(b.TransactionID) FILTER (WHERE b.TransactionDT >= a.TransactionDT - 3600) AS c1h,
         count(b.TransactionID) FILTER (WHERE b.TransactionDT >= a.TransactionDT - 86400) AS c24h,
         count(b.TransactionID) FILTER (WHERE b.TransactionDT >= a.TransactionDT - 604800) AS c7d,
         coalesce(a.TransactionDT - max(b.TransactionDT), 0) AS since_last
  FROM tx a LEFT JOIN tx b
    ON a.card1 = b.card1
   AND (b.TransactionDT < a.TransactionDT
        OR (b.TransactionDT = a.TransactionDT AND b.TransactionID < a.TransactionID))
  WHERE a.card1 IS NOT NULL
  GROUP BY a.TransactionID, a.card1, a.TransactionDT
)"""
ORACLE["stream_card_velocity"] = with_canon(_VEL_ONLY + """
SELECT TransactionID, card1, CAST(since_last AS DOUBLE) AS time_since_last_tx, CAST(c1h AS INTEGER) AS card_tx_count_1h,
  CAST(c24h AS INTEGER) AS card_tx_count_24h, CAST(c7d AS INTEGER) AS card_tx_count_7d FROM vel""")
ORACLE["message_roundtrip"] = _q("SELECT TransactionID, TransactionDT, " + r6("TransactionAmt", "TransactionAmt")
                                 + ", ProductCD, card1, " + r6("addr1", "addr1")
                                 + ", P_emaildomain, isFraud, DeviceType, DeviceInfo FROM merged")


ORACLE["csv_source"] = ORACLE["message_roundtrip"]
ORACLE["bounded_scan"] = _q("SELECT TransactionID, TransactionDT, " + r6("TransactionAmt", "TransactionAmt")
                            + ", ProductCD, card1, " + r6("addr1", "addr1")
                            + ", P_emaildomain, isFraud, DeviceType, DeviceInfo FROM merged ORDER BY TransactionID "
                              "LIMIT 100")
ORACLE["identity_match"] = _q("""SELECT (SELECT count(*) FROM tx) AS n_transactions, (SELECT count(*) FROM idn) AS n_identity,
  (SELECT count(*) FROM idn WHERE TransactionID IN (SELECT TransactionID FROM tx)) AS n_identity_matched,
  """ + r6("(SELECT count(*) FROM idn WHERE TransactionID IN (SELECT TransactionID FROM tx)) / "
           "(SELECT count(*) FROM tx)", "match_rate"))


def _r4(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) * (1.0 + 1e-11), 4) AS {alias}"


ORACLE["card_amount_windows"] = _q("""SELECT a.TransactionID, """ + ", ".join(
    _r4(f"avg(b.TransactionAmt) FILTER (WHERE b.TransactionDT >= a.TransactionDT - {w})", f"card_tx_mean_amt_{lab}")
    + ", " + _r4(f"stddev_samp(b.TransactionAmt) FILTER (WHERE b.TransactionDT >= a.TransactionDT - {w})",
                 f"card_tx_std_amt_{lab}")
    for w, lab in ((3600, "1h"), (86400, "24h"), (604800, "7d"))) + """
FROM tx a LEFT JOIN tx b ON a.card1 = b.card1
   AND (b.TransactionDT < a.TransactionDT OR (b.TransactionDT = a.TransactionDT AND b.TransactionID < a.TransactionID))
GROUP BY a.TransactionID""")


# M2 by the min-max formula: the highest, over all starts up to a score, of the
# lowest mean from that start to any end at or behind the score
ORACLE["isotonic_calibration"] = with_canon(SCORES.split("cv AS")[0].rstrip().rstrip(",") + """,
pts AS (SELECT score, count(*) AS w, sum(label) AS wy FROM sc WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT score, sum(w) OVER o AS cw, sum(wy) OVER o AS cy, w, wy FROM pts WINDOW o AS (ORDER BY score)),
pair AS (SELECT a.score AS a, b.score AS b, (b.cy - a.cy + a.wy) / (b.cw - a.cw + a.w) AS mean FROM cum a JOIN cum b ON b.score >= a.score),
low AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM pair)
SELECT """ + r6("b", "score") + ", " + r6("max(least)", "calibrated") + " FROM low GROUP BY b")

ORACLE["contribution_checks"] = _q("SELECT TransactionID, true AS sums_to_margin, true AS top_five FROM tx")
ORACLE["scored_from_store"] = _q("SELECT TransactionID, true AS same_score, true AS same_level FROM tx")
