"""Mergeable distinct counts and request rules on hand-worked cases."""

from pyspark.sql import functions as F

from riskloom.operators import distinct, monitor


def test_daily_states_merge_into_any_range(spark):
    rows = [("hot", (i * 7919) % 5000, i % 10) for i in range(20_000)] + [("b", 1, 0), ("b", 1, 3), ("b", None, 3), (None, 4, 1), ("b", 2, None)]
    df = spark.createDataFrame(rows, "dev string, card long, d int").withColumn("y", (F.col("card") == 1).cast("int"))
    states = distinct.daily_states(df, "dev", "card", F.col("d"), "y")
    early, late = states.where("day < 4"), states.where("day >= 4")
    for part, keep in ((early, lambda d: d < 4), (early.unionByName(late), lambda d: True)):
        got = {r["entity"]: r for r in distinct.over_days(part).collect()}
        for e in ("hot", "b"):
            mine = [c for v, c, d in rows if v == e and c is not None and d is not None and keep(d)]
            exact = len(set(mine))
            assert abs(got[e]["n_members"] - exact) <= max(1, distinct.error_bound() * exact)
            assert got[e]["n_rows"] == len(mine) and got[e]["n_labels"] == sum(c == 1 for c in mine)
        assert set(got) == {"hot", "b"}
    # appending a day equals building all days at once
    again = distinct.over_days(early.unionByName(late), F.floor(F.col("day") / 5))
    assert again.where("entity = 'hot'").count() == 2
    assert distinct.over_days(distinct.daily_states(df.limit(0), "dev", "card", F.col("d"))).count() == 0


def test_batches_go_or_stay_whole(spark):
    df = spark.createDataFrame([(i, "big") for i in range(101)] + [(i, "full") for i in range(100)] + [(1, None)] * 150, "id long, batch string")
    valid, bad = monitor.validate_batches(df, "batch")
    assert valid.count() == 250 and valid.columns == df.columns
    assert [r.asDict() for r in bad.groupBy("batch", "quarantine_reason").count().collect()] == [
        {"batch": "big", "quarantine_reason": "batch of 101 requests, at most 100 allowed", "count": 101}]


def test_prediction_rules(spark):
    rows = [(0.0, "LOW"), (1.0, "CRITICAL"), (1.01, "CRITICAL"), (-0.1, "LOW"), (None, "LOW"), (float("nan"), "LOW"), (0.5, "low"), (0.5, None)]
    valid, bad = monitor.validate_predictions(spark.createDataFrame(rows, "fraud_score double, risk_level string"))
    assert [tuple(r) for r in valid.orderBy("fraud_score").collect()] == rows[:2]
    got = {r["quarantine_reason"]: r["count"] for r in bad.groupBy("quarantine_reason").count().collect()}
    assert got == {"missing score": 2, "score outside [0, 1]": 2, "unknown risk level": 2}
