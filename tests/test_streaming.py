"""Stream = batch checks on a JSON file source."""

import os
import tempfile

from pyspark.sql import functions as F

from riskloom.config import ForestParams, GbtParams, Config
from riskloom.sources.tables import events_transactions, merged_transactions
from riskloom.streaming import stream as st

SF = "/root/testdata/sf0.001"


def test_stream_scoring_writes_alerts_and_quarantine(spark):
    from riskloom.plans import train as tr
    df = merged_transactions(spark, SF)
    cfg = Config(gbt=GbtParams(max_iter=3, max_depth=3), forest=ForestParams(n_trees=10))
    art, _ = tr.train(spark, df, cfg, skip_graph=True)
    base = tempfile.mkdtemp(prefix="rl-stream-")
    st.write_time_ordered_files(df, f"{base}/in", 3)
    q = st.start_scoring(st.transaction_stream(spark, f"{base}/in"), art, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    batches = sorted(d for d in os.listdir(f"{base}/out/alert_log") if d.startswith("batch_id="))
    assert len(batches) == 3
    log = spark.read.json(f"{base}/out/alert_log")
    batch = tr.score(df, art).filter(F.col("prediction.risk_level").isin("HIGH", "CRITICAL"))
    assert log.count() == batch.count()
    assert set(r.transaction_id for r in log.select("transaction_id").collect()) == \
        set(r[0] for r in batch.select("prediction.transaction_id").collect())


def test_stream_velocity_equals_batch(spark):
    from riskloom.operators.velocity import velocity_features
    from riskloom.streaming.velocity_state import card_velocity_stream
    tx = events_transactions(spark, SF)
    base = tempfile.mkdtemp(prefix="rl-vel-")
    st.write_time_ordered_files(tx, f"{base}/in", 4)
    q = (card_velocity_stream(st.transaction_stream(spark, f"{base}/in")).writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.TransactionID: r for r in spark.read.parquet(f"{base}/out").collect()}
    want = velocity_features(tx).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r.TransactionID]
        assert (g.time_since_last_tx, g.card_tx_count_1h, g.card_tx_count_24h, g.card_tx_count_7d) == \
            (r.time_since_last_tx, r.card_tx_count_1h, r.card_tx_count_24h, r.card_tx_count_7d)


def test_codec_roundtrip_and_corrupt_records(spark):
    df = merged_transactions(spark, SF)
    back = st.decode_messages(st.encode_messages(df))
    assert back.filter(F.col("_corrupt_record").isNotNull()).count() == 0
    assert back.select(*df.columns).exceptAll(df).count() == 0
    bad = spark.createDataFrame([("{not json",)], "value string")
    assert st.decode_messages(bad).first()["_corrupt_record"] == "{not json"
