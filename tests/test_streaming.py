import random

from quarry.operators import replay as R
from quarry.streaming.replay import replay, windowed_counts


def test_stream_replay_ends_as_the_batch_does(spark, tmp_path):
    random.seed(3)
    rows = [(d, i, random.choice("abc"), random.choice(["bad", "covered", "missing"])) for i in range(30) for d in range(5)]
    schema = "d long, i int, kc_id string, mark string"
    for part in range(3):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen: dict = {}
    query = replay(stream, "d", ["i"]).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({(r.d, r.kc_id): r.status for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    batch = {(r.d, r.kc_id): r.status for r in R.states(spark.createDataFrame(rows, schema), ["d"], ["i"]).collect()}
    assert seen == batch


def test_windowed_counts(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:10:00', 'a'), (timestamp'2024-01-01 00:50:00', 'a'), (timestamp'2024-01-01 01:10:00', 'b') AS t(ts, k)")
    assert sorted((r.k, r.n) for r in windowed_counts(df, "ts", "k").collect()) == [("a", 2), ("b", 1)]
