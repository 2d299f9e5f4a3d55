"""The sink that lets each alert in once, alerts as messages, and metrics of the stream."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import store
from logloom.sources import logs
from logloom.streaming import detect

SCHEMA = "run string, session_key string, score double, t_send_ns long, ingested_ns long, arrival long"


def batch(spark, keys, at):
    return spark.createDataFrame([("r", k, 1.0, 5_000_000, 7_000_000, at + n) for n, k in enumerate(keys)], SCHEMA)


def stored(spark, path):
    return sorted(r.session_key or "" for r in logs.read_store(spark, path, batch(spark, [], 0).schema).collect())


def test_replays_add_nothing(spark, tmp_path):
    """A batch stopped before its rows are written, after some of them, and between them and its mark; then replayed."""
    path = str(tmp_path / "store")
    write = logs.store_batch(store.insert_alerts, path, "q", ["run", "session_key"], 4)
    keys = [f"k{n}" for n in range(20)]
    write(batch(spark, keys + keys[:5], 0), 0)
    assert stored(spark, path) == sorted(keys)
    write(batch(spark, keys, 0), 0)
    assert stored(spark, path) == sorted(keys)

    create = logs._place

    class Stopped(Exception):
        pass

    def stop(spark, place):
        if "/batches/" in place:
            stop.asked += 1
            if stop.asked == 2:  # first it is asked whether the mark is there
                raise Stopped
        return create(spark, place)

    stop.asked = 0
    logs._place = stop
    try:
        with pytest.raises(Stopped):
            write(batch(spark, [*keys[:3], "new1", "new2"], 100), 1)
    finally:
        logs._place = create
    assert stored(spark, path) == sorted([*keys, "new1", "new2"]) and not logs.exists(spark, f"{path}/batches/q/1")
    partial = batch(spark, ["new4"], 300).withColumn("ingest_lag_ms", F.lit(2.0)).withColumn("bucket", F.pmod(F.xxhash64("run", "session_key"), F.lit(4)).cast("int"))
    partial.write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")  # what an attempt at batch 2 left
    for _ in range(2):
        write(batch(spark, [*keys[:3], "new1", "new2"], 100), 1)
        write(batch(spark, ["new3", "new4", "new3"], 300), 2)
        assert stored(spark, path) == sorted([*keys, "new1", "new2", "new3", "new4"])
    logs.store_batch(store.insert_alerts, path, "other", ["run", "session_key"], 4)(batch(spark, ["new1", "z"], 400), 1)
    assert "z" in stored(spark, path) and stored(spark, path).count("new1") == 1


def test_a_batch_reads_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    logs.store_batch(store.insert_alerts, path, "q", ["run", "session_key"], 8)(batch(spark, [f"k{n}" for n in range(50)], 0), 0)
    seen = []

    def insert(known, fresh):
        seen.append(known._jdf.queryExecution().executedPlan().toString())
        return store.insert_alerts(known, fresh)

    logs.store_batch(insert, path, "q", ["run", "session_key"], 8)(batch(spark, ["only"], 1), 1)
    assert "PartitionFilters: [" in seen[0] and "bucket" in seen[0].split("PartitionFilters: [")[1].split("]")[0]


def test_alerts_as_messages(spark, tmp_path):
    """Encoded alerts go through a streaming write and come back by the decoder, with the same id in every attempt."""
    rows = [("a", "incremental", 0.7, 3, 5, 0.5, None), ("b", "deadline", 0.9, 2, 9, 0.5, 1)]
    spark.createDataFrame(rows, detect.ALERT).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(detect.ALERT).parquet(f"{tmp_path}/in")
    detect.send(stream, f"{tmp_path}/state", "run7", "pca", format="parquet", once=True, path=f"{tmp_path}/out").awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/out")
    assert {r.key for r in sent.collect()} == {"a", "b"}
    good, bad = logs.decode_alerts(sent)
    assert bad.count() == 0
    assert {(r.id, r.score, r.v["run"], r.v["kind"], r.v.get("sent_ns")) for r in good.collect()} == {("run7:a", 0.7, "run7", "incremental", None), ("run7:b", 0.9, "run7", "deadline", "1")}


PROGRESS = {"runId": "u", "batchId": 4, "timestamp": "2024-01-01T00:00:10.500Z", "numInputRows": 300, "durationMs": {"triggerExecution": 1500},
            "eventTime": {"watermark": "2024-01-01T00:00:00.000Z", "max": "2024-01-01T00:00:07.000Z"},
            "stateOperators": [{"numRowsTotal": 12, "memoryUsedBytes": 1000, "numRowsDroppedByWatermark": 2}], "sources": [{"metrics": {"maxOffsetsBehindLatest": "42"}}]}


def test_progress_of_a_batch(spark):
    r = logs.progress_rows(spark, [PROGRESS, {"batchId": 5, "numInputRows": 0, "durationMs": {}}]).orderBy("batch_id").collect()
    assert (r[0].batch_id, r[0].rows, r[0].duration_s, r[0].rows_per_s, r[0].lag_s, r[0].state_rows, r[0].late_rows, r[0].offsets_behind) == (4, 300, 1.5, 200.0, 7.0, 12, 2, 42)
    assert (r[1].rows_per_s, r[1].lag_s, r[1].state_rows, r[1].offsets_behind) == (None, None, 0, None)


def test_metrics_by_second(spark):
    later = PROGRESS | {"batchId": 5, "timestamp": "2024-01-01T00:00:10.900Z", "numInputRows": 100, "durationMs": {"triggerExecution": 500}, "stateOperators": [{"numRowsTotal": 20}]}
    progress = logs.progress_rows(spark, [PROGRESS, later])
    alerts = spark.createDataFrame([("2024-01-01 00:00:10.1", 10.0), ("2024-01-01 00:00:10.2", 30.0), ("2024-01-01 00:00:12", 5.0)], "ts string, ms double").withColumn("ts", F.to_timestamp("ts"))
    a, b = logs.per_second(progress, alerts).orderBy("second").collect()
    assert (a.rows, a.rows_per_s, a.batches, a.state_rows, a.alerts, a.p50_ms, a.p95_ms) == (400, 200.0, 2, 20, 2, 20.0, 29.0)
    assert (b.second - a.second, b.rows, b.rows_per_s, b.batches, b.alerts, b.p99_ms) == (2, 0, None, 0, 1, 5.0)


def test_listener_sees_every_batch(spark, tmp_path):
    listener = logs.Metrics()
    spark.streams.addListener(listener)
    try:
        spark.range(10).write.json(f"{tmp_path}/in")
        query = detect.start(logs.file_stream(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/state", once=True, path=f"{tmp_path}/out")
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows = listener.rows(spark).collect()
    finally:
        spark.streams.removeListener(listener)
    assert sum(r.rows for r in rows) == 10 and {r.query for r in rows} == {str(query.runId)}
    assert logs.capacity(logs.progress_rows(spark, [*listener.progress])).first().rows == 10
