"""Incremental ingestion and session states on small file streams."""

import json

from pyspark.sql import functions as F

from cuelake.streaming import windows


def test_ingest_reads_each_file_once(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"id": 1}) + "\n")

    def upsert(batch, _):
        seen.extend(r.id for r in batch.collect())

    for extra in (None, "b.json"):
        if extra:
            (source / extra).write_text(json.dumps({"id": 2}) + "\n")
        windows.ingest(spark, str(source), "id LONG", upsert, f"file://{tmp_path}/state").awaitTermination()
    assert sorted(seen) == [1, 2]


def test_sessions_expire(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    steps = [[("s1", "2024-01-01T10:00:00", "queued"), ("s1", "2024-01-01T10:01:00", "ready")], [("s2", "2024-01-01T12:00:00", "queued")], [("s2", "2024-01-01T12:05:00", "ready")]]
    stream = spark.readStream.schema("session_id STRING, ts TIMESTAMP, step STRING").option("maxFilesPerTrigger", 1).json(str(source)).withWatermark("ts", "1 minute")
    got = []
    states = windows.session_states(stream, "30 minutes")

    def keep(batch, _):
        got.extend((r.session_id, r.status) for r in batch.collect())

    for i, rows in enumerate(steps):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "ts", "step"), r))) for r in rows))
        states.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert ("s1", "ready") in got and ("s1", "expired") in got and ("s2", "ready") in got and ("s2", "expired") not in got


def test_late_events_are_left_out(spark, tmp_path):
    """What comes after the watermark has passed its window no longer counts."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("ts TIMESTAMP, event_type STRING, value DOUBLE").json(str(source)).withWatermark("ts", "10 minutes")
    counts, out = windows.tumbling(stream, "1 hour"), f"file://{tmp_path}/out"
    for i, hour in enumerate((1, 5, 1, 9)):
        (source / f"{i}.json").write_text(json.dumps({"ts": f"2024-01-01T{hour:02d}:30:00", "event_type": "view", "value": 1.0}))
        counts.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    rows = {r.start.hour: r.n for r in spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp")).collect()}
    assert rows[1] == 1 and rows[5] == 1
