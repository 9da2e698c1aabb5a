"""Event-time windows and incremental ingestion on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.scratch import shared_dir

EVENTS = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, sf_dir: str, watermark: str = "90 days") -> DataFrame:
    """The event table as a stream; the watermark covers a whole replay, as files come in no order."""
    stamp = dict(spark.read.parquet(f"{sf_dir}/events.parquet").dtypes)["ts"]
    raw = spark.readStream.schema(EVENTS.replace("TIMESTAMP", stamp)).parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(stream: DataFrame, width: str) -> DataFrame:
    g = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str, step: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withColumn("day", F.date_trunc("day", "ts")).dropDuplicatesWithinWatermark(keys).select(*keys)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the final table, written by the stream to the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/table"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest(spark: SparkSession, source: str, schema: str, upsert, checkpoint: str):
    """Micro-batches of new files, each handed to `upsert(batch, id)`; files once read are not read again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()


SESSION_STATE = "status STRING, changed DOUBLE"


def session_states(stream: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """stream: session_id, ts, step. The last step of each session; `expired` once nothing came for a while (event time)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    minutes = int(idle.split()[0])

    def advance(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "status": ["expired"], "changed": [0.0]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        changed = rows.ts.iloc[-1].timestamp()
        state.update((rows.step.iloc[-1], changed))
        state.setTimeoutTimestamp(max(int(changed * 1000), state.getCurrentWatermarkMs()) + minutes * 60_000)
        yield pd.DataFrame({"session_id": [key[0]], "status": [rows.step.iloc[-1]], "changed": [changed]})

    return stream.groupBy("session_id").applyInPandasWithState(advance, "session_id STRING, status STRING, changed DOUBLE", SESSION_STATE, "update", GroupStateTimeout.EventTimeTimeout)
