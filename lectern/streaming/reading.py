"""Event streams: each function takes a batch or a streaming frame of events (user_id, ts, event_type, value, event_id). A stream has its watermark from ``event_stream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How late an event may come.
LATE = "2 hours"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 100, late: str = LATE) -> DataFrame:
    """Events of the parquet files under a path as a stream, with event time in UTC and its watermark."""
    return with_time(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)).withWatermark("ts", late)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(events: DataFrame) -> DataFrame:
    """Each event id once: a stream forgets ids older than its watermark, so its state is bounded."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def capped(events: DataFrame, most: float) -> DataFrame:
    """Positive amounts of at most ``most``; others drop before any state is kept."""
    return events.where("value > 0").withColumn("value", F.least("value", F.lit(most)))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, ended, events, total): runs of events at most ``gap`` apart; ended is the last event's time plus the gap."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return g.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "total")


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(started, event_type, events, total): tumbling windows, or sliding ones with a slide."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("started"), "event_type", "events", "total")


def sampled(events: DataFrame, every: str = "400 milliseconds") -> DataFrame:
    """(user_id, started, event_id, value): the last event of each user in each interval."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return events.groupBy("user_id", F.window("ts", every).alias("w")).agg(last).select("user_id", F.col("w.start").alias("started"), "x.event_id", "x.value")


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type, value): the newest event of each user; as a stream in update mode, one row of state for each."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


def settled(events: DataFrame, quiet_ms: int) -> DataFrame:
    """Events of a batch that no other of the same user follows within ``quiet_ms``: what a debounced reader acts on."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("_next", nxt).where(F.col("_next").isNull() | (F.unix_millis(F.col("_next").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp")) > quiet_ms)).drop("_next")


def changes(events: DataFrame) -> DataFrame:
    """Events of a batch whose value differs from the one before of the same user."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("_before", before).where(~F.col("value").eqNullSafe(F.col("_before"))).drop("_before")


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """A stream of newest rows kept in a table: each batch is merged into the next version, so replay of a batch changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        here = hadoop.Path(path)
        fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(here)) if fs.exists(here) else []
        old = [v for v in versions if v < batch_id]
        rows = batch
        if old:
            rows = spark.read.parquet(f"{path}/v{old[-1]}").join(batch.select(key), key, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        for v in old[:-1]:
            fs.delete(hadoop.Path(f"{path}/v{v}"), True)

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, in append mode, written to a table with exactly-once bookkeeping; the table is read back."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
