"""Light curves cut at gaps while they arrive: the streaming counterpart of gap removal, an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def gap_sessions(events: DataFrame, gap: str = "36 hours", lateness: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n_obs, peak): runs of observations without a gap of that length; works on streams and tables."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_obs"), F.max("value").alias("peak"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_obs", "peak")


def window_peaks(events: DataFrame, window: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """The highest flux per object and window."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    found = rows.groupBy("user_id", F.window("ts", window, slide).alias("w")).agg(F.max("value").alias("peak"), F.count("*").alias("n_obs"))
    return found.select("user_id", F.col("w.start").alias("start"), "peak", "n_obs")


def drain(stream: DataFrame, folder: str, output_mode: str = "append") -> DataFrame:
    """Run a stream over what is there into Parquet files under ``folder`` and return its rows.

    In complete mode each trigger's whole result replaces the one before; nothing is gathered on the driver.
    """
    path = f"{folder}/rows"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if output_mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(output_mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


def merged_sessions(parts: DataFrame) -> DataFrame:
    """Sessions (user_id, start, end, n_obs, peak) that overlap, joined to one: parts of a table's sessions are its sessions."""
    before = W.partitionBy("user_id").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("start") > reach)).cast("int")  # as session windows do, which join at a gap of just that length
    numbered = parts.withColumn("_new", opens).withColumn("_k", F.sum("_new").over(before.rowsBetween(W.unboundedPreceding, 0)))
    found = numbered.groupBy("user_id", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_obs").alias("n_obs"), F.max("peak").alias("peak"))
    return found.drop("_k")


def drain_sessions(stream: DataFrame, folder: str, gap: str = "36 hours") -> DataFrame:
    """The sessions of a stream of events that is run over what is there.

    Each trigger writes the sessions of its own events, once, and the parts are joined at the end. So a trigger costs what it brings,
    however many there are, sessions may span triggers, and late events count. A trigger that is run again replaces its part.
    """

    def put(batch: DataFrame, number: int) -> None:
        gap_sessions(batch, gap).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = gap_sessions(stream.sparkSession.createDataFrame([], stream.schema), gap).schema
    return merged_sessions(stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows"))
