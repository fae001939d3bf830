"""Structured streaming over activity logs: windows, sessions, first sightings; the sinks are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casework.shared import fresh


def read(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """A stream of the files that match ``pattern``, with ``ts`` as a timestamp."""
    return spark.readStream.schema(schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """began_us, event_type, n per window; events later than ``watermark`` are left out."""
    g = events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("began_us"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "2 hours") -> DataFrame:
    """user_id, began_us, n of runs of events without a pause of ``gap``."""
    e = events.withWatermark("ts", watermark) if watermark else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("began_us"), "n")


def first_seen(events: DataFrame, keys: list[str], watermark: str = "365 days") -> DataFrame:
    """The keys when they are first met."""
    return events.withWatermark("ts", watermark).select(*keys, "ts").dropDuplicatesWithinWatermark(keys).select(*keys)


def run(stream: DataFrame, mode: str = "complete", state: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its result as a table.

    Every batch is written to a folder of its own number, so a batch that is played again replaces itself.  In
    ``complete`` mode the last batch's result is the whole (the state grows with the number of keys, whatever the watermark); in
    ``append`` mode the batches add up.  With ``state``, a folder, a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    base = state or fresh(spark, "stream")
    out = f"{base}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = stream.schema
    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path)) if fs.exists(path) else []
    if not numbers:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{out}/batch={numbers[-1]}")
    return spark.read.schema(schema).option("basePath", out).parquet(*[f"{out}/batch={n}" for n in numbers]).select(*schema.names)
