"""Structured Streaming: event-time windows and keyed job state over folders of parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir


#: Event time of the row that ends a bounded input.
END = "9000-01-01 00:00:00"


def with_end(stream: DataFrame, out: str, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """The stream with a second source, the still empty folder out/end, and the row that will end it: nulls at the time END."""
    spark = stream.sparkSession
    end = spark.range(1).select(*[F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    end.where("false").write.parquet(f"{out}/end")
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{out}/end")), end


def run_to_end(result: DataFrame, end: DataFrame, out: str) -> DataFrame:
    """What a bounded stream writes in append mode: it runs until its input is read, then once more with the row that ends it.

    The row comes to the second source only after the last batch of input, so the watermark moves past all windows and timers
    when nothing can be late any more, however many batches there were. State lies in RocksDB, in the shared folder.
    """
    spark = result.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for last in (False, True):
            if last:
                end.coalesce(1).write.mode("append").parquet(f"{out}/end")
            result.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def span_seconds(spark: SparkSession, path: str) -> int:
    """Seconds between the first and the last ts of a table: how long a watermark waits if its files come in any order."""
    r = spark.read.parquet(path).agg((F.max(F.col("ts").cast("timestamp").cast("double")) - F.min(F.col("ts").cast("timestamp").cast("double"))).alias("s")).first()
    return int(r.s or 0) + 1


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of parquet files or over a single file; nothing beside it is read."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    if status.isDirectory():
        return reader.parquet(at.toString())
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def event_windows(spark: SparkSession, path: str, size: str = "1 hour", delay: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """start, event_type, n, total of each window of event time, emitted once when the watermark closes it; rows without time have no window."""
    out = fresh_dir(spark, "windows")
    rows = read_stream(spark, path, files_per_batch).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows, end = with_end(rows, out)
    counted = rows.withWatermark("ts", delay or f"{span_seconds(spark, path)} seconds").groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    done = run_to_end(counted.select(F.col("w.start").alias("start"), "event_type", "n", "total"), end, out)
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def runs(spark: SparkSession, path: str, silence: str = "2 hours", delay: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """user_id, began, n, last_ts, last_type of each run of a user's events: keyed state that a silence of event time closes."""
    out = fresh_dir(spark, "runs")
    rows = read_stream(spark, path, files_per_batch).where("user_id is not null").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "event_id")
    rows, end = with_end(rows, out)
    kept = rows.withWatermark("ts", delay or f"{span_seconds(spark, path)} seconds").groupBy("user_id", F.session_window("ts", silence).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return run_to_end(kept.select("user_id", F.col("w.start").alias("began"), "n", F.col("last.ts").alias("last_ts"), F.col("last.event_type").alias("last_type")), end, out).where("user_id is not null")


def job_states(spark: SparkSession, path: str, as_of: str | None = None, stale_seconds: int = 7200) -> DataFrame:
    """user_id, state, n, last_ts of each job (here a user's events): the type of the last event, or stale where that is older than so many seconds at as_of, the last event of all by default."""
    jobs = runs(spark, path, f"{stale_seconds} seconds").groupBy("user_id").agg(F.sum("n").alias("n"), F.max(F.struct("last_ts", "last_type")).alias("l")).select("user_id", "n", "l.*")
    now = F.lit(as_of).cast("timestamp") if as_of else F.lit(spark.read.parquet(path).agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    age = now.cast("double") - F.col("last_ts").cast("double")
    return jobs.select("user_id", "n", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), F.when(age > stale_seconds, "stale").otherwise(F.col("last_type")).alias("state"))
