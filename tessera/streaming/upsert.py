"""Structured Streaming: files of records as batches, each merged into a versioned state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are there, ascending."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def versioned(
    spark: SparkSession, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 3
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a version is the merge of the last one before it and the batch.

    A batch that is run again after a failure writes its version again, so each counts once. ``keep`` versions stay.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = [n for n in versions(spark, path) if n < number]
        old = spark.read.parquet(f"{path}/v={before[-1]}") if before else None
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v={number}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for n in before[: max(0, len(before) + 1 - keep)]:
            gone = folder(f"{path}/v={n}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return run


def follow(spark: SparkSession, source: str, schema, checkpoint: str, state: str, merge, files: int = 1) -> StreamingQuery:
    """Start a query that takes all files there are, some at a time, and ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    writer = stream.writeStream.foreachBatch(versioned(spark, state, merge)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest(key: str, order: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that keeps each key's row with the greatest order."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if old is None else old.unionByName(batch)
        others = [c for c in both.columns if c != key]
        top = both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *others)).alias("top"))
        return top.select(key, "top.*").select(*both.columns)

    return merge


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events and their values by window; works on streams, with a watermark, and on tables."""
    watched = stream.withWatermark(time, late) if stream.isStreaming else stream
    grouped = watched.groupBy(F.window(time, width).alias("w"), by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "total")
