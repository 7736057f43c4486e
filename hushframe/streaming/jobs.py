"""Streaming jobs: masked copies and counts that are kept up to date.

Files (or any other stream) come in, results go to folders. State and progress live under the
checkpoint folder, which has to be one that the whole cluster shares, so that a job goes on
where it stopped, on whichever executors are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import free, redact


def files(spark: SparkSession, path: str, schema=None, most_files: int = 1000) -> DataFrame:
    """Parquet files under ``path`` (a folder or pattern) as a stream, ``most_files`` a batch."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", most_files).parquet(path)


def mask_to(stream: DataFrame, out: str, checkpoint: str, style: str = "labels", text: str = "text", **options) -> StreamingQuery:
    """A masked copy of all that comes in; the text itself is not written. Stateless: every
    row is masked on its own, and each file written exactly once."""
    new = free(stream, "__masked")
    copy = redact(stream, style, text, new, **options).drop(text).withColumnRenamed(new, text)
    return copy.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, keys: list[str], every: str = "1 hour", late: str | None = "1 day", step: str | None = None) -> DataFrame:
    """Rows by window of time and ``keys``, one window each ``step`` (by default side by side); rows
    later than ``late`` behind the newest are dropped by the watermark, which also bounds the
    state. With ``late`` None none is dropped, and the state keeps all windows. Tables work too."""
    seen = stream if late is None else stream.withWatermark(time, late)
    return seen.groupBy(F.window(time, every, step).alias("slot"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("slot.start").alias("start"), *keys, "n")


def in_sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str | None = "1 day") -> DataFrame:
    """``(start, end, keys, n)``: runs of rows of a key that come less than ``gap`` apart."""
    seen = stream if late is None else stream.withWatermark(time, late)
    return seen.groupBy(F.session_window(time, gap).alias("run"), *keys).agg(F.count(F.lit(1)).alias("n")).select("run.start", "run.end", *keys, "n")


def updates_to(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed counts of each batch, in a folder per batch: a batch that is run again after a
    failure overwrites its own folder, so nothing counts twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last count of each window and key that ``updates_to`` has written."""
    return spark.read.option("basePath", out).parquet(out).groupBy("start", *keys).agg(F.max_by("n", "batch").alias("n"))
