"""Streaming queries over the events table, run until they have caught up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs, tracks


def shared(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, or on this machine where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="hushframe-")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def hourly(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Events by hour and type, counted as a stream. All events count, in whatever order their
    files come: the run ends when it has caught up, so its state needs no watermark."""
    path = f"{sf_dir}/events.parque[t]"  # a pattern, as the table may be a file or a folder
    events = jobs.files(spark, path, **options).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = shared(spark)
    jobs.updates_to(jobs.windowed(events.where("ts IS NOT NULL"), "ts", ["event_type"], late=None), f"{folder}/out", f"{folder}/progress").awaitTermination()
    return jobs.latest(spark, f"{folder}/out", ["event_type"]).select(F.unix_seconds("start").alias("start"), "event_type", "n")


def tracked_live(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Events as boxes, tracked as a stream; all of them, as the watermark lets a
    hundred years pass.
    Each comes with the time its scene began. A last row without a box, far ahead, gets the rest out."""
    events = jobs.files(spark, f"{sf_dir}/events.parque[t]", **options)
    k = F.coalesce(F.regexp_extract("props", r"(\d+)", 1).try_cast("double"), F.lit(0.0))
    sides = {"x": F.col("value") * 4, "y": k, "w": F.lit(60.0), "h": F.lit(60.0), "score": F.col("event_id") % 10 / 10}
    boxes = events.select("user_id", "event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at"), *[v.cast("double").alias(c) for c, v in sides.items()])
    folder = shared(spark)
    beat = spark.createDataFrame([(None, None, 7_258_118_400)], "user_id string, event_id string, at long")
    beat = beat.select(F.lit(-1).cast(boxes.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds("at").alias("at"), *[F.lit(None).cast("double").alias(c) for c in sides])
    ahead = beat.where("false")
    ahead.write.parquet(f"{folder}/beats")
    both = boxes.unionByName(spark.readStream.schema(ahead.schema).parquet(f"{folder}/beats"))
    before = {c: spark.conf.get(c, None) for c in tracks.STORE}
    try:
        for c, v in tracks.STORE.items():
            spark.conf.set(c, v)
        for _ in range(2):  # what is there, and then the row ahead
            found = tracks.tracks(both, "user_id", "at", "event_id", max_gap=24 * 3600, late="36525 days")
            found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
            beat.write.mode("append").parquet(f"{folder}/beats")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v else spark.conf.unset(c)
    return spark.read.schema(found.schema).parquet(f"{folder}/out").select("event_id", "user_id", F.unix_seconds("scene").alias("scene"), "track")


QUERIES = {"hourly": hourly, "tracked_live": tracked_live}
SQL = {"hourly": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL"}
