"""Queries over the events table, read as time series: operators of the timeline tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import as_of, carried, islands, sampled, valid_until


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: each event with the user's last purchase at or before it."""
    e = events(spark, sf_dir)
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"))
    return as_of(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "paid").select("event_id", "paid")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands: runs of one kind of event per user."""
    found = islands(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")
    return found.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long an event is the user's latest, in microseconds; -1 for the last one."""
    found = valid_until(events(spark, sf_dir).dropDuplicates(["user_id", "ts"]).select("user_id", "ts"), ["user_id"], "ts")
    return found.select("user_id", F.unix_micros("ts").alias("us"), F.coalesce(F.unix_micros("until") - F.unix_micros("ts"), F.lit(-1)).alias("held"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-rate sampling: the first event of a user in each hour."""
    e = events(spark, sf_dir).groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return sampled(e, ["user_id"], "ts", "1 hour").select("user_id", "event_id")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded carry: the value of the last purchase among eight events, else of the next one."""
    e = events(spark, sf_dir).withColumn("paid", F.expr("CASE WHEN event_type = 'purchase' THEN value END"))
    return carried(e, ["user_id"], ["ts", "event_id"], "paid").select("event_id", "carried")


QUERIES = {f.__name__: f for f in (last_purchase, runs, validity, slots, filled)}
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
SQL = {
    "last_purchase": """
SELECT e.event_id, max(p.value) AS paid FROM events e
LEFT JOIN (SELECT user_id, ts, max(value) AS value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
  ON e.user_id = p.user_id AND p.ts <= e.ts AND (p.until IS NULL OR e.ts < p.until) GROUP BY e.event_id""",
    "runs": f"""
WITH c AS (SELECT *, CASE WHEN lag(event_type) {OVER}) IS NOT DISTINCT FROM event_type AND row_number() {OVER}) > 1 THEN 0 ELSE 1 END AS c FROM events),
i AS (SELECT *, CAST(sum(c) {OVER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM c)
SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS least FROM i GROUP BY ALL""",
    "validity": """
SELECT user_id, epoch_us(ts) AS us, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts), -1) AS held FROM (SELECT DISTINCT user_id, ts FROM events)""",
    "slots": """
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts) AS n
  FROM (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY user_id, ts)) WHERE n = 1""",
    "filled": f"""
SELECT event_id, coalesce(last_value(paid IGNORE NULLS) {OVER} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), first_value(paid IGNORE NULLS) {OVER} ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) AS carried
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events)""",
}
