"""Intervals as tables: joins and unions of spans of texts of any length.

A key's places are dealt to bins of ``SIZE``, so that the spans of one text, however many, are many
small keys. What passes from bin to bin is one row per bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 2048


def binned(df: DataFrame, ends: tuple[str, str], out: str, size: int) -> DataFrame:
    """``df`` once per bin that a row's interval touches; empty intervals touch the bin that they lie in."""
    first, last = F.floor(F.col(ends[0]) / size), F.floor((F.greatest(F.col(ends[0]) + 1, F.col(ends[1])) - 1) / size)
    return df.withColumn(out, F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], of_left: tuple[str, str] = ("start", "end"), of_right: tuple[str, str] = ("start", "end"), size: int = SIZE) -> DataFrame:
    """The pairs of rows of the same key ``by`` whose intervals share a place: an equality join on the
    bins both touch. A pair that meets in several bins counts in the first. Other columns of the two
    have to differ in name; null keys and ends meet nothing."""
    place = "bin"
    while place in {*left.columns, *right.columns}:
        place += "_"
    met = binned(left, of_left, place, size).join(binned(right, of_right, place, size), [*by, place])
    (a, b), (c, d) = of_left, of_right
    met = met.where((F.col(a) < F.col(d)) & (F.col(b) > F.col(c)))
    return met.where(F.col(place) == F.floor(F.greatest(F.col(a), F.col(c)) / size)).drop(place)


def coalesced(spans: DataFrame, by: list[str], tag: str = "tag", size: int = SIZE) -> DataFrame:
    """``(by, start, end, tag)``: overlapping spans of a key as one, tagged by the last span that was longer
    than all before it had become; touching ones stay apart. The table form of ``spans.coalesce``.

    Spans are sorted within their bin; how far those of earlier bins reach, and where the last
    union of them began, comes as one row per bin. Spans of null key or ends are left out."""
    rows = spans.dropna(subset=[*by, "start", "end"]).select(*by, "start", "end", F.col(tag).alias("__tag"), F.floor(F.col("start") / size).alias("__bin"))
    bins = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*by, "__bin").agg(F.max("end").alias("__most")).withColumn("__reach", F.max("__most").over(bins)).drop("__most")
    line = Window.partitionBy(*by, "__bin").orderBy("start", F.desc("end"), "__tag")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.join(reach, [*by, "__bin"]).withColumn("__till", F.greatest("__reach", F.max("end").over(before)))
    seen = seen.withColumn("__new", F.coalesce(F.col("start") >= F.col("__till"), F.lit(True)))
    seen = seen.withColumn("__first", F.last(F.when(F.col("__new"), F.col("start")), True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    begun = seen.groupBy(*by, "__bin").agg(F.max("__first").alias("__begun")).withColumn("__begun", F.last("__begun", True).over(bins))
    seen = seen.join(begun, [*by, "__bin"]).withColumn("__first", F.coalesce("__first", "__begun"))
    longer = F.col("__new") | (F.col("end") - F.col("start") > F.col("__till") - F.col("__first"))
    rank = F.when(longer, F.struct("start", (-F.col("end")).alias("e"), "__tag"))
    return seen.groupBy(*by, "__first").agg(F.max("end").alias("end"), F.max(rank).alias("__r")).select(*by, F.col("__first").alias("start"), "end", F.col("__r.__tag").alias(tag))
