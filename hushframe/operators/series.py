"""Time-series operators, keyed: as-of look-ups, islands, carries, validity, sampling.

All but sampling are windows partitioned by key; a key's rows meet in one task, sorted and spillable.
Sampling is an aggregate, so a key with many rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .redact import free


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, tolerance: float | None = None) -> DataFrame:
    """``left`` with the last ``right`` row of the same key at or before its time: columns
    ``value`` and ``{value}_{time}``, null where there is none or it is older than ``tolerance`` seconds.

    One sort of both sides together, no join: the latest right-hand row is carried forward.
    Rows of ``right`` at the same time come first; of several, the largest value counts."""
    side, hit, last = (free(left, n) for n in ("side", "hit", "last"))
    seen = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    a = left.withColumn(side, F.lit(1)).withColumn(hit, F.lit(None).cast(right.select(seen).schema[0].dataType))
    b = right.select(*by, time, F.lit(0).alias(side), seen.alias(hit))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, side, F.col(f"{hit}.v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(last, F.last(hit, ignorenulls=True).over(w)).where(F.col(side) == 1)
    near = F.lit(True) if tolerance is None else seconds(F.col(time)) - seconds(F.col(f"{last}.t")) <= tolerance
    return found.select(*left.columns, F.when(near, F.col(f"{last}.v")).alias(value if value not in left.columns else f"{value}_as_of"), F.when(near, F.col(f"{last}.t")).alias(f"{value}_{time}"))


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / 1e6


def islands(df: DataFrame, by: list[str], order: list[str], state: str, out: str = "island") -> DataFrame:
    """Numbers the runs of rows with the same ``state`` within a key."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn(out, change).withColumn(out, F.sum(out).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def valid_until(df: DataFrame, by: list[str], time: str, end: Column | None = None, out: str = "until") -> DataFrame:
    """When the next row of the key takes over; the last one holds to ``end``."""
    return df.withColumn(out, F.coalesce(F.lead(time).over(Window.partitionBy(*by).orderBy(time)), end if end is not None else F.lit(None).cast("timestamp")))


def carried(df: DataFrame, by: list[str], order: list[str], value: str, most: int = 8, out: str = "carried") -> DataFrame:
    """The last known value of at most ``most`` rows before, else the first of as many after."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = F.last(value, True).over(w.rowsBetween(-most, 0)), F.first(value, True).over(w.rowsBetween(0, most))
    return df.withColumn(out, F.coalesce(before, after))


def sampled(df: DataFrame, by: list[str], time: str, every: str = "250 milliseconds") -> DataFrame:
    """The first row of each key in each slot of time."""
    row, slot = free(df, "row"), free(df, "slot")
    firsts = df.groupBy(*by, F.window(time, every).alias(slot)).agg(F.min_by(F.struct(*df.columns), time).alias(row))
    return firsts.select(f"{row}.*")
