"""Shared pieces of the corpus operators: checkpoints, per-row Arrow functions, ranks.

Conventions that hold for every operator here, unless its docstring says otherwise:

* A null text counts as an empty text.
* Results carry only the operator's own columns, taken from the input by the column
  names passed in, so other input columns never clash with them.
* Repeated rows are processed and returned once each; an empty table gives an empty
  result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


#: Texts that a Python worker holds as Python objects at once.
ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none, on one machine, a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local" and not spark.sparkContext.getCheckpointDir():
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="hushframe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, its lineage cut there,
    and so safe against the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: like ``cut``, and a good deal
    smaller. ``clean`` takes it away once no result that reads it is needed."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/hushframe-table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def clean(spark: SparkSession) -> None:
    """Deletes what ``written`` has left in the shared folder. Call it when no job that reads such a
    table is running or still to come, whichever session began it."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = files.Path(f"{shared_dir(spark).rstrip('/')}/hushframe-table-*")
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.globStatus(pattern) or []:
        system.delete(found.getPath(), True)


def per_text(fn: Callable[[pa.Array], pa.Array], returns: str):
    """An Arrow function over a text column; ``fn`` gets a string array without nulls.

    It is marked as non-deterministic only to keep the optimizer from running it twice
    when its result is both filtered on and returned."""

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("") if texts.null_count else texts
        parts = [fn(texts.slice(at, ROWS)) for at in range(0, max(len(texts), 1), ROWS)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, returns).asNondeterministic()


def struct_array(**columns) -> pa.Array:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def bucket_of(key: Column, buckets: int) -> Column:
    """crc32 of the key's text, modulo ``buckets``."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(buckets)


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose hashed key is smallest: a deterministic bounded sample.

    Hashes are first cut at a rate from the number of rows, a good deal above ``n``: the sort meets in
    one task, and would get ``n`` rows of every partition. ``df`` is read twice."""
    total = df.count()
    rate = (1.2 * n + 1000) / max(1, total)
    if rate < 1:
        df = df.where(F.xxhash64(F.col(key)) < F.lit(int(rate * (1 << 64)) - (1 << 63)))
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)


def sorted_ranks(df: DataFrame, group: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Adds ``rank``: the row's position (from 0) within its group, by ``order``.

    A window over a hot group would meet in one task. Here all rows are range-partitioned
    by group *and* order, and last by their place in the input, so that neither a hot group nor
    rows that are repeated meet in one task; each task knows the position of a row among its own rows of the group, and a running sum over the counts
    per task and group (one small row each) gives where the task begins. The sorted rows
    are checkpointed, as range bounds may differ from one run of a plan to the next."""
    keys = [F.col(c) for c in group + order]
    place = [*keys, F.col("__place")]
    dealt = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*place).sortWithinPartitions(*place)
    dealt = cut(dealt.drop("__place").withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.spark_partition_id()))
    counts = dealt.groupBy("__task", *group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    starts = starts.select("__task", "__first", "__before", *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)])
    same = [dealt["__task"] == starts["__task"]] + [dealt[c].eqNullSafe(starts[f"__g{i}"]) for i, c in enumerate(group)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = dealt.join(starts, on, "left").withColumn(rank, F.col("__at") - F.col("__first") + F.col("__before"))
    return out.select(*df.columns, rank)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, least: int = 1000, most: int = 10_000) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row per ``key`` and, in column
    ``rows``, how many rows of ``left`` have it.

    Keys that hold more than one in ``most`` of all rows, and more than ``least``, are hot: there
    are fewer than ``most`` of them however large the tables, so they are broadcast, and their
    rows stay where they are. All others meet by shuffle, in groups of limited size."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = max(least, total // most)
    hot = right.where(F.col(rows) > limit)
    if total <= limit or hot.isEmpty():
        return left.join(right, key)
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    rest = marked.where("__hot IS NULL").drop("__hot").join(right.where(F.col(rows) <= limit), key)
    return left.join(F.broadcast(hot), key).union(rest)


def bytes_of(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def ranges(counts: np.ndarray) -> np.ndarray:
    """Start offsets for consecutive runs of the given lengths, and the end."""
    return np.concatenate([[0], np.cumsum(counts)])
