"""Sharding by extendible hashing.

A document's hash is the leading bits of its id's md5. The directory is indexed by prefixes
of those bits; a bucket whose documents exceed the byte limit splits on the next bit, and
only such buckets do, until every shard fits. The directory is built from one aggregation:
bytes per cell (a prefix somewhat longer than needed on average) are rolled up to every
shorter prefix, and a document's shard is the shortest prefix that fits. Cells that are
still too large go on with more bits. Documents that no bit can part (equal ids) and that
exceed the limit together are chained: by running total of bytes into overflow shards.
A single document larger than the limit is a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sorted_ranks

#: Bytes of a shard, at most: a file that is read in one go, of which a loader mixes many.
LIMIT = 64 << 20
#: The limit of ``op3_sharding`` and of ``SQL``, which parts tables of a few megabytes as well.
QUERY_LIMIT = 160 << 10
#: Bits of the hash in use.
BITS = 60
#: Bits more than the average shard needs, in the first pass and in each further one.
SLACK = 6


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: str, depth) -> Column:
    return F.expr(f"shiftright({bits}, {BITS} - ({depth}))")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def directory(rows: DataFrame, limit: int, low: int, deep: int) -> DataFrame:
    """``(cell, depth, single)`` for each cell, ``deep`` leading bits, of ``rows (bits, bytes)``:
    the depth (``low`` at least) of the bucket that holds it, null where the cell itself is
    too large; ``single`` tells that all its rows have one hash."""
    cells = cut(rows.groupBy(prefix("bits", deep).alias("cell")).agg(F.sum("bytes").alias("bytes"), (F.min("bits") == F.max("bits")).alias("single")))
    up = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
    fits = cut(up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("depth", "prefix"))
    # No prefix shorter than the shortest that fits takes part: there all cells share a few of them.
    least = fits.agg(F.min("depth")).first()[0]
    found = up.where(F.col("depth") >= (deep + 1 if least is None else least)).join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cut(cells.select("cell", "single").join(found, "cell", "left"))


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, bytes, depth, bucket, chain)`` per row of ``docs``: a shard is ``depth`` bits
    with value ``bucket``, and ``chain`` (0 but for overflow shards).

    ``bytes`` is the text's length in UTF-8 (null: 0). Null ids share one hash, like equal
    ids; repeated rows count each. An empty table has no shards."""
    rows = cut(docs.select(F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("bytes"), hash_bits(F.col(id_col)).alias("bits")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, deep = 0, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK
    parts = []
    while True:
        deep = min(BITS, deep)
        found = rows.withColumn("cell", prefix("bits", deep)).join(directory(rows, limit, low, deep), "cell")
        parts.append(found.where("depth is not null").select("id", "bytes", "depth", prefix("bits", "depth").alias("bucket"), F.lit(0).cast("long").alias("chain")))
        large = cut(found.where("depth is null").select("id", "bytes", "bits", "single"))
        if large.isEmpty():
            break
        parts.append(chains(large.where("single" if deep < BITS else "true"), limit, deep))
        if deep == BITS:
            break
        rows, low, deep = large.where("not single").select("id", "bytes", "bits"), deep + 1, deep + SLACK
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumnRenamed("id", id_col)


def chains(rows: DataFrame, limit: int, deep: int) -> DataFrame:
    """Overflow shards for rows of one hash: rows of one size go side by side, each shard
    taking as many as fit."""
    ranked = sorted_ranks(rows.select("id", "bytes", "bits"), ["bits", "bytes"], ["id"])
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    groups = ranked.groupBy("bits", "bytes").agg(F.count(F.lit(1)).alias("n")).withColumn("pages", F.ceil(F.col("n") / per).cast("long"))
    before = F.coalesce(F.sum("pages").over(Window.partitionBy("bits").orderBy("bytes").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("bits", "bytes", before.alias("first"))
    return ranked.join(groups, ["bits", "bytes"]).select("id", "bytes", F.lit(deep).alias("depth"), prefix("bits", deep).alias("bucket"), (F.col("first") + F.floor(F.col("rank") / per)).cast("long").alias("chain"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet under ``path``, one folder ``shard=depth-bucket-chain`` per shard.

    Ids must occur once: an id that is repeated, or null in two rows, raises ValueError, as
    rows of one id may be of several shards. An empty table gives no folder; no column may be
    named like ``shard``."""
    placed = cut(shards(docs, limit, id_col, text_col).select(F.col(id_col).alias("id"), F.format_string("%02d-%x-%d", "depth", "bucket", "chain").alias("shard")))
    if not placed.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError(f"{id_col} must be different in every row")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("mine"))
    found = rows.join(placed, F.col("mine").eqNullSafe(F.col("id"))).select("row.*", "shard")
    found.repartition("shard").write.partitionBy("shard").parquet(path)


#: For tables whose ids are distinct and whose documents fit the limit, so without chains.
SQL = """
WITH docs AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS bits FROM documents
), up AS (
  SELECT doc_id, bytes, d.depth, bits >> (60 - d.depth) AS bucket FROM docs, (SELECT CAST(range AS INTEGER) AS depth FROM range(61)) d
), sums AS (
  SELECT depth, bucket, sum(bytes) AS total, count(*) AS n FROM up GROUP BY depth, bucket
)
SELECT doc_id, arg_min(bytes, u.depth) AS bytes, min(u.depth) AS depth, arg_min(u.bucket, u.depth) AS bucket, CAST(0 AS BIGINT) AS chain
FROM up u JOIN sums s ON u.depth = s.depth AND u.bucket = s.bucket
WHERE s.total <= 163840 GROUP BY doc_id
"""
