"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is its share of the mix by weight, but at most ``most`` times its size;
what a capped source can't take is shared anew among the others by weight. All documents of
a source expect the same number of copies, target / size (at most ``most``). Going through
the source's documents in order of size (so that every stretch holds like documents), the
expected copies are summed up; one offset in [0, 1), drawn from the source's name and the
seed, is added, and a document is emitted once for each integer that the sum crosses at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sorted_ranks

#: Words are runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``, one row per source.

    Sources take the weights in turn, by code point, null last. With sources in order of
    size for weight, the capped ones come first: the k smallest are capped, k being the
    least number for which the next source's part of the rest is within its cap."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = (F.lit(share) * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighted.withColumn("level", rest).withColumn("free", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return levels.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(level * F.col("weight"), F.lit(float("inf"))))).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """``(id_col, source, size, source_size, target, copies, taken)`` for every row of
    ``docs``; ``taken`` is ``copies * size``.

    Null texts have size 0; a null source is a source like any other, the last; a source
    without words has target 0. Ties in size go by the hashed id, then the id. Repeated rows
    are documents of their own. Two runs over the same rows give the same result."""
    if share > most:
        raise ValueError("the mix can't be larger than all sources at their caps")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("tie", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    ranked = sorted_ranks(rows, ["source"], ["size", "tie", "id"])
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, list(weights), share, most).withColumnRenamed("source", "of")
    found = ranked.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))))
    crossed = F.floor((F.col("rank") + 1) * each + offset) - F.floor(F.col("rank") * each + offset)
    return found.withColumn("copies", crossed.cast("long")).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: ``docs`` with each row repeated as often as ``mix`` takes its id.

    All columns are kept, whatever their names; an empty table gives an empty one. Ids should
    occur once: rows that share an id, or have none, share the copies of all of them evenly. Only
    the rows of such ids are ranked, by range, so that none of them meet in one task."""
    mine = mix(docs, id_col=id_col, **options).select(F.col(id_col).alias("id"), "copies")
    many = cut(mine.groupBy("id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")))
    found = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("mine")).join(many, F.col("mine").eqNullSafe(F.col("id")))

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn("turn", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("row.*")

    once = repeated(found.where("rows = 1"), F.col("copies"))
    if many.where("rows > 1").isEmpty():
        return once
    shared = sorted_ranks(found.where("rows > 1").withColumn("hash", F.xxhash64("row")), ["id"], ["hash"])
    return once.union(repeated(shared, F.floor(F.col("copies") / F.col("rows")) + (F.col("rank") < F.col("copies") % F.col("rows")).cast("int")))


SQL = """
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM sizes
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
      - 2 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level
  FROM weighted
), chosen AS (
  SELECT level FROM levels WHERE level * weight <= 2 * source_size ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1
), plan AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce((SELECT level FROM chosen) * weight, 'inf'::DOUBLE)) AS target FROM levels
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM docs
), each AS (
  SELECT doc_id, size, source_size, target, rank, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS f,
    ('0x' || substr(md5('mix:' || coalesce('s' || r.source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CAST(floor((rank + 1) * f + u) - floor(rank * f + u) AS BIGINT) * size AS taken
FROM each
"""
