"""SimHash near-duplicates, found by deletion-variant signatures.

A 64-bit fingerprint per text: words are runs of other than ASCII white space, A-Z lower-
cased; the XXH64 (seed 42) of every shingle of ``words`` words, repeats included, votes on
each bit, which is 1 if set in over half of the hashes. A text with fewer words is one
shingle; a text without words has fingerprint zero.

Two fingerprints are linked if they differ in ``distance`` bits at most. To find links, the
64 bits are cut into ``distance // 2 + 1`` segments: then some segment differs in one bit
at most. Every segment is indexed by its one-wildcard variants (the segment with bit *i*
blanked, for each *i*), so linked fingerprints share a signature (segment, i, blanked
value), found by equality and verified by the number of differing bits.

Exact copies meet first: only distinct fingerprints are indexed. A signature held by many
distinct fingerprints (a large family of edited copies) would give pairs by the square of
their number, though one chain of links says as much. Members of such a signature are
handled exactly another way, linear in their number:

* each flips every one of its bits once; all fingerprints that reach the same point are
  within two bits of each other and are linked to the smallest (at most 65 reach a point);
* what is then still apart can only be linked at three bits: a fingerprint outside its
  signature's largest component looks up all points within two flips among the points that
  the others reach with one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, join_hot, per_text, ranges
from .graph import components

#: Distinct fingerprints on a signature from which on pairs are no longer formed.
DENSE = 64
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    out, hashes, counts = [], [], []
    digest, seed, waiting = xxhash.xxh64_intdigest, 42, 0
    for text in texts:
        found = text.lower().split()
        n = len(found)
        if n <= words:
            got = [digest(b" ".join(found), seed)] if n else []
        else:
            got = [digest(b" ".join(found[i : i + words]), seed) for i in range(n - words + 1)]
        hashes.append(np.array(got, np.uint64))
        counts.append(len(got))
        waiting += len(got)
        if waiting >= BLOCK:
            out.append(votes(np.concatenate(hashes), np.array(counts)))
            hashes, counts, waiting = [], [], 0
    if counts:
        out.append(votes(np.concatenate(hashes), np.array(counts)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ones = np.zeros((len(counts), 64), np.int64)
    at = ranges(counts)
    some = np.flatnonzero(counts)
    for first in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[first : first + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        last = first + len(bits)
        here = some[(at[some] < last) & (at[some + 1] > first)]
        starts = np.maximum(at[here], first) - first
        ones[here] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    set_ = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(words: int = 3):
    """An Arrow function from a text to its fingerprint, as a signed 64-bit integer."""
    return per_text(lambda texts: pa.array(fingerprints(bytes_of(texts), words).view(np.int64)), "bigint")


def signatures(distinct: DataFrame, distance: int) -> DataFrame:
    """``(sig, key, fp)``: the one-wildcard variants of each segment."""
    parts = distance // 2 + 1
    edges = [64 * p // parts for p in range(parts + 1)]
    variants = []
    for low, high in zip(edges, edges[1:], strict=False):
        mask = ((1 << high) - 1) ^ ((1 << low) - 1)
        for bit in range(low, high):
            kept = mask & ~(1 << bit)
            variants.append(F.struct(F.lit(bit).cast("smallint").alias("sig"), F.col("fp").bitwiseAND(F.lit(kept - (1 << 64) if kept >> 63 else kept)).alias("key")))
    return distinct.select("fp", F.explode(F.array(*variants)).alias("v")).select("v.sig", "v.key", "fp")


def flipped(masks: list[int]):
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.explode(F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.col("fp").bitwiseXOR(m)))


def links(distinct: DataFrame, distance: int = 3, dense: int = DENSE) -> DataFrame:
    """``(a, b)``: links whose components are those of all pairs of fingerprints that differ
    in ``distance`` (1 to 3) bits at most. ``distinct`` has one row per ``fp``."""
    if not 1 <= distance <= 3:
        raise ValueError("distances from 1 to 3 are supported")
    # Counted by aggregation: a signature of many fingerprints never meets in one task. Two on a
    # signature are its least and its greatest; only those of three and more are looked up.
    signed = signatures(distinct, distance)
    held = cut(signed.groupBy("sig", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    shared = cut(signed.join(held.where("n > 2").select("sig", "key", "n"), ["sig", "key"]))
    few = shared.where(F.col("n") <= dense)
    more = few.select("sig", "key", F.col("fp").alias("a")).join(few.select("sig", "key", F.col("fp").alias("b")), ["sig", "key"]).where(F.col("a") < F.col("b")).select("a", "b")
    pairs = held.where("n = 2").select("a", "b").union(more).where(near).distinct()
    crowd = shared.where(F.col("n") > dense)
    if crowd.isEmpty():
        return pairs
    members = cut(crowd.select("fp").distinct())
    once = [0] + [1 << i for i in range(64)]
    if distance < 2:  # links within one bit are a flip of each other
        there = members.select("fp", flipped(once[1:]).alias("point")).join(members.select(F.col("fp").alias("point")), "point")
        return pairs.union(there.select(F.col("fp").alias("a"), F.col("point").alias("b")).where("a < b"))
    reach = members.select("fp", flipped(once).alias("point"))
    close = reach.withColumn("b", F.min("fp").over(Window.partitionBy("point"))).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    close = cut(close)
    if distance == 2:
        return pairs.union(close)
    group = components(close)
    named = cut(members.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")))
    sizes = crowd.select("sig", "key", "fp").join(named, "fp").groupBy("sig", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("sig", "key").agg(F.count(F.lit(1)).alias("groups"), F.max_by("component", F.struct("n", "component")).alias("main")).where("groups > 1")
    outside = crowd.select("sig", "key", "fp").join(named, "fp").join(largest, ["sig", "key"]).where(F.col("component") != F.col("main")).select("fp", "component").distinct()
    twice = once + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    points = named.select("fp", "component", flipped(once).alias("point")).groupBy("point").agg(F.min("component").alias("other"))
    far = outside.select("fp", "component", flipped(twice).alias("point")).join(points, "point").where(F.col("other") != F.col("component")).select(F.col("component").alias("a"), F.col("other").alias("b")).distinct()
    return pairs.union(close).union(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """``(id_col, fp, component_id)`` per row of ``docs``: the fingerprint, and the smallest id
    reachable over links, the row's own included.

    Null texts count as empty; empty texts share fingerprint zero and are linked like any
    others. Rows with a null id are returned with the component of the others (null if all
    ids in it are null). Repeated rows come back as often as they occur."""
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(words)(F.col(text_col)).alias("fp")))
    own = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    group = components(links(own.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = cut(own.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("texts"))
    final = cut(join_hot(named, cut(least), "component", "texts").select("fp", "n", "component_id"))
    return join_hot(rows, final, "fp", "n").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest id, and of the rows with
    that id the first by hash. A row with a null id stays only where no other is in its group.

    All columns are kept, whatever their names; an empty table gives an empty one. The survivor of
    a group is found by aggregation before any join, so that a large group never meets in one task."""
    keep = docs.select(F.col(id_col).alias("id"), fingerprint(words)(F.col(text_col)).alias("fp"), F.xxhash64(F.col(text_col)).alias("h"))
    rows = cut(keep)
    own = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("best")))
    group = components(links(own.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = own.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    chosen = named.groupBy("component").agg(F.min("best").alias("best")).select("best.id", "best.h")
    times = rows.groupBy(F.col("id").alias("same_id"), F.col("h").alias("same_h")).agg(F.count(F.lit(1)).alias("times"))
    chosen = cut(chosen.join(times, F.col("id").eqNullSafe(F.col("same_id")) & (F.col("h") == F.col("same_h"))).select("id", "h", "times"))
    mine = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("my_id"), F.xxhash64(F.col(text_col)).alias("my_h"))
    found = mine.join(chosen, F.col("my_id").eqNullSafe(F.col("id")) & (F.col("my_h") == F.col("h")))
    once = found.where("times = 1").select("row.*")
    if chosen.where("times > 1").isEmpty():
        return once
    twice = found.where("times > 1").withColumn("first", F.xxhash64("row"))
    # One of the rows alike: all but the first by hash go in a task each, before any meet.
    return once.union(twice.groupBy("id", "h").agg(F.min_by("row", "first").alias("row")).select("row.*"))
