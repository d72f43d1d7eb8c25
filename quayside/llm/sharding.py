"""Sharding by extendible hashing.

A directory is indexed by hash-prefix bits. Bytes are summed by prefix; a bucket within the byte limit is
a shard, and only larger ones split on another bit. One pass sums cells of a few bits more than an even
split needs, and their sums give the buckets of all shorter prefixes; cells that are still too large,
which hold some very long document, are split further on their own documents, down to the last bit.

Rows that no bit tells apart (equal doc_id and text) are interchangeable: they are counted, not gathered,
and their copies are dealt to consecutive parts within the limit. A single row above the limit is a shard
of its own, marked oversized.

Cases: a null text has OVERHEAD bytes, like an empty one; null doc_id is hashed by its text; a text above the
limit is a shard of its own however long; repeated rows are dealt to parts, and which of them goes where makes
no difference; other columns are ignored, and may have any name when shards are written; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import id_hash, repeated, written

SHARD_BYTES = 16 << 20
#: Bytes that a row costs besides its text.
OVERHEAD = 16
BITS = 60
#: Bits beyond those of an even split that the first pass sums by.
SPARE = 5


def hash_of(doc_id: Column, text: Column) -> Column:
    return id_hash(doc_id, F.md5(F.coalesce(text, F.lit(""))))


def weighed(docs: DataFrame) -> DataFrame:
    """doc_id, hash and bytes; equal rows as one with their number."""
    h = hash_of(F.col("doc_id"), F.col("text")).alias("h")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("bytes")
    return docs.select("doc_id", h, size).groupBy("h", "doc_id", "bytes").agg(F.count("*").alias("copies"))


def buckets(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell of `high` bits the depth from `low` on at which its bucket fits the limit, if any does."""
    every = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = every.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    found = every.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
    return found.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, bytes, shard (prefix in hexadecimal, its depth, and a part where rows can't be told apart), depth, shard_bytes, oversized."""
    return _assigned(docs, limit).drop("h", "copy")


def _assigned(docs: DataFrame, limit: int) -> DataFrame:
    keys = ("h", "copy")
    rows = written(weighed(docs), "sharding-rows")
    total = rows.agg(F.sum(F.col("bytes") * F.col("copies"))).first()[0] or 0
    high = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE))
    rows = rows.withColumn("cell", F.shiftright("h", BITS - high))
    cells = rows.groupBy("cell").agg(F.sum(F.col("bytes") * F.col("copies")).alias("bytes"))
    leaves = buckets(cells, 0, high, limit)
    placed = written(rows.join(leaves, "cell", "left"), "sharding-first")
    # the documents of cells that are too large at these bits
    deep = placed.filter("leaf is null")
    inner = deep.groupBy("h").agg(F.sum(F.col("bytes") * F.col("copies")).alias("bytes")).withColumnRenamed("h", "cell")
    deeper = buckets(inner, high + 1, BITS, limit).withColumnRenamed("leaf", "deep_leaf").withColumnRenamed("cell", "h")
    deep = deep.join(deeper, "h", "left").withColumn("leaf", F.coalesce("leaf", "deep_leaf")).drop("deep_leaf")
    both = placed.filter("leaf is not null").unionByName(deep)
    # rows that no bit parts: each copy goes to a part of the bucket of all bits
    per_part = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes")))
    copy = repeated(written(both, "sharding-leaves"), "copies", "copy")
    stuck = F.col("leaf").isNull()
    part = F.when(stuck, F.floor(F.col("copy") / per_part)).otherwise(0)
    own = F.least(per_part, F.col("copies") - part * per_part) * F.col("bytes")
    depth = F.coalesce("leaf.depth", F.lit(BITS))
    name: Column = F.concat_ws("-", depth.cast("string"), F.hex(F.coalesce("leaf.prefix", "h")), F.when(stuck, part.cast("string")))
    return copy.select(*keys, "doc_id", "bytes", name.alias("shard"), depth.alias("depth"), F.coalesce("leaf.shard_bytes", own).cast("long").alias("shard_bytes"), (F.coalesce("leaf.shard_bytes", own) > limit).alias("oversized"))


def directory(assigned: DataFrame) -> DataFrame:
    """A row for each shard: its depth, bytes and documents."""
    return assigned.groupBy("shard", "depth").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_docs"))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write the rows of docs as Parquet, a folder for each shard; the shards' directory.

    Equal rows are numbered and each takes the place of its number, so ids may be null or repeated."""
    places = written(_assigned(docs, limit), "sharding-places")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row).withColumn("h", hash_of(F.col("row.doc_id"), F.col("row.text")))
    few = places.groupBy("h").agg(F.count("*").alias("n"), F.min("shard").alias("shard"))
    alone = rows.join(few.filter("n = 1").select("h", "shard"), "h").select("shard", "row")
    several = rows.join(few.filter("n > 1").select("h"), "h", "left_semi")
    # numbered in each task, after the equal rows of the tasks before
    several = written(several.withColumn("task", F.spark_partition_id()), "sharding-equal")
    counts = several.groupBy("h", "task").agg(F.count("*").alias("c"))
    counts = counts.withColumn("before", F.sum("c").over(W.partitionBy("h").orderBy("task")) - F.col("c")).select("h", "task", "before")  # a row for each task
    own = F.row_number().over(W.partitionBy("h", "task").orderBy(F.lit(1))) - 1
    numbered = several.withColumn("own", own).join(counts, ["h", "task"]).select("h", "row", (F.col("before") + F.col("own")).alias("copy"))
    placed = numbered.join(places.select("h", "copy", "shard"), ["h", "copy"]).select("shard", "row")
    out = alone.unionByName(placed)
    names = [c for c in docs.columns]
    folder = "shard" if "shard" not in names else "shard_"
    out.select(F.col("shard").alias(folder), "row").repartition(folder).select(folder, "row.*").write.partitionBy(folder).parquet(path)
    return directory(places)
