"""What the training-data operators share: scratch tables, inputs, driver-side helpers."""

from __future__ import annotations

import gc
import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.sources.scratch import delete, new_path, release, scratch, shared_dir, written  # noqa: F401

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"

#: Rows of an Arrow batch; texts may be long.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the driver runs from a checkout, and keep Arrow batches of whole texts small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    if root not in sys.path:
        sys.path.append(root)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def unique() -> str:
    return uuid.uuid4().hex


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more, which it does when the driver collects garbage; for steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column | str) -> Column:
    """Words of a text as an array, [] for null; native."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE_RE), lambda w: w != "")


def id_hash(*cols: Column | str) -> Column:
    """60 uniform bits from md5 of the columns; the same in any engine that has md5."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("-")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


#: Steps of share_hash.
SHARES = 1 << 62


def share_hash(*cols: Column | str) -> Column:
    """A uniform number below SHARES from the columns, for samples of rows."""
    return F.pmod(F.xxhash64(*cols), F.lit(SHARES).cast("long"))


def remainder_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def packed_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of the columns to keep, whatever their names) and, where it isn't kept, text; for Arrow functions."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    return docs.select(row) if "text" in keep else docs.select(row, F.col("text"))


def texts_of(batch) -> list[str | None]:
    """Texts of an Arrow batch of packed_rows."""
    kept = batch.column(0)
    return (kept.field("text") if kept.type.get_field_index("text") >= 0 else batch.column(1)).to_pylist()


def fitted_in_task(rows: DataFrame, order: list[str], fit) -> object:
    """fit(table) of a bounded table, run in one executor task, so that the driver gets the model alone; None without rows.

    rows: what fit needs, in an order that makes it repeatable."""

    def run(batches):
        import pickle

        import pyarrow as pa

        held = list(batches)
        if held and sum(b.num_rows for b in held):
            model = pickle.dumps(fit(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    if not got:
        return None
    import pickle

    return pickle.loads(got[0]["model"])


def repeated(rows: DataFrame, n: str, index: str, chunk: int = 10_000) -> DataFrame:
    """Each row n times, numbered from 0 in index; rows with large n are dealt out in chunks, so that no task makes all of them."""
    few = rows.filter(F.col(n) <= chunk).withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    many = rows.filter(F.col(n) > chunk)
    if many.isEmpty():
        return few
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(chunk).cast("long")))
    dealt = many.withColumn(index, first)
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = F.least(F.col(index) + chunk, F.col(n).cast("long")) - 1
    return few.unionByName(dealt.withColumn(index, F.explode(F.sequence(F.col(index), last))))


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with sums over all rows before each in an order, by range partitions and one row for each of these."""
    ranged = written(rows.withColumns(sums).repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()), "running")
    inside = W.partitionBy("range_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    heads = ranged.groupBy("range_part").agg(*[F.sum(c).alias(c) for c in sums])
    before = W.orderBy("range_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    heads = heads.select("range_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in sums])
    within = ranged.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(heads), "range_part")
    return within.withColumns({c: F.col(c) + F.col(f"{c}_base") for c in sums}).drop("range_part", *[f"{c}_base" for c in sums])


def sent_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df to be broadcast if it has at most that many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
