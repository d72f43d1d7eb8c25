"""Intermediate tables in the folder that all executors share, so that rounds don't recompute each other."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables and, where the session names none, the chosen folder, by application.
_written: dict[str, list[str]] = {}
_chosen: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; a temporary one where none is set and the master is local (tests).

    The chosen folder is kept here, since a running session doesn't take a value for spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _chosen.get(app) or _chosen.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quayside-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quayside-{label}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """While tables are written inside, rows that lie by some of the keys of a join are joined where they lie, and what is
    exchanged for a table is deleted once it is written."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bucketed(df: DataFrame, label: str, by: str, n: int) -> DataFrame:
    """df, written in n buckets by a column and read back as it lies: joins and groups by that column, alone or among others, need no exchange.

    A frame that isn't dealt out by that column already is dealt out by the caller, so that a bucket is one file."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = "quayside_" + path.rsplit("/", 1)[1]
    df.write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(name)
    return spark.table(name)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables; frames that read them can't be used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS quayside_{path.rsplit('/', 1)[1]}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    delete(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A list that holds, at the end, the intermediate tables written inside."""
    before, paths = set(_written.get(spark.sparkContext.applicationId, [])), []
    yield paths
    paths += [p for p in _written.get(spark.sparkContext.applicationId, []) if p not in before]
