"""Written graphs and documents, read back."""

import glob
import gzip
import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from quayside.sources import scratch, sinks

CALLS = "day string, trip_id long, idx int, station string, arr int, dep int"


def test_graph_replaces_its_days_only(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    sinks.write_graph(spark.createDataFrame([("2026-07-14", 1, 1, "a", 1, 1), ("2026-07-15", 1, 1, "a", 1, 1)], CALLS), path)
    sinks.write_graph(spark.createDataFrame([("2026-07-15", 2, 1, "b", 2, 1500)], CALLS), path)
    assert {(r.day, r.trip_id, r.dep) for r in sinks.read_graph(spark, path).collect()} == {("2026-07-14", 1, 1), ("2026-07-15", 2, 1500)}


def test_graph_without_days_is_legacy(spark, tmp_path):
    path = f"file://{tmp_path}/old"
    spark.range(2).write.parquet(path)
    assert {r.day for r in sinks.read_graph(spark, path).collect()} == {"legacy"}


def test_documents_plain_packed_and_without_stale_ones(spark, tmp_path):
    path = f"file://{tmp_path}/reach"
    rows = spark.createDataFrame([("A", "C", 90, None), ("A", "B", 50, "IC"), ("Z", "A", 10, None)], "origin string, id string, duration int, train string")
    sinks.write_documents(sinks.reach_documents(rows, "now", "2026-07-14"), path)
    sinks.write_documents(sinks.reach_documents(rows.filter("origin = 'A'"), "now", "2026-07-14"), path)
    plain = glob.glob(f"{tmp_path}/reach/plain/origin=*/*.txt")
    packed = glob.glob(f"{tmp_path}/reach/gzip/origin=*/*.gz")
    assert len(plain) == len(packed) == 1 and "origin=A" in plain[0]
    text = open(plain[0]).read()
    assert json.loads(text) == {"origin": "A", "computed_at": "now", "sample_date": "2026-07-14", "destinations": [{"id": "B", "duration": 50, "train": "IC"}, {"id": "C", "duration": 90}]}
    assert gzip.open(packed[0], "rt").read() == text


def test_histograms_of_zeros_are_left_out(spark):
    df = spark.createDataFrame([({"1": {"d": [0, 2]}, "2": {"d": [0, 0]}},), ({"1": {"d": [0, 0]}},), (None,)], "h map<string, map<string, array<int>>>")
    assert [r.h for r in df.select(sinks.nonzero(F.col("h")).alias("h")).collect()] == [{"1": {"d": [0, 2]}}, None, None]


def test_small_table(spark, tmp_path):
    sinks.write_small(spark.range(3), f"file://{tmp_path}/s")
    assert len(glob.glob(f"{tmp_path}/s/plain/*.json")) == len(glob.glob(f"{tmp_path}/s/gzip/*.json.gz")) == 1


def test_intermediate_tables_are_released(spark):
    held = scratch._written.pop(spark.sparkContext.applicationId, [])
    folder = scratch.shared_dir(spark).removeprefix("file:").replace("//", "/")
    assert scratch.written(spark.range(3), "t").count() == 3 and glob.glob(f"{folder}/quayside-t/*")
    scratch.release(spark)
    assert not glob.glob(f"{folder}/quayside-t/*")
    scratch._written[spark.sparkContext.applicationId] = held


def test_sessions_without_presets_have_a_folder(tmp_path):
    """A plain session, whose configuration folder is empty, keeps one folder; what stands on written tables runs in it."""
    code = """
from pyspark.sql import SparkSession
from quayside.plans import registry
from quayside.sources import scratch
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert scratch.shared_dir(spark) == scratch.shared_dir(spark)
assert registry.reach_journeys(spark, "/root/testdata/sf0.001").count() > 0
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
