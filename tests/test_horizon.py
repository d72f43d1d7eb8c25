"""Verdicts on published windows: small cases, batch against a plain loop, and the stream against the batch."""

import datetime
import random

from pyspark.sql import functions as F

from quayside.streaming import horizon

SCHEMA = "service long, kind string, ts timestamp, until timestamp"
T0 = datetime.datetime(2026, 9, 8)
at = lambda m: None if m is None else T0 + datetime.timedelta(minutes=m)


def frame(spark, rows):
    return spark.createDataFrame([(s, k, at(t), at(u)) for s, k, t, u in rows], SCHEMA)


def got(df):
    return sorted((r.service, (r.start - T0).total_seconds() / 60, (r.until - T0).total_seconds() / 60, r.n_seen, r.verdict) for r in df.collect())


def plain(rows, late):
    now = max((t for s, k, t, u in rows if None not in (s, t) and (k == "seen" or k == "publish" and u is not None and u >= t)), default=0)
    out = []
    for s, a, b in {(s, t, u) for s, k, t, u in rows if k == "publish" and None not in (s, t, u) and u >= t}:
        n = len({t for s2, k, t, _ in rows if k == "seen" and s2 == s and t is not None and a <= t <= b})
        out.append((s, a, b, n, "open" if b >= now - late else "present" if n else "absent"))
    return sorted(out)


def world(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        t, s = rng.randint(0, 4000), rng.choice([1, 1, 1, 2, 3, 4])
        rows.append((s, "publish", t, t + rng.choice([0, 30, 90, 2000])) if rng.random() < 0.4 else (s, "seen", t, None))
    return rows + rows[:50]


def test_windows_close_only_once_they_have_passed(spark):
    rows = [(1, "publish", 0, 60), (1, "publish", 0, 60), (1, "seen", 60, None), (1, "seen", 60, None), (2, "publish", 0, 60), (2, "seen", 61, None), (3, "publish", 0, 290), (4, "publish", 10, 5), (4, "publish", 10, None), (None, "publish", 0, 10), (5, "seen", None, None), (5, "other", 9000, None), (6, "seen", 300, None)]
    want = [(1, 0, 60, 1, "present"), (2, 0, 60, 0, "absent"), (3, 0, 290, 0, "open")]
    assert got(horizon.verdicts(frame(spark, rows), 600)) == want == plain(rows, 10)
    assert horizon.verdicts(frame(spark, []), 600).count() == 0


def test_counts_over_days_equal_a_plain_loop(spark):
    for seed in (1, 2):
        rows = world(seed)
        assert got(horizon.verdicts(frame(spark, rows), 3600)) == plain(rows, 60)


def test_stream_closes_what_the_batch_closes(spark, tmp_path):
    rows = sorted(world(3, 250), key=lambda r: r[2])
    rng = random.Random(9)
    # late by less than the delay, and repeated
    rows = sorted(rows, key=lambda r: r[2] + rng.randint(0, 50)) + [(9, "seen", 6000, None)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    step = len(rows) // 4 + 1
    for k in range(0, len(rows), step):
        frame(spark, rows[k : k + step]).coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", horizon.ROCKS)
    try:
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = horizon.stream(events, "60 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        assert q.awaitTermination(240) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    closed = horizon.verdicts(frame(spark, rows), 3600).filter(F.col("verdict") != "open")
    assert got(spark.read.schema(horizon.RESULT).parquet(out)) == got(closed) and closed.count() > 20
