"""How long staged folders live, and where they are."""

import gc
import os
import threading
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyframe import session as module
from tallyframe.session import drop_unused, release_staged, shared_folder, stage, stage_bucketed, staging


def folders():
    return {p for p in module._staged if os.path.exists(p.removeprefix("file:"))}


def settled(n):
    """Remaining folders, after the JVM had time to notice what is unused."""
    for _ in range(20):
        if drop_unused(collect=True) <= n:
            break
        time.sleep(0.2)
    return len(folders())


def test_folders_live_as_long_as_frames_that_read_them(spark):
    base = settled(0)
    held = stage(spark.range(100).withColumn("k", F.col("id") % 7))
    derived = held.groupBy("k").count().join(spark.range(7).withColumnRenamed("id", "k"), "k")
    del held
    assert settled(base) == base + 1 and derived.count() == 7
    twice = stage(derived).union(stage(derived)).select("k")
    del derived
    assert settled(base + 2) == base + 2 and twice.count() == 14
    twice.write.format("noop").mode("overwrite").save()
    del twice
    assert settled(base) == base


def test_staging_deletes_what_earlier_steps_left(spark):
    base = settled(0)
    for _ in range(30):
        frame = stage(spark.range(10))
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)
    # the last few may still be known to the JVM
    assert len(folders()) < base + 15 and frame.count() == 10
    del frame
    assert settled(base) == base


def test_release_and_blocks(spark):
    base = settled(0)
    with staging():
        frame = stage(spark.range(5))
        assert len(folders()) == base + 1 and frame.count() == 5
    assert len(folders()) == base
    other = stage(spark.range(5))
    release_staged(other)
    assert len(folders()) == base


def _session(master, **conf):
    """What ``shared_folder`` asks a session for."""
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
                           sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_a_cluster_must_name_its_folder(spark):
    for master in ("spark://somewhere:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(_session(master, **{"spark.sql.warehouse.dir": "/w"}))
        assert shared_folder(_session(master, **{"spark.checkpoint.dir": "/shared/place/"})) == "/shared/place"
    for master in ("local", "local[8]", "local[*]"):
        assert shared_folder(_session(master, **{"spark.sql.warehouse.dir": "/w/"})) == "/w/_staged"
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")


def test_threads_leave_the_session_as_it_was(spark):
    before = spark.conf.get(module._DROP_SHUFFLES, "false")
    frames = []
    threads = [threading.Thread(target=lambda i=i: frames.append(stage(spark.range(100 * i + 1).repartition(3)))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(f.count() for f in frames) == [100 * i + 1 for i in range(6)]
    assert spark.conf.get(module._DROP_SHUFFLES) == before and not module._writing


def test_buckets_are_joined_where_they_are(spark):
    base = settled(0)
    wide = stage_bucketed(spark.range(2000).selectExpr("id % 100 as k", "id as v"), "k", 7)
    other = spark.range(100).selectExpr("id as of", "id * 2 as w").hint("shuffle_hash")
    joined = wide.join(other, F.col("k") == F.col("of"))
    assert joined.count() == 2000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # one exchange, of the other side
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and len(folders()) == base + 1
    release_staged(wide)
    assert len(folders()) == base and not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed")]


def test_buckets_go_with_the_frames_that_read_them(spark):
    base = settled(0)
    wide = stage_bucketed(spark.range(200).selectExpr("id % 10 as k", "id as v"), "k", 3)
    derived = wide.groupBy("k").agg(F.sum("v").alias("v"))
    del wide
    assert settled(base) == base + 1 and derived.count() == 10
    del derived
    assert settled(base) == base and not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed")]
