"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import gc
import os
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: shuffle files of a finished SQL execution are removed at its end.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Staged folders that still exist: the session that can delete them, and once written a weak reference to what every
#: plan that reads the folder has in common.
_staged: dict[str, tuple[SparkSession, JavaObject | None]] = {}
#: Sessions whose switch is on: writes under way, and its value before the first of them.
_writing: dict[int, tuple[int, str]] = {}
_lock = threading.Lock()


def local_session(app: str = "tallyframe", cpus: str | int | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench. A cluster brings its own session and settings."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, else the session's checkpoint folder. A session
    whose executors are all in the driver's process may go without and has a folder in its warehouse; for a cluster
    that names none this is an error, never a folder of one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse or not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{warehouse.rstrip('/')}/_staged"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``release_staged`` deletes whatever is written there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _lock:
        if not _staged:
            atexit.register(_release_all)
        _staged[path] = (spark, None)
    return path


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when these have ended. The switch belongs to the session, so it stays on
    until the last of several threads has left."""
    with _lock:
        under_way, before = _writing.get(id(spark), (0, spark.conf.get(_DROP_SHUFFLES, "false")))
        _writing[id(spark)] = (under_way + 1, before)
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            under_way, before = _writing.pop(id(spark))
            if under_way > 1:
                _writing[id(spark)] = (under_way - 1, before)
            else:
                spark.conf.set(_DROP_SHUFFLES, before)


def stage(df: DataFrame) -> DataFrame:
    """Hold ``df`` for several passes over it.

    The rows are written to the shared folder as Parquet and read back: lineage ends, a lost executor costs a
    re-read and not a recomputation, and every pass reads only the columns it uses. Shuffle files of the
    write are removed when it has ended. The folder belongs to the frames that read it, the returned one and all
    derived from it: once none of them is left (and the JVM has noticed, which may take a while) the next ``stage``
    or :func:`drop_unused` deletes it, as Spark's own cleaner does with shuffles and checkpoints. ``release_staged``,
    the end of a ``staging`` block and the end of the program delete it at once.
    """
    spark = df.sparkSession
    drop_unused()
    path = scratch_path(spark, "staged")
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    return belonging(path, spark.read.schema(df.schema).parquet(path))


def belonging(path: str, df: DataFrame) -> DataFrame:
    """``df``, which reads the folder at ``path`` (from :func:`scratch_path`): the folder lives as long as frames that
    read it through the same reader."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        # the file listing of the relation is shared by every plan that is built on it
        files = leaves.apply(i).relation().location()
        if path.rsplit("/", 1)[1] in files.rootPaths().mkString(","):
            with _lock:
                if path in _staged:
                    _staged[path] = (spark, spark._jvm.java.lang.ref.WeakReference(files))
            break
    return df


def stage_bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """As :func:`stage`, dealt into ``buckets`` by the column ``by``, so that later joins and groupings by it read each
    bucket where it is and shuffle the other side alone. It is a table of the session's catalog; it goes with the frames
    that read it, too."""
    spark = df.sparkSession
    # dealt out in a write of its own, whose shuffle files go when it has ended; the table is then written without any
    dealt = stage(df.repartition(buckets, by))
    path = scratch_path(spark, "bucketed")
    dealt.write.bucketBy(buckets, by).option("path", path).saveAsTable(_table_of(path))
    release_staged(dealt)
    table = belonging(path, spark.table(_table_of(path)))
    # the catalog remembers how it read the table, which would keep the folder
    spark.catalog.refreshTable(_table_of(path))
    return table


def _table_of(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def drop_unused(collect: bool = False) -> int:
    """Delete staged folders that no frame reads any more, and say how many remain. ``collect`` has Python and the JVM
    look for unused objects first."""
    if collect:
        gc.collect()
        for spark in {id(s): s for s, _ in _staged.values()}.values():
            spark._jvm.System.gc()
    with _lock:
        unused = [path for path, (_, files) in _staged.items() if files is not None and files.get() is None]
    _delete(unused)
    return len(_staged)


def release_staged(df: DataFrame | None = None, keep: frozenset[str] = frozenset()) -> None:
    """Delete staged folders: those ``df`` reads directly, or all but ``keep``."""
    if df is not None:
        files = df.inputFiles()
        _delete([p for p in list(_staged) if any(p.rsplit("/", 1)[1] in f for f in files)])
    else:
        _delete([p for p in list(_staged) if p not in keep])


def _delete(paths: list[str]) -> None:
    for path in paths:
        with _lock:
            spark, _ = _staged.pop(path, (None, None))
        if spark is not None:
            if path.rsplit("/", 1)[1].startswith("bucketed-"):
                spark.sql(f"drop table if exists {_table_of(path)}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def staging() -> Iterator[None]:
    """Delete at its end whatever was staged inside the block. Results are to be written or fetched in it."""
    before = frozenset(_staged)
    try:
        yield
    finally:
        release_staged(keep=before)


def _release_all() -> None:
    try:
        release_staged()
    except Exception:  # the session may have ended before the program does
        _staged.clear()
