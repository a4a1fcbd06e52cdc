"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keep a normal daily series (about 5,500 rows in 22 years) in memory while
    # its windows are evaluated, rather than moving it to the spillable sorter.
    "spark.sql.windowExec.buffer.in.memory.threshold": "16384",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", settings: dict | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]")
               .appName("factorloom")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a fresh temporary folder; on a
    cluster every executor has to reach the folder, so it must be configured.  A path
    that names the file system itself (``file:`` for a mounted share) is taken
    at its word.  The executors of ``local-cluster`` are processes of the driver's
    machine, on whose disk they all find a plain path.  On other clusters a plain path
    may be a mount that all machines have or a place on the disk of each; that is
    tried, and the latter is refused.
    """
    context = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    local = context.master.startswith("local[") or context.master == "local"
    one_machine = local or context.master.startswith("local-cluster[")
    if folder and (one_machine or not _on_own_disk(context, folder) or _seen_by_all(spark, folder)):
        return folder
    if folder:
        raise RuntimeError(f"{folder} is on the disk of each machine; name a shared file system")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="factorloom-")
    context.setCheckpointDir(folder)
    return folder


def _on_own_disk(context, folder: str) -> bool:
    """A path without a scheme, where that means the local disk."""
    if "://" in folder or folder.startswith("file:"):
        return False
    return context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


#: By session and folder: the machines that executors were on when it was tried, and how that ended.
_TRIED: dict[tuple[str, str], tuple[frozenset, bool]] = {}


def _seen_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether the driver and all executors see what each executor writes to ``folder``.

    Tried once in a session, and again when there are executors on further machines.
    """
    try:
        context = spark.sparkContext
        hosts = frozenset(x.host() for x in context._jsc.sc().statusTracker().getExecutorInfos())
        known, seen = _TRIED.get((context.applicationId, folder), (None, False))
        if known is None or not hosts <= known:
            seen = _written_and_read(spark, f"{folder.rstrip('/')}/seen-{uuid.uuid4().hex}")
            _TRIED[context.applicationId, folder] = hosts, seen
        return seen
    except Exception:  # nothing could be tried: not known to be shared
        return False


def _written_and_read(spark: SparkSession, path: str) -> bool:
    """Two tasks for each core write a row each; whether all rows are found again."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == tasks
    except Exception:  # not to be written, or read, by some machine
        return False
    finally:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_WRITTEN: list[str] = []
_HELD: list[DataFrame] = []


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several jobs read one expensive result.  The table survives the
    loss of executors, prunes columns for each reader, and carries a real size,
    so that the planner broadcasts it only when it is small.  On a cluster without
    a shared folder the rows stay on the disks of the executors.  ``drop_tables``
    removes what a session has written.
    """
    spark = df.sparkSession
    try:
        folder = shared_folder(spark)
    except RuntimeError:
        return _held(df)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _held(df: DataFrame) -> DataFrame:
    """``df`` as computed now, its rows persisted on the executors' disks.

    Like a table, the result has a plan that begins with these rows, and their real size.
    Rows that are lost with an executor are computed again.
    """
    spark, frame = df.sparkSession, df._jdf
    rows = spark._jsparkSession.internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False)
    held = DataFrame(rows, spark).persist(StorageLevel.DISK_ONLY)
    held.count()
    _HELD.append(held)
    return held


def drop_tables(spark: SparkSession) -> int:
    """Remove the tables that ``materialize`` has written in this process; how many there were.

    For the end of a run: frames that read them cannot be used afterwards.
    """
    removed = 0
    while _WRITTEN:
        removed += bool(_delete(spark, _WRITTEN.pop()))
    while _HELD:
        _HELD.pop().unpersist()
        removed += 1
    return removed
