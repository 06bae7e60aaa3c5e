"""Session helpers: a local session for tests, and the shared work folder of a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "tillwatch", memory: str = "12g") -> SparkSession:
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # The JVM does not compile methods beyond 8,000 bytes; wide projections then run faster as
        # separate operators than in one generated method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Without call-site capture a plan of a few thousand column calls is built in half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHARED: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where a cluster names none it is a folder below the warehouse, which Spark shares for its own tables; a
    bare local session gets a temporary folder. A folder on a cluster's local disks must show the driver what
    tasks write there, else it is refused; ``spark.tillwatch.sharedLocalFolder`` says that this is known.
    """
    context = spark.sparkContext
    cluster = not context.master.startswith("local") or context.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and cluster:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tillwatch-shared"
    elif named is None:
        named = tempfile.mkdtemp(prefix="tillwatch-")
        context.setCheckpointDir(named)
    asked = (context.applicationId, named)
    if cluster and asked not in _SHARED and spark.conf.get("spark.tillwatch.sharedLocalFolder", "false") != "true":
        if file_system(spark, named)[1].getScheme() == "file":
            rows = context.defaultParallelism
            if rows_seen(spark, named, rows) != rows:
                raise RuntimeError(f"{named} is a local folder; executors on other machines cannot see it")
        _SHARED.add(asked)
    return named


def rows_seen(spark: SparkSession, folder: str, rows: int) -> int:
    """How many of ``rows`` rows, each written by a task of its own, are there when the folder is read again."""
    path = f"{folder.rstrip('/')}/tillwatch/probe-{uuid.uuid4().hex}"
    try:
        spark.range(0, rows, 1, rows).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count()
    finally:
        remove_path(spark, path)


def file_system(spark: SparkSession, path: str):
    """A path and its file system, as the cluster's file layer sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


_WORKSPACE: ContextVar[str | None] = ContextVar("workspace", default=None)


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder, inside the current workspace if there is one."""
    folder = _WORKSPACE.get() or f"{shared_dir(spark).rstrip('/')}/tillwatch"
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """The owner of all that is stored within the block: it goes at the block's end.

    Lazy results read what was stored for them, so they must be written or collected inside::

        with workspace(spark):
            near_duplicates(docs).write.parquet(target)
    """
    folder = f"{work_path(spark, 'work')}"
    token = _WORKSPACE.set(folder)
    try:
        yield folder
    finally:
        _WORKSPACE.reset(token)
        remove_path(spark, folder)


def path_exists(spark: SparkSession, path: str) -> bool:
    where, system = file_system(spark, path)
    return system.exists(where)


def remove_path(spark: SparkSession, path: str) -> None:
    where, system = file_system(spark, path)
    system.delete(where, True)


def copy_path(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder; the bytes stream through the caller, file by file."""
    (source, of), (target, to) = file_system(spark, source), file_system(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(of, source, to, target, False, spark._jsc.hadoopConfiguration())


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Spark's own file server hands the zipped package to the executors, once per application, so the
    session need not have been started with ``--py-files``."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tillwatch-code-"), "tillwatch.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
    _SENT.add(context.applicationId)


_HUGE = "spark.sql.codegen.hugeMethodLimit"


def compile_wide(spark: SparkSession) -> None:
    """Let projections that the JVM would not compile (methods beyond 8,000 bytes) run as operators of their own, unless
    the session has a limit that is not Spark's default."""
    if spark.conf.get(_HUGE) == "65535":
        spark.conf.set(_HUGE, "8000")


class Stored:
    """A frame written as parquet below the shared folder and read back.

    Later plans start from the stored columns, with pruning and statistics, and the files outlive lost
    executors. ``drop`` removes them; used in a ``with`` block, the files go at its end.
    """

    def __init__(self, df: DataFrame, purpose: str):
        self.spark = df.sparkSession
        self.path = work_path(self.spark, purpose)
        df.write.parquet(self.path)
        self.frame = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove_path(self.spark, self.path)

    def __enter__(self) -> DataFrame:
        return self.frame

    def __exit__(self, *_) -> None:
        self.drop()


def store(df: DataFrame, purpose: str) -> DataFrame:
    """The same for a frame whose lazy result is handed on: the job's owner clears the folder."""
    return Stored(df, purpose).frame
