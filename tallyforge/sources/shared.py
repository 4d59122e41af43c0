"""Files in the folder that driver and executors share: checkpoints and written tables, and their removal.

What an operator writes there is read as long as results that need it aren't
written, so that only its caller knows when it may go. Inside `with
scope(spark):` every folder written by that thread is removed at the end; so
results must be written, or collected, inside. Without a scope folders stay
until the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folders of the innermost scope of this thread.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
#: Folders that no scope owns, with the session that can remove them.
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir() or made


def _own(spark: SparkSession, folder: str) -> None:
    mine = _scope.get()
    if mine is None:
        _left[folder] = spark
    else:
        mine.append(folder)


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Frames that are made inside delete the files of their shuffles when they have run, not when the driver's memory is next swept."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint(df: DataFrame, free: bool = False) -> DataFrame:
    """df, computed once and kept in the shared folder; with free, the shuffles that made it are deleted."""
    shared_dir(df.sparkSession)
    with _freed(df.sparkSession) if free else nullcontext():
        out = (df.select("*") if free else df).checkpoint(eager=True)
    folder = _folder(out)
    if folder:
        _own(df.sparkSession, folder)
    return out


def _folder(df: DataFrame) -> str | None:
    """Where a frame that checkpoint() gave is kept."""
    plan = df._jdf.queryExecution().analyzed()
    found = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    return found.get() if found is not None and found.isDefined() else None


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _own(spark, folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder, of which later reads take only the columns that they need; the shuffles that made it are deleted."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    with _freed(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders, which no scope owns any longer."""
    mine = _scope.get()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _left.pop(folder, None)
        if mine is not None and folder in mine:
            mine.remove(folder)


def drop(df: DataFrame) -> None:
    """Deletes what checkpoint() kept of df, which nothing reads any longer: in loops, the round before the last."""
    folder = _folder(df)
    if folder:
        remove(df.sparkSession, [folder])


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Owns the folders that this thread writes inside, and removes them at its end, whatever else the session runs."""
    mine: list[str] = []
    before = _scope.set(mine)
    try:
        yield mine
    finally:
        remove(spark, list(mine))
        _scope.reset(before)


@atexit.register
def _sweep() -> None:
    for folder, spark in list(_left.items()):
        try:
            remove(spark, [folder])
        except Exception:  # the JVM has ended before
            return
