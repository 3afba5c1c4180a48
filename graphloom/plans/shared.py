"""Cutting lineage through the folder that all executors share.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir``.  A lost executor then costs a re-read, not a re-run, and
the columns stay prunable, which ``DataFrame.checkpoint`` would not give.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a temporary folder; on a cluster that is an
    error, as executors would write where no other machine reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Arrow batches that go to Python have at most ``rows`` rows, which bounds their bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def _no_leavings(spark: SparkSession):
    """Within it, the shuffle files of a plan go when it has run, whether or not the driver has collected the plan."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_made: list[list[DataFrame]] = []


@contextlib.contextmanager
def tracked():
    """Within it, every table that ``materialize`` makes is appended to the list that it gives."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    with _no_leavings(spark):  # nothing but this write reads them
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    for made in _made:
        made.append(out)
    return out


def reads(df: DataFrame, tables: list[DataFrame]) -> bool:
    """Whether the plan of ``df`` reads one of ``tables`` that ``materialize`` made; true where that can't be told."""
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        paths = [leaves.apply(i).relation().location().rootPaths().mkString("\n") for i in range(leaves.size())]
    except Exception:  # a leaf that is no table of files
        return True
    return any(t._graphloom_path.rpartition("/")[2] in p for t in tables for p in paths)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so for plans that the driver has collected."""
    gc.collect()
    spark._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let executors hand back the memory that their heaps have grown to: a task on each core has its JVM collect all garbage."""
    n = spark.sparkContext.defaultParallelism
    collected = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collected.alias("done")).write.format("noop").mode("overwrite").save()


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for df in tables:
        _delete(df)


def _delete(df: DataFrame | None) -> None:
    path = getattr(df, "_graphloom_path", None)
    if path is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    with contextlib.suppress(Exception):  # a folder that stays costs disk only
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
