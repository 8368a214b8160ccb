"""Session settings the plans are written for, and the lineage cut between stages."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows gathered by person stay put when joined on person and a further key
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "storkline", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: file system and path of each stage, and the stages that a catalog names
_written: list[tuple] = []
_named: list[tuple[SparkSession, str]] = []


def _stage_folder(spark: SparkSession) -> str:
    """The shared folder for stages: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Only a local session, where driver and executors are one process, may go without; its stages
    go below the warehouse folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"
    return folder.rstrip("/")


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what lies there goes when the driver ends."""
    path = f"{_stage_folder(spark)}/storkline/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((place.getFileSystem(spark._jsc.hadoopConfiguration()), place))
    return path


def let_go(spark: SparkSession) -> str | None:
    """Give native memory that the driver's JVM has freed, as its compilers do, back to the system, as
    `jcmd System.trim_native_heap` does; else it stays with a driver that plans many stages. Returns the JVM's
    answer; one that knows no such command is left alone."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go as soon as it has ended; a stage that is written needs them no more."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def small_batches(spark: SparkSession, size: str = "2m") -> Iterator[None]:
    """Within, Spark hands a Python worker no more bytes at once, unless a row alone has more; a task holds them in the JVM
    and in the worker."""
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


@contextmanager
def small_tasks(spark: SparkSession, size: int = 16 << 20) -> Iterator[None]:
    """Within, adaptive execution puts partitions of a shuffle together up to this size only, so that tasks that hold their
    rows in a hash table as well as sorted need not spill."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    with _set(spark, key, str(min(now, size))):
        yield


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write a stage as a Parquet table to the shared checkpoint folder and go on from there.

    Readers of the stage get column pruning, pushed filters and a known size, and a lost
    executor costs a re-read, not a recomputation. The shuffle files go at once, not when the driver
    happens to collect its garbage. ``options`` are those of the Parquet writer.
    """
    path = stage_path(df.sparkSession)
    with shuffles_let_go(df.sparkSession):
        df.write.options(**options).parquet(path)
    let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like `cut`, with the rows of a key in one of so many buckets: joins and groupings by the key read
    the stage where it lies, without a shuffle. Compressed by zstd, as such a stage is read often."""
    spark, name = df.sparkSession, f"storkline_{uuid.uuid4().hex}"
    stage = df.write.format("parquet").option("path", stage_path(spark)).option("compression", "zstd")
    with shuffles_let_go(spark):
        stage.bucketBy(buckets, key).saveAsTable(name)
    let_go(spark)
    _named.append((spark, name))
    return spark.table(name)


@atexit.register
def remove_stages() -> None:
    """Remove the stages written so far, of stopped sessions too; frames that read them are void then."""
    while _named:
        spark, name = _named.pop()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _written:
        files, place = _written.pop()
        try:
            files.delete(place, True)
        except (ConnectionError, Py4JError):  # the driver's JVM has ended before this process
            return
