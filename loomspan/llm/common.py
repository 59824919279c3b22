"""Shared helpers of the corpus operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_USED: set[tuple[str, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a local folder; on a cluster there is no folder that all could read, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "loomspan-checkpoints")
    return folder.rstrip("/")


def aside(docs: DataFrame, *seen: str) -> tuple[DataFrame, Callable[[DataFrame, tuple[str, ...]], DataFrame]]:
    """(the table with only ``seen`` under their names, a function that gives all others theirs back).

    Whatever an operator names its columns inside, it then meets none of the table's own.  The function takes the result and
    the names that the operator adds; own columns of these names give way, in the place of the added ones.
    """
    others = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c not in seen}
    renamed = docs.select(*[F.col(f"`{c}`").alias(others.get(c, c)) for c in docs.columns])

    def back(result: DataFrame, added: tuple[str, ...] = ()) -> DataFrame:
        there = set(result.columns)
        own = [F.col(f"`{others.get(c, c)}`").alias(c) for c in docs.columns if c not in added and others.get(c, c) in there]
        return result.select(*own, *[F.col(f"`{c}`") for c in added])

    return renamed, back


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    All tables of an application are in one folder there, which is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/loomspan-{spark.sparkContext.applicationId}"
    if not _USED:
        atexit.register(_clean, spark)
    _USED.add((spark.sparkContext.applicationId, home))
    path = f"{home}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    tidy(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect once its heap is over half of what it may become, and give back freed native memory.

    A heap that grows by garbage isn't given back by itself, and the plans of former steps hold their broadcasts and
    shuffle files until it is collected; operators of many steps would fill the driver with both.  Beside the heap, the
    C library keeps what the JVM's compilers and network buffers have freed, a fifth of the driver's memory.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        gc.collect()
        spark._jvm.java.lang.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> bool:
    """Have the driver's JVM return freed native memory to the system; False where it has no such command."""
    try:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        of = jvm.java.lang.Class.forName
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is not open to reflection
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)
    except (Py4JError, AttributeError, TypeError):  # another JVM, or another C library
        return False
    return True


def _clean(spark: SparkSession) -> None:
    """Delete what this driver wrote; the JVM may be gone already, then the folder's owner has to."""
    try:
        jvm = spark._jvm
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for _, home in _USED:
            path = jvm.org.apache.hadoop.fs.Path(home)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 (the process ends; nothing depends on it)
        return
