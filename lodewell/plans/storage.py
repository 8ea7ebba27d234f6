"""Where intermediate tables live, and how input tables are opened."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce
from math import ceil

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python. Documents can be long, so a batch is kept to a few MB.
ARROW_ROWS = "512"
#: Seconds between two collections of the driver's garbage.
TIDY_SECONDS = 20.0
#: Rows of a task that holds all of its rows in memory.
TASK_ROWS = 250_000
_tidied = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by the path that Spark itself opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodewell-checkpoint-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{scratch_root(spark)}/lodewell-{uuid.uuid4().hex}/{name}"
    atexit.register(remove_path, spark, path.rpartition("/")[0])
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, if the session still lives."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or jsc is None:
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Unlike localCheckpoint the files outlive any executor, and unlike checkpoint() they are columnar.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodewell_path = path
    tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Let go of what finished jobs leave behind, once in TIDY_SECONDS at most.

    Shuffle files and broadcasts are removed when the driver collects the objects of their jobs, which a
    quiet driver does late; its native heap is handed back where the JVM offers that.
    """
    global _tidied
    if time.monotonic() - _tidied < TIDY_SECONDS:
        return
    _tidied = time.monotonic()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(server, args)
    except Py4JError:  # not a JVM with that command
        return


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    remove_path(df.sparkSession, df._lodewell_path.rpartition("/")[0])


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch for operators that send whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt over all tasks by a key, before work that is large for their bytes: a column file of a few MB is one split, so one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *key)


def dealt(rows: DataFrame, total: int, *key: str) -> DataFrame:
    """rows, `total` at most, dealt by a key over as many tasks as give TASK_ROWS to each.

    AQE would put short rows together by their compressed bytes, of which a task's memory is many times as much.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, ceil(total / TASK_ROWS)), *key)


def in_blocks(rows: DataFrame, key: str, most: int, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f over rows, which f broadcasts: in one go up to `most` rows, beyond that in hash blocks of about `most`, united."""
    blocks = ceil(rows.count() / most) or 1
    if blocks == 1:
        return f(rows)
    of = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [f(rows.where(of == i)) for i in range(blocks)])
