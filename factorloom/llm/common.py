"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens

#: A word is a run of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Spark's setting that ends shuffle files with the execution that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="factorloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session, which is one machine,
    has a folder of its own; any other is told to set it."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, when the session is built")
        base = _own_dir(context.applicationId)
    return f"{base.rstrip('/')}/factorloom-{context.applicationId}"


_staged: list[tuple[str, str]] = []
_scopes = ["query"]


@contextlib.contextmanager
def scope(name: str):
    """Tables staged inside belong to `name`, for release()."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((_scopes[-1], path))
    return path


def crowded(free: int, total: int, most: int) -> bool:
    """Whether a third of what a heap may take is in use, or half of it is taken from the machine."""
    return total - free > most // 3 or total > most // 2


def give_back(spark: SparkSession) -> str:
    """Gives the driver's free memory to the machine, and tells what its JVM gave ('' for one that can't).

    Each of the JVM's many threads has its own heap in the C library, which keeps what they free.
    """
    tokens.trim()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        # The server's own class isn't open to calls from outside its module, so its interface is asked.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except (Py4JError, PySparkException):
        return ""


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut of the lineage that outlives executors.

    Spark is told to remove the shuffle files of the write when it ends, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    # Plans, broadcasts and shuffles that nothing needs any more are held until the driver collects its garbage; a heap that has
    # grown stays so until then, even where little of it is in use.
    heap = spark.sparkContext._jvm.Runtime.getRuntime()
    if crowded(heap.freeMemory(), heap.totalMemory(), heap.maxMemory()):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, name: str | None = None) -> None:
    """Removes the staged tables of a scope, or all of this driver's; nothing may need them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for x in [x for x in _staged if name in (None, x[0])]:
        path = jvm.org.apache.hadoop.fs.Path(x[1])
        path.getFileSystem(conf).delete(path, True)
        _staged.remove(x)


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _staged:
        try:
            release(spark)
        except Exception as e:  # the JVM may have gone first; its folder is the cluster's to clean
            print(f"staged tables were left in place: {type(e).__name__}")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def running_total(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all earlier rows of the group, in order of (bucket, order).

    Two levels, so that no task sees a whole group: sums per (group, bucket), a prefix over the few buckets of a
    group, and a running sum inside each bucket. `bucket` must follow the order; no column may be null but those
    of `group`.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    pre = sums.select(*[F.col(k).alias(f"__p_{k}") for k in keys], F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__p_{k}"))
    return local.join(pre, cond).withColumn(out, (F.col("__local") + F.col("__before")).cast("long")).drop("__local", "__before", *[f"__p_{k}" for k in keys])


def hash_order(*cols: Column) -> Column:
    """A non-negative 63-bit hash to shuffle rows by."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
