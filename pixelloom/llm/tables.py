"""Tables kept in the folder that the whole cluster shares, to cut lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a new local folder in a local session, as in tests, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str = "t", block: int = 128 << 20, dictionary: bool = True, codec: str = "zstd") -> DataFrame:
    """df, written to the shared folder (in row groups of about `block` bytes) and read again.

    dictionary: False for columns of mostly distinct values.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.block.size", block).option("parquet.enable.dictionary", dictionary).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a kept table that nothing reads any more."""
    path = getattr(df, "_kept_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles removed that nothing reads any more: Spark does so when its driver collects its garbage.

    The driver's freed memory goes back to the system, too.
    """
    release()
    spark._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Give back what the driver's JVM has freed outside its heap (compiled plans, buffers of codecs): its C library keeps that."""
    gateway, named = spark.sparkContext._gateway, spark._jvm.java.lang.Class.forName

    def array(kind: str, *of):
        out = gateway.new_array(getattr(spark._jvm.java.lang, kind), len(of))
        for k, x in enumerate(of):
            out[k] = x
        return out

    try:
        bean = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = spark._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds = array("Class", *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        # by reflection: the server's own class is not open to callers
        invoke = named("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        invoke.invoke(server, array("Object", bean, "systemTrimNativeHeap", array("Object"), array("String")))
    except Py4JError:  # another C library, or a JVM without that command
        pass


def size_of(df: DataFrame) -> int:
    """Bytes of a kept table's files."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(df._kept_at)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def release() -> None:
    """Give the freed memory of the driver's Python back to the system, as what follows may need it in the JVM."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
