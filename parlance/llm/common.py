"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where the session has none, a
    temporary folder becomes the checkpoint folder if all runs in one local process, as in tests;
    on a cluster that raises."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/parlance-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and survives
    lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of a stored() frame that nothing reads any more.  Other tables stay until
    the shared folder is cleared, as results are lazy and may read them."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointable(spark: SparkSession) -> None:
    """Makes sure ``checkpoint()`` has a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def modest_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Texts may be long, so Arrow batches of about ``size`` bytes keep Python workers small.  The
    setting is read when a query runs, so it stays with the session; a lower one is left."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
    now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    if now <= 0 or now > size:
        spark.conf.set(name, str(size))


def release_memory() -> None:
    """Gives freed memory of a Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = "__" + name
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most ``most`` rows, else as it is.  Counts it, so hand over
    what is cheap to compute twice, of narrow rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 3 is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
