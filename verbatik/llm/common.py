"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"
#: Shared folder used only on a local master whose session names none (tests, laptops).
FALLBACK_SHARED = "/tmp/checkpoints/verbatik"
#: Rows of an Arrow batch whose texts are held as Python objects at once.
BLOCK_ROWS = 500
#: Rows after which freed memory is given back.
GIVE_BACK_ROWS = 4_000
#: Seconds without a task after which a Python worker forgets what it remembers from task to task.
IDLE_S = 5
_IDLE: dict = {}


def give_back() -> None:
    """Return freed memory of this process to the system; a reused Python worker would keep it while others work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def blocks(batches, rows: int = BLOCK_ROWS):
    """The batches in slices of at most `rows` rows; freed memory is given back now and then, and after the last one."""
    n = 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
            n += rows
            if n >= GIVE_BACK_ROWS:
                give_back()
                n = 0
    b = None
    give_back()


def in_use(name: str) -> None:
    """A task uses what this worker remembers under that name: it isn't idle."""
    timer = _IDLE.pop(name, None)
    if timer:
        timer.cancel()


def forget_when_idle(name: str, remembered: dict) -> None:
    """Empty `remembered` unless a task uses it again within IDLE_S seconds; a task that holds an entry keeps it."""

    def forget():
        remembered.clear()
        give_back()

    in_use(name)
    _IDLE[name] = timer = threading.Timer(IDLE_S, forget)
    timer.daemon = True
    timer.start()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can read: the session's spark.checkpoint.dir; a cluster has to name one."""
    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or FALLBACK_SHARED)
    return sc.getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives executor loss."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._verbatik_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    spark, path = df.sparkSession, df._verbatik_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def in_files(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in at most as many partitions as rows of it need, for materialize(): on a local disk the executor's JVM forks several times for each file it writes."""
    return df.coalesce(max(2, -(-rows // each)))


def rows_in(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def shards(spark: SparkSession, rows: int, per_shard: int = 100_000) -> int:
    """How many tasks to deal rows over: grows with the data, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_shard))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))
