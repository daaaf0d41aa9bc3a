"""Shared folders, cut lineage and worker set-up for the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for local sessions that name none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    prepare(spark)
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


_holder: list = [None, None]


def tidy() -> None:
    """Give memory that this process has freed back to the machine; workers live on after their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def claim(operator: str, release=None) -> None:
    """A worker process keeps the caches of one operator at a time: another one's are released."""
    if _holder[0] != operator:
        if _holder[1]:
            _holder[1]()
        tidy()
        _holder[:] = [operator, release]


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors cost no recomputation of what is above.

    The files go when the driver's JVM ends, if :func:`discard` has not taken them away before.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, into: str = "rank") -> DataFrame:
    """A dense rank from 0 over the whole table, in an order that ties do not fix, without one task for all rows.

    Rows go to range partitions, are sorted there and numbered by partition and
    place, and are written, as another evaluation would draw other ranges; the
    rows of the partitions before are added from one row for each partition.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may part
    placed = placed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.drop("_tie"), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # as the numbering has them
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), part == F.col("_part")).withColumn(into, F.col("_base") + place).drop("_at", "_part", "_base")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; else they stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class SharedFiles:
    """Binary files in the shared folder, from executors; a file appears under its name only when whole.

    Local and mounted folders are memory-mapped when read. Other stores go
    through the file systems that pyarrow knows.
    """

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"file:{root}")
        self.local = isinstance(self.fs, fs.LocalFileSystem)
        self.fs.create_dir(self.path, recursive=True)

    def write(self, name: str, chunks) -> int:
        part = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        size = 0
        with self.fs.open_output_stream(part, compression=None) as out:
            for chunk in chunks:
                out.write(chunk)
                size += len(chunk)
        self.fs.move(part, f"{self.path}/{name}")
        return size

    def map(self, name: str) -> memoryview:
        """The bytes of a file; on local file systems without reading it whole."""
        import mmap

        path = f"{self.path}/{name}"
        if not self.local:
            with self.fs.open_input_file(path) as f:
                return memoryview(f.read())
        if not os.path.getsize(path):
            return memoryview(b"")
        with open(path, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def stream(self, name: str):
        return self.fs.open_input_stream(f"{self.path}/{name}", compression=None)
