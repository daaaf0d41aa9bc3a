"""Python workers find this package where the driver has it; on a cluster it is installed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def let_workers_import(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a private folder only for local sessions that name none."""
    import atexit
    import shutil
    import tempfile
    import uuid

    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        before = sc._jsc.sc().getCheckpointDir()
        if not before.isDefined():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            sc.setCheckpointDir(f"file://{own}")
        root = sc._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may be remote, is a folder's."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return bool(files.exists(hadoop) and files.getFileStatus(hadoop).isDirectory())


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` evaluated once: written to the shared folder and read again, so that all that is built on it sees the same rows.

    The files go when the driver's JVM ends. Columns of no type come back as null strings.
    """
    from pyspark.sql import functions as F

    spark = df.sparkSession
    path = shared_folder(spark, label)
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
