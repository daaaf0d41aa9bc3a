"""Folders of media: files written from rows, and listings of what is there.

A listing is made by executors, level by level: the folders of a level are spread
over tasks, each task reads the names in its folders and nothing of the files, and
the level is written to the shared folder, so that a lost task lists its folders
again and the driver sees one number for each level. Folders are mounted ones, or in
a store that pyarrow knows, as for ``sources.indexed``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.indexed import folder
from millrace.sources.workers import let_workers_import, written

LEVEL = "path string, below boolean"


def entries(base: str, inside: str) -> Iterator[tuple[str, bool]]:
    """(path from the base, whether it is a folder) of what a folder holds; hidden names are skipped, a folder that has gone is empty.

    Links are followed for files and not for folders, so that no listing goes round.
    """
    from pyarrow import fs

    store, root = folder(base)
    here = f"{root.rstrip('/')}/{inside}".rstrip("/") or "/"
    before = f"{inside}/" if inside else ""
    if isinstance(store, fs.LocalFileSystem):  # names come one at a time, however many there are
        try:
            with os.scandir(here) as found:
                for e in found:
                    if not e.name.startswith(".") and not (e.is_symlink() and e.is_dir()):
                        yield before + e.name, e.is_dir()
        except FileNotFoundError:
            return
    else:
        for e in store.get_file_info(fs.FileSelector(here, allow_not_found=True)):
            if not e.base_name.startswith("."):
                yield before + e.base_name, e.type == fs.FileType.Directory


def list_files(spark: SparkSession, base: str, *extensions: str, batch: int = 10_000) -> DataFrame:
    """Files below ``base``, whole trees, as ``path`` (from the base), ``folder``, ``stem`` and ``extension`` (lower-case, without dot).

    With ``extensions`` only those. A base that is not there, or is empty, gives no rows.
    """
    let_workers_import(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["path", "below"])

        held = []
        for b in batches:
            for inside in b.column("path").to_pylist():
                for e in entries(base, inside):
                    held.append(e)
                    if len(held) == batch:
                        yield record(held)
                        held = []
        yield record(held)

    folders, tasks, levels = spark.createDataFrame([("",)], "path string"), 1, []
    while tasks:
        level = written(folders.repartition(tasks, "path").mapInArrow(listed, LEVEL), "listing")
        levels.append(level)
        folders = level.where("below").select("path")
        tasks = min(folders.count(), 4 * spark.sparkContext.defaultParallelism)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    files = found.where("not below").select(
        "path",
        F.regexp_extract("path", r"\A(?s:(.*))/[^/]*\z", 1).alias("folder"),
        F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"(?s).\.([^.]*)\z", 1)).alias("extension"),
    )
    return files.where(F.col("extension").isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else files


def write_files(df: DataFrame, base: str, path: str, content: str) -> DataFrame:
    """One file for each row: ``content`` (text in UTF-8, or binary; null is empty) at ``path`` below ``base``. Evaluates; gives (path, size).

    A file is written beside its place under a hidden name and then moved there, so a lost or repeated task leaves whole files
    alone, and listings do not show the rest. Rows with one path are one file, the greatest content; a null or empty path, or
    one that leaves the base, is an error.
    """
    let_workers_import(df.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, root = folder(base)
        made = set()
        for b in batches:
            sizes = []
            for to, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if not to or to.startswith("/") or ".." in to.split("/"):
                    raise ValueError(f"no path below the folder: {to!r}")
                data = data or b""
                full = f"{root.rstrip('/')}/{to}"
                parent, name = full.rsplit("/", 1)
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                beside = f"{parent}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(data)
                store.move(beside, full)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(sizes, pa.int64())], ["path", "size"])

    rows = df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    one = rows.groupBy("path").agg(F.max("content").alias("content"))
    return written(one.mapInArrow(put, "path string, size long"), "files")
