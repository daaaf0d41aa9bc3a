"""Indexed binary sets: rows by number, as a data source.

A set is a folder of shards of up to ``shardBytes`` and their offset indexes::

    <shard>.bin    records one after another, each the UTF-8 JSON of a row
    <shard>.idx    n + 1 little-endian 64-bit offsets, where each record begins
    manifest.json  the schema, and the shards in order with rows, bytes and the number of the first row

Rows are numbered by write partition and place. A task writes shards of its own
names, and what counts is the manifest, which the driver writes when all tasks
have ended; so a lost task, or one that runs twice, leaves no half shard in the
set, and files of a failed job are deleted.

    df.write.format("indexed").option("path", folder).mode("overwrite").save()
    spark.read.format("indexed").option("path", folder).option("rows", "3,77,-1").load()

Reading by number finds the shard by bisection over first rows, and then reads two
offsets and one record; negative numbers count from the end, and a number that is
not there is an error. Without ``rows`` a scan is planned by bytes, ``splitBytes`` a
task. Every row comes with its number as ``_row``. Folders are local or mounted
ones, or in a store that pyarrow knows.
"""

from __future__ import annotations

import bisect
import json
import sys
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

MANIFEST = "manifest.json"


def folder(path: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    shards: list[tuple[str, int, int]]  # name, rows, bytes


@dataclass
class Piece(InputPartition):
    """Rows of one shard: a range, or places."""

    shard: str
    base: int
    first: int
    end: int
    places: tuple[int, ...] | None = None


class IndexedWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.limit = int(options.get("shardbytes", options.get("shardBytes", 10**10)))

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        files, root = folder(self.path)
        files.create_dir(root, recursive=True)
        shards: list[tuple[str, int, int]] = []
        name, out, ends = "", None, []

        def close():
            out.close()
            with files.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                index.write(np.array([0, *ends], "<u8").tobytes())
            shards.append((name, len(ends), ends[-1]))

        for row in iterator:
            if out is None:
                name, ends = uuid.uuid4().hex, []
                out = files.open_output_stream(f"{root}/{name}.bin", compression=None)
            data = json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode()
            out.write(data)
            ends.append((ends[-1] if ends else 0) + len(data))
            if ends[-1] >= self.limit:
                close()
                out = None
        if out is not None:
            close()
        return Written(TaskContext.get().partitionId(), shards)

    def commit(self, messages) -> None:
        files, root = folder(self.path)
        files.create_dir(root, recursive=True)
        known, base = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, rows, size in m.shards:
                known.append({"name": name, "first": base, "rows": rows, "bytes": size})
                base += rows
        text = json.dumps({"schema": self.schema.jsonValue(), "rows": base, "shards": known})
        part = f"{root}/.{uuid.uuid4().hex}"
        with files.open_output_stream(part, compression=None) as out:
            out.write(text.encode())
        files.move(part, f"{root}/{MANIFEST}")

    def abort(self, messages) -> None:
        files, root = folder(self.path)
        for m in messages:
            for name, _, _ in m.shards if m else ():
                for kind in ("bin", "idx"):
                    files.delete_file(f"{root}/{name}.{kind}")


class IndexedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.rows = options.get("rows")
        self.split = int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))

    def partitions(self) -> list[Piece]:
        known = manifest(self.path)
        shards = known["shards"]
        if self.rows is None:
            out = []
            for s in shards:
                step = max(1, s["rows"] * self.split // max(s["bytes"], 1))
                out += [Piece(s["name"], s["first"], a, min(a + step, s["rows"])) for a in range(0, s["rows"], step)]
            return out
        firsts, places = [s["first"] for s in shards], {}
        for n in map(int, filter(None, self.rows.split(","))):
            at = n + known["rows"] if n < 0 else n
            if not 0 <= at < known["rows"]:
                raise IndexError(f"row {n} of {known['rows']}")
            shard = bisect.bisect_right(firsts, at) - 1
            places.setdefault(shard, []).append(at - firsts[shard])
        return [Piece(shards[k]["name"], firsts[k], 0, 0, tuple(v)) for k, v in sorted(places.items())]

    def read(self, partition: Piece | None):
        if partition is None:  # a set without rows
            return
        files, root = folder(self.path)
        schema = to_arrow_schema(self.schema)

        def batch(places, records):
            rows = [json.loads(r) for r in records]
            cols = [pa.array([partition.base + p for p in places], pa.int64())]
            cols += [column([r[f.name] for r in rows], f.type) for f in list(schema)[1:]]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        with files.open_input_file(f"{root}/{partition.shard}.idx") as index, files.open_input_file(f"{root}/{partition.shard}.bin") as data:

            def offsets(a: int, n: int) -> np.ndarray:
                index.seek(8 * a)
                return np.frombuffer(index.read(8 * n), "<u8")

            if partition.places is not None:
                for p in partition.places:
                    a, b = offsets(p, 2).tolist()
                    data.seek(a)
                    yield batch([p], [data.read(b - a)])
                return
            for a in range(partition.first, partition.end, 4096):
                edges = offsets(a, min(4096, partition.end - a) + 1).astype("i8")
                data.seek(int(edges[0]))
                block = data.read(int(edges[-1] - edges[0]))
                yield batch(range(a, a + len(edges) - 1), [block[x:y] for x, y in zip((edges[:-1] - edges[0]).tolist(), (edges[1:] - edges[0]).tolist())])


def column(values: list, kind: pa.DataType) -> pa.Array:
    """Values of JSON in a column's type; dates, times (local ones, as Python rows have them) and decimals are written as text."""
    if pa.types.is_timestamp(kind) and kind.tz:
        return pa.array([None if v is None else datetime.fromisoformat(v).astimezone(timezone.utc) for v in values], kind)
    if pa.types.is_temporal(kind) or pa.types.is_decimal(kind):
        return pa.array([None if v is None else str(v) for v in values], pa.string()).cast(kind)
    return pa.array(values, kind)


def manifest(path: str) -> dict:
    files, root = folder(path)
    with files.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())


class IndexedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed"

    def schema(self) -> StructType:
        own = StructType.fromJson(manifest(self.options["path"])["schema"])
        return StructType([StructField("_row", LongType()), *own.fields])

    def reader(self, schema: StructType) -> IndexedReader:
        return IndexedReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> IndexedWriter:
        return IndexedWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known; its code travels with the plan."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(IndexedSource)


def write_indexed(df: DataFrame, path: str, *order: str, shard_bytes: int = 10**10) -> None:
    """Rows in order, numbered from 0. An earlier set of the folder is replaced when the new one is whole."""
    register(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.format("indexed").option("path", path).option("shardBytes", shard_bytes).mode("overwrite").save()


def read_indexed(spark: SparkSession, path: str, rows: list[int] | None = None) -> DataFrame:
    """Rows by number, or all of them."""
    register(spark)
    reader = spark.read.format("indexed").option("path", path)
    return (reader if rows is None else reader.option("rows", ",".join(map(str, rows)))).load()
