"""Token-id output: flat unsigned files with 64-bit document offsets.

Document ids are ranged over tasks, as many as the bytes of the texts ask for, and a
task writes one shard after another, each of a bounded number of bytes and documents.
A shard is three files in the shared folder, named by its task and place::

    TTTTT-PPPPP.tokens   ids, flat, little-endian uint16 (uint32 for vocabularies over 65,536)
    TTTTT-PPPPP.offsets  n+1 little-endian uint64: where each document begins within the shard
    TTTTT-PPPPP.ids      n little-endian int64 document ids, then n uint8 (0: the id was null)

``manifest.json`` lists the shards in order with their bases: the exclusive
prefix sums of the shards' token counts. A document's global start is its
shard's base plus its offset, so no pass over the rows is ever global.

A shard is written under a passing name and moved into place when whole, so a
task that is lost or run twice leaves the same files. Tokens go out as they come,
and a reader holds one shard at most, also where files cannot be mapped.

Defined results: null and empty texts hold the end id alone; null ids come
first; equal ids are ordered by a hash of the text, rows that are equal in both
are interchangeable; a document longer than a shard has one for itself; an empty
table gives a manifest without shards.
"""

from __future__ import annotations

import json
import zlib
from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import memo_tokenizer
from millrace.llm.runtime import SharedFiles, prepare

SHARD_SCHEMA = "shard string, n_docs long, n_tokens long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(
    docs: DataFrame,
    root: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    task_bytes: int = 128 << 20,
    shard_bytes: int = 256 << 20,
    shard_docs: int = 1 << 22,
) -> dict:
    """Encode ``text_col`` and write the shards in ascending ``id_col`` order under ``root``; returns the manifest.

    Ids are cut into ``shards`` ranges, or one for each ``task_bytes`` of text and no fewer than shuffles have partitions; a range
    that is larger is more shards, as one ends before the document that would take it over ``shard_bytes`` of tokens or ``shard_docs``.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tok = memo_tokenizer.load(tokenizer)
        end = np.array([end_id], tok.dtype).tobytes()
        width = tok.dtype.itemsize

        def documents():
            """(shard of this task, id, its bytes) in order."""
            shard = size = n = 0
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for at in range(0, len(texts), 256):
                    packed = tok.encode(texts.slice(at, 256).to_pylist())
                    for key, payload in zip(ids[at : at + 256], packed):
                        length = len(payload) + width
                        if n and (size + length > shard_bytes or n == shard_docs):
                            shard, size, n = shard + 1, 0, 0
                        size, n = size + length, n + 1
                        yield shard, key, payload

        files = SharedFiles(root)
        for shard, group in groupby(documents(), key=lambda d: d[0]):
            ids, valid, offsets = array("q"), bytearray(), array("Q", [0])

            def tokens():
                held, size = [], 0
                for _, key, payload in group:
                    ids.append(key or 0)
                    valid.append(key is not None)
                    offsets.append(offsets[-1] + len(payload) // width + 1)
                    held += (payload, end)
                    size += len(payload)
                    if size > 1 << 20:
                        yield b"".join(held)
                        held, size = [], 0
                yield b"".join(held)

            name = f"{task:05d}-{shard:05d}"
            files.write(f"{name}.tokens", tokens())
            files.write(f"{name}.offsets", [np.asarray(offsets).astype("<u8").tobytes()])
            files.write(f"{name}.ids", [np.asarray(ids).astype("<i8").tobytes(), bytes(valid)])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([name]), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([offsets[-1]], pa.int64())})

    written = sorted(map(tuple, rows.mapInArrow(write, SHARD_SCHEMA).collect()), key=lambda r: [int(x) for x in r[0].split("-")])  # a row for each shard
    base, table = 0, []
    for shard, n_docs, n_tokens in written:
        table.append({"shard": shard, "n_docs": n_docs, "n_tokens": n_tokens, "base": base})
        base += n_tokens
    manifest = {"tokenizer": tokenizer.rsplit("/", 1)[-1], "end_id": end_id, "dtype": memo_tokenizer.load(tokenizer).dtype.str, "shards": table}
    SharedFiles(root).write("manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read_manifest(root: str) -> dict:
    return json.loads(bytes(SharedFiles(root).map("manifest.json")))


def map_shard(files: SharedFiles, shard: str, dtype: str):
    """(ids, valid, offsets, tokens) of a shard, as arrays over the mapped files."""
    offsets = np.frombuffer(files.map(f"{shard}.offsets"), "<u8").astype("i8")
    n = len(offsets) - 1
    keys = files.map(f"{shard}.ids")
    return np.frombuffer(keys[: 8 * n], "<i8"), np.frombuffer(keys[8 * n :], "u1").astype(bool), offsets, np.frombuffer(files.map(f"{shard}.tokens"), dtype)


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """A row for each document of the file set: id, global start, length and checksum, all from the mapped files."""
    prepare(spark)
    manifest = read_manifest(root)
    shards, dtype = manifest["shards"], manifest["dtype"]

    def read(batches):
        files = SharedFiles(root)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, valid, offsets, tokens = map_shard(files, shards[k]["shard"], dtype)
                for at in range(0, len(ids), 4096):
                    to = min(at + 4096, len(ids))
                    crcs = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(at, to)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(ids[at:to], pa.int64(), mask=~valid[at:to]),
                            "start": pa.array(offsets[at:to] + shards[k]["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(offsets[at : to + 1]), pa.int64()),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, DOC_SCHEMA)
