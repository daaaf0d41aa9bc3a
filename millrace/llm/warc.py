"""WARC archives in Zstandard: one frame for each record, dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; every record after it is one frame,
compressed with that dictionary. The reader loads the dictionary from the
leading frame, decodes frame by frame in a stream and checks each record:
version line, header syntax, that the block has the length its header states
and is followed by two line ends, and the digests of block and payload.

Pages with equal payloads are stored once: the one with the smallest id is a
``response``, the others are ``revisit`` records that name it. Groups are found
from digests alone (smallest id by partial aggregation); pages meet their
group's smallest id in a join by digest, whose one side is a table of its own,
so that Spark splits the other where one payload is hot.

A record that breaks the format comes back as a row with an ``error`` and no
values, and so does what cannot be unpacked; after the latter the rest of the
archive cannot be read and is left.

Defined results: a null payload is empty; rows with the smallest id of their
group are all responses if that id is repeated; null ids come after all others;
a group of null ids alone holds responses; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.runtime import SharedFiles, cut, prepare

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, error string"


class BadRecord(ValueError):
    """A record that breaks the format."""


def digest(data: bytes) -> str:
    """Base32 SHA-1, as WARC writes it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A whole response record, or a revisit record if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").encode("ascii", "backslashreplace").decode().translate({10: "%0A", 13: "%0D"})
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise BadRecord(f"header line {line[:60]!r}")
        out[name.decode("ascii").lower()] = value.strip().decode()
    return out


def parse_record(data: bytes) -> dict:
    """Check a record and take it apart."""
    version, end, rest = data.partition(b"\r\n")
    if version != VERSION or not end:
        raise BadRecord(f"version line {version[:40]!r}")
    head, end, body = rest.partition(b"\r\n\r\n")
    if not end:
        raise BadRecord("no end of headers")
    h = headers(head)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(h)
    if missing:
        raise BadRecord(f"no header {sorted(missing)}")
    if not h["content-length"].isdigit() or len(body) != int(h["content-length"]) + 4 or body[-4:] != b"\r\n\r\n":
        raise BadRecord("block length differs from its header")
    block = body[:-4]
    if h.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise BadRecord("block digest")
    http_head, end, payload = block.partition(b"\r\n\r\n")
    status, _, http_lines = http_head.partition(b"\r\n")
    if not end or not status.startswith(b"HTTP/"):
        raise BadRecord("no HTTP header")
    http = headers(http_lines)
    if not http.get("content-length", "").isdigit():
        raise BadRecord("no length of the payload")
    stated = h["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if h["warc-type"] == "response":
        if len(payload) != size or digest(payload) != stated:
            raise BadRecord("payload differs from its length or digest")
    elif h["warc-type"] != "revisit" or payload or "warc-refers-to" not in h:
        raise BadRecord("neither a response nor a revisit")
    return {
        "page_id": page_of(h["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": h["warc-type"],
        "refers_to": page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None,
        "url": h.get("warc-target-uri"),
        "payload": payload if h["warc-type"] == "response" else None,
    }


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A dictionary, or an empty one where the samples are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) > 15 else b""
    except zstandard.ZstdError:
        return b""


def archive(records, dictionary: bytes, level: int = 3):
    """The frames of an archive; ``records`` are whole records."""
    stored = zstandard.ZstdCompressor(level=level).compress(dictionary)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)
    for record in records:
        yield packer.compress(record)


def read_archive(stream, chunk: int = 1 << 18):
    """The decoded records of an archive, from a stream; memory holds one record and a chunk."""
    held = stream.read(8)
    if len(held) < 8:
        raise BadRecord("no leading frame")
    magic, size = struct.unpack("<II", held)
    if magic != DICTIONARY_MAGIC:
        raise BadRecord(f"leading frame {magic:#x}")
    stored = stream.read(size)
    if len(stored) < size:
        raise BadRecord("the leading frame is cut")
    plain = zstandard.ZstdDecompressor().decompressobj().decompress(stored) if stored[:4] == b"\x28\xb5\x2f\xfd" else stored
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain)) if plain else zstandard.ZstdDecompressor()
    held = b""
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = stream.read(chunk)
            if not held:
                raise BadRecord("the last frame is cut")
        yield b"".join(parts)


def checked(data: bytes) -> dict:
    """The parts of a record, or what is wrong with it."""
    try:
        return parse_record(data)
    except ValueError as e:  # also of a page id or of bytes that are no text
        return {"error": str(e)}


def records_of(stream):
    """The decoded records of an archive; where it cannot be unpacked any more, a dict with the error."""
    try:
        yield from read_archive(stream)
    except (BadRecord, zstandard.ZstdError) as e:
        yield {"error": str(e)}


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, sha1, refers_to) of each page."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts, "firsts")
    joined = rows.join(firsts.select("sha1", "first"), "sha1", "left")
    again = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least_bytes), F.col("first"))
    return joined.select("page_id", "url", "payload", "sha1", again.alias("refers_to"))


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0, sample: int = 400, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> list[str]:
    """Write an archive for each partition under ``root``; returns their names.

    The dictionary is trained on the first 4 KB of ``sample`` pages, chosen by a hash of their ids.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = with_revisits(pages, least_bytes, id_col, payload_col, url_col)
    chosen = pages.select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i"), "i").limit(sample).distinct()
    heads = pages.select(F.col(id_col).alias("i"), F.substring(F.coalesce(F.col(payload_col), F.lit("")), 1, 4096).alias("t"))
    heads = heads.join(F.broadcast(chosen), "i", "left_semi").orderBy("i", "t").limit(sample)  # `sample` ids at most
    dictionary = train_dictionary([build_record(r["i"], "", r["t"].encode(), "", None) for r in heads.collect()])

    def write(batches):
        from pyspark import TaskContext

        name = f"{TaskContext.get().partitionId():05d}.warc.zst"
        n = 0

        def records():
            nonlocal n
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, payload, sha1, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                    n += 1
                    yield build_record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to)

        size = SharedFiles(root).write(name, archive(records(), dictionary))
        yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64()), "size": pa.array([size], pa.int64())})

    return sorted(r["name"] for r in rows.mapInArrow(write, "name string, n long, size long").collect())  # a row for each archive


def read_archives(spark, root: str, names: list[str], payloads: bool = True) -> DataFrame:
    """The checked records of the archives, and a row with an ``error`` for each broken one."""
    prepare(spark)

    def read(batches):
        files = SharedFiles(root)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with files.stream(names[k]) as stream:
                    out, size = [], 0
                    for data in records_of(stream):
                        record = (data if isinstance(data, dict) else checked(data)) | {"archive": names[k]}
                        if not payloads:
                            record["payload"] = None
                        out.append(record)
                        size += len(data) + 200 if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    ARROW = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("error", pa.string())]
    )
    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(read, RECORD)
