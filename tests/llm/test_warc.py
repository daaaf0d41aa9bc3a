import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc
from millrace.llm.runtime import scratch

PAGES = "page_id long, url string, html string"


def run(spark, rows, least=0):
    root = scratch(spark, "warc")
    pages = spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("payload"), F.lit(2).alias("sha1"), F.lit(3).alias("first"))
    return warc.read_archives(spark, root, warc.write_archives(pages, root, least)).collect()


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        first = min(same, default=None)
        again = first is not None and i != first and len(p) >= least
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


ROWS = [(5, "http://a/ü\n", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (None, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (1, "u", "x\r\n\r\ny" * 40_000), (2, "u", "WARC/1.1\r\n"), (None, "u", "alone"), (None, "u", "alone")]


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, least):
    got = run(spark, ROWS, least)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(key, brute(ROWS, least)))
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_dictionary_frame_and_one_frame_per_record():
    records = [warc.build_record(i, "u", b"page %d " % i + b"same words here " * 20, warc.digest(b"page %d " % i + b"same words here " * 20), None) for i in range(40)]
    dictionary = warc.train_dictionary(records, 2048)
    assert dictionary
    chunks = list(warc.archive(records, dictionary))
    data = b"".join(chunks)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D and len(chunks) == 41
    assert list(warc.read_archive(io.BytesIO(data), chunk=7)) == records
    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(io.BytesIO(data[:-5])))
    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(io.BytesIO(b"\x28\xb5\x2f\xfd1234")))


def test_broken_records_are_refused():
    good = warc.build_record(1, "u", b"abc", warc.digest(b"abc"), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc\r\n", b"abd\r\n"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"WARC-Date:", b"No-Date:")):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)


def test_broken_records_are_rows_with_an_error(spark):
    from millrace.llm.runtime import SharedFiles

    good = [warc.build_record(i, "u", b"abc%d" % i, warc.digest(b"abc%d" % i), None) for i in range(4)]
    bad = [good[0][:-1], good[1].replace(b"<urn:page:1>", b"<urn:page:x>"), good[2].replace(b"WARC-Payload-Digest", b"No-Digest"), good[3].replace(b"Content-Length: 4\r\n\r\n", b"Content-Length: z\r\n\r\n", 1)]
    root = scratch(spark, "warc")
    files = SharedFiles(root)
    files.write("00000.warc.zst", warc.archive([good[0], *bad, good[3]], b""))
    files.write("00001.warc.zst", [b"".join(warc.archive(good[:2], b""))[:-6]])
    files.write("00002.warc.zst", [b"no archive at all"])
    rows = warc.read_archives(spark, root, [f"0000{k}.warc.zst" for k in range(3)]).collect()
    read = sorted((r["archive"], r["page_id"]) for r in rows if r["error"] is None)
    assert read == [("00000.warc.zst", 0), ("00000.warc.zst", 3), ("00001.warc.zst", 0)]
    assert sorted(r["archive"][:5] for r in rows if r["error"]) == ["00000"] * 4 + ["00001", "00002"]
    assert all(r["page_id"] is None and r["payload"] is None for r in rows if r["error"])


def test_clashing_names(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    for c in ("n", "url_", "refers_to", "payload_digest", "archive", "error", "i", "t", "page"):
        pages = pages.withColumn(c, F.lit("x"))
    root = scratch(spark, "warc")
    assert warc.read_archives(spark, root, warc.write_archives(pages, root)).where("error is null").count() == len(ROWS)
