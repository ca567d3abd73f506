import base64
import glob
import hashlib
import struct

import pytest
import zstandard

from loomq.llm import warc_zst as w

ROWS = [(1, "http://a/", "<p>one</p>" * 50), (2, "http://b/", None), (3, None, ""), (4, "http://a/\r\nX: y", "<p>one</p>" * 50), (9, "u", "é\r\n\r\n\x00"), (9, "u", "é\r\n\r\n\x00"), (None, "n", "solo"), (None, "n", "pair"), (5, "n", "pair")]
SCHEMA = "page_id bigint, url string, html string"


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    got = sorted((tuple(r)[:1] + tuple(r)[2:] for r in w.archived(df).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        ids = [j for j, _, h in ROWS if (h or "").encode() == data and j is not None]
        best = max(ids) if ids else None
        revisit = best is not None and i != best
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    assert got == sorted(want, key=str)
    assert w.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_plain_zstandard(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(2)
    w.write_archives(pages, str(tmp_path / "w"))
    back = w.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()
    want = {r.page_id: r.html for r in pages.collect()}
    assert len(back) == len(want)
    assert all(r.payload.decode() == want[r.page_id] for r in back if r.record_type == "response") and all(r.payload is None for r in back if r.record_type == "revisit")
    data = open(sorted(glob.glob(str(tmp_path / "w" / "part-*")))[0], "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == w.DICT_MAGIC
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC-Record-ID: ") == len(list(w.read_archive(data)))


def record(**change):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": "2"} | change
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\nab\r\n\r\n"


def test_reader_accepts_and_refuses():
    z = zstandard.ZstdCompressor(write_checksum=True)
    good = z.compress(record())
    skip = struct.pack("<II", 0x184D2A53, 3) + b"xyz"
    assert len(list(w.read_archive(skip + good + w.SEPARATOR + good))) == 2
    big = record(**{"Content-Length": str(300_000)})[: -len(b"ab\r\n\r\n")] + b"q" * 300_000 + b"\r\n\r\n"
    streamed = zstandard.ZstdCompressor().compressobj()
    assert len(list(w.read_archive(streamed.compress(big) + streamed.flush() + good))) == 2
    raw = zstandard.train_dictionary(512, [record(**{"X": str(k)}) * 3 for k in range(200)]).as_bytes()
    with_dict = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record())
    for held in (raw, zstandard.ZstdCompressor().compress(raw)):
        assert len(list(w.read_archive(struct.pack("<II", w.DICT_MAGIC, len(held)) + held + with_dict))) == 1
    bad = [good[:-1], good[: len(good) // 2], b"junk", good + b"x", struct.pack("<II", 0x184D2A50, 99)]
    bad += [z.compress(x) for x in (b"", b"HTTP/1.1", record()[:-1], record() + b"x", record(**{"Content-Length": "3"}), record(**{"Content-Length": "-2"}), record(**{"Content-Length": None}), record(**{"WARC-Type": None}), record(**{"WARC-Date": None}), b"WARC/1.1\r\nno colon\r\n\r\nab\r\n\r\n")]
    for data in bad:
        with pytest.raises(ValueError):
            list(w.read_archive(data))


def test_archives_are_rolled_by_bytes_not_partitions(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(k, f"http://h/{k}", rng.randbytes(1500).hex()) for k in range(400)] + [(1000, "long", rng.randbytes(1_500_000).hex()), (1001, "long too", "é" * 4_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 3):
        folder = str(tmp_path / f"w{parts}")
        w.write_archives(df.repartition(parts), folder, archive_bytes=100_000)
        sizes = sorted(len(open(f, "rb").read()) for f in glob.glob(f"{folder}/part-*"))
        assert len(sizes) >= 6 and all(n <= 100_000 + len(w.SEPARATOR) for n in sizes[:-2])  # the dictionary among them
        back = {r.page_id: r.payload.decode() for r in w.read_archives(spark, folder, payloads=True).collect()}
        assert back == {i: h for i, _, h in rows}


def test_other_columns_may_have_any_name(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS payload", "2 AS sha1", "3 AS best", "4 AS record_type", "5 AS payload_bytes", "6 AS refers_to", "7 AS h", "8 AS x")
    assert sorted(map(str, w.archived(df).collect())) == sorted(map(str, w.archived(spark.createDataFrame(ROWS, SCHEMA)).collect()))
