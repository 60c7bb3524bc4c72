import hashlib
import random
import struct

import pytest
import zstandard

from tableguard.llm import queries, warc
from tests.llm.helpers import prose, write_tables

SCHEMA = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def fixture_rows():
    rng = random.Random(4)
    shared = "<p>" + prose(rng, 400) + "</p>"
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<html><p>{prose(rng, rng.randint(1, 300))}</p></html>") for i in range(60)]
    rows += [(100 + i, f"http://copy.example/{i}", shared) for i in range(5)]
    rows += [(200, None, None), (201, "", ""), (202, "http://x\r\nEvil: 1/ä b%20c", "small"), (203, "u", "small"),
             (None, "http://null.example", shared), (204, "http://big.example", prose(rng, 100_000) + "é\U0001f600"),
             (3, "http://again.example", rows[3][2])]
    return rows


def by_hand(rows, min_bytes=1000):
    best = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= min_bytes and page is not None:
            best[data] = max(best.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= min_bytes and data in best and page != best[data]
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[data] if revisit else None))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) if v is not None else (True, 0) for v in r))


@pytest.mark.parametrize("archive_bytes", [1, 2000, 4 << 20])
def test_round_trip(spark, tmp_path, archive_bytes):
    rows = fixture_rows()
    path = f"{tmp_path}/a"
    warc.write_archives(pages(spark, rows).repartition(3), path, archive_bytes=archive_bytes)
    back = warc.read_archives(spark, path).collect()
    assert order([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]) == order(by_hand(rows))
    texts = {(r[0], (r[2] or "").encode()) for r in rows}
    assert all((r.page_id, bytes(r.payload)) in texts for r in back if r.record_type == "response")
    assert all(r.error is None for r in back)


def test_archives_have_the_convention_s_layout(spark, tmp_path):
    path = tmp_path / "a"
    warc.write_archives(pages(spark, fixture_rows()).repartition(1), str(path))
    files = [f for f in path.iterdir() if f.name.startswith("part-")]
    assert files
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and data[8:12] == struct.pack("<I", 0xEC30A437)
        dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
        plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
        assert plain.count(b"WARC/1.1\r\nWARC-Type") == len(list(warc.read_archive(data)))


def test_broken_archives_are_reported():
    record = warc.build_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest())
    frame = zstandard.ZstdCompressor().compress
    good = frame(record)
    assert next(iter(warc.read_archive(good)))["error"] is None
    assert next(iter(warc.read_archive(b"")), None) is None
    cases = {
        "cut": good[:-3], "short header": good + b"\x01", "magic": b"abcdefgh" + good,
        "length": frame(record.replace(b"Content-Length: 7", b"Content-Length: 8")),
        "digest": frame(record.replace(b"payload\r\n\r\n", b"payloaD\r\n\r\n")),
        "type": frame(record.replace(b"WARC-Type: response", b"WARC-Type: metadata")),
        "missing": frame(record.replace(b"WARC-Date", b"WARC-Dote")),
        "tail": frame(record + b"x"),
        "late dictionary": good + struct.pack("<II", warc.DICT_MAGIC, 4) + b"abcd",
    }
    for name, data in cases.items():
        assert any(r["error"] for r in warc.read_archive(data)), name


def test_strict_reading_fails_and_lenient_reading_tells(spark, tmp_path):
    (tmp_path / "a").mkdir()
    record = warc.build_record(1, "u", b"x", hashlib.sha1(b"x").hexdigest())
    packed = zstandard.ZstdCompressor().compress(record)
    (tmp_path / "a" / "one.warc.zst").write_bytes(packed + packed[:-2])
    lenient = warc.read_archives(spark, f"{tmp_path}/a", strict=False).collect()
    assert [r.error is None for r in lenient] == [True, False]
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, f"{tmp_path}/a").collect()


def test_shuffled_marks_equal_broadcast_marks(spark, monkeypatch):
    df = pages(spark, fixture_rows())
    key = ["page", "url", "keeper"]
    a = warc.mark_revisits(df).select(key).collect()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert order(map(tuple, a)) == order(map(tuple, warc.mark_revisits(df).select(key).collect()))


def test_empty_table_and_extra_columns(spark, tmp_path):
    warc.write_archives(pages(spark, []), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0
    df = pages(spark, fixture_rows()).selectExpr("*", "'x' AS digest", "1 AS _digest", "2 AS payload", "3 AS _keeper", "4 AS _most")
    warc.write_archives(df, f"{tmp_path}/extra")
    assert warc.read_archives(spark, f"{tmp_path}/extra").count() == len(fixture_rows())


def test_query_on_a_fixture(spark, tmp_path):
    rows = [r for r in fixture_rows() if r[0] is not None]
    folder = write_tables({"pages": pages(spark, rows)}, tmp_path)
    got = queries.QUERIES["op10_warc_zstd"](spark, folder).collect()
    assert order(map(tuple, got)) == order(by_hand(rows))
