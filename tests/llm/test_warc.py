import io
import zipfile

import pytest

from lumenwatch.llm import warc
from lumenwatch.session import scratch_path


def test_directory_of_plain_and_wide_zips():
    for wide in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            for name, body in (("a/é.txt", b"x" * 1000), ("b", b""), (warc.ARCHIVE, b"hello")):
                with z.open(name, "w", force_zip64=wide) as f:
                    f.write(body)
            z.comment = b"a comment"
        found = warc.members(raw, len(raw.getvalue()))
        assert [(m.name, m.size) for m in found] == [("a/é.txt", 1000), ("b", 0), (warc.ARCHIVE, 5)]
        raw.seek(warc.data_start(raw, found[2]))
        assert raw.read(5) == b"hello"
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"nothing"), 7)


def test_zip64_end_and_entries():
    """An archive whose end record refers to ZIP64 throughout, written by hand."""
    import struct

    name, body = b"data", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, 4, 20) + name + struct.pack("<HHQQ", 1, 16, 7, 7)
    start = 5  # bytes before the archive's first header
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", warc.ENTRY, 45, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, 4, 28, 0, 0, 0, 0, warc.FULL32)
    entry += name + struct.pack("<HHQQQ", 1, 24, 7, 7, start)
    at = start + len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", warc.LOCATOR64, 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", warc.END, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 0)
    raw = io.BytesIO(b"....." + local + body + entry + end64 + locator + end)
    (member,) = warc.members(raw, len(raw.getvalue()))
    raw.seek(warc.data_start(raw, member))
    assert member.size == 7 and raw.read(7) == body


def test_round_trip_with_copies_nulls_and_small_packages(spark):
    big, small = "<p>é" + "x" * 200, "<p>tiny"
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, "u\r\nX: y", big), (3, "s", small), (4, "s", small), (6, None, None), (7, "e", ""), (None, "n", big), (2, "http://a/2", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first", "3 AS payload")
    packages = warc.write_packages(warc.with_originals(pages), scratch_path(spark, "w"), package_bytes=300)
    out = warc.read_packages(packages, with_payload=True).collect()
    assert packages.count() > 1 and len(out) == len(rows)
    kinds = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in out}
    n = len(big.encode())
    assert kinds == {5: ("revisit", 2, n), 2: ("response", None, n), 9: ("revisit", 2, n), 3: ("response", None, 7), 4: ("response", None, 7), 6: ("response", None, 0), 7: ("response", None, 0), None: ("revisit", 2, n)}
    assert all(r.payload == (b"" if r.record_type == "revisit" else dict((p, (h or "").encode()) for p, _, h in rows)[r.page_id]) for r in out)
    assert warc.read_packages(warc.write_packages(warc.with_originals(pages.limit(0)), scratch_path(spark, "w"))).collect() == []
