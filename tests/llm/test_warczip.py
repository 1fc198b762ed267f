import io
import zipfile

import pytest

from heristat.llm import warczip as Z
from tests.conftest import DATA, rows


def test_query(spark, duck):
    assert rows(Z.query(spark.read.parquet(f"{DATA}/pages.parquet")).toPandas()) == rows(duck.sql(Z.SQL).df())


def test_edges(spark):
    big = "é" * 60
    pages = [(5, "u\r\nX: y", big), (3, "u", big), (3, "u", big), (9, None, big), (None, "u", big), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (10, "u", "x" * 1_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS kind", "3 AS n", "4 AS p")
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in Z.query(df).collect())
    assert got == [(0, "revisit", 3, 120), (1, "response", None, 5), (2, "response", None, 5), (3, "response", None, 120), (3, "response", None, 120), (5, "revisit", 3, 120), (7, "response", None, 0), (8, "response", None, 0), (9, "revisit", 3, 120), (10, "response", None, 1_000_000)]
    assert Z.query(df.filter("false")).count() == 0
    many = Z.write(df, limit=100)  # a package for nearly each record
    assert many.count() >= 8 and many.agg({"records": "sum"}).first()[0] == 10
    read = {r.page_id: bytes(r.payload) for r in Z.read(Z.index(many)).filter("record_type = 'response'").collect()}
    assert read[10] == b"x" * 1_000_000 and read[3] == big.encode() and read[7] == b""
    assert {r.url for r in Z.read(Z.index(many)).filter("page_id IN (5, 9)").collect()} == {"u%0D%0AX: y", None}


@pytest.mark.parametrize("wide", [False, True])
def test_directories(wide):
    raw = io.BytesIO()
    raw.write(b"in front")
    with zipfile.ZipFile(raw, "a", zipfile.ZIP_STORED) as z:
        for n in range(3 if not wide else 66_000):  # over 65535 members need the ZIP64 end record
            with z.open(f"é{n}", "w", force_zip64=wide and n < 3) as f:
                f.write(b"data%d" % n)
        z.writestr("packed", b"p" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 isn't the end"
    package = Z.ZipReader(raw)
    assert package.read("é2") == b"data2" and package.at(package.start("é1") + 1, 3) == b"ata"
    with pytest.raises(ValueError, match="compressed"):
        package.read("packed")
    for bad in (b"", b"x" * 100):
        with pytest.raises(ValueError):
            Z.ZipReader(io.BytesIO(bad))


def test_zip64_sizes():
    """A hand-made directory whose sizes and offset are all in the 64-bit field."""
    import struct

    name, data = b"m", b"0123456789"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 10, 10, 1, 0) + name + data
    extra = struct.pack("<HHQQQ", 1, 24, 10, 10, 0)
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert Z.ZipReader(io.BytesIO(local + central + end64 + locator + end)).read("m") == data


def test_a_changed_payload_is_noticed():
    import hashlib

    raw = Z.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), "response", None)
    assert Z.parse(raw).payload == b"abc"
    with pytest.raises(ValueError, match="digest"):
        Z.parse(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
