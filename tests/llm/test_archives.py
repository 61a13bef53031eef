"""Archives written and read back, and archives made by hand, against a reader that follows them byte by byte."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assayer.llm import queries, warc

SF = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ODD = [
    None, "", "", "<p>a</p>", "<p>a</p>", "WARC/1.1", "\nWARC/1.1\r\n", "\r\n\r\n", "\n", "\r", INNER, INNER * 3, "x\n" + INNER, "WARC/1.0\r\nContent-Length: 100000\r\n\r\n",
    "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\n", "日本 é\x00", "long " * 40_000, ("\n" + INNER) * 300, "ends\n", "ends\r\n", "ends\r\n\r\n", "ends\r\n\r\nWARC/1.", "\nWARC/1." * 500, "WARC/1." * 50,
]


def expected(rows):
    top = {}
    for i, _, html in rows:
        top[html or ""] = max(top.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        most = top[html or ""]
        revisit = (-1 if i is None else i) != most
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", most if revisit else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.fixture
def blocks(spark):
    """Sets how many bytes a task reads."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(keys, (n, 1))]
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [700, 4096, 100_000, 128 << 20])
def test_pages_survive_the_archive(spark, blocks, size):
    rng = random.Random(size)
    rows = [(i * 3, f"http://h/{i}\r\nWARC/1.0 {i}" if i % 5 else None, h) for i, h in enumerate(ODD)]
    rows += [(1000 + i, "u", "".join(rng.choice(["a", "\n", "\r\n", "\r\n\r\n", "WARC/1.", "WARC/1.0\r\n", "\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", INNER]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(None, "u", "<p>a</p>"), (None, "u", "no id")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for c in ("f", "b", "top", "salt", "digest"):
        df = df.withColumn(c, F.lit("x"))
    blocks(size)
    assert rows_of(warc.archived(df)) == expected(rows)


def test_many_copies_are_salted(spark, monkeypatch):
    monkeypatch.setattr(warc, "SALT_ROWS", 7)
    rows = [(i, "u", "copy" if i % 3 == 0 else f"own {i % 40}") for i in range(400)]
    assert rows_of(warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"))) == expected(rows)


def test_payloads_below_the_least_size_are_all_stored(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", b"ab"), (2, "u", b"ab"), (3, "u", b"abcd"), (4, "u", b"abcd")], "id long, uri string, payload binary")
    warc.write(rows, f"file://{tmp_path}/w", least=3)
    assert [r[3] for r in rows_of(warc.report(warc.read(spark, f"file://{tmp_path}/w")))] == ["response", "response", "revisit", "response"]


def record(payload, kind=b"response", version=b"1.0", name=b"Content-Length"):
    return b"WARC/" + version + b"\r\nWARC-Type: " + kind + b"\r\nX-Note: WARC/1.0 in a value\r\n" + name + b": " + str(len(payload)).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_archives_of_others(spark, tmp_path, blocks, size):
    """Any bytes, other versions and cases of headers; offsets are those of the file."""
    rng, want = random.Random(3), []
    for k in range(3):
        data = b""
        for i in range(40):
            payload = rng.choice([bytes(rng.randrange(256) for _ in range(rng.randint(0, 400))), record(b"in")[: rng.randint(0, 90)] * 4, b"\n" + record(b"x" * 500)])
            want.append((f"{k}.warc", len(data), payload))
            data += record(payload, version=rng.choice([b"1.0", b"1.1"]), name=rng.choice([b"Content-Length", b"content-length"]))
        (tmp_path / f"{k}.warc").write_bytes(data)
    blocks(size)
    got = [(r.file.split("/")[-1], r.offset, bytes(r.payload)) for r in warc.read(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("harm", [lambda x: x[:-1], lambda x: x[:-200], lambda x: x.replace(b"Content-Length: 50", b"Content-Length: 51", 1), lambda x: b"?" + x])
def test_damaged_archives_are_errors(spark, tmp_path, harm):
    (tmp_path / "a.warc").write_bytes(harm(record(b"a" * 50) + record(b"b" * 300)))
    with pytest.raises(ValueError, match="1 archives"):
        warc.read(spark, f"file://{tmp_path}")


def test_query_matches_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(queries.op12_warc_archive(spark, SF)) == expected(rows)


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
