r"""WARC archives written and read by Spark's own text files, whose separators are what records end and begin with.

Written: each row is one line that ends with \r\n\r\n, so a part file is an archive. Equal payloads are stored once: that of the
largest id is the response, others revisit it. Payloads stay where they are but for those whose digest falls into one of
2**BUCKET_BITS buckets that hold repeated ones; these are joined on digest and salt, of which a bucket has as many as its
largest group needs. Only the buckets, a bounded number, are broadcast.

Read: files are split at \nWARC/1. by the reader, so any number of tasks reads one file, on any store that Spark reads. A
payload may hold that too, so pieces are only candidates: each task emits the offsets of its candidates and where each
candidate's successor would begin, already followed to the first one beyond the task's block. Pointers from block to block are
then jumped in Spark from each file's start, twice as far each round: what is reached is a record, all else lies in payloads.
A chain that doesn't end at the file's end is an error (truncated or damaged), and so are pieces that don't add up to the file.
A second reading starts in each block at its first record; parts of records that go on in another block are put together by
a shuffle. What it needs of each block, 40 bytes or so, is broadcast: 60 MB for 190 TB in blocks of 128 MB.

Null and empty payloads are empty. A null id is less than any other and written as none; a null URI is left out. Rows of one
payload and of its largest id are all responses. URIs' line breaks are escaped. Long payloads are whole. An empty table makes
an archive without records. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import Cut, arrow_batches, trimmed
from assayer.sources.tables import scratch

BUCKET_BITS = 20
#: Rows of one payload that a salt takes.
SALT_ROWS = 5_000
#: Where pieces part, and how much of that belongs to the record that begins there.
_MAGIC = b"WARC/1."
_PART = b"\n" + _MAGIC
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]{1,15})[ \t]*\r\n", re.I)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Base 32 (A-Z, 2-7) of hexadecimal digits whose number is a multiple of five."""
    each = F.transform(F.sequence(F.lit(1), F.length(hexadecimal), F.lit(5)), lambda i: F.lpad(F.conv(hexadecimal.substr(i, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(each, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _referred(rows: DataFrame, least: int) -> DataFrame:
    """rows (id, uri, payload, digest) with `top`: the largest id of its payload where another row holds that id, and `more`: whether its payload repeats."""
    bucket = F.expr(f"cast(conv(substring(digest, 1, {BUCKET_BITS // 4}), 16, 10) as int)")
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    repeated = Cut(groups.where("n > 1").withColumn("bucket", bucket), "repeated").df
    buckets = F.broadcast(repeated.groupBy("bucket").agg((1 + F.expr(f"max(n) div {SALT_ROWS}")).alias("salts")))
    marked = rows.withColumn("bucket", bucket).join(buckets, "bucket", "left")
    once = marked.where("salts is null").select("id", "uri", "payload", "digest", F.lit(None).cast("long").alias("top"), F.lit(False).alias("more"))
    dealt = repeated.join(buckets, "bucket").select(F.col("digest").alias("_digest"), "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("_salt"))
    some = marked.where("salts is not null").withColumn("salt", F.pmod(F.xxhash64("id", "uri"), F.col("salts")))
    met = some.join(dealt.hint("merge"), (F.col("digest") == F.col("_digest")) & (F.col("salt") == F.col("_salt")), "left")
    return once.unionByName(met.select("id", "uri", "payload", "digest", "top", F.col("_digest").isNotNull().alias("more")))


def write(rows: DataFrame, path: str, least: int = 0) -> None:
    """Archives of rows (id long, uri string, payload binary) under path; equal payloads of at least `least` bytes are stored once."""
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("uri").cast("string").alias("uri"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    told = _referred(own.withColumn("digest", F.sha1("payload")), least)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("more") & ~F.col("id").eqNullSafe(F.col("top"))
    uri = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")),
        F.when(F.col("uri").isNotNull(), line("WARC-Target-URI", uri)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        line("X-Payload-Length", F.octet_length("payload").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("top")), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.octet_length("payload").cast("string"))),
        F.lit("\r\n"),
    ]
    record = F.concat(*(x.cast("binary") for x in head), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    told.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "none").text(path)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, f (its hash), b (the block's start), size, value: what lies between the separators, in order within a block."""
    arrow_batches(spark)
    rows = spark.read.option("lineSep", _PART.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _head(piece: bytes, first: bool) -> tuple[int, int] | None:
    """(bytes of the header, of the whole record) if a piece begins as a record does; `first` pieces of a file hold the magic themselves."""
    text = piece[len(_MAGIC) :] if first else piece
    if text[:3] not in (b"0\r\n", b"1\r\n") or (first and not piece.startswith(_MAGIC)):
        return None
    end = text.find(b"\r\n\r\n")
    if end < 0 and text.endswith(b"\r\n\r"):  # the separator took the last byte: the payload begins with the magic
        end = len(text) - 3
    length = _LENGTH.search(text[: end + 2]) if end >= 0 else None
    if length is None:
        return None
    head = len(_MAGIC) + end + 4
    return head, head + int(length[1]) + 4


_MARKS = "f long, b long, size long, total long, start long, exit long, last long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: its bytes, and its candidates' starts with where their chains leave the block and from which record; offsets count from the block's first piece."""
    names = [x.split()[0] for x in _MARKS.split(", ")]

    def block(key: tuple, size: int, total: int, found: list[tuple[int, int]]) -> pa.RecordBatch:
        exits, rows = {}, [(*key, size, total, None, None, None)]
        for start, after in reversed(found):
            exits[start] = exits.get(after, (after, start))
            rows.append((*key, size, None, start, *exits[start]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    key, size, at, found = None, 0, 0, []
    for batch in batches:
        for f, b, n, value in zip(*(batch.column(c).to_pylist() for c in ("f", "b", "size", "value"))):
            if (f, b) != key:
                if key is not None:
                    yield block(key, size, at, found)
                key, size, at, found = (f, b), n, 0, []
            first = b == 0 and at == 0
            head = _head(value, first)
            if head is not None:
                start = at if first else at - len(_MAGIC)
                found.append((start, start + head[1]))
            at += len(value) + len(_PART)
    if key is not None:
        yield block(key, size, at, found)


def _reached(nodes: DataFrame) -> DataFrame:
    """Of nodes (f, start, exit), those on the chain from each file's start: (f, start). Each round follows pointers twice as long."""
    reach = Cut(nodes.where("start = 0").select("f", "start"), "reach").df
    jump = nodes.select("f", "start", "exit")
    n = reach.count()
    while n:
        ahead = jump.join(reach, ["f", "start"], "left_semi").select("f", F.col("exit").alias("start")).join(nodes.select("f", "start"), ["f", "start"], "left_semi")
        reach = Cut(reach.unionByName(ahead).distinct(), "reach").df
        more = reach.count()
        if more == n:
            break
        n = more
        on = jump.select("f", F.col("start").alias("exit"), F.col("exit").alias("further"))
        jump = Cut(jump.join(on, ["f", "exit"], "left").select("f", "start", F.coalesce("further", "exit").alias("exit")), "jump").df
    return reach


def _blocks(pieces: DataFrame) -> DataFrame:
    """(f, b, base, entry, open): where each block's first piece lies in its file, its first record from there, and the record that is open before it."""
    marks = Cut(pieces.select("f", "b", "size", "value").mapInArrow(trimmed(_candidates), _MARKS), "marks").df
    own = Window.partitionBy("f").orderBy("b")
    totals = marks.where("total is not null")
    blocks = Cut(totals.select("f", "b", "size", (F.sum("total").over(own) - F.col("total")).alias("base"), F.sum("total").over(Window.partitionBy("f")).alias("bytes")), "blocks").df
    found = marks.where("total is null").join(blocks.select("f", "b", "base"), ["f", "b"])
    found = found.select("f", "b", "base", *((F.col(c) + F.col("base")).alias(c) for c in ("start", "exit", "last")))
    # Only where a chain from another block may arrive, or a file begins, does a pointer start.
    targets = found.select("f", F.col("exit").alias("start")).unionByName(blocks.select("f", F.lit(0).cast("long").alias("start"))).distinct()
    nodes = Cut(found.join(targets, ["f", "start"], "left_semi"), "nodes").df
    real = nodes.join(_reached(nodes), ["f", "start"], "left_semi")
    real = Cut(real.select("f", "b", "start", "exit", "last"), "entries").df
    ends = blocks.groupBy("f").agg(F.max(F.col("bytes") - len(_PART)).alias("end"), F.max("size").alias("size"))
    broken = ends.join(real.select("f", F.col("exit").alias("end"), F.lit(True).alias("whole")), ["f", "end"], "left").agg(F.count_if(F.col("whole").isNull()))
    if n := broken.first()[0]:
        raise ValueError(f"{n} archives hold a chain of records that does not end at the file's end")
    rows = blocks.join(real.select("f", "b", F.col("start").alias("entry"), "last"), ["f", "b"], "left")
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("f", "b", "base", "entry", F.last("last", True).over(before).alias("open"))


def _record(data: bytes) -> tuple:
    """(type, headers, payload) of a record's bytes."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    low = {k.lower(): v for k, v in headers.items()}
    return low.get("warc-type"), headers, data[end + 4 : end + 4 + int(low["content-length"])]


_RECORD_FIELDS = [("file", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
_RECORDS = "file string, offset long, type string, headers map<string,string>, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and parts (at, data) of those that go on in another block."""
    schema = pa.schema([*_RECORD_FIELDS, ("at", pa.int64())])

    def told(file: str, offset: int, at: int, length: int | None, data: list[bytes]) -> tuple:
        whole = b"".join(data)
        # The last byte of a record is part of the next separator.
        if length is not None and len(whole) >= length - 1:
            return (file, offset, *_record(whole), None)
        return (file, offset, None, None, whole, at)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        columns[3] = [None if h is None else list(h.items()) for h in columns[3]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    key, now, out, size = None, None, [], 0
    for batch in batches:
        for file, f, b, base, entry, before, value in zip(*(batch.column(c).to_pylist() for c in ("file", "f", "b", "base", "entry", "open", "value"))):
            if (f, b) != key:
                if now is not None:
                    out.append(told(*now))
                # Until the block's first record, bytes belong to the one that is open before it.
                key, at, expect, now = (f, b), base, entry, None if before is None else (file, before, base - len(_PART), None, [])
            first = at == 0
            start = at if first else at - len(_MAGIC)
            if start == expect:
                if now is not None and now[4]:
                    out.append(told(*now))
                length = _head(value, first)[1]
                now, expect = (file, start, start, length, [value if first else _MAGIC + value]), start + length
            else:
                now[4].append(_PART + value)
            at += len(value) + len(_PART)
            size += len(value)
            if size >= 1 << 22 and out:
                yield batch_of(out)
                out, size = [], 0
    if now is not None and now[4]:
        out.append(told(*now))
    if out:
        yield batch_of(out)


def _joined(rows: pa.Table) -> pa.Table:
    """A record from its parts."""
    parts = sorted(zip(rows.column("at").to_pylist(), rows.column("payload").to_pylist()))
    kind, headers, payload = _record(b"".join(x for _, x in parts))
    values = [rows.column("file")[0].as_py(), rows.column("offset")[0].as_py(), kind, list(headers.items()), payload]
    return pa.table({name: pa.array([v], t) for (name, t), v in zip(_RECORD_FIELDS, values)})


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of the archives under path: file, offset, type, headers, payload."""
    pieces = _pieces(spark, path)
    blocks = _blocks(pieces)
    met = pieces.join(F.broadcast(blocks), ["f", "b"]).select("file", "f", "b", "base", "entry", "open", "value")
    rows = met.mapInArrow(trimmed(_read), _RECORDS + ", at long")
    parts = rows.where("at is not null").groupBy("file", "offset").applyInArrow(_joined, _RECORDS)
    return rows.where("at is null").drop("at").unionByName(parts)


def _header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def report(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of read()'s records: a response's from its payload, a revisit's from its header."""
    page = lambda name: F.regexp_extract(F.coalesce(_header(name), F.lit("")), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    told = F.col("type") == "revisit"
    return records.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(told, _header("X-Payload-Length").try_cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(told, F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "")).otherwise(base32(F.sha1("payload"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(told, page("WARC-Refers-To")).alias("refers_to"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) written to archives under the shared folder and read back: report()'s rows."""
    path = scratch(pages.sparkSession, "warc")
    write(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").cast("string").cast("binary").alias("payload")), path)
    return report(read(pages.sparkSession, path))
