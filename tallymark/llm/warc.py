"""WARC archives of pages, and a two-level capture index over them.

Archives hold a gzip member for each record; the member's head has its
compressed length (the "sl" field of the WARC annex on compression), so that
captures are listed without unpacking payloads. Of pages with equal payloads
of at least ``MIN_REVISIT`` bytes one is a response and the others are
revisits of it. The index sorts captures by reversed-host key; an index file
is a run of compressed blocks of captures, then a sparse directory with each
block's first and last key and place, then a footer. One more file of the same
form holds the first and last key of every index file. A lookup searches that
file's directory, reads a block of it, searches the directory of the index
file found there, reads one block, and then the record's range of the archive:
a fixed number of range reads, whatever the number of captures. Tasks read the
ranges themselves where Python opens the store, and have them from Spark by
``ranges`` elsewhere; the steps are the same.

Spark's text writer writes all files, one record each, so they may go to any
store that Spark writes to. Its line end stands for the last byte of a file:
zero for gzip (the high byte of the last member's size), a line feed for index
files.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import all_open, contents, let, listed, new_path, opened, removed_at_end, small_batches, sorted_groups, stored, table, text_slices
from tallymark.llm.ranges import range_reader

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
BLOCK_CAPTURES = 1000
FILE_BLOCKS = 200
DATE = "2024-01-01T00:00:00Z"
_FOOT = b"TALLYCDX"
_CRLF = b"\r\n"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.org:80/p?q`` is ``org,a,www:80)/p?q``; what can't be parsed stands as it is."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


#: Gzip head with an extra field: "sl", eight bytes, compressed and plain length of the member.
_HEAD = struct.Struct("<4sIBBH2sHII")
_GZIP = b"\x1f\x8b\x08\x04"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return _HEAD.pack(_GZIP, 0, 0, 255, 12, b"sl", 8, _HEAD.size + len(body) + 8, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _block(kind: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n"]
    head += [f"{k}: {v}\r\n" for k, v in fields]
    return "".join(head).encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + _CRLF * 2


def _info() -> bytes:
    return _member(_block("warcinfo", [("WARC-Record-ID", "<urn:x-tallymark:info>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))


def _stored_url(url: str) -> str:
    """A url as a record's head can hold it."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def _urn(page) -> str:
    return f"<urn:x-page:{'' if page is None else quote(str(page), safe='')}>"


def _page(urn: str) -> str | None:
    """The page_id, as text, in a record's name; an empty one is null."""
    return unquote(urn[12:-1]) or None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; the HTTP header of a revisit keeps the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _urn(page))]
    if url is not None:
        fields.append(("WARC-Target-URI", _stored_url(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _member(_block("response", fields, http + payload))
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    return _member(_block("revisit", fields, http))


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of an uncompressed record; names in lower case."""
    head, _, rest = data.partition(_CRLF * 2)
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    body = rest[: int(fields["content-length"])]
    if rest[len(body) :] != _CRLF * 2:
        raise ValueError("a record is cut off")
    http, payload = {}, b""
    if fields["warc-type"] in ("response", "revisit"):
        top, _, payload = body.partition(_CRLF * 2)
        http = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in top.decode().split("\r\n")[1:]))
    return fields, http, payload


def _length(head: bytes) -> int | None:
    """The compressed length of a member by its head, or None if it doesn't say."""
    if len(head) < _HEAD.size:
        return None
    magic, _, _, _, extra, name, n, length, _ = _HEAD.unpack_from(head)
    return length if (magic, extra, name, n) == (_GZIP, 12, b"sl", 8) else None


def members(size: int, read, most: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, uncompressed) of each gzip member of an archive; ``read(offset, length)`` fetches a range of it.

    With ``most`` only so much of a record is unpacked, and only the ranges
    needed for that are read. A member that doesn't tell its length is
    unpacked to its end.
    """
    at = 0
    while at < size:
        first = bytes(read(at, min(1 << 12, size - at)))
        length = _length(first)
        if length is not None:
            if at + length > size:
                raise ValueError("an archive is cut off")
            data = first if most is not None else bytes(read(at, length))
            yield at, length, zlib.decompressobj(31).decompress(data, most or 0)
            at += length
            continue
        z, pos, parts = zlib.decompressobj(31), at, []
        while not z.eof:
            if pos >= size:
                raise ValueError("an archive is cut off")
            parts.append(z.decompress(bytes(read(pos, min(1 << 14, size - pos)))))
            pos = min(pos + (1 << 14), size)
        end = pos - len(z.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def fields_of(data: bytes) -> dict[str, str]:
    """The WARC fields of a record, whose end may be missing; names in lower case."""
    head, end, _ = data.partition(_CRLF * 2)
    if not end:
        raise ValueError("a record's head is cut off")
    return dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))


def resolved(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages with digest and the page that each revisits.

    Null html is an empty payload. Among equal payloads the largest page_id is
    the response (all rows that have it, if rows repeat); null ids never are,
    unless no other id has the payload. Which page a row revisits is found
    from ids and digests alone; payloads are then joined with it by id and
    digest, so that a payload of many pages is no hot key.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = p.where(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    each = large.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    latest = each.groupBy("digest").agg(F.max("page_id").alias("latest"), F.sum("n").alias("n")).where("n > 1 AND latest IS NOT NULL").drop("n")
    refs = stored(each.join(latest, "digest").where(~F.col("page_id").eqNullSafe(F.col("latest"))).select(F.col("page_id").alias("own"), F.col("digest").alias("own_digest"), F.col("latest").alias("refers_to")), "warc-revisits")
    out = p.join(refs, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")), "left")
    return out.select("page_id", "url", "payload", "digest", "refers_to")


def _binary_files(df: DataFrame, path: str, last: str) -> None:
    df.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", last).option("compression", "none").text(path)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes page_id, url, html as WARC files of some ``ARCHIVE_BYTES`` each.

    Null html is an empty payload, a null url leaves its field out, and a null
    page_id an empty name. Repeated rows are records of their own. A payload
    of any length is one record, in memory as a whole. An empty table writes
    no archive. Other columns are not read. Sets the session's Arrow batch size.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0

        def file() -> pa.RecordBatch:
            if parts[-1][-1]:  # a member of 16 MB or more
                parts.append(_info())
            return pa.RecordBatch.from_pydict({"content": pa.array([b"".join(parts)[:-1]], pa.binary())})

        for batch in text_slices(batches, "payload"):
            for page, url, payload, digest, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                parts = parts or [_info()]
                parts.append(record(page, url, payload, digest, to))
                held += len(parts[-1])
                if held >= ARCHIVE_BYTES:
                    yield file()
                    parts, held = [], 0
        if parts:
            yield file()

    _binary_files(resolved(pages).mapInArrow(run, "content binary"), path, "\0")


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE_DDL = "key string, page_id string, file string, offset long, length long"
#: Bytes of a record that are unpacked for its WARC fields at first.
_FIELDS = 1 << 11


def _ahead(f, window: int = 1 << 16):
    """``read(offset, length)`` of a file, which fetches ``window`` bytes at a time where less is asked for."""
    start, held = 0, b""

    def read(at: int, n: int) -> bytes:
        nonlocal start, held
        if not start <= at <= at + n <= start + len(held):
            start, held = at, bytes(f.read_at(max(n, window), at))
        return held[at - start : at - start + n]

    return read


def captures(spark: SparkSession, path: str) -> DataFrame:
    """key, page_id (as text), file, offset, length of every response and revisit in the archives under ``path``.

    An empty or missing set of archives gives no rows. Members follow from one
    another, so where Python can't open the store they are walked in an
    archive's content.
    """
    small_batches(spark)

    def rows(name: str, size: int, read) -> pa.RecordBatch:
        out = []
        for offset, length, data in members(size, read, _FIELDS):
            try:
                fields = fields_of(data)
            except ValueError:  # longer fields than most
                fields = fields_of(zlib.decompress(bytes(read(offset, length)), 31))
            if fields["warc-type"] in ("response", "revisit"):
                out.append((surt(fields.get("warc-target-uri")), _page(fields["warc-record-id"]), name, offset, length))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 5, _CAPTURE, strict=True)], schema=_CAPTURE)

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                with opened(name) as f:
                    yield rows(name, size, _ahead(f))

    def by_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                view = memoryview(content.as_buffer())
                yield rows(name, len(view), lambda at, n: view[at : at + n])  # noqa: B023

    files = listed(spark, path)
    if all_open(files):
        return files.mapInArrow(by_range, _CAPTURE_DDL)
    return contents(spark, path).mapInArrow(by_content, _CAPTURE_DDL)


def index_bytes(blocks: list[list[list]]) -> bytes:
    """An index file without its last byte, which the writer adds. Rows begin with their first and last key."""
    out, directory, at = [], [], 0
    for rows in blocks:
        z = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode())
        directory.append([rows[0][0], rows[-1][1], at, len(z), len(rows)])
        out.append(z)
        at += len(z)
    sparse = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
    return b"".join(out) + sparse + at.to_bytes(8, "little") + len(sparse).to_bytes(8, "little") + _FOOT


def _span(first: list[bytes], last: list[bytes], key: bytes) -> range:
    """Which of rising ranges of keys can hold a key, by binary search."""
    return range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))


class Ranges:
    """Rows that begin with a first and a last key, in rising order of both."""

    def __init__(self, rows: list[list]):
        self.rows = rows
        self.first = [x[0].encode() for x in rows]
        self.last = [x[1].encode() for x in rows]

    def find(self, key: str) -> list[list]:
        """The rows that can hold a key, by binary search."""
        return [self.rows[k] for k in _span(self.first, self.last, key.encode())]


def _directory(packed: bytes) -> Ranges:
    return Ranges(json.loads(zlib.decompress(packed)))


class IndexFile:
    """An index file; ``read(offset, length)`` fetches a range of it."""

    def __init__(self, size: int, read):
        self.read = read
        foot = bytes(read(size - 25, 25))
        if foot[16:] != _FOOT + b"\n":
            raise ValueError("not a whole index file")
        self.directory = _directory(bytes(read(int.from_bytes(foot[:8], "little"), int.from_bytes(foot[8:16], "little"))))

    def block(self, at: int, n: int) -> list[list]:
        return json_rows(bytes(self.read(at, n)))

    def places(self, key: str) -> list[tuple[int, int]]:
        """(offset, length) of the blocks that can hold a key, by binary search in the directory."""
        return [tuple(x[2:4]) for x in self.directory.find(key)]

    def find(self, key: str) -> list[list]:
        """Rows of a key: its blocks by the directory, then a binary search in each."""
        return [row for at, n in self.places(key) for row in Ranges(self.block(at, n)).find(key)]


def _packed_directory(read, file: Column, size: Column) -> Column:
    """The directory of an index file as it lies there, by two range reads of Spark: the footer, then what that names."""

    def body(foot: Column) -> Column:
        little = lambda k: F.conv(F.concat(*[F.substring(foot, 2 * i + 1, 2) for i in range(k + 7, k - 1, -1)]), 16, 10).cast("long")
        whole = F.substring(foot, 33, 18) == (_FOOT + b"\n").hex().upper()
        return F.when(whole, read(file, little(0), little(8))).otherwise(F.raise_error(F.lit("not a whole index file")).cast("binary"))

    return let(F.hex(read(file, size - 25, F.lit(25))), body)


_TOP_DDL = "first string, last string, file string, size long"


def write_index(entries: DataFrame, path: str) -> None:
    """Sorts captures by key over all tasks and writes them as index files, and the file over these in ``path`` + "-top".

    Without captures there are no files.
    """
    spark = entries.sparkSession

    def pack(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
        blocks: list[list[list]] = [[]]

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"content": pa.array([index_bytes([b for b in blocks if b])], pa.binary())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks[-1].append(list(row))
                if len(blocks[-1]) >= BLOCK_CAPTURES:
                    if most and len(blocks) >= most:
                        yield file()
                        blocks = []
                    blocks.append([])
        if blocks[0]:
            yield file()

    # Equal keys may be many: file and offset make the order whole, so that a key's captures can span tasks.
    order = ["key", "page_id", "file", "offset"]
    dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("key").alias("first"), F.col("key").alias("last"), "page_id", "file", "offset", "length")
    _binary_files(dealt.mapInArrow(lambda x: pack(x, FILE_BLOCKS), "content binary"), path, "\n")

    def ends(directory: Ranges, name: str, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"first": [directory.rows[0][0]], "last": [directory.rows[-1][1]], "file": [name], "size": pa.array([size], pa.int64())})

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                with opened(name) as f:
                    yield ends(IndexFile(size, lambda at, n: f.read_at(n, at)).directory, name, size)  # noqa: B023

    def by_spark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield ends(_directory(packed), name, size)

    files = listed(spark, path)
    if all_open(files):
        rows = files.mapInArrow(by_range, _TOP_DDL)
    else:
        rows = files.select("path", "length", _packed_directory(range_reader(spark), F.col("path"), F.col("length"))).mapInArrow(by_spark, _TOP_DDL)
    # A row for each index file, of ``FILE_BLOCKS`` blocks each: one task sorts them.
    top = rows.repartition(1).sortWithinPartitions("first", "last")
    _binary_files(top.mapInArrow(lambda x: pack(x, None), "content binary"), path + "-top", "\n")


def _files_of(first: tuple[str, int], keys: Iterator[str]) -> Iterator[tuple[str, str, int, int, int]]:
    """(key, index file, its size, offset and length of a block) of the blocks that can hold each of the keys."""
    held: dict[str, IndexFile] = {}
    handles = []

    def index(name: str, size: int) -> IndexFile:
        if name not in held:
            while len(handles) > 1:  # the file over all others stays open, and the last one used
                old, f = handles.pop()
                del held[old]
                f.close()
            f = opened(name)
            handles.append((name, f))
            held[name] = IndexFile(size, lambda at, n: f.read_at(n, at))
        return held[name]

    top = index(*first)
    for key in keys:
        for _, _, name, size in top.find(key):
            for at, n in index(name, size).places(key):
                yield key, name, size, at, n
    for _, f in handles:
        f.close()


#: Keys with the file or block to search for each next; ``first`` where it isn't that of the row before.
_FILE = pa.schema([("key", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("first", pa.bool_())])
_PLACE = pa.schema([("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.bool_())])


def _mapped(rows: DataFrame, run, schema: pa.Schema, most: int = 8192) -> DataFrame:
    """The tuples of ``run(rows of a task)``, with ``first`` if the schema has it."""

    def flagged(found: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for row in found:
            yield *row, row[1:] != last
            last = row[1:]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = run(row for batch in given for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = flagged(found) if "first" in schema.names else found
        while held := list(islice(found, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    return rows.mapInArrow(batches, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _searched(rows: DataFrame, data: Column, unpack, found, schema: pa.Schema) -> DataFrame:
    """The tuples of ``found(unpack(data), key, ...)`` for each row; data is read at rows that are ``first``."""

    def run(given: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for *row, packed in given:
            held = held if packed is None else unpack(packed)
            yield from found(held, *row)

    return _mapped(rows.withColumn("data", F.when(F.col("first"), data)).drop("first"), run, schema)


def _lookup_by_spark(spark: SparkSession, first: tuple[str, int], wanted: DataFrame) -> DataFrame:
    """The steps of a lookup with ranges that Spark reads: the top directory, a block of that file, an index file's directory, a block of it."""
    read = range_reader(spark)
    name, size = first
    # An entry of this directory stands for ``BLOCK_CAPTURES`` index files.
    top = _directory(bytes(spark.range(1).select(_packed_directory(read, F.lit(name), F.lit(size))).first()[0]))
    block = read(F.col("file"), F.col("at"), F.col("n"))
    directory = _packed_directory(read, F.col("file"), F.col("size"))
    rows = lambda data: Ranges(json_rows(data))
    # Each task goes through its own range of the keys as far as the blocks of captures.
    keys = wanted.repartitionByRange("key").sortWithinPartitions("key")
    tops = _mapped(keys, lambda given: ((k, name, *x[2:4]) for (k,) in given for x in top.find(k)), _PLACE)
    files = _searched(tops, block, rows, lambda f, key, *_: ((key, *x[2:4]) for x in f.find(key)), _FILE)
    places = _searched(files, directory, _directory, lambda f, key, name, _: ((key, name, *x[2:4]) for x in f.find(key)), _PLACE)
    places = places.withColumn("first", F.row_number().over(W.partitionBy("file", "at").orderBy("key")) == 1)
    return _searched(places, block, rows, lambda f, key, *_: (tuple(x[1:]) for x in f.find(key)), _CAPTURE)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Captures of the keys in the one column of ``keys``, through the directories; each block is read once.

    Absent and null keys have none, and repeated keys count once. A key with
    many captures has many blocks, which different tasks read. Where Python
    can't open the store, Spark reads the same ranges.
    """
    small_batches(spark)
    wanted = keys.toDF("key").where("key IS NOT NULL").distinct()
    first = [tuple(r) for r in listed(spark, path + "-top").collect()]  # one file at most
    if not first:
        return spark.createDataFrame([], _CAPTURE_DDL)
    if not all_open(listed(spark, path)):
        return _lookup_by_spark(spark, first[0], wanted)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "file", "size", "at", "n"])

        rows = []
        for row in _files_of(first[0], (k for batch in batches for k in batch.column("key").to_pylist())):
            rows.append(row)
            if len(rows) >= 8192:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["file", "at"]):
            name, size, at, n = (group.column(c)[0].as_py() for c in ("file", "size", "at", "n"))
            own = set(group.column("key").to_pylist())
            with opened(name) as f:
                rows = [r[1:] for r in json_rows(f.read_at(n, at)) if r[0] in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(list(zip(*rows, strict=True)) or [()] * 5, _CAPTURE, strict=True)], schema=_CAPTURE)

    places = wanted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(search, "key string, file string, size long, at long, n long")
    return places.repartition("file", "at").sortWithinPartitions("file", "at").mapInArrow(read, _CAPTURE_DDL)


def json_rows(block: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the index files under ``path``, block after block."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                view = memoryview(content.as_buffer())
                f = IndexFile(len(view), lambda at, n, v=view: v[at : at + n])
                for x in f.directory.rows:
                    rows = [r[1:] for r in f.block(x[2], x[3])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)

    return contents(spark, path).select("content").mapInArrow(run, _CAPTURE_DDL)


def _row(data: bytes) -> tuple:
    fields, http, payload = parse(data)
    digest, n = fields["warc-payload-digest"][5:], int(http["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't match its digest")
    return _page(fields["warc-record-id"]), n, digest, fields["warc-type"], _page(fields.get("warc-refers-to", ""))


_ROWS = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
_ROWS_DDL = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_records(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """The record of every capture, by a range read of its archive; ids are text, as the archives have them.

    Captures of one archive (a bounded number) come to one task, which opens
    the file once. Where Python can't open the store, Spark reads the ranges.
    Without captures there are no rows.
    """
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, _ROWS, strict=True)], schema=_ROWS)

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["file"]):
            with opened(group.column("file")[0].as_py()) as f:
                rows = [_row(zlib.decompress(f.read_at(n, at), 31)) for at, n in zip(group.column("offset").to_pylist(), group.column("length").to_pylist(), strict=True)]
            yield out(rows)

    def by_spark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield out([_row(zlib.decompress(x.as_buffer(), 31)) for x in batch.column("data")])

    dealt = entries.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    if all_open(entries.select(F.col("file").alias("path"))):
        return dealt.mapInArrow(by_range, _ROWS_DDL)
    read = range_reader(spark)
    return dealt.select(read(F.col("file"), F.col("offset"), F.col("length")).alias("data")).mapInArrow(by_spark, _ROWS_DDL)


def url_keys(pages: DataFrame) -> DataFrame:
    """The keys of all urls, null ones included, as the index has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([surt(None if u is None else _stored_url(u)) for u in batch.column("url").to_pylist()], pa.string())})

    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "key string")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    removed_at_end(spark, archives, index, index + "-top")
    write_archives(pages, archives)
    write_index(captures(spark, archives), index)
    found = stored(lookup(spark, index, url_keys(pages)), "warc-captures")
    kind = pages.schema["page_id"].dataType
    return read_records(spark, found).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages)
"""
