"""WARC archives of pages, and a two-level index of their captures.

Every page becomes a gzip member of its own in an archive. Of pages with equal payloads one is a
``response``, the others are ``revisit`` records, which name it and have no payload.

Captures are sorted by their URL's key, whose host is reversed so that a site stands together, and
cut into compressed blocks of ``BLOCK`` lines. An index file ends with its block directory: the first key
of each block and where it lies. A search bisects the files' first and last keys, then a file's
directory, reads only the blocks that may hold the key, and of the archives only the records' bytes.

Files are named after the task attempt that wrote them and count only where a row names them, so a
task that runs again does no harm. They lie in a folder that all executors share, of any kind that
Arrow opens (a path, file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.schemas import to_arrow
from ripplet.llm.common import split_join

#: Captures of an index block; bytes after which an archive is closed.
BLOCK, ARCHIVE = 512, 1 << 30
#: Bytes of an archive whose records one task reads in turn; a gap that is read over; bytes of one read.
CHUNK, GAP, MOST = 1 << 20, 1 << 16, 1 << 23
#: The id of a page without one.
NO_ID = -(1 << 63)
URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"
CAPTURE = "key string, id long, file string, at long, size long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """The sort key of a URL: its host's parts from last to first, in lower case, then the rest without a fragment.

    ``https://a.example.org/x?y#z`` gives ``org,example,a)/x?y``. What has no host is its own key, null the empty one.
    """
    host, port, rest = (F.regexp_extract(url, URL, k) for k in (1, 2, 3))
    reversed_host = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    key = F.when(url.rlike(URL), F.concat(reversed_host, port, F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("")))
    for sign, name in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(sign), F.lit(name))
    return key


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if local := re.match(r"file:/*(/.*)", path):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, owner: int | None, date: str) -> bytes:
    """A record: with a payload a response, without one (``owner``) a revisit."""
    clean = (url or "").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if owner is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + clean)
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if owner is None:
        block += payload
    else:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % owner]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """``RECORD`` and the payload (null for a revisit) of one uncompressed record; a ``ValueError`` if it is broken."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = dict(line.split(b": ", 1) for line in lines)
    length = int(fields.get(b"Content-Length", -1))
    if not found or not version.startswith(b"WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("a broken WARC record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\nContent-Length: ([0-9]+)", http)[1])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    ids = [None if (x := fields.get(f, b"<urn:page:None>")[len("<urn:page:") : -1]) == b"None" else int(x) for f in (b"WARC-Record-ID", b"WARC-Refers-To")]
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"page {ids[0]}: the payload is not what was written")
    url = fields.get(b"WARC-Target-URI")
    return ids[0], url.decode() if url is not None else None, n, digest, kind, ids[1], payload if kind == "response" else None


def _revisits(rows: DataFrame) -> DataFrame:
    """``(sha, id, owner)`` of the pages whose payload a page with a larger id has too."""
    narrow = rows.select("sha", "id")
    owners = narrow.groupBy("sha").agg(F.max("id").alias("owner"), F.min("id").alias("least")).where("least < owner").drop("least")
    return split_join(narrow, owners, "sha").where("id < owner").distinct()


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html, …)`` below ``folder``; its captures, in the columns of ``CAPTURE``.

    Null payloads are empty ones. Of records with equal payloads those with the largest page_id are
    responses (one, but for rows of one id), the others revisit them; a null id is below all others.
    The captures are a table in the folder, so a page is written once.
    """
    schema = to_arrow(CAPTURE)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    url, number = F.col("url").cast("string"), F.col("page_id").cast("long")
    rows = pages.select(F.coalesce(number, F.lit(NO_ID)).alias("id"), url.alias("url"), url_key(url).alias("key"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    held = rows.join(_revisits(rows), ["sha", "id"], "left")  # no hot key: an id has few rows; the planner sends the revisits around if they are few
    held = held.select("id", "url", "key", F.when(F.col("owner").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("n"), "sha", "owner")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _folder(folder)
        task, out, at, count = TaskContext.get(), None, 0, 0
        for batch in batches:
            made = []
            for number, url, key, data, n, sha, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    name, at, count = f"{task.partitionId():05d}-{task.taskAttemptId()}-{count}.warc.gz", 0, count + 1
                    system.create_dir(f"{root}/archives", recursive=True)
                    out = system.open_output_stream(f"{root}/archives/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = gzip.compress(_record(None if number == NO_ID else number, url, data, digest, n, owner, date), 6, mtime=0)
                out.write(member)
                made.append((key, None if number == NO_ID else number, name, at, len(member)))
                at += len(member)
            yield _batch(made, schema)
        if out is not None:
            out.close()

    held.mapInArrow(write, CAPTURE).write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(CAPTURE).parquet(f"{folder}/captures")


def write_index(captures: DataFrame, folder: str) -> None:
    """The index of ``captures`` below ``folder``: files of compressed blocks in the order of the keys, and the table of these files."""
    kind = "name string, first string, last string, n long"
    schema = to_arrow(kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _folder(folder)
        task, directory, lines, out, at, keys, n = TaskContext.get(), [], [], None, 0, [], 0
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.cdx"

        def close_block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append(f"{lines[0].partition(chr(9))[0]}\t{at}\t{len(data)}")
            out.write(data)
            at += len(data)
            lines.clear()

        for batch in batches:
            for key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(f"{root}/index", recursive=True)
                    out = system.open_output_stream(f"{root}/index/{name}", compression=None)
                    keys = [key]
                keys[1:], n = [key], n + 1
                lines.append("\t".join([key, *("" if x is None else str(x) for x in rest)]))
                if len(lines) == BLOCK:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            data = zlib.compress("\n".join(directory).encode(), 6)
            out.write(data + struct.pack("<QQ", at, len(data)))
            out.close()
            yield _batch([(name, keys[0], keys[-1], n)], schema)

    ordered = captures.select("key", "id", "file", "at", "size").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    ordered.mapInArrow(write, kind).write.parquet(f"{folder}/files")


def _directory(system: fs.FileSystem, path: str) -> tuple[list[str], list[tuple[int, int]]]:
    """First keys and places of an index file's blocks, by two range reads."""
    with system.open_input_file(path) as f:
        size = f.size()
        at, n = struct.unpack("<QQ", f.read_at(16, size - 16))
        lines = zlib.decompress(f.read_at(n, at)).decode().split("\n")
    rows = [line.split("\t") for line in lines]
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


def _order(text: str) -> bytes:
    """Keys are in the order of their UTF-8 bytes."""
    return text.encode()


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """All captures, in the columns of ``CAPTURE``, of the URL keys ``keys(key)``; repeated and unknown keys are allowed, null ones have none.

    Keys go to the blocks that may hold them, then each of these blocks is read once. A key of many
    captures has many blocks, so it is spread. The driver sees a row for each index file.
    """
    spark = keys.sparkSession
    files = sorted(spark.read.schema("name string, first string, last string").parquet(f"{folder}/files").collect(), key=lambda r: (_order(r["first"]), _order(r["last"]), r["name"]))
    names, firsts, lasts = [r["name"] for r in files], [_order(r["first"]) for r in files], [_order(r["last"]) for r in files]
    kind = "key string, name string, at long, size long"
    placed, found = to_arrow(kind), to_arrow(CAPTURE)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _folder(folder)
        blocks_of = lru_cache(8)(lambda name: (lambda d: ([_order(k) for k in d[0]], d[1]))(_directory(system, f"{root}/index/{name}")))
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                at = _order(key)
                for k in range(bisect_left(lasts, at), bisect_right(firsts, at)):
                    heads, places = blocks_of(names[k])
                    for b in range(max(0, bisect_left(heads, at) - 1), bisect_right(heads, at)):
                        out.append((key, names[k], *places[b]))
                    if len(out) > 10_000:
                        yield _batch(out, placed)
                        out = []
            yield _batch(out, placed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _folder(folder)
        file = lru_cache(1)(lambda name: system.open_input_file(f"{root}/index/{name}"))
        block = lru_cache(1)(lambda name, at, size: [x.split("\t") for x in zlib.decompress(file(name).read_at(size, at)).decode().split("\n")])
        heads = lru_cache(1)(lambda *place: [_order(r[0]) for r in block(*place)])
        for batch in batches:
            out = []
            for key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, at = block(*place), _order(key)
                for _, number, name, begin, size in rows[bisect_left(heads(*place), at) : bisect_right(heads(*place), at)]:
                    out.append((key, int(number) if number else None, name, int(begin), int(size)))
                if len(out) > 10_000:
                    yield _batch(out, found)
                    out = []
            yield _batch(out, found)

    distinct = keys.where("key is not null").select("key").distinct()
    routed = distinct.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(route, kind)
    return routed.repartition("name", "at").sortWithinPartitions("name", "at", "key").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """``RECORD``, with ``payload`` also the bytes, of each of ``captures(file, at, size, …)``, by range reads of the archives.

    Records that lie close together are read at once. A record that is not what was written is an error.
    """
    kind = RECORD + ", payload binary" * payload
    schema = to_arrow(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _folder(folder)
        file = lru_cache(1)(lambda name: system.open_input_file(f"{root}/archives/{name}"))
        for batch in batches:
            places, k = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), 0
            while k < len(places):
                name, begin, size = places[k]
                run, end = [places[k]], begin + size
                while (k := k + 1) < len(places) and places[k][0] == name and places[k][1] <= end + GAP and places[k][1] + places[k][2] - begin <= MOST:
                    run.append(places[k])
                    end = max(end, places[k][1] + places[k][2])
                data = file(name).read_at(end - begin, begin)
                parsed = (parse_record(zlib.decompress(data[at - begin : at - begin + n], 31)) for _, at, n in run)
                yield _batch([r if payload else r[:-1] for r in parsed], schema)

    spread = captures.select("file", "at", "size").repartition("file", F.expr(f"at div {CHUNK}")).sortWithinPartitions("file", "at")
    return spread.mapInArrow(read, kind)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` and their index below ``folder``, then look up every page's URL there and read its records: ``RECORD`` for each page.

    An empty table gives no rows. Other columns are not read.
    """
    write_index(write_archives(pages, folder), folder)
    return read_records(lookup(pages.select(url_key(F.col("url").cast("string")).alias("key")), folder), folder)
