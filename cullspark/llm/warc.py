"""Web archives in ZIP packages: written by partition, read back by byte ranges without extraction.

A package holds a WARC file, each record its own gzip member, and an index of them in CDXJ (a key, a time and
an object with url, filename, offset and length), both stored and not deflated. A reader finds archives and
indexes by folder and suffix in the central directory, any number of either, reads the indexes and then only
the ranges of the records it wants. An archive that no index names isn't read. Files are read and written with pyarrow's file systems, so any shared store will do.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Where a package has its archives and indexes, and how their names end.
ARCHIVES, INDEXES = ("archive/", (".warc.gz", ".warc")), ("indexes/", (".cdxj", ".cdx", ".idx"))
#: Payloads under so many bytes are never revisits.
REVISIT_BYTES = 100
#: A package ends when it has so many bytes of records; a task holds them until then.
PACKAGE_BYTES = 32 << 20
READ_BYTES = 4 << 20
#: Records that one reading task is dealt, roughly.
TASK_RECORDS = 2_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX_SCHEMA = "path string, offset long, length long, page_id long, url string"
_RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


# --- ZIP directories


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset and size of the data of each stored member. f: has seek and read."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = at(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", locator[8:16])
        count, length, start = struct.unpack("<QQQ", at(end64, 56)[32:56])
    directory, found, i = at(start, length), {}, 0
    for _ in range(count):
        if directory[i : i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, i + 10)[0]
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, i + 20)
        (header,) = struct.unpack_from("<I", directory, i + 42)
        name = directory[i + 46 : i + 46 + n_name].decode("utf-8", "replace")
        extra, j = directory[i + 46 + n_name : i + 46 + n_name + n_extra], 0
        while j + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, j)
            if kind == 1:  # ZIP64: only the fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, j + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            j += 4 + n
        if method == 0:
            local = at(header, 30)
            found[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        i += 46 + n_name + n_extra + n_note
    return found


# --- writing


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c >= " ")


def record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One WARC record: a response, or with first a revisit of that page, whose HTTP header is kept."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"] if first is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def key_of(url: str | None) -> str:
    """What an index sorts by: the parts of the host from the last to the first, then the path, in lower case."""
    try:
        parts = urlsplit(_clean(url).strip().lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:  # what is no address is its own key
        host, rest = "", _clean(url).lower()
    return f"{host}){rest}".replace(" ", "%20")


def _package(folder: str, rows: list[tuple[bytes, int | None, str | None]]) -> tuple[str, int]:
    """Writes one package. Its name is new each time: the manifest says which of a retried task's files count."""
    path, index, at = f"{folder}/{uuid.uuid4().hex}.wacz", [], 0
    store, local = pafs.FileSystem.from_uri(path)
    store.create_dir(local.rpartition("/")[0], recursive=True)
    with store.open_output_stream(local) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(WARC), "w", force_zip64=True) as w:
            for data, page_id, url in rows:
                w.write(data)
                line = {"id": page_id, "url": url, "filename": WARC.rpartition("/")[2], "offset": str(at), "length": str(len(data))}
                index.append(f"{key_of(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(line)}")
                at += len(data)
        with z.open(zipfile.ZipInfo(INDEX), "w") as w:
            w.write("".join(f"{x}\n" for x in sorted(index)).encode("utf-8", "replace"))
    return path, len(rows)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages; returns the manifest: path and records of each package."""
    folder = folder or new_folder(pages.sparkSession, "wacz")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    known = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    known = cut(known, "digests")
    groups = cut(known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n"), "groups")
    again = known.join(groups, "digest").where("not page_id <=> first").distinct()
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path, n = _package(folder, held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                held.append((pack.compress(record(page_id, url, payload, digest, first)) + pack.flush(), page_id, url))
                size += len(held[-1][0]) + 200  # and its line of the index
                if size >= PACKAGE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return cut(marked.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "path string, records long"), "manifest")


# --- reading


def _named(found: dict[str, tuple[int, int]], kind: tuple[str, tuple[str, ...]]) -> dict[str, tuple[int, int]]:
    """The stored members in a folder whose names end so, by their names in it."""
    folder, ends = kind
    return {n[len(folder) :]: place for n, place in found.items() if n.startswith(folder) and n.lower().endswith(ends)}


def _entry(line: bytes, archives: dict[str, tuple[int, int]]) -> tuple | None:
    """Offset in the package, length, page id and url of a line of an index; None for one that names no record here."""
    text = line.decode("utf-8", "replace")
    try:
        row = json.loads(text[text.index("{") :])
        name = row.get("filename")
        start, size = archives[name] if name is not None else next(iter(archives.values())) if len(archives) == 1 else (None, 0)
        offset, length = int(row["offset"]), int(row["length"])
    except (ValueError, KeyError, TypeError):
        return None
    if start is None or offset < 0 or length <= 0 or offset + length > size:
        return None
    return start + offset, length, row.get("id") if isinstance(row.get("id"), int) else None, row.get("url")


def index(manifest: DataFrame) -> DataFrame:
    """Where each record of the packages lies: path, offset, length, page_id (null in a package of others), url. Lines that name no record are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as f:
                    found = members(f, f.size())
                    archives = _named(found, ARCHIVES)
                    for at, left in _named(found, INDEXES).values():
                        rest = b""
                        while left:
                            f.seek(at)
                            data = f.read(min(left, READ_BYTES))
                            at, left = at + len(data), left - len(data)
                            *lines, rest = (rest + data).split(b"\n")
                            lines += [rest] if not left else []  # the last line may have no end
                            rows = [r for x in lines if (r := _entry(x, archives))]
                            columns = list(zip(*rows)) or [[], [], [], []]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["path", "offset", "length", "page_id", "url"])

    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(tasks).mapInArrow(run, _INDEX_SCHEMA)


_PAGE = re.compile(r"<urn:page:(\d+)>$")


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by name in lower case."""
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(data: bytes) -> tuple:
    """Page id, url, payload bytes, payload digest, type, referred page and payload of one record, a gzip member or plain.

    Page ids are of the packages written here and null in others; so is what a revisit of another's doesn't say.
    """
    head, _, body = (zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data).partition(b"\r\n\r\n")
    fields = _fields(head)
    block = body[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    page = lambda name: int(m[1]) if (m := _PAGE.match(fields.get(name, ""))) else None
    kind, url = fields.get("warc-type"), fields.get("warc-target-uri")
    if kind == "revisit":
        size, digest = _fields(http).get("content-length"), fields.get("warc-payload-digest", "")
        return page("warc-record-id"), url, int(size) if size else None, digest.removeprefix("sha256:") or None, kind, page("warc-refers-to"), None
    return page("warc-record-id"), url, len(payload), hashlib.sha256(payload).hexdigest(), kind, None, payload


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Joins records that lie side by side to reads of READ_BYTES: path, start, end and the records in it."""
    now: tuple | None = None
    for path, offset, length in rows:
        if now and now[0] == path and offset == now[2] and offset + length - now[1] <= READ_BYTES:
            now[3].append((offset, length))
            now = (path, now[1], offset + length, now[3])
            continue
        if now:
            yield now
        now = (path, offset, offset + length, [(offset, length)])
    if now:
        yield now


def read_records(wanted: DataFrame, payload: bool = False) -> DataFrame:
    """Records of an index (path, offset, length, url): page_id, url, payload_bytes, payload_digest, record_type, refers_to; with payload also that.

    The url is the index's: a record's header has no room for control characters.
    """
    n = max(1, wanted.count() // TASK_RECORDS)
    dealt = wanted.select("path", "offset", "length", "url").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    schema = _RECORD_SCHEMA + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_now, f = None, None
        for batch in batches:
            urls = iter(batch.column(3).to_pylist())
            for path, start, end, parts in ranges(list(zip(*(c.to_pylist() for c in batch.columns[:3])))):
                if path != path_now:
                    if f:
                        f.close()
                    path_now, f = path, _open(path)
                f.seek(start)
                data = f.read(end - start)
                rows = [(r[0], url, *r[2:]) for (o, k), url in zip(parts, urls) for r in [parse(data[o - start : o - start + k])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)][: len(names)], names)
        if f:
            f.close()

    return dealt.mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to packages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of payloads that are equal and have at least 100 bytes, the smallest
    page_id is the response, the others revisit it; smaller ones are responses. Rows without page_id can
    be revisits but not first; rows that repeat the first's page_id are responses too. Null urls leave
    out the header. Other columns are not read. No rows in, no rows out.
    """
    places = cut(index(write_archives(pages)), "places")
    return read_records(places).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
