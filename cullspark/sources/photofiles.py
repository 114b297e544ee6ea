"""Photos as files: a data source that lists them or reads ranges of their bytes, and one that takes in and deletes them.

Reading. spark.read.format("photo_files").load(root) lists the photos under root/album; with the option part_bytes
their contents come as slices of so many bytes, with head only the first bytes of each. A task opens a file and
reads [start, end), never the rest, and fails if it gets another number of bytes. Albums are listed where they are
read; the driver counts their bytes and deals them in ranges. Filters on album and name are applied to the listing.

Writing. df.write.format("photo_files") stores rows of album, photo_id, file_name, content, thumbnail and detail.
A task writes to a folder of its own attempt and leaves a list of what it stored; the commit writes one manifest
that names the attempts which count. What a failed or repeated attempt has written is in no manifest and so in no
reading. A photo without a thumbnail isn't stored.

root is an address of any file system that pyarrow knows, one that all machines see.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .scratch import written
from .store import DERIVED, MIME

#: Bytes that a task reads, and a folder's name for manifests.
TASK_BYTES, MANIFESTS = 128 << 20, "_manifests"
LISTED = "album string, name string, uri string, size long, type string"
SLICED = LISTED + ", start long, end long, content binary"


class SizeMismatch(IOError):
    """A slice has another number of bytes than was asked for."""


def _address(root: str) -> str:
    return (root if ":" in root else f"file://{root}").rstrip("/")


def _files(root: str):
    """The file system of an address and the path in it."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(_address(root))
    return found, path.rstrip("/")


def read_slice(root: str, path: str, start: int, end: int) -> bytes:
    """Bytes [start, end) of a file; fewer or more are an error."""
    found, _ = _files(root)
    with found.open_input_file(path) as f:
        f.seek(start)
        content = f.read(end - start)
    if len(content) != end - start:
        raise SizeMismatch(f"{path}: expected {end - start} bytes from {start}, got {len(content)}")
    return content


def _photos_in(found, album_path: str) -> list:
    """Files of an album in order of name, without hidden ones and derived images."""
    from pyarrow import fs

    entries = found.get_file_info(fs.FileSelector(album_path, allow_not_found=True))
    return sorted((e for e in entries if e.type == fs.FileType.File and not e.base_name.startswith(".")), key=lambda e: e.base_name)


class _Range(InputPartition):
    """Bytes [low, high) of an album, whose files follow one another in order of name."""

    def __init__(self, album: str, low: int, high: int):
        self.album, self.low, self.high = album, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = _address(options["path"])
        self.part = int(options["part_bytes"]) if "part_bytes" in options else None
        self.head = int(options["head"]) if "head" in options else None
        self.task = int(options.get("task_bytes", TASK_BYTES))
        self.albums: list[str] | None = None
        self.names: list[str] | None = None
        self.starts: list[str] = []
        if self.part is not None and self.head is not None:
            raise ValueError("part_bytes reads files whole, head their beginnings: one of them")
        if (self.part or 1) < 1 or (self.head or 1) < 1 or self.task < 1:
            raise ValueError("numbers of bytes are above 0")

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("album",):
                self.albums = [v for v in values if self.albums is None or v in self.albums]
            elif values is not None and f.attribute == ("name",):
                self.names = [v for v in values if self.names is None or v in self.names]
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.starts.append(f.value)
            else:
                yield f

    def _wanted(self, found, root: str, album: str) -> list:
        files = _photos_in(found, f"{root}/{album}")
        return [e for e in files if (self.names is None or e.base_name in self.names) and all(e.base_name.startswith(s) for s in self.starts)]

    def _bytes(self, e) -> int:
        """What a file adds to the bytes of its album: what is read of it, and one for being listed."""
        return 1 + (e.size if self.part else min(e.size, self.head) if self.head else 0)

    def partitions(self):
        from pyarrow import fs

        found, root = _files(self.root)
        if self.albums is not None:
            albums = sorted({a for a in self.albums if a and "/" not in a})
        else:
            albums = sorted(e.base_name for e in found.get_file_info(fs.FileSelector(root, allow_not_found=True)) if e.type == fs.FileType.Directory)
        out = []
        for album in albums:
            if album.startswith((".", "_")) or album in DERIVED:
                continue
            total = sum(self._bytes(e) for e in self._wanted(found, root, album))
            out += [_Range(album, at, min(total, at + self.task)) for at in range(0, total, self.task)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.album:
            return
        found, root = _files(self.root)
        at = 0
        for e in self._wanted(found, root, partition.album):
            begin, at = at, at + self._bytes(e)
            # a slice is the task's whose range its first byte is in; the byte for being listed goes with the first slice
            row = (partition.album, e.base_name, f"{self.root}/{partition.album}/{e.base_name}", e.size, MIME.get(e.base_name.rpartition(".")[2].lower(), "image/jpeg"))
            if self.part is None:
                if partition.low <= begin < partition.high:
                    end = min(e.size, self.head or 0)
                    yield (*row, 0, end, read_slice(self.root, e.path, 0, end)) if self.head else row
                continue
            for start in range(0, max(1, e.size), self.part):
                if partition.low <= begin + (start + 1 if start else 0) < partition.high:
                    end = min(e.size, start + self.part)
                    yield (*row, start, end, read_slice(self.root, e.path, start, end))


# --- taking in

#: Rows of the list that an attempt leaves.
STORED = "album string, name string, uri string, size long, type string, thumbnail_uri string, detail_uri string, state string, error string"
_COLUMNS = [c.split(" ")[0] for c in STORED.split(", ")]
INGESTED = "album string, photo_id string, file_name string, content binary, thumbnail binary, detail binary"


class _Attempt(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


def _put(found, path: str, content: bytes) -> None:
    found.create_dir(posixpath.dirname(path), recursive=True)
    with found.open_output_stream(path) as f:
        f.write(content)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("photos are added; delete() takes some out")
        self.root, self.job = _address(options["path"]), uuid.uuid4().hex

    def _at(self, attempt: str) -> str:
        return f"{MANIFESTS}/{self.job}/{attempt}"

    def write(self, iterator) -> _Attempt:
        import pyarrow as pa
        import pyarrow.parquet as pq

        found, root = _files(self.root)
        attempt, rows = uuid.uuid4().hex, []
        for r in iterator:
            ext = posixpath.splitext(r.file_name or "photo.jpg")[1]
            photo = r.photo_id or uuid.uuid4().hex
            name, folder = photo + ext, f"{r.album}/.{attempt}"
            kind = f"public.{ext[1:].lower()}" if len(ext) > 1 else "image/jpeg"
            if r.content is None or not r.thumbnail:
                error = "no source" if r.content is None else "no thumbnail"
                rows.append((r.album, name, None, None, kind, None, None, "aborted", error))
                continue
            made = {name: bytes(r.content), f"thumbs/{photo}.v4.jpg": bytes(r.thumbnail)} | ({f"details/{photo}.d1.jpg": bytes(r.detail)} if r.detail else {})
            for k, v in made.items():
                _put(found, f"{root}/{folder}/{k}", v)
            uri = lambda k: f"{self.root}/{folder}/{k}"  # noqa: B023, E731
            rows.append((r.album, name, uri(name), len(r.content), kind, uri(f"thumbs/{photo}.v4.jpg"), uri(f"details/{photo}.d1.jpg") if r.detail else None, "stored", None))
        columns = list(zip(*rows)) if rows else [[] for _ in _COLUMNS]
        kinds = [pa.int64() if c == "size" else pa.string() for c in _COLUMNS]
        table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], _COLUMNS)
        found.create_dir(f"{root}/{self._at(attempt)}", recursive=True)
        pq.write_table(table, f"{root}/{self._at(attempt)}/list.parquet", filesystem=found)
        return _Attempt(attempt, len(rows))

    def commit(self, messages) -> None:
        found, root = _files(self.root)
        _manifest(found, root, {"job": self.job, "attempts": sorted(m.name for m in messages if m is not None and m.rows)})

    def abort(self, messages) -> None:
        """Attempts that are known take their files with them; what others left is in no manifest."""
        from pyarrow import fs

        found, root = _files(self.root)
        for m in messages:
            if m is None:
                continue
            for e in found.get_file_info(fs.FileSelector(root)):
                hidden = f"{root}/{e.base_name}/.{m.name}"
                if e.type == fs.FileType.Directory and found.get_file_info(hidden).type == fs.FileType.Directory:
                    found.delete_dir(hidden)
        if found.get_file_info(f"{root}/{MANIFESTS}/{self.job}").type == fs.FileType.Directory:
            found.delete_dir(f"{root}/{MANIFESTS}/{self.job}")


def _manifest(found, root: str, content: dict) -> None:
    """Writes the next manifest, whole or not at all."""
    number = 1 + max((n for n, _ in _manifests(found, root)), default=-1)
    made = f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"
    _put(found, made, json.dumps(content).encode())
    found.move(made, f"{root}/{MANIFESTS}/{number:012d}-{uuid.uuid4().hex[:8]}.json")


def _manifests(found, root: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    entries = found.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    return sorted((int(e.base_name[:12]), e.path) for e in entries if e.base_name.endswith(".json") and not e.base_name.startswith("."))


class PhotoFiles(DataSource):
    """Options: path; for reading part_bytes or head, and task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "photo_files"

    def schema(self) -> str:
        return SLICED if "part_bytes" in self.options or "head" in self.options else LISTED

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it."""
    spark.dataSource.register(PhotoFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def photos(spark: SparkSession, root: str, **options) -> DataFrame:
    """The photos under root/album, with slices of their contents where an option asks for them."""
    register(spark)
    return spark.read.format("photo_files").options(**{k: str(v) for k, v in options.items()}).load(root)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """album, name, uri, size, type, thumbnail_uri and detail_uri of the photos that manifests name; of one name in an album the latest, unless it was deleted."""
    root = _address(root)
    found, path = _files(root)
    parts = []
    for number, at in _manifests(found, path):
        with found.open_input_stream(at) as f:
            m = json.loads(f.read())
        parts += [(f"{root}/{MANIFESTS}/{m['job']}/{a}", number) for a in m["attempts"]]
    if not parts:
        return spark.createDataFrame([], STORED).drop("state", "error")
    rows = spark.read.schema(STORED).parquet(*(p for p, _ in parts)).withColumn("_attempt", F.element_at(F.split(F.input_file_name(), "/"), -2))
    numbers = spark.createDataFrame([(p.rpartition("/")[2], n) for p, n in parts], "_attempt string, _number long")
    latest = Window.partitionBy("album", "name").orderBy(F.desc("_number"), F.desc("uri"))
    rows = rows.where("state <> 'aborted'").join(numbers, "_attempt").withColumn("_k", F.row_number().over(latest))
    return rows.where("_k = 1 and state = 'stored'").drop("_attempt", "_number", "_k", "state", "error")


def ingest(rows: DataFrame, root: str, replace: bool = False) -> DataFrame:
    """Stores rows (see INGESTED) and gives album, name, state and error of those that weren't: without a source or thumbnail, or there already.

    With replace a photo of the same name takes the place of the one that is there. Of rows of one name in one call the first by content counts.
    """
    spark = rows.sparkSession
    register(spark)
    ext = F.regexp_extract(F.coalesce("file_name", F.lit("photo.jpg")), r"\.[^./]*$", 0)
    own = F.substring(F.sha2(F.concat_ws("/", "album", "file_name", F.hex("content")), 256), 1, 32)  # the same when a task is repeated
    named = rows.withColumn("photo_id", F.coalesce(F.nullif("photo_id", F.lit("")), own)).withColumn("name", F.concat("photo_id", ext))
    once = F.row_number().over(Window.partitionBy("album", "name").orderBy(F.sha2("content", 256)))
    named = named.withColumn("_k", once).where("_k = 1").drop("_k")
    known = stored(spark, root).select("album", "name")
    refused = spark.createDataFrame([], "album string, name string, state string, error string")
    if not replace:
        refused = named.join(known, ["album", "name"], "left_semi").select("album", "name", F.lit("aborted").alias("state"), F.lit("exists").alias("error"))
        named = named.join(known, ["album", "name"], "left_anti")
    bad = named.where("content is null or thumbnail is null or length(thumbnail) = 0")
    failed = refused.unionByName(bad.select("album", "name", F.lit("aborted").alias("state"), F.when(F.col("content").isNull(), "no source").otherwise("no thumbnail").alias("error")))
    failed = written(failed, "failed")  # what was there before this call
    named.select("album", "photo_id", "file_name", "content", "thumbnail", "detail").write.format("photo_files").mode("append").save(root)
    return failed


# --- deleting

#: Fixed names of images derived from a photo, by the platform that made them; {} is the photo's id.
DERIVED_NAMES = {
    "desktop": ("thumbs/{}.v4.jpg", "thumbs/{}.jpg", "details/{}.d1.jpg"),
    "windows": ("thumbs/{}.v4.jpg", "thumbs/{}.w3.jpg", "thumbs/{}.w2.jpg", "thumbs/{}.jpg", "thumbs/{}.o1.jpg", "details/{}.d1.jpg", "previews/{}.w3.jpg", "previews/{}.w2.jpg"),
}


def _removed(batches: Iterator[pd.DataFrame], root: str, profile: str) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    found, path = _files(root)
    for batch in batches:
        out = []
        for album, name, uri in zip(batch["album"], batch["name"], batch["uri"]):
            file = path + uri[len(root) :]
            folder, photo = posixpath.dirname(file), posixpath.splitext(name)[0]
            crops = [e.path for e in found.get_file_info(fs.FileSelector(f"{folder}/face-thumbs", allow_not_found=True)) if e.base_name.startswith(f"{photo}-")]
            gone = 0
            for at in [file, *(f"{folder}/{n.format(photo)}" for n in DERIVED_NAMES[profile]), *crops]:
                if found.get_file_info(at).type == fs.FileType.File:
                    found.delete_file(at)
                    gone += 1
            out.append((album, name, gone))
        yield pd.DataFrame(out, columns=["album", "name", "files"])


def remove_files(photos: DataFrame, root: str, profile: str = "desktop") -> DataFrame:
    """Deletes photos (album, name, uri) with all that was derived from them, and gives how many files each lost; what isn't there counts as deleted.

    The table is written once, so that reading it deletes nothing again.
    """
    root = _address(root)
    return written(photos.select("album", "name", "uri").mapInPandas(lambda b: _removed(b, root, profile), "album string, name string, files int"), "removed")


def delete(spark: SparkSession, root: str, keys: DataFrame, profile: str = "desktop") -> DataFrame:
    """Takes photos of keys (album, name) out of what is stored, then deletes their files; a repeated call changes nothing."""
    root = _address(root)
    gone = written(stored(spark, root).join(keys.select("album", "name").distinct(), ["album", "name"], "left_semi"), "gone")
    job, attempt = uuid.uuid4().hex, uuid.uuid4().hex
    found, path = _files(root)
    if not gone.isEmpty():
        found.create_dir(f"{path}/{MANIFESTS}/{job}", recursive=True)
        marks = gone.withColumns({"state": F.lit("deleted"), "error": F.lit(None).cast("string")}).select(*_COLUMNS)
        marks.write.parquet(f"{root}/{MANIFESTS}/{job}/{attempt}")
        _manifest(found, path, {"job": job, "attempts": [attempt]})
    return remove_files(gone, root, profile)

