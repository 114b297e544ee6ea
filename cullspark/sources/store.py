"""Photo files and the photo table: listing, reading by key, writing by key.

The table is Parquet partitioned by album, with the fields that filters use as columns of their own
beside the JSON of the whole row, so scans prune albums and push filters down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.merge import upsert

#: Folders of derived images.
DERIVED = ("thumbs", "details", "previews", "face-thumbs")
PROMOTED = {"file_size": ("$.file.size", "bigint", "0"), "upload_status": ("$.status", "string", "pending"), "analysis_status": ("$.analysisStatus", "string", "idle"), "server_upload_status": ("$.serverUploadStatus", "string", "idle")}
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "heic": "image/heic", "heif": "image/heif", "tif": "image/tiff", "tiff": "image/tiff", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}


def list_photos(spark: SparkSession, root: str) -> DataFrame:
    """uri, name, size and type of the photos under root/album: no hidden files, no derived images. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    parts = F.split("path", "/")
    derived = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(*DERIVED))
    return files.withColumn("name", F.element_at(parts, -1)).where(~F.col("name").startswith(".") & ~derived).select(F.col("path").alias("uri"), "name", "size", mime(F.col("name")).alias("type"))


def mime(name: Column, given: Column | None = None) -> Column:
    """A type with a slash as given, else by extension, else a JPEG."""
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    by_name = F.coalesce(F.try_element_at(table, F.lower(F.substring_index(name, ".", -1))), F.lit("image/jpeg"))
    return by_name if given is None else F.when(given.contains("/"), F.lower(F.trim(given))).otherwise(by_name)


def content_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a file, null if it is shorter."""
    return F.when(F.octet_length(content) >= end, F.substring(content, start + 1, end - start))


def encode(photos: DataFrame, row: list[str], version: Column) -> DataFrame:
    """album_id, photo_id, data (the JSON of row) and the promoted columns."""
    data = F.to_json(F.struct(*row))
    out = photos.select("album_id", F.col("photo_id").cast("string").alias("photo_id"), data.alias("data"), version.cast("long").alias("updated_at"))
    return promote(out)


def promote(table: DataFrame) -> DataFrame:
    """The promoted columns from the JSON of the rows, as a migration adds them; missing fields get their defaults."""
    made = {k: F.coalesce(F.get_json_object("data", path).cast(kind), F.lit(default).cast(kind)) for k, (path, kind, default) in PROMOTED.items()}
    return table.withColumns(made)


def write(table: DataFrame, path: str) -> None:
    """Replaces the albums that table holds and leaves the others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("album_id").parquet(path)


def put(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The table at path with rows in place of older ones of the same album and photo; only their albums are rewritten by write()."""
    albums = rows.select("album_id").distinct()
    old = spark.read.parquet(path).join(albums, "album_id", "left_semi").select(rows.columns)
    return upsert(old, rows, ("album_id", "photo_id"), "updated_at")


def remove(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table without the photos of keys (album_id, photo_id), or without albums if keys has only album_id."""
    return table.join(keys, keys.columns, "left_anti")


def decode(table: DataFrame, schema: str) -> DataFrame:
    """Keys and fields of the rows' JSON; rows that can't be parsed are left out."""
    v = F.from_json("data", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return table.withColumn("_v", v).where("_v is not null and _v._bad is null").select("album_id", "photo_id", "updated_at", "_v.*").drop("_bad")


def photo(table: DataFrame, album_id, photo_id) -> DataFrame:
    return table.where((F.col("album_id") == album_id) & (F.col("photo_id") == photo_id))


def photo_ids(table: DataFrame, album_id) -> DataFrame:
    return table.where(F.col("album_id") == album_id).orderBy("updated_at", "photo_id").select("photo_id")


def photos_of(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, ["album_id", "photo_id"], "left_semi")


def page(rows: DataFrame, key: str, after=None, limit: int = 48) -> DataFrame:
    """The next rows behind a key, without counting those before."""
    rest = rows if after is None else rows.where(F.col(key) > after)
    return rest.orderBy(key).limit(limit)


def import_map(rows: DataFrame, column: str = "value") -> DataFrame:
    """album_id, photo_id and data of rows that hold a whole album as one JSON map."""
    entries = F.explode(F.from_json(column, "map<string,string>")).alias("key", "data")
    return rows.select(entries).select(F.substring_index("key", ":", 1).alias("album_id"), F.expr("substring(key, instr(key, ':') + 1)").alias("photo_id"), "data")


def uploadable(batch: DataFrame, photos: DataFrame) -> DataFrame:
    """A batch's photos with supported: ids without a photo, and WebP, are not."""
    known = photos.select("album_id", "photo_id", F.coalesce(S.supported_format(F.col("file_name"), F.lit(None).cast("string")), F.lit(False)).alias("ok"))
    return batch.join(known, ["album_id", "photo_id"], "left").select("album_id", "photo_id", F.coalesce("ok", F.lit(False)).alias("supported"))
