"""Albums: their table, what a list or a detail page shows of them, and which photos leave them selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .merge import BUSY_ANALYSIS, BUSY_SERVER, BUSY_UPLOAD, recovered, upsert

KEY_FACES_SHOWN = 9
#: Fields of a photo that culling works on.
CULLING = ("album_id", "photo_id", "file_name", "faces", "selected", "ai_selected", "maybe", "blurred", "closed_eyes", "duplicated", "star_rating")


def album(albums: DataFrame, album_id) -> DataFrame:
    return albums.where(F.col("album_id") == album_id)


def album_ids(albums: DataFrame) -> DataFrame:
    """Ids, last changed first."""
    return albums.orderBy(F.desc("updated_at"), "album_id").select("album_id")


def newest_first(albums: DataFrame) -> DataFrame:
    """Albums by the time they were made, ISO text, newest first."""
    return albums.orderBy(F.desc("created_at"), "album_id").select("album_id", "created_at")


def put(albums: DataFrame, new: DataFrame) -> DataFrame:
    """albums with new rows in place of older ones."""
    return upsert(albums, new, ("album_id",), "updated_at")


def normalised(albums: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums with defaults and totals, and their photos with defaults, as after a restart, with position by name.

    albums: album_id, name, created_at, link, completed, has_uploads, total_photos, total_storage; totals are
    counted anew where an album has photos.
    """
    counted = photos.groupBy("album_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("file_size", F.lit(0))).alias("_bytes"))
    zero = F.lit(0).cast("long")
    made = {
        "name": F.coalesce("name", F.lit("Untitled")),
        "link": F.coalesce("link", F.lit("")),
        "created_at": F.coalesce("created_at", F.lit("1970-01-01T00:00:00.000Z")),
        "completed": F.coalesce("completed", F.lit(False)),
        "has_uploads": F.coalesce("has_uploads", F.lit(False)),
        "total_photos": F.coalesce("_n", "total_photos", zero),
        "total_storage": F.coalesce("_bytes", "total_storage", zero),
    }
    done = albums.join(counted, "album_id", "left").withColumns(made).select(albums.columns)
    w = Window.partitionBy("album_id").orderBy(S.natural_key(F.col("file_name")), "photo_id")
    rows = recovered(photos.withColumn("uploaded_at", F.coalesce("uploaded_at", zero)))
    return done, rows.withColumn("position", F.row_number().over(w))


def culling_photos(photos: DataFrame) -> DataFrame:
    """What culling sees of the photos."""
    return photos.select(*(c for c in CULLING if c in photos.columns))


def in_flight(photos: DataFrame) -> DataFrame:
    """Adds uploading, analyzing and sending: whether a photo is on its way in, through analysis, or to the server."""
    of = lambda column, values: F.coalesce(F.col(column).isin(*values), F.lit(False))
    return photos.withColumns({"uploading": of("status", BUSY_UPLOAD), "analyzing": of("analysis_status", BUSY_ANALYSIS), "sending": of("server_upload_status", BUSY_SERVER)})


def disabled(photos: DataFrame, albums: DataFrame) -> DataFrame:
    """Adds disabled: an album with uploads is read-only as a whole."""
    return photos.join(albums.select("album_id", F.coalesce("has_uploads", F.lit(False)).alias("disabled")), "album_id", "left").fillna(False, ["disabled"])


def selected_ids(photos: DataFrame) -> DataFrame:
    """album_id and photo_id of analysed photos that are selected, in order of position."""
    return photos.where((F.col("analysis_status") == "analyzed") & F.col("selected")).orderBy("album_id", "position").select("album_id", "photo_id", "position")


def overlaid(state: DataFrame, stored: DataFrame, order: DataFrame) -> DataFrame:
    """Photos of albums with an order (album_id, photo_id, position): state's rows of it first, then stored rows that it lacks; other albums as stored.

    Adds source (state or stored) and, where state gives a row, its position.
    """
    keys = ["album_id", "photo_id"]
    live = state.join(order, keys).withColumn("source", F.lit("state"))
    rest = stored.join(live.select(*keys), keys, "left_anti").withColumns({"position": F.lit(None).cast("int"), "source": F.lit("stored")})
    return live.select(*stored.columns, "position", "source").unionByName(rest.select(*stored.columns, "position", "source"))


def shown_key_faces(variants: DataFrame, most: int = KEY_FACES_SHOWN) -> DataFrame:
    """The first key faces of each album that have a crop, by first_order."""
    w = Window.partitionBy("album_id").orderBy("first_order", "variant")
    return variants.where(F.coalesce("crop_uri", F.lit("")) != "").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def seeded_clusters(faces: DataFrame, known: DataFrame) -> DataFrame:
    """album_id, cluster_id, print and area of the first face of each cluster, for albums that known (album_id) doesn't have.

    faces: album_id, photo_order, face_index, cluster_id, print, area, analysis_status; only analysed photos count.
    """
    fine = faces.where((F.col("analysis_status") == "analyzed") & (F.coalesce("cluster_id", F.lit("")) != ""))
    first = F.min_by(F.struct("print", "area"), F.struct("photo_order", "face_index")).alias("f")
    return fine.join(known.select("album_id").distinct(), "album_id", "left_anti").groupBy("album_id", "cluster_id").agg(first).select("album_id", "cluster_id", "f.*")


def has_uploads(status: Column) -> Column:
    """Whether any photo of a group has reached the server."""
    return F.bool_or(status == "uploaded")
