"""Summaries kept up to date after deletions and edits: differences, not recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import duplicates as D
from . import stats as T

COUNTERS = ("total_photos", "my_selections", "ai_selected", "maybe", "blurred", "closed_eyes", "duplicated")


def stats_after_delete(stats: DataFrame, gone: DataFrame) -> DataFrame:
    """stats less what the deleted photos had counted for, never below 0."""
    less = T.album_stats(gone)
    joined = stats.alias("s").join(less.alias("l"), "album_id", "left")
    return joined.select("album_id", *(F.greatest(F.lit(0), F.col(f"s.{c}") - F.coalesce(F.col(f"l.{c}"), F.lit(0))).cast("long").alias(c) for c in COUNTERS))


def groups_after_delete(members: DataFrame, photos: DataFrame, gone: DataFrame) -> DataFrame:
    """Duplicate groups after a deletion: those left with one photo or without a good one dissolve, others keep their name.

    The best is taken among good photos only, so this is not the same as finding the groups anew.
    members: album_id, photo_id, group_id. photos: flags, rating, time and name. gone: album_id, photo_id.
    """
    keys = ["album_id", "photo_id"]
    left = members.select(*keys, "group_id").join(gone.select(*keys), keys, "left_anti").join(photos, keys)
    w = Window.partitionBy("album_id", "group_id")
    keeper = D.tier(F.col("blurred"), F.col("closed_eyes")) >= D.KEEPER
    left = left.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("keepers", F.count_if(keeper).over(w))
    left = left.withColumn("best", F.first("photo_id").over(w.orderBy(*D.preference())))
    stays = (F.col("n") > 1) & (F.col("keepers") > 0)
    return left.select(*keys, F.when(stays, F.col("group_id")).alias("group_id"), F.when(stays, F.col("best")).alias("best_photo_id"), F.when(stays, F.col("photo_id") != F.col("best")).otherwise(False).alias("duplicated"))


def key_faces_after_delete(variants: DataFrame, gone: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """Key faces without the deleted photos: empty ones go, counts drop to 1 at least, the source moves to the first photo left.

    With faces (album_id, photo_id, face_index, variant, cluster) source_face_index is the source photo's first face of
    the same variant, else of the same cluster, else the one of the former best face's number, else 0. Variants with
    face_indexes (their first face in each of photo_ids) have it from there, so that no faces are read.
    """
    keys = ["album_id", "variant"]
    known = faces is None and "face_indexes" in variants.columns
    was = [F.col("best.face_index").alias("_was")] if faces is not None else []
    members = F.arrays_zip("photo_ids", "face_indexes") if known else F.transform("photo_ids", lambda x: F.struct(x.alias("photo_ids")))
    # what a variant has besides goes along with its photos, so that it needn't be joined again
    own = variants.select(*keys, "occurrences", F.size("photo_ids").alias("_n"), *was, F.posexplode(members).alias("_at", "_m"))
    own = own.select("*", F.col("_m.photo_ids").alias("_photo"), *([F.col("_m.face_indexes").alias("_face")] if known else [])).drop("_m")
    g = gone.select(F.col("album_id").alias("_album"), F.col("photo_id").alias("_gone"))
    own = own.join(g, F.col("album_id").eqNullSafe(F.col("_album")) & (F.col("_photo") == F.col("_gone")), "left_anti")
    member = F.struct("_at", "_photo", *(["_face"] if known else []))
    rest = [F.first(c).alias(c) for c in ("occurrences", "_n", *(["_was"] if was else []))]
    v = own.groupBy(*keys).agg(*rest, F.array_sort(F.collect_list(member)).alias("_left"))
    count = F.when(F.size("_left") < F.col("_n"), F.greatest(F.lit(1), F.col("occurrences") - (F.col("_n") - F.size("_left")))).otherwise(F.col("occurrences"))
    source = F.element_at("_left", 1)
    index = [F.coalesce(source["_face"], F.lit(0)).alias("source_face_index")] if known else []
    out = v.select(*keys, count.cast("long").alias("occurrences"), F.transform("_left", lambda x: x["_photo"]).alias("photo_ids"), source["_photo"].alias("source_photo_id"), *index, *(["_was"] if was else []))
    if faces is None:
        return out
    f = faces.select("album_id", F.col("photo_id").alias("source_photo_id"), "face_index", F.col("variant").alias("_variant"), F.col("cluster").alias("_cluster"))
    rank = F.when(F.col("_variant") == F.col("variant"), 0).when(F.col("_cluster") == F.substring_index("variant", "::", 1), 1).when(F.col("face_index") == F.col("_was"), 2)
    found = out.join(f, ["album_id", "source_photo_id"]).withColumn("_rank", rank).where("_rank is not null")
    found = found.groupBy(*keys).agg(F.min_by("face_index", F.struct("_rank", "face_index")).alias("source_face_index"))
    return out.join(found, keys, "left").withColumn("source_face_index", F.coalesce("source_face_index", F.lit(0))).drop("_was")


def with_duplicate_flags(photos: DataFrame, members: DataFrame) -> DataFrame:
    """Sets duplicated, and takes duplicates out of the selection; nothing is selected anew."""
    flags = members.select("album_id", "photo_id", F.col("duplicated").alias("_d"))
    j = photos.join(flags, ["album_id", "photo_id"], "left").withColumn("duplicated", F.coalesce("_d", F.lit(False))).drop("_d")
    return j.withColumn("selected", F.when(F.col("duplicated"), False).otherwise(F.col("selected")))


def toggle_star(photos: DataFrame, clicks: DataFrame) -> DataFrame:
    """New ratings after clicks (album_id, photo_id, star): the same star again clears it."""
    j = photos.join(clicks, ["album_id", "photo_id"])
    return j.select("album_id", "photo_id", F.when(F.coalesce("star_rating", F.lit(0)) == F.col("star"), 0).otherwise(F.col("star")).alias("star_rating"))


def edited(photos: DataFrame, edits: DataFrame, albums: DataFrame) -> DataFrame:
    """photos after edits (album_id, photo_id, new_selected, new_star; null leaves a field), refused where the album has uploads.

    albums: album_id, has_uploads.
    """
    keys = ["album_id", "photo_id"]
    allowed = edits.join(albums.where("has_uploads").select("album_id"), "album_id", "left_anti")
    j = photos.join(allowed, keys, "left")
    new = {"selected": F.coalesce("new_selected", "selected"), "star_rating": F.coalesce("new_star", "star_rating")}
    return j.withColumns(new).select(photos.columns)


def stats_after_edit(stats: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """stats with my_selections moved by the selections that changed, never below 0."""
    j = before.select("album_id", "photo_id", F.col("selected").alias("was")).join(after.select("album_id", "photo_id", "selected"), ["album_id", "photo_id"])
    moved = j.where("was <> selected").groupBy("album_id").agg(F.sum(F.when(F.col("selected"), 1).otherwise(-1)).alias("_d"))
    s = stats.join(moved, "album_id", "left")
    return s.withColumn("my_selections", F.greatest(F.lit(0), F.col("my_selections") + F.coalesce("_d", F.lit(0)))).select(stats.columns)


def with_crops(variants: DataFrame, crops: DataFrame) -> DataFrame:
    """Key faces whose crop_uri is missing take that of their source face, if there is one.

    variants: photo_id, face_index, crop_uri and others. crops: photo_id, face_index, crop_uri.
    """
    c = crops.where("crop_uri is not null").groupBy("photo_id", "face_index").agg(F.min("crop_uri").alias("_c"))
    return variants.join(c, ["photo_id", "face_index"], "left").withColumn("crop_uri", F.coalesce("crop_uri", "_c")).select(variants.columns)


def pruned(photos: DataFrame) -> DataFrame:
    """What an album keeps when its import is cancelled: photos that had arrived."""
    return photos.where("status = 'uploaded'")


def started(albums: DataFrame, photos: DataFrame) -> DataFrame:
    """album_id and started: completed before, or any photo past idle. albums: album_id, completed."""
    any_ = photos.groupBy("album_id").agg(F.bool_or(F.coalesce(F.col("analysis_status") != "idle", F.lit(False))).alias("_any"))
    return albums.join(any_, "album_id", "left").select("album_id", (F.coalesce("completed", F.lit(False)) | F.coalesce("_any", F.lit(False))).alias("started"))


def after_delete(photos: DataFrame, stats: DataFrame, members: DataFrame, variants: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Photos, stats, duplicate groups and key faces after a deletion, each from its own former state."""
    keys = ["album_id", "photo_id"]
    out = photos.join(gone.select(*keys), keys, "left_semi")
    left = groups_after_delete(members, photos.drop("duplicated"), gone)
    kept = photos.join(gone.select(*keys), keys, "left_anti")
    freed = kept.drop("duplicated").join(left.select(*keys, F.col("duplicated").alias("_d")), keys, "left")
    freed = freed.withColumn("duplicated", F.coalesce("_d", F.lit(False))).select(photos.columns)
    return freed, stats_after_delete(stats, out), left, key_faces_after_delete(variants, gone)
