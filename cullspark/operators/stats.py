"""Flags, ratings, counts and progress of photos: grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def photo_flags(labelled: DataFrame) -> DataFrame:
    """One row per photo with faces: flags and stars from its faces' eye, focus and tier."""
    has = lambda c: F.bool_or(c)
    eye, focus, tier = F.col("eye"), F.col("focus"), F.col("tier")
    seen = labelled.groupBy("photo_id").agg(has(eye == "closed").alias("closed_eyes"), has(focus == "blurred").alias("blurred"), has((focus == "soft") | (eye == "partial")).alias("_weak"), F.min("tier").alias("_least"), F.sum("tier").alias("_tiers"), F.count(F.lit(1)).alias("n_faces"))
    good = ~F.col("closed_eyes") & ~F.col("blurred")
    share = F.col("_tiers") / (2 * F.col("n_faces"))
    stars = F.when(F.col("_least") == 2, 5).when(F.col("_least") > 0, 4).when(share <= 1 / 3, 1).when(share >= 2 / 3, 3).otherwise(2)
    return seen.select("photo_id", "n_faces", "closed_eyes", "blurred", (good & ~F.col("_weak")).alias("ai_selected"), (good & F.col("_weak")).alias("maybe"), good.alias("selected"), stars.alias("stars"))


def flagged(photos: DataFrame, labelled: DataFrame) -> DataFrame:
    """Photos with their flags; a photo without faces has none."""
    joined = photos.join(photo_flags(labelled), "photo_id", "left")
    return joined.fillna(False, ["closed_eyes", "blurred", "ai_selected", "maybe", "selected"]).fillna(0, ["stars", "n_faces"]).withColumn("duplicated", F.lit(False))


def album_stats(photos: DataFrame) -> DataFrame:
    """Seven counters per album; a duplicate counts only as such."""
    keys = ("ai_selected", "maybe", "blurred", "closed_eyes", "duplicated")
    return photos.groupBy("album_id").agg(F.count(F.lit(1)).alias("total_photos"), F.count_if("selected").alias("my_selections"), *(F.count_if(S.flag_matches(k)).alias(k) for k in keys))


def album_totals(photos: DataFrame) -> DataFrame:
    return photos.groupBy("album_id").agg(F.count(F.lit(1)).alias("photos"), F.sum(F.coalesce("file_size", F.lit(0))).cast("long").alias("bytes"))


def status_counts(batch: DataFrame, photos: DataFrame, statuses: tuple[str, ...], missing: str = "pending", idle_as: str | None = "pending") -> DataFrame:
    """Counts per album and status of a batch of ids; ids without a photo count as missing."""
    state = F.coalesce("status", F.lit(missing))
    state = F.when(state == "idle", idle_as) .otherwise(state) if idle_as else state
    joined = batch.join(photos.select("album_id", "photo_id", "status"), ["album_id", "photo_id"], "left").withColumn("_s", state)
    return joined.groupBy("album_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("_s") == s).alias(s) for s in statuses))


def local_progress(total: Column, pending: Column, uploading: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(1 - (pending + uploading) / total)


def upload_progress(photos: DataFrame) -> DataFrame:
    """Share of bytes done per album: finished and failed count whole, uploads by their percentage."""
    weight = F.when(F.coalesce("file_size", F.lit(0)) > 0, F.col("file_size")).otherwise(1)
    done = F.when(F.col("status").isin("uploaded", "failed"), 1.0).when(F.col("status") == "uploading", F.col("progress") / 100).otherwise(0.0)
    return photos.groupBy("album_id").agg((F.sum(weight * done) / F.sum(weight)).alias("progress"), (F.bool_and(F.col("status").isin("uploaded", "failed"))).alias("finished"), F.bool_and(F.col("status") == "uploaded").alias("successful"), F.bool_or(F.col("status") == "uploading").alias("in_flight"))
