"""Merging of photo rows from several places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUSY_UPLOAD = ("pending", "uploading")
BUSY_ANALYSIS = ("pending", "analyzing")
BUSY_SERVER = ("pending", "uploading")


def recovered(photos: DataFrame) -> DataFrame:
    """Rows as they are after a restart: interrupted uploads wait again, interrupted analyses are done if they have faces."""
    analysis = F.when(F.col("analysis_status").isin(*BUSY_ANALYSIS), F.when(F.col("n_faces") > 0, "analyzed").otherwise("idle")).otherwise(F.coalesce("analysis_status", F.lit("idle")))
    server = F.when(F.col("server_upload_status") == "uploading", "pending").otherwise(F.coalesce("server_upload_status", F.lit("idle")))
    upload = F.when(F.col("status") == "uploading", "pending").otherwise(F.coalesce("status", F.lit("pending")))
    return photos.withColumns({"analysis_status": analysis, "server_upload_status": server, "status": upload})


def prefers_current(prefix_current: str, prefix_incoming: str) -> Column:
    """Whether the stored row is farther along than the incoming one; the first rule that tells them apart decides."""
    c, i = (lambda n: F.col(prefix_current + n)), (lambda n: F.col(prefix_incoming + n))
    is_ = lambda col, *values: F.coalesce(col.isin(*values), F.lit(False))
    rules = [(is_(s("server_upload_status"), "uploaded") for s in (c, i)), (is_(s("server_upload_status"), *BUSY_SERVER) for s in (c, i)), (is_(s("analysis_status"), *BUSY_ANALYSIS) for s in (c, i)), (is_(s("analysis_status"), "analyzed") for s in (c, i)), (is_(s("status"), "uploaded") for s in (c, i))]
    return reduce(lambda rest, rule: F.when(rule[0] & ~rule[1], True).when(rule[1] & ~rule[0], False).otherwise(rest), [tuple(r) for r in reversed(rules)], F.lit(False))


def merged(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("album_id", "photo_id")) -> DataFrame:
    """One row per key from either side; where both have it, the one that is farther along."""
    fields = [x for x in current.columns if x not in keys]
    side = lambda df, p: df.select(*keys, *(F.col(x).alias(p + x) for x in fields), F.lit(True).alias(p + "has"))
    j = side(current, "c_").join(side(incoming, "i_"), list(keys), "full_outer")
    ours = F.coalesce(F.col("c_has"), F.lit(False)) & (F.col("i_has").isNull() | prefers_current("c_", "i_"))
    return j.select(*keys, *(F.when(ours, F.col("c_" + x)).otherwise(F.col("i_" + x)).alias(x) for x in fields))


def reconciled(disk: DataFrame, store: DataFrame) -> DataFrame:
    """Files on disk against stored rows, by uri: matches finish, new files come as uploaded, rows without a file stay only while they wait or failed.

    disk: album_id, uri, name, size. store: album_id, photo_id, uri, name, size, status. Derivatives' uris are left out.
    """
    keep = ~F.coalesce(F.col("uri").contains("/thumbs/"), F.lit(False))
    d = disk.where(keep).select("album_id", "uri", F.col("name").alias("d_name"), F.col("size").alias("d_size"), F.lit(True).alias("on_disk"))
    s = store.where(keep).select("album_id", "uri", "photo_id", "name", "size", "status", F.lit(True).alias("known"))
    j = d.join(s, ["album_id", "uri"], "full_outer")
    status = F.when(F.col("known").isNull(), "uploaded").when(F.col("on_disk") & F.col("status").isin(*BUSY_UPLOAD), "uploaded").otherwise(F.col("status"))
    stays = F.col("on_disk").isNotNull() | F.col("status").isin(*BUSY_UPLOAD, "failed")
    name = F.coalesce("name", "d_name")
    return j.where(stays).select("album_id", "uri", F.coalesce(F.col("photo_id").cast("string"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).alias("photo_id"), name.alias("name"), F.coalesce("size", "d_size").alias("size"), status.alias("status"))


def changed(current: DataFrame, server: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Server rows that differ from the stored ones in a field, null-safely, where none is on its way."""
    quiet = current.where(~F.coalesce(F.col("server_upload_status").isin(*BUSY_SERVER), F.lit(False)))
    j = quiet.alias("c").join(server.alias("s"), ["album_id", "photo_id"])
    differs = reduce(lambda a, b: a | b, (~F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in fields))
    return j.where(differs).select("album_id", "photo_id", *(F.col(f"s.{x}").alias(x) for x in fields))


def upsert(table: DataFrame, updates: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """table with updates in place of older rows of their keys; of equal versions the update wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_new")


def ordered(photos: DataFrame, order: DataFrame) -> DataFrame:
    """position of each photo: those named in order (album_id, photo_id, photo_order) first, then the rest by name."""
    from ..functions import scalar as S

    j = photos.join(order, ["album_id", "photo_id"], "left")
    w = Window.partitionBy("album_id").orderBy(F.asc_nulls_last("photo_order"), S.natural_key(F.col("file_name")), "photo_id")
    return j.withColumn("position", F.row_number().over(w))
