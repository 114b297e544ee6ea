"""Streams of photo updates and of analysed faces."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.identity import match_faces


def coalesced(updates: DataFrame) -> DataFrame:
    """One row per photo of a micro-batch: the last status by sequence, and the sum of storage changes.

    updates: album_id, photo_id, seq, status, storage_delta.
    """
    return updates.groupBy("album_id", "photo_id").agg(F.max_by("status", "seq").alias("status"), F.sum(F.coalesce("storage_delta", F.lit(0))).alias("storage_delta"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("updates"))


def shifts(updates: DataFrame, before: DataFrame) -> DataFrame:
    """How the counts of statuses change per album when coalesced updates meet the rows before."""
    j = updates.join(before.select("album_id", "photo_id", F.col("status").alias("was")), ["album_id", "photo_id"], "left")
    moves = j.select("album_id", F.explode(F.array(F.struct(F.col("was").alias("status"), F.lit(-1).alias("n")), F.struct(F.col("status").alias("status"), F.lit(1).alias("n")))).alias("m"))
    return moves.where("m.status is not null").groupBy("album_id", "m.status").agg(F.sum("m.n").alias("shift")).where("shift <> 0")


def counted(counters: DataFrame, moved: DataFrame, storage: DataFrame) -> DataFrame:
    """Counters (album_id, status, n) and storage (album_id, bytes) after a batch: counts move by shifts and never go below 0.

    moved: album_id, status, shift. storage: album_id, bytes, storage_delta. Gives album_id, counts (a map of status) and bytes.
    """
    n = counters.join(moved, ["album_id", "status"], "full_outer")
    n = n.select("album_id", "status", F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) + F.coalesce("shift", F.lit(0))).alias("n"))
    maps = n.groupBy("album_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))
    total = storage.groupBy("album_id").agg(F.greatest(F.lit(0), F.sum(F.coalesce("bytes", F.lit(0)) + F.coalesce("storage_delta", F.lit(0)))).cast("long").alias("bytes"))
    return maps.join(total, "album_id", "full_outer").select("album_id", "counts", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


#: Batches after which a writer folds their changes into a new base.
FOLD = 20


def writer(path: str):
    """A foreachBatch sink that keeps the table at path up to date; a repeated batch changes nothing.

    A batch writes only its own photos' last states, to a folder of its epoch, so one that fails half way is
    written again. Every FOLD batches a new base is written, and what the base before it needed is deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        coalesced(batch).select("album_id", "photo_id", "status", "seq", "storage_delta").write.mode("overwrite").parquet(f"{path}/delta/epoch={epoch:012d}")
        if epoch % FOLD == FOLD - 1:
            last = [e for e in _epochs(spark, f"{path}/base") if e < epoch]
            latest(spark, path).write.mode("overwrite").parquet(f"{path}/base/epoch={epoch:012d}")
            for kind in ("base", "delta"):
                for old in _epochs(spark, f"{path}/{kind}"):
                    if last and old < last[-1]:
                        _forget(spark, f"{path}/{kind}/epoch={old:012d}")

    return write


def _epochs(spark, path: str) -> list[int]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda x: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(where) if done(x)) if fs.exists(where) else []


def _forget(spark, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def latest(spark, path: str) -> DataFrame | None:
    """album_id, photo_id, status, seq and storage_delta (all changes so far) of the table under path: the newest base and the batches after it."""
    base, delta = _epochs(spark, f"{path}/base"), _epochs(spark, f"{path}/delta")
    folders = [f"{path}/base/epoch={e:012d}" for e in base[-1:]] + [f"{path}/delta/epoch={e:012d}" for e in delta if not base or e > base[-1]]
    if not folders:
        return None
    rows = spark.read.parquet(*folders)
    return rows.groupBy("album_id", "photo_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.sum("storage_delta").alias("storage_delta"))


def clustered(faces: DataFrame) -> DataFrame:
    """Cluster ids of a stream of photos with faces, album by album; the clusters found so far are the state.

    faces: album_id, photo_id, captured_at, faces (array of struct<face_index, print, area>).
    """

    def run(key, parts, state):
        clusters, number = ({}, 1)
        if state.exists:
            text, number = state.get
            clusters = {k: (p, a) for k, (p, a) in json.loads(text).items()}
        rows = pd.concat(list(parts)).sort_values(["captured_at", "photo_id"], na_position="first")
        out = []
        for r in rows.itertuples():
            ids, number = match_faces([(list(f["print"]), f["area"]) for f in r.faces], clusters, number)
            out += [(key[0], r.photo_id, f["face_index"], c) for f, c in zip(r.faces, ids)]
        state.update((json.dumps(clusters), number))
        yield pd.DataFrame(out, columns=["album_id", "photo_id", "face_index", "cluster_id"])

    return faces.groupBy("album_id").applyInPandasWithState(run, "album_id long, photo_id long, face_index int, cluster_id string", "clusters string, number long", "append", "NoTimeout")


def backfill(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests for derived images, each photo once within the watermark."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["album_id", "photo_id"])
