"""Near-duplicate photos: a range join over time, a predicate over names, hashes and faces, and groups.

The five-minute range becomes an equality of time buckets, each photo meeting its own bucket and the one
before; where names count too, of buckets of their numbers. Either join shuffles by album and bucket, so
no album becomes a product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources import scratch

# The window in milliseconds, hash distances, name gaps.
WINDOW = 300_000
SAME, SAME_ADJACENT, SCENE, SCENE_ADJACENT = 4, 8, 24, 30
GAP, ADJACENT = 10, 2
KEEPER = 2
# Milliseconds within which the older detector sorts photos.
HOUR = 3_600_000
# Milliseconds within which photos are looked for company; no part of the rule.
DAY = 86_400_000


def pairs(photos: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs (a later, b earlier) of one album within window; missing times count as 0, ties are by photo_id."""
    t = F.coalesce("captured_at", F.lit(0)).cast("long")
    base = photos.withColumn("t", t).withColumn("bucket", F.floor(F.col("t") / window))
    keys = ["album_id", "bucket"]
    held = [c for c in base.columns if c not in keys]
    late = base.select(*keys, *(F.col(c).alias(f"a_{c}") for c in held))
    early = base.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1))).select(*keys, *(F.col(c).alias(f"b_{c}") for c in held))
    order = (F.col("b_t") < F.col("a_t")) | ((F.col("b_t") == F.col("a_t")) & (F.col("b_photo_id") < F.col("a_photo_id")))
    return late.join(early, keys).where(order & (F.col("a_t") - F.col("b_t") <= window)).withColumn("dt", F.col("a_t") - F.col("b_t"))


def near_duplicate(gap: Column, apart: Column, both_hashes: Column, framing: Column, faces: Column) -> Column:
    """The decision for a pair, cheap tests first. apart is null where a hash is missing."""
    adjacent = gap <= ADJACENT
    near = F.coalesce(apart, F.lit(999))
    far = both_hashes & (near > F.when(adjacent, SCENE_ADJACENT).otherwise(SCENE))
    return F.when(gap.isNull() | (gap > GAP), False).when(near <= SAME, True).when(adjacent & (near <= SAME_ADJACENT), True).when(far, False).when(adjacent & both_hashes & framing, True).otherwise(faces & framing)


def _in_company(photos: DataFrame) -> DataFrame:
    """photos (album_id, t and others) without those that have no other of their album within WINDOW.

    Times are compared inside a day; photos within WINDOW of its beginning or end stay as they are.
    """
    at = F.pmod(F.col("t"), F.lit(DAY))
    inside = Window.partitionBy("album_id", F.col("t") - at).orderBy("t")
    near = (F.col("t") - F.lag("t").over(inside) <= WINDOW) | (F.lead("t").over(inside) - F.col("t") <= WINDOW)
    return photos.withColumn("_near", near | (at < WINDOW) | (at >= DAY - WINDOW)).where("_near").drop("_near")


def _near_numbers(photos: DataFrame) -> DataFrame:
    """Pairs (a later, b earlier) of one album and name prefix within WINDOW whose numbers are GAP apart at most.

    Numbers are dealt in tens and meet their own ten and its neighbours, so photos of one time, or of none,
    make no bucket of their own. Only ids, times, numbers and hashes of photos that aren't alone are shuffled.
    """
    n = F.col("file_name")
    rows = _in_company(photos.select("album_id", "photo_id", F.coalesce("captured_at", F.lit(0)).cast("long").alias("t"), "file_name", "perceptual_hash"))
    rows = rows.select("album_id", "photo_id", "t", S.burst_prefix(n).alias("prefix"), S.burst_index(n).alias("idx"), "perceptual_hash").where("prefix is not null and idx is not null")
    ten = F.col("idx") - F.col("idx") % GAP
    keys, held = ["album_id", "prefix", "ten"], ["photo_id", "t", "idx", "perceptual_hash"]
    late = rows.withColumn("ten", ten).select(*keys, *(F.col(c).alias(f"a_{c}") for c in held))
    early = rows.withColumn("ten", F.explode(F.array(ten - GAP, ten, ten + GAP))).select(*keys, *(F.col(c).alias(f"b_{c}") for c in held))
    order = (F.col("b_t") < F.col("a_t")) | ((F.col("b_t") == F.col("a_t")) & (F.col("b_photo_id") < F.col("a_photo_id")))
    p = late.join(early, keys).where(order & (F.col("a_t") - F.col("b_t") <= WINDOW))
    return p.withColumn("gap", F.abs(F.col("a_idx") - F.col("b_idx"))).where(F.col("gap") <= GAP)


#: Photos that may be broadcast, once they were counted: ids alone.
FEW = 1_000_000


def gathered(faces: DataFrame) -> DataFrame:
    """photo_id, boxes and prints of faces (photo_id, face_index, box, print), in order of face_index."""
    by = faces.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("face_index", "box", "print"))).alias("_f"))
    return by.select("photo_id", F.transform("_f", lambda x: x["box"]).alias("boxes"), F.transform("_f", lambda x: x["print"]).alias("prints"))


def duplicate_pairs(photos: DataFrame, faces: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Near-duplicate pairs (album_id, a, b, gap, hamming) of photos, given their faces (photo_id, face_index, box, print).

    Numbers and hashes decide most pairs. The others are written and the photos in them counted, and only those
    photos' faces are read, gathered and joined. faces may be a function from photo_ids to their faces, so that
    what it does before is done for those photos alone.
    """
    p = _near_numbers(photos)
    hashes = (F.coalesce("a_perceptual_hash", F.lit("")) != "") & (F.coalesce("b_perceptual_hash", F.lit("")) != "")
    p = p.withColumn("both_hashes", hashes).withColumn("hamming", F.when(hashes, S.hamming(F.col("a_perceptual_hash"), F.col("b_perceptual_hash"))))
    judge = lambda framing, faces: near_duplicate(F.col("gap"), F.col("hamming"), F.col("both_hashes"), framing, faces)
    p = p.select("album_id", F.col("a_photo_id").alias("a"), F.col("b_photo_id").alias("b"), "gap", "hamming", "both_hashes")
    p = p.withColumn("sure", judge(F.lit(False), F.lit(False))).where(judge(F.lit(True), F.lit(True)))
    p = scratch.written(p, "pairs")
    open_ = p.where("not sure")
    asked = scratch.written(open_.select(F.explode(F.array("a", "b")).alias("photo_id")).distinct(), "asked")
    given = F.broadcast(asked) if asked.count() <= FEW else asked
    seen = scratch.written(gathered(faces(given) if callable(faces) else faces.join(given, "photo_id", "left_semi")), "seen")
    for k in "ab":
        face = seen.select(F.col("photo_id").alias(k), F.col("boxes").alias(f"{k}_boxes"), F.col("prints").alias(f"{k}_prints"))
        open_ = open_.join(face, k, "left")
    some = lambda c: F.coalesce(c, F.array())
    framing = S.framings_similar(some(F.col("a_boxes")), some(F.col("b_boxes")))
    alike = S.faces_similar(some(F.col("a_prints")), some(F.col("b_prints")))
    columns = ["album_id", "a", "b", "gap", "hamming"]
    return p.where("sure").select(*columns).unionByName(open_.where(judge(framing, alike)).select(*columns))


def groups(photos: DataFrame, links: DataFrame) -> DataFrame:
    """album_id, photo_id, component (smallest photo_id) of photos in groups, from links (album_id, a, b).

    Labels shrink by hooking to the smallest neighbour and jumping along labels until nothing changes;
    each round is written, so it runs once, lineage stays short and lost executors cost one round.
    """
    edges = links.select("album_id", "a", "b").unionByName(links.select("album_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = scratch.written(edges, "edges")
    label = scratch.written(edges.groupBy("album_id", F.col("a").alias("photo_id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "label")
    while True:
        near = edges.join(label.withColumnRenamed("photo_id", "b"), ["album_id", "b"]).groupBy("album_id", F.col("a").alias("photo_id")).agg(F.min("component").alias("near"))
        next_ = label.join(near, ["album_id", "photo_id"]).select("album_id", "photo_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = label.select("album_id", F.col("photo_id").alias("component"), F.col("component").alias("up"))
        next_ = next_.join(up, ["album_id", "component"], "left").select("album_id", "photo_id", "old", F.least("component", F.coalesce("up", "component")).alias("component"))
        next_ = scratch.written(next_, "label")
        moved = not next_.where("old <> component").isEmpty()
        label = next_.drop("old")
        if not moved:
            return label


def ensure_checkpoints(spark) -> None:
    """Checkpoints go to the folder that all machines see."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch.shared_dir(spark))


def tier(blurred: Column, closed: Column) -> Column:
    return F.when(blurred, 0).when(closed, 1).otherwise(KEEPER)


def preference(prefix: str = "") -> list[Column]:
    """Sort order in which the best photo of a group comes first."""
    c = lambda n: F.col(prefix + n)
    return [F.desc(tier(c("blurred"), c("closed_eyes"))), F.desc(F.coalesce(c("star_rating"), F.lit(0))), F.asc_nulls_last(c("captured_at")), S.natural_key(c("file_name")).asc(), c("photo_id").cast("string").asc()]


def best_of_groups(photos: DataFrame, members: DataFrame) -> DataFrame:
    """Members with group_id, best_photo_id and duplicated, for groups of at least two."""
    m = photos.join(members, ["album_id", "photo_id"])
    w = Window.partitionBy("album_id", "component")
    m = m.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("best_photo_id", F.first("photo_id").over(w.orderBy(*preference())))
    m = m.where("n > 1").withColumn("group_id", F.concat_ws("-", F.lit("dup"), "best_photo_id", "n"))
    return m.select("album_id", "photo_id", "component", "group_id", "best_photo_id", (F.col("photo_id") != F.col("best_photo_id")).alias("duplicated"))


def hash_blocks(photos: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (a < b) of an album within a Hamming distance: of most + 1 blocks of the hash one must be equal.

    A pair is kept in the first block that it shares, so each comes once.
    """
    half = lambda k: F.conv(F.substring("perceptual_hash", k, 8), 16, 10).cast("long")
    size = -(-64 // (most + 1))
    masks = [((1 << min(64, (k + 1) * size)) - (1 << k * size)) for k in range(most + 1)]
    masks = [F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in masks]
    rows = photos.where(S.valid_hash(F.col("perceptual_hash")).isNotNull()).select("album_id", "photo_id", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("h"))
    rows = rows.select("album_id", "photo_id", "h", F.posexplode(F.array(*(F.col("h").bitwiseAND(m) for m in masks))).alias("k", "block"))
    one, two = (rows.select("album_id", "k", "block", F.col("photo_id").alias(x), F.col("h").alias("h" + x)) for x in "ab")
    near = one.join(two, ["album_id", "k", "block"]).where(F.col("a") < F.col("b")).withColumn("x", F.col("ha").bitwiseXOR(F.col("hb")))
    first = F.lit(True)
    for k, m in enumerate(masks):
        first = first & ((F.col("k") <= k) | (F.col("x").bitwiseAND(m) != 0))
    return near.where(first & (F.bit_count("x") <= most)).select("album_id", "a", "b", F.bit_count("x").alias("hamming"))


def _runs(timed: DataFrame, within: int) -> DataFrame:
    """Adds run, the time at which an album's photos begin or go on after a gap of within: photos of two runs are never near.

    Photos are sorted inside an hour; by album only the hours' first and last times are.
    """
    t, inside = F.col("t"), Window.partitionBy("album_id", "hour").orderBy("t")
    rows = timed.withColumn("hour", F.floor(t / HOUR)).withColumn("begins", F.when(t - F.lag("t").over(inside) >= within, t))
    album = Window.partitionBy("album_id").orderBy("hour")
    hours = rows.groupBy("album_id", "hour").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("begins").alias("begun"))
    gap = F.col("first") - F.lag("last").over(album)
    hours = hours.withColumn("head", F.when(gap.isNull() | (gap >= within), F.col("first")))
    before = F.last(F.coalesce("begun", "head"), ignorenulls=True).over(album.rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select("album_id", "hour", F.coalesce("head", before).alias("open"))
    return rows.join(hours, ["album_id", "hour"]).withColumn("run", F.coalesce(F.max("begins").over(inside), "open")).drop("hour", "begins", "open")


def greedy_duplicates(photos: DataFrame, most: int = 8, within: int = 5000) -> DataFrame:
    """The older detector: in order of time each photo meets the later ones that are near; the larger file stays, or at one size the earlier.

    keeper is the photo that a duplicate lost to first, else its own id. A photo that has lost meets the rest
    of its near ones, but begins no round. At one size and one time the one later in order of photo_id stays.
    Photos are dealt by runs without a gap of within; a task holds one run and a batch at a time. The time is
    captured_at, else uploaded_at if there is one, else 0.
    """

    def solved(pdf, starts):
        t, size, ids = (pdf[c].to_numpy() for c in ("t", "file_size", "photo_id"))
        hashes = np.array([int(h, 16) for h in pdf["perceptual_hash"]], np.uint64)
        of = np.full(len(pdf), -1)
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            for i in range(a, b - 1):  # a run of one photo has no round
                if of[i] >= 0:
                    continue
                e = a + np.searchsorted(t[a:b], t[i] + within)
                for j in i + 1 + np.flatnonzero((np.bitwise_count(hashes[i + 1 : e] ^ hashes[i]) <= most) & (of[i + 1 : e] < 0)):
                    win, lose = (i, j) if (size[i] > size[j] if size[i] != size[j] else t[i] < t[j]) else (j, i)
                    of[lose] = win if of[lose] < 0 else of[lose]
        return pdf.assign(keeper=np.where(of < 0, ids, ids[of]))[["album_id", "photo_id", "keeper"]]

    def run(batches):
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            if (held[0][["album_id", "run"]].iloc[0] == pdf[["album_id", "run"]].iloc[-1]).all():
                continue
            rows = pd.concat(held, ignore_index=True)
            new = (rows["album_id"] != rows["album_id"].shift()) | (rows["run"] != rows["run"].shift())
            starts = np.flatnonzero(new)
            yield solved(rows.iloc[: starts[-1]], starts[:-1])
            held = [rows.iloc[starts[-1] :]]
        if held:
            yield solved(pd.concat(held, ignore_index=True), [0])

    time = F.coalesce(*(c for c in ("captured_at", "uploaded_at") if c in photos.columns), F.lit(0)).cast("long").alias("t")
    timed = photos.where(S.valid_hash(F.col("perceptual_hash")).isNotNull()).select("album_id", "photo_id", "perceptual_hash", F.coalesce("file_size", F.lit(0)).cast("long").alias("file_size"), time)
    runs = _runs(timed, within).repartition("album_id", "run").sortWithinPartitions("album_id", "run", "t", "photo_id")
    return runs.mapInPandas(run, "album_id long, photo_id long, keeper long")
