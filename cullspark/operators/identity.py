"""People across photos: face clusters, key faces and their merging.

Grouping, counting and representatives are aggregates. Matching a face to a cluster depends on all faces
before it, so that runs per album in order of time, with state only of the clusters found so far.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

# Fixed values of matching and blending.
MATCH, MATCH_AREA = 0.05, 3.0
MERGE, MERGE_SAME_SCENE = 0.08, 0.18
OLD_SHARE, NEW_SHARE = 0.65, 0.35
#: Distances that two engines sum differ by less.
ROUNDING = 1e-6


def rms(a: list[float], b: list[float]) -> float:
    """Root mean square difference over a's length; NaN where b is shorter."""
    if len(b) < len(a) or not len(a):
        return math.nan
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)) / len(a))


class Clusters(dict):
    """Clusters (fingerprint, area) by id, in the order they were founded, with arrays of those of one length that grow as clusters do."""

    def __init__(self, given=()):
        super().__init__()
        self.of_length: dict[int, list] = {}  # ids' ranks, prints, areas, how many
        self.place: dict[str, tuple[int, int]] = {}
        self.names: list[str] = []
        self.rank: dict[str, int] = {}
        for k, v in dict(given).items():
            self[k] = v

    def __setitem__(self, k: str, v: tuple[list[float], float]) -> None:
        super().__setitem__(k, v)
        print_, area = v
        if k not in self.rank:
            self.rank[k] = len(self.names)
            self.names.append(k)
        length, row = self.place.get(k, (None, 0))
        if length != len(print_):
            if length is not None:
                self.of_length[length][2][row] = -1.0  # fits nothing any more
            length = len(print_)
            group = self.of_length.setdefault(length, [np.zeros(8, int), np.zeros((8, length)), np.zeros(8), 0])
            row = group[3]
            if row == len(group[0]):
                group[:3] = [np.concatenate([x, np.zeros_like(x)]) for x in group[:3]]
            group[3] += 1
            group[0][row] = self.rank[k]
            self.place[k] = (length, row)
        group = self.of_length[length]
        group[1][row], group[2][row] = print_, area


def match_faces(faces: list[tuple[list[float], float]], clusters: dict[str, tuple[list[float], float]], start: int) -> tuple[list[str], int]:
    """Cluster ids of one photo's faces (fingerprint, area); clusters are updated in place.

    All distances are taken before any cluster moves; pairs are taken nearest first, each face and each
    cluster once; a matched cluster blends towards the face, other faces found new clusters.
    """
    if not isinstance(clusters, Clusters):
        known = Clusters(clusters)
        ids, start = match_faces(faces, known, start)
        clusters.update(known)
        return ids, start
    near = []
    for length in set(clusters.of_length):
        ranks, prints, areas, n = clusters.of_length[length]
        ranks, area = ranks[:n], areas[:n]
        for width in {len(p) for p, _ in faces}:  # a shorter print is held against the beginning, a longer one matches nothing
            of = [i for i, (p, size) in enumerate(faces) if len(p) == width and size > 0]
            if not of or not 0 < width <= length:
                continue
            own, size = np.array([faces[i][0] for i in of]), np.array([faces[i][1] for i in of])[:, None]
            d = np.sqrt(((own[:, None, :] - prints[None, :n, :width]) ** 2).sum(axis=2) / width)
            fits = (d < MATCH) & (area > 0) & (np.maximum(area, size) <= MATCH_AREA * np.minimum(area, size))
            near += [(d[r, k], length, of[r], ranks[k]) for r, k in zip(*np.nonzero(fits))]
    order = {length: k for k, length in enumerate(set(clusters.of_length))}
    near = [(d, i, clusters.names[k]) for d, length, i, k in sorted(near, key=lambda x: (x[0], order[x[1]], *x[2:]))]
    out: list[str | None] = [None] * len(faces)
    used: set[str] = set()
    for _, i, k in near:
        if out[i] is None and k not in used:
            out[i] = k
            used.add(k)
            known, area = clusters[k]
            print_, size = faces[i]
            clusters[k] = ([o * OLD_SHARE + n * NEW_SHARE for o, n in zip(known, print_)], area * OLD_SHARE + size * NEW_SHARE)
    for i, k in enumerate(out):
        if k is None:
            out[i] = f"person-{start}"
            clusters[out[i]] = faces[i]
            start += 1
    return out, start


_CLUSTERED = "album_id long, photo_id long, face_index int, cluster_id string"


def cluster_faces(faces: DataFrame) -> DataFrame:
    """cluster_id of each face (album_id, photo_id, captured_at, face_index, print, area), album by album in order of time.

    A task reads an album's photos in batches and holds only the clusters found so far.
    """

    def run(batches):
        album, clusters, number, held = None, Clusters(), 1, None
        for pdf in _then_none(batches):
            rows = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            if rows is None or not len(rows):
                continue
            if pdf is not None:  # the last photo may go on in the next batch
                open_ = (rows["album_id"] == rows["album_id"].iloc[-1]) & (rows["photo_id"] == rows["photo_id"].iloc[-1])
                rows, held = rows[~open_], rows[open_]
            out = []
            albums, photos, indexes, prints, areas = (rows[c].tolist() for c in ("album_id", "photo_id", "face_index", "print", "area"))
            new = (rows["album_id"] != rows["album_id"].shift()) | (rows["photo_id"] != rows["photo_id"].shift())
            starts = np.flatnonzero(new).tolist()
            for a, b in zip(starts, [*starts[1:], len(rows)]):
                if albums[a] != album:
                    album, clusters, number = albums[a], Clusters(), 1
                ids, number = match_faces([(p.tolist(), size) for p, size in zip(prints[a:b], areas[a:b])], clusters, number)
                out += [(album, photos[a], f, c) for f, c in zip(indexes[a:b], ids)]
            yield pd.DataFrame(out, columns=["album_id", "photo_id", "face_index", "cluster_id"])

    chosen = faces.select("album_id", "photo_id", "captured_at", "face_index", "print", "area")
    order = ["album_id", F.asc_nulls_first("captured_at"), "photo_id", "face_index"]
    return chosen.repartition("album_id").sortWithinPartitions(*order).mapInPandas(run, _CLUSTERED)


def _then_none(batches):
    yield from batches
    yield None


def resolved_cluster(faces: DataFrame) -> DataFrame:
    """Adds cluster: an empty or, in its photo, repeated cluster_id becomes photo_id#face_index."""
    seen = F.row_number().over(Window.partitionBy("photo_id", "cluster_id").orderBy("face_index"))
    own = F.concat_ws("#", "photo_id", "face_index")
    return faces.withColumn("cluster", F.when((F.coalesce("cluster_id", F.lit("")) == "") | (seen > 1), own).otherwise(F.col("cluster_id")))


def key_faces(faces: DataFrame, indexes: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Variants (cluster, eye, focus) of an album: occurrences, photos in first-seen order and the best face.

    faces: album_id, photo_id, photo_order, face_index, cluster, eye, focus, sharpness, yaw, pitch, box.
    With indexes also face_indexes, the variant's first face in each of the photos. best has photo_id, face_index, score
    and the carried columns.
    """
    b = F.col("box")
    score = F.when(F.col("eye") == "open", 400).when(F.col("eye") == "partial", 200).otherwise(0) + F.when(F.col("focus") == "good", 300).when(F.col("focus") == "soft", 150).otherwise(0)
    score = score + F.least(F.col("sharpness"), F.lit(100)) + F.greatest(F.lit(0), 100 - F.abs("yaw") - F.abs("pitch")) + b["width"] * b["height"] * 500 - F.col("photo_order") * 10
    f = faces.withColumn("score", score).withColumn("variant", S.variant_id(F.col("cluster"), F.col("eye"), F.col("focus")))
    ordered = F.array_sort(F.collect_set(F.struct("photo_order", "photo_id", *(["face_index"] if indexes else []))))
    rank = F.struct("score", (-F.col("photo_order")).alias("o"), (-F.col("face_index")).alias("i"))
    k = f.groupBy("album_id", "variant").agg(F.count(F.lit(1)).alias("occurrences"), ordered.alias("members"), F.max_by(F.struct("photo_id", "face_index", "score", *carried), rank).alias("best"), F.min(F.struct("photo_order", "face_index")).alias("first"))
    members = F.col("members")
    if indexes:  # sorted, so a photo's first entry has its first face
        members = F.filter(members, lambda x, i: (i == 0) | (F.get(F.col("members"), i - 1)["photo_id"] != x["photo_id"]))
    photos = [F.transform(members, lambda x: x["photo_id"]).alias("photo_ids"), *([F.transform(members, lambda x: x["face_index"]).alias("face_indexes")] if indexes else [])]
    return k.select("album_id", "variant", "occurrences", *photos, "best", F.col("first.photo_order").alias("first_order"), F.col("first.face_index").alias("first_face"))


def merge_key_faces(variants: DataFrame, threshold: float = MERGE, same_scene: float = MERGE_SAME_SCENE) -> DataFrame:
    """Merges an album's variants of one eye and focus that show one person; greedy in first-seen order.

    variants: album_id, variant, eye, focus, print, area, box, score, photo_ids, first_order, first_face and, if known,
    crop_uri and scenes (duplicate groups of its photos). Two merge if they share no photo, and have one crop,
    or prints nearer than threshold, or nearer than same_scene with a scene in common and boxes alike in size,
    shape and place. A better-scored member gives its print, area and box; another only blends in. Gives variant
    and merged_into. A task holds the variants of one eye and focus of an album, people times three at most.

    Until two have merged all are as they were given, so where no two of a group could merge as given, none ever does:
    those groups are told by columns and keep their variants; only the others are walked.
    """
    for name, kind in (("crop_uri", "string"), ("scenes", "array<string>")):
        variants = variants if name in variants.columns else variants.withColumn(name, F.lit(None).cast(kind))

    def framed(a: dict, b: dict) -> bool:
        x, y = a["box"], b["box"]
        aspect = lambda box: box["width"] / max(box["height"], 1e-8)
        for one, two, most in ((a["area"], b["area"], 1.85), (aspect(x), aspect(y), 1.35)):
            if min(one, two) <= 1e-8 or max(one, two) / min(one, two) > most:
                return False
        apart = math.hypot(x["left"] + x["width"] * 0.5 - y["left"] - y["width"] * 0.5, x["top"] + x["height"] * 0.5 - y["top"] - y["height"] * 0.5)
        return apart < (math.hypot(x["width"], x["height"]) + math.hypot(y["width"], y["height"])) / 2 * 0.55

    def one_person(k: dict, r: dict) -> bool:
        if k["photos"] & r["photos"]:
            return False
        if k["crop"] and k["crop"] == r["crop"]:
            return True
        if not k["print"] or len(k["print"]) != len(r["print"]):
            return False
        d = rms(k["print"], r["print"])
        return d < threshold or (d < same_scene and bool(k["scenes"] & r["scenes"]) and framed(k, r))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        rows = []
        # groups are many and small, so rows are plain tuples: sorting and walking a frame costs more than the rule
        last = lambda x: (x is None or x != x, x)
        given = zip(*(pdf[c].tolist() for c in ("first_order", "first_face", "variant", "album_id", "photo_ids", "scenes", "print", "area", "box", "score", "crop_uri")))
        for _, _, variant, album, photos, scenes, print_, area, box, score, crop in sorted(given, key=lambda v: (*last(v[0]), *last(v[1]), v[2])):
            scenes = set() if scenes is None else set(scenes)
            box_area = max(0.0, box["width"]) * max(0.0, box["height"])
            r = {"variant": variant, "photos": set(photos), "scenes": scenes, "print": list(print_), "area": box_area, "blended": area, "box": box, "score": score, "crop": crop}
            k = next((k for k in kept if one_person(k, r)), None)
            if k is None:
                kept.append(r)
            else:
                if r["score"] > k["score"]:
                    k.update({x: r[x] for x in ("print", "area", "blended", "box", "score", "crop")})
                elif len(k["print"]) == len(r["print"]) and k["print"]:
                    k["print"] = [o * OLD_SHARE + n * NEW_SHARE for o, n in zip(k["print"], r["print"])]
                    k["blended"] = k["blended"] * OLD_SHARE + r["blended"] * NEW_SHARE
                k["photos"] |= r["photos"]
                k["scenes"] |= r["scenes"]
            rows.append((album, variant, (k or r)["variant"]))
        return pd.DataFrame(rows, columns=["album_id", "variant", "merged_into"])

    def may_merge(x: Column, y: Column) -> Column:
        """Whether one_person may hold; true also where it isn't known, or by rounding."""
        n = F.size(x["print"])
        d = F.sqrt(F.aggregate(F.zip_with(x["print"], y["print"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / n)
        scene = F.coalesce(F.arrays_overlap(x["scenes"], y["scenes"]), x["scenes"].isNotNull() & y["scenes"].isNotNull())
        near = (n > 0) & (n == F.size(y["print"])) & ((d < threshold + ROUNDING) | (scene & (d < same_scene + ROUNDING)))
        crop = F.coalesce((x["crop_uri"] != "") & (x["crop_uri"] == y["crop_uri"]), F.lit(False))
        return F.coalesce((x["variant"] <= y["variant"]) & ~F.arrays_overlap(x["photo_ids"], y["photo_ids"]) & (crop | near), F.lit(True))

    keys, held = ["album_id", "eye", "focus"], ["variant", "print", "area", "box", "score", "photo_ids", "first_order", "first_face", "crop_uri", "scenes"]
    by = variants.groupBy(*keys).agg(F.collect_list(F.struct(*held)).alias("_v"))
    by = by.withColumn("_open", F.exists("_v", lambda x: F.exists("_v", lambda y: may_merge(x, y))))
    alone = by.where("not _open").select(F.col("album_id").cast("long").alias("album_id"), F.explode(F.transform("_v", lambda x: x["variant"])).alias("variant"))
    walked = by.where("_open").select(*keys, F.inline("_v")).groupBy(*keys).applyInPandas(run, "album_id long, variant string, merged_into string")
    return alone.select("album_id", "variant", F.col("variant").alias("merged_into")).unionByName(walked)


def scenes_of(variants: DataFrame, members: DataFrame) -> DataFrame:
    """variants (album_id, variant, photo_ids, ...) with scenes: the duplicate groups (album_id, photo_id, group_id) of their photos."""
    own = variants.select("album_id", "variant", F.explode("photo_ids").alias("photo_id")).join(members.select("album_id", "photo_id", "group_id"), ["album_id", "photo_id"])
    own = own.groupBy("album_id", "variant").agg(F.array_sort(F.collect_set("group_id")).alias("scenes"))
    return variants.join(own, ["album_id", "variant"], "left")


def share_scene(a, b):
    """Whether two sets of photos or of duplicate groups meet; null or empty ones never do."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
