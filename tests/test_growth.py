"""Steps that once grew faster than their input, or took one task."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from cullspark.functions import detector, image
from cullspark.functions import scalar as S
from cullspark.operators import duplicates, faces, identity, incremental
from cullspark.plans import catalogue, extraction

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def test_pictures_are_made_in_batches_on_all_cores(spark):
    p = extraction._pictures(spark, SF, "9 + photo_id % 3", "5 + photo_id % 2")
    assert p.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "unhex" not in plan and "ArrowEvalPython" in plan
    for r in p.orderBy("photo_id").limit(7).collect():
        n, pixels = r.photo_id, np.frombuffer(r.content, np.uint8).reshape(r.height, r.width, 3)
        blue = [[(n * 31 + x * x * 7 + y * 13 + x * y * (n % 97)) % 256 for x in range(r.width)] for y in range(r.height)]
        assert pixels[..., 0].tolist() == blue
        assert pixels[..., 1].tolist() == [[b * 3 % 256 for b in row] for row in blue] and pixels[..., 2].tolist() == [[(b + 85) % 256 for b in row] for row in blue]


@pytest.mark.parametrize("profile", list(image.SHARPNESS))
def test_images_of_one_size_are_scored_at_once(profile):
    some = np.random.default_rng(4).integers(0, 255, (5, 41, 170, 3)).astype(np.uint8)
    for box in (None, (1.5, 2.25, 166.0, 37.5), (3.0, 3.0, 20.0, 18.0), (0.0, 0.0, 2.0, 9.0)):
        together = np.broadcast_to(image.sharpness(image.luma(some.transpose(1, 2, 0, 3)), box, profile), 5)
        assert together == pytest.approx([image.sharpness(image.luma(p), box, profile) for p in some])


@pytest.mark.parametrize("profile", list(image.SOURCES))
def test_images_of_one_size_are_hashed_at_once(profile):
    some = np.random.default_rng(5).integers(0, 255, (4, 300, 520, 3)).astype(np.uint8)
    for turn in (None, 1, 6):
        assert image.dhashes(some.transpose(1, 2, 0, 3), profile, turn) == [image.dhash(p, profile, turn) for p in some]


def test_photos_without_company_are_left_out_and_pairs_stay(spark):
    """Photos alone within five minutes don't reach the join by numbers; those about midnight do."""
    day, w = duplicates.DAY, duplicates.WINDOW
    times = [0, w, 3 * w, 10 * w, 10 * w + w + 1, day - 1, day + w - 1, 3 * day - w - 1, -1, -w - 1, 5 * day + 7 * w, None]
    rows = [(1, k, None if t is None else t, f"IMG_{1000 + k}.JPG", "0" * 16) for k, t in enumerate(times)] + [(2, 99, 10 * w + 1, "IMG_1003.JPG", "0" * 16)]
    df = spark.createDataFrame(rows, "album_id long, photo_id long, captured_at long, file_name string, perceptual_hash string")
    t = {k: x or 0 for k, x in enumerate(times)}
    want = {(a, b) for a in t for b in t if a != b and (t[b], b) < (t[a], a) and t[a] - t[b] <= w and abs(a - b) <= 10}
    got = {(r.a_photo_id, r.b_photo_id) for r in duplicates._near_numbers(df).collect()}
    assert got == want and want
    kept = {r.photo_id for r in duplicates._in_company(df.selectExpr("*", "coalesce(captured_at, 0) as t")).collect()}
    assert not kept & {2, 3, 4, 10, 99} and {x for p in want for x in p} <= kept


def test_only_the_faces_of_photos_in_question_are_labelled(spark):
    all_ = catalogue.labelled(spark, SF)
    ids = all_.select("photo_id").distinct().where("photo_id % 7 = 2")
    columns = ["photo_id", "face_index", "eye", "focus"]
    few = catalogue.labelled(spark, SF, F.broadcast(ids))
    assert sorted(few.select(columns).collect()) == sorted(all_.where("photo_id % 7 = 2").select(columns).collect())
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("LeftSemi")  # the ids meet the rows before these are numbered


def plain_match(faces, clusters, start):
    """Every distance from lists, nearest first; ties by the order of lengths, faces and founding."""
    near = []
    for length in {len(p) for p, _ in clusters.values()}:
        for i, (p, size) in enumerate(faces):
            for k, (known, area) in clusters.items():
                if len(known) == length and 0 < len(p) <= length and size > 0 and area > 0 and max(area, size) <= identity.MATCH_AREA * min(area, size):
                    d = np.sqrt(((np.array(p) - np.array(known)[: len(p)]) ** 2).sum() / len(p))
                    if d < identity.MATCH:
                        near.append((d, i, k))
    out, used = [None] * len(faces), set()
    for _, i, k in sorted(near, key=lambda x: x[0]):
        if out[i] is None and k not in used:
            out[i] = k
            used.add(k)
            (known, area), (p, size) = clusters[k], faces[i]
            clusters[k] = ([o * identity.OLD_SHARE + n * identity.NEW_SHARE for o, n in zip(known, p)], area * identity.OLD_SHARE + size * identity.NEW_SHARE)
    for i, k in enumerate(out):
        if k is None:
            out[i] = f"person-{start}"
            clusters[out[i]] = faces[i]
            start += 1
    return out, start


def test_clusters_keep_their_arrays_between_photos():
    """Prints of three lengths, equal ones among them; a shorter print shortens its cluster."""
    r = np.random.default_rng(6)
    plain, held, one, two = {}, identity.Clusters(), 1, 1
    for _ in range(150):
        faces = [((r.integers(0, 4, r.choice([3, 5, 8])) / 40).tolist(), float(r.choice([0.0, 0.1, 0.2, 0.5]))) for _ in range(r.integers(1, 6))]
        want, one = plain_match(faces, plain, one)
        got, two = identity.match_faces(faces, held, two)
        assert got == want and one == two
    assert {k: (list(p), a) for k, (p, a) in held.items()} == {k: (list(p), a) for k, (p, a) in plain.items()}
    assert sum(g[3] for g in held.of_length.values()) > len(held)  # some have moved to a shorter length


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_boxes_of_photos_are_judged_in_batches(spark):
    """As photo by photo, with numbers that are none among them."""
    rng = np.random.default_rng(8)
    box = "struct<left: double, top: double, width: double, height: double>"
    rows = []
    for photo in range(300):
        boxes = np.round(rng.random((int(rng.integers(0, 12)), 4)) * 0.4, 2).tolist()
        rows.append((photo, [(k, tuple(b), float(rng.integers(0, 4))) for k, b in enumerate(boxes)]))
    rows += [(300, None), (301, [(0, (0.1, 0.1, float("nan"), 0.2), 1.0), (1, (0.1, 0.1, 0.2, 0.2), 2.0)]), (302, [(0, (0.1, 0.1, None, 0.2), 1.0), (1, (0.1, 0.1, 0.2, 0.2), None)])]
    df = spark.createDataFrame(rows, f"photo_id int, faces array<struct<face_index: int, box: {box}, score: double>>").repartition(3)
    for how in ({}, {"values": S.DETECTOR}, {"overlap": 0.3}, {"most": 3}, {"score": None}):
        how = {"score": lambda f: f["score"], **how}
        got = df.select("photo_id", faces.suppressed(F.col("faces"), **how).alias("a"), faces.folded(F.col("faces"), how["score"], how.get("values"), how.get("overlap"), how.get("most")).alias("b"))
        assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
        assert all(str(r.a) == str(r.b) for r in got.collect())


def test_what_pairs_need_is_worked_out_once_a_face(spark):
    """Rules name a face's measures and a photo's reference area once, not once a pair."""
    sets = catalogue._sets(spark, SF)
    assert _plan(sets.select(faces.without_artifacts(F.col("faces")).alias("x"))).count("filter(transform(faces") == 1
    assert _plan(sets.select(faces.without_displayed_media(F.col("faces"), yaw=catalogue._yaw).alias("x"))).count("RADIANS") == 1
    assert _plan(catalogue.labelled(spark, SF).select(S.fingerprint(F.col("face")).alias("x"))).count("try_element_at") == 4


def test_contours_are_judged_in_batches(spark):
    """As point by point, over several contours and lists of any length; points are made and judged in one pass of Arrow batches."""
    rng = np.random.default_rng(2)
    rows = [(k, None if k % 50 == 0 else [None if rng.random() < 0.002 else tuple(p) for p in (rng.random((int(rng.integers(95, 107)), 2)) * 9).tolist()]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, p array<struct<x: double, y: double>>").repartition(2)
    got = {r.k: r.ratio for r in df.select("k", detector.contour_eyes(F.col("p"))["ratio"].alias("ratio")).collect()}
    for k, points in rows:
        eyes = [[(points or [])[i] if i < len(points or []) else None for i in of] for of in (detector.LEFT_CONTOUR, detector.RIGHT_CONTOUR)]
        if any(p is None for e in eyes for p in e):
            assert got[k] is None
            continue
        ratio = 0
        for e in eyes:
            y = [p[1] for p in e]
            up, low = [v for v in y if v >= sum(y) / 10], [v for v in y if v <= sum(y) / 10]
            ratio += abs(sum(up) / len(up) - sum(low) / len(low)) / max(1e-3, max(p[0] for p in e) - min(p[0] for p in e))
        assert got[k] == pytest.approx(ratio / 2, abs=1e-12)
    plan = extraction.contour_eye_states(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "sequence(0, 105" not in plan


def test_key_faces_after_deletion_read_faces_once(spark):
    """The source's face comes with the variant, so lines are read once, and only what faces are made of."""
    plan = catalogue.QUERIES["keyface_patch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "FileScan" in line and "l_orderkey" in line]
    assert len(reads) == 1 and "l_partkey" in reads[0] and "l_shipdate" not in reads[0]
    f = catalogue._album_faces(spark, SF).withColumn("variant", S.variant_id(F.col("cluster"), F.col("eye"), F.col("focus")))
    gone = catalogue.photos(spark, SF).where("photo_id % 5 = 0")
    by_faces = incremental.key_faces_after_delete(identity.key_faces(f), gone, f)
    rows = lambda df: sorted(tuple(r) for r in df.select("album_id", "variant", "occurrences", "photo_ids", "source_photo_id", "source_face_index").collect())
    known = rows(incremental.key_faces_after_delete(identity.key_faces(f, indexes=True), gone))
    assert known == rows(by_faces) and any(r[-1] for r in known)


def test_key_faces_of_no_album_lose_deleted_photos_too(spark):
    variants = spark.createDataFrame([(None, "p::open::good", 3, [7, 8], [1, 0]), (None, "q::open::good", 1, [7], [2])], "album_id long, variant string, occurrences long, photo_ids array<long>, face_indexes array<int>")
    gone = spark.createDataFrame([(None, 7)], "album_id long, photo_id long")
    assert [tuple(r) for r in incremental.key_faces_after_delete(variants, gone).collect()] == [(None, "p::open::good", 2, [8], 8, 0)]
