"""Golden rows, edges and plain loops for the photo engine."""

import collections
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cullspark.functions import image
from cullspark.functions import scalar as S
from cullspark.operators import duplicates, faces, identity, incremental, merge
from cullspark.plans import catalogue
from cullspark.sources import store
from cullspark.streaming import updates

DIR = "/root/testdata/sf0.001"


def value(spark, column, **columns):
    df = spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{k} {t}" for k, (_, t) in columns.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("eyes, want", [((False, 95, 0.12, 0.18), "closed"), ((False, 95, 0.10, 0.45), "partial"), ((True, 70, None, None), "open"), ((True, 69, None, None), "partial"), ((False, 88, None, None), "closed"), ((False, 87, None, None), "partial"), ((True, None, 0.9, 0.9), "partial"), ((True, 90, math.nan, 0.9), "open"), ((None, 60, 0.9, 0.4), "open")])
def test_eye_status(spark, eyes, want):
    c = S.eye_status(*(F.col(k) for k in "vclr"))
    v, conf, left, right = eyes
    assert value(spark, c, v=(v, "boolean"), c=(conf, "int"), l=(left, "double"), r=(right, "double")) == want


def test_focus(spark):
    assert [r[0] for r in spark.createDataFrame([(65,), (64,), (40,), (39,), (None,)], "s int").select(S.focus_level(F.col("s"))).collect()] == ["good", "soft", "soft", "blurred", "blurred"]


def test_hashes_and_names(spark):
    df = spark.createDataFrame([("35de531b646d2da5", "35ce9319646d05a5", "IMG_3811.JPG"), ("f" * 16, "0" * 16, "noindex.JPG"), ("8000000000000000", "0" * 16, "a.b.007")], "a string, b string, n string")
    got = df.select(S.hamming(F.col("a"), F.col("b")), S.burst_prefix(F.col("n")), S.burst_index(F.col("n")).cast("long")).collect()
    assert [tuple(r) for r in got] == [(6, "img_", 3811), (64, None, None), (1, None, None)]
    assert [r[0] for r in spark.createDataFrame([("IMG_10",), ("img_9",), ("IMG_2",)], "n string").orderBy(S.natural_key(F.col("n"))).collect()] == ["IMG_2", "img_9", "IMG_10"]
    long = ["x" + "9" * 30, "x1" + "0" * 30, "x1" + "0" * 29 + "1", "x" + "0" * 50 + "2" + "0" * 30]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in long[::-1]], "n string").orderBy(S.natural_key(F.col("n"))).collect()] == long


def test_exif(spark):
    df = spark.createDataFrame([("2020:01:02 03:04:05",), ("2021:02:31 00:00:00",), ("1969:01:01 00:00:00",), ("2020:13:01 00:00:00",), ("x",), (None,), ("2020:01:01 00:00:60Z",)], "t string")
    assert [r[0] for r in df.select(S.exif_millis(F.col("t"))).collect()] == [1577934245000, 1614729600000, None, None, None, None, 1577836860000]


def test_small_functions(spark):
    assert value(spark, S.supported_format(F.col("n"), F.col("t")), n=("a.WEBP", "string"), t=(None, "string")) is False
    assert value(spark, S.supported_format(F.col("n"), F.col("t")), n=("a.jpg", "string"), t=(None, "string")) is True
    assert value(spark, S.photo_id_of_file(F.col("n")), n=(".hidden", "string")) == ".hidden"
    assert value(spark, S.needs_reanalysis(F.col("n")), n=("scrfd-ocec-15", "string")) is False
    assert value(spark, S.parse_variant(F.col("n")), n=("p::open::soft", "string")).asDict() == {"cluster": "p", "eye": "open", "focus": "soft"}
    assert value(spark, S.parse_variant(F.col("n")), n=("p::open", "string")) is None
    assert [value(spark, S.backoff_bound(F.col("n")), n=(k, "int")) for k in (0, 1, 5)] == [500, 1000, 8000]


BOX = "left double, top double, width double, height double"


def photo_rows(spark, rows):
    """(photo_id, name, time, hash) of one album with one face each."""
    box = {"left": 0.3, "top": 0.2, "width": 0.25, "height": 0.3}
    data = [(1, p, n, t, h, s, 0, [tuple(box.values())], [[0.8, 0.3, 0.2, 0.0, 0.0]]) for p, n, t, h, s in rows]
    return spark.createDataFrame(data, f"album_id long, photo_id long, file_name string, captured_at long, perceptual_hash string, star_rating int, file_size long, boxes array<struct<{BOX}>>, prints array<array<double>>").withColumns({"blurred": F.lit(False), "closed_eyes": F.lit(False), "selected": F.lit(True), "duplicated": F.lit(False)})


def found(spark, rows):
    p = photo_rows(spark, rows)
    faces_ = p.select("photo_id", F.posexplode(F.arrays_zip("boxes", "prints")).alias("face_index", "f")).select("photo_id", "face_index", F.col("f.boxes").alias("box"), F.col("f.prints").alias("print"))
    links = duplicates.duplicate_pairs(p, faces_)
    return p, duplicates.best_of_groups(p, duplicates.groups(p, links))


def test_near_duplicates(spark):
    near, far = "35de531b646d2da5", "35ce9319646d05a5"
    _, m = found(spark, [(1, "IMG_3811.JPG", 1000, near, 5), (2, "IMG_3812.JPG", 2000, far, 5)])
    assert {r.photo_id: (r.group_id, r.duplicated) for r in m.collect()} == {1: ("dup-1-2", False), 2: ("dup-1-2", True)}
    _, m = found(spark, [(1, "IMG_3811.JPG", 1000, near, 5), (2, "IMG_3812.JPG", 301_001, far, 5), (3, "TR5_1337.JPG", 1000, near, 5), (4, "IMG_3899.JPG", 1000, near, 5)])
    assert m.count() == 0
    _, m = found(spark, [(k, f"IMG_{3688 + k}.JPG", None, near, 5) for k in (3, 2, 1)] + [(9, "nodigits.JPG", None, near, 5)])
    assert {r.photo_id for r in m.where("not duplicated").collect()} == {1} and m.count() == 3


def test_groups_after_delete(spark):
    p, m = found(spark, [(k, f"IMG_{3688 + k}.JPG", 1000 * k, "35de531b646d2da5", 5) for k in (1, 2, 3)])
    left = incremental.groups_after_delete(m, p, p.where("photo_id = 1")).orderBy("photo_id").collect()
    assert [(r.photo_id, r.group_id, r.best_photo_id, r.duplicated) for r in left] == [(2, "dup-1-3", 2, False), (3, "dup-1-3", 2, True)]
    left = incremental.groups_after_delete(m, p, p.where("photo_id < 3")).collect()
    assert [(r.group_id, r.duplicated) for r in left] == [(None, False)]


def test_chains_become_one_group(spark):
    r = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(r.randint(100, 200), r.randint(100, 200)) for _ in range(60)]
    df = spark.createDataFrame([(1, a, b) for a, b in links if a != b], "album_id long, a long, b long")
    got = {x.photo_id: x.component for x in duplicates.groups(None, df).collect()}
    parent = {x: x for p in links for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert all(got[x] == top(x) for x in got)


def loop_suppressed(boxes):
    def area(b):
        return max(0, b[2]) * max(0, b[3])

    def redundant(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        inter = max(0, w) * max(0, h)
        if inter <= 0:
            return False
        small, large = sorted((area(a), area(b)))
        iou, uneven = inter / (small + large - inter), large / max(small, 1e-8) >= 1.8
        apart = math.dist((a[0] + a[2] / 2, a[1] + a[3] / 2), (b[0] + b[2] / 2, b[1] + b[3] / 2))
        return iou >= 0.42 or (uneven and inter / max(small, 1e-8) >= 0.5) or (uneven and iou >= 0.18 and apart < 0.48 * min(math.hypot(a[2], a[3]), math.hypot(b[2], b[3])))

    kept = []
    for i in sorted(range(len(boxes)), key=lambda i: (-round(area(boxes[i]) * 1e3 + boxes[i][4], 6), i)):
        if not any(redundant(boxes[k], boxes[i]) for k in kept):
            kept.append(i)
    return kept


def test_suppression_and_its_order(spark):
    r = random.Random(8)
    sets = [[(r.randint(0, 60) / 100, r.randint(0, 60) / 100, r.randint(5, 40) / 100, r.randint(5, 40) / 100, r.randint(0, 99)) for _ in range(r.randint(0, 7))] for _ in range(80)]
    rows = [(p, i, b[:4], b[4]) for p, s in enumerate(sets) for i, b in enumerate(s)]
    df = faces.gather(spark.createDataFrame(rows, f"photo_id long, face_index int, box struct<{BOX}>, eye_conf int"), "eye_conf")
    got = {x.photo_id: [f.face_index for f in x.k] for x in df.select("photo_id", faces.suppressed(F.col("faces")).alias("k")).collect()}
    assert got == {p: loop_suppressed(s) for p, s in enumerate(sets) if s}


def loop_dominant(fs):
    """Subjects of faces (index, left, top, width, height, sharpness, yaw)."""
    if len(fs) < 2:
        return [f[0] for f in fs]
    m = [dict(i=f[0], area=max(0, f[3]) * max(0, f[4]), x=f[1] + f[3] / 2, y=f[2] + f[4] / 2, f=f, s=f[5], yaw=f[6]) for f in fs]
    med = lambda v: float(np.median(v))
    prom = lambda o: o["area"] * (0.35 + 0.65 * o["s"] / 100)
    peers = lambda seed: [o for o in m if max(o["area"], seed["area"]) <= 2.4 * min(o["area"], seed["area"])]
    score = lambda g: round(sum(o["area"] for o in g) * len(g) ** 0.5 * (0.5 + 0.5 * sum(o["s"] for o in g) / len(g) / 100), 12)
    groups = [peers(o) for o in m]
    rank = lambda k: (score(groups[k]), len(groups[k]), -k)
    g = groups[max(range(len(m)), key=rank)]
    many = [k for k in range(len(m)) if len(groups[k]) > 1]
    first = max(m, key=lambda o: (prom(o), -o["i"]))
    if many:
        g = dense = groups[max(many, key=rank)]
        if first not in dense:
            area, (_, left, top, w, h, _, _) = med([o["area"] for o in dense]), first["f"]
            edge = left < 0.08 or top < 0.06 or left + w > 0.92 or top + h > 0.94 or first["x"] < 0.16 or first["x"] > 0.84
            front = first["area"] >= area * 1.55 and first["s"] >= 0.8 * med([o["s"] for o in dense]) and first["s"] >= 45
            win = prom(first) >= 1.2 * max(map(prom, dense)) and first["area"] >= 1.35 * area and first["s"] >= 45
            if not (first["area"] >= 3.5 * area and edge) and (front or win):
                g = peers(first)
    if len(g) > 2:
        cx, cy, w, h = (med(v) for v in ([o["x"] for o in g], [o["y"] for o in g], [o["f"][3] for o in g], [o["f"][4] for o in g]))
        mx, my = med([abs(o["x"] - cx) for o in g]), med([abs(o["y"] - cy) for o in g])
        lx, ly = max(3.25 * mx, 2.5 * w), max(3.25 * my, 1.75 * h)
        if my <= 0.55 * h:
            lx = max(lx, 2.75 * med(np.diff(sorted(o["x"] for o in g))), 4 * w)
        g = [o for o in g if abs(o["x"] - cx) <= lx and abs(o["y"] - cy) <= ly] or g
    least = lambda g: max(1, math.ceil(0.35 * len(g)))
    if len(g) > 1:
        md, mx = med([o["s"] for o in g]), max(o["s"] for o in g)
        if not (md < 20 and mx < 40):
            kept = [o for o in g if o["s"] >= 0.48 * md and not (mx >= 55 and o["s"] < 0.45 * mx and o["s"] < 50)]
            g = kept if len(kept) >= least(g) else g
    if len(g) > 1:
        md = med([o["s"] for o in g])
        if md >= 40 and any(abs(o["yaw"]) < 18 and o["s"] >= 0.9 * md and o["s"] >= 50 for o in g):
            kept = [o for o in g if not (abs(o["yaw"]) >= 28 and o["s"] < 0.72 * md)]
            g = kept if len(kept) >= least(g) else g
    return sorted(o["i"] for o in g)


def test_dominant_faces(spark):
    r = random.Random(4)
    sets = [[(i, r.randint(0, 80) / 100, r.choice([40, 42, r.randint(0, 80)]) / 100, r.randint(4, 30) / 100, r.randint(4, 30) / 100, float(r.randint(0, 100)), float(r.choice([0, 0, 34]))) for i in range(r.randint(1, 8))] for _ in range(150)]
    rows = [(p, f[0], f[1:5], f[5], f[6]) for p, s in enumerate(sets) for f in s]
    df = faces.gather(spark.createDataFrame(rows, f"photo_id long, face_index int, box struct<{BOX}>, sharpness double, yaw double"), "sharpness", "yaw")
    got = {x.photo_id: [f.face_index for f in x.faces] for x in faces.dominant(df, yaw=lambda f: f["yaw"]).collect()}
    assert got == {p: loop_dominant(s) for p, s in enumerate(sets)}


def test_face_clusters(spark):
    got = identity.cluster_faces(catalogue._album_faces(spark, DIR)).collect()
    rows = catalogue._album_faces(spark, DIR).select("album_id", "photo_id", "captured_at", "face_index", "print", "area").collect()
    want = {}
    albums = collections.defaultdict(list)
    for r in rows:
        albums[r.album_id].append(r)
    for album, rs in albums.items():
        known, n = [], 1
        for photo in sorted({(r.captured_at, r.photo_id) for r in rs}, key=lambda x: (x[0] is not None, x)):
            mine = sorted((r for r in rs if r.photo_id == photo[1]), key=lambda r: r.face_index)
            near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(f.print, c[1])) / len(f.print)), i, k) for i, f in enumerate(mine) for k, c in enumerate(known) if len(f.print) <= len(c[1]) and max(f.area, c[2]) / min(f.area, c[2]) <= 3)
            taken = {}
            for d, i, k in near:
                if d < 0.05 and i not in taken and k not in taken.values():
                    taken[i] = k
            for i, f in enumerate(mine):
                if i in taken:
                    c = known[taken[i]]
                    c[1], c[2] = [a * 0.65 + b * 0.35 for a, b in zip(c[1], f.print)], c[2] * 0.65 + f.area * 0.35
                else:
                    taken[i] = len(known)
                    known.append([f"person-{n}", list(f.print), f.area])
                    n += 1
                want[f.photo_id, f.face_index] = known[taken[i]][0]
    assert {(r.photo_id, r.face_index): r.cluster_id for r in got} == want


def seen():
    return {"first_face": F.lit(0), "score": F.lit(1.0), "area": F.lit(0.1), "box": F.struct(F.lit(0.3).alias("left"), F.lit(0.2).alias("top"), F.lit(0.25).alias("width"), F.lit(0.3).alias("height"))}


def test_better_faces_and_common_scenes_merge(spark):
    box, aside, small = (0.3, 0.2, 0.25, 0.3), (0.7, 0.2, 0.25, 0.3), (0.3, 0.2, 0.1, 0.1)
    # album 1: b replaces a's print, so c is near it; album 2: only blends, so c stays; 3: scenes; 4: one crop, whatever the prints
    rows = [(1, "a", [0.10, 0.0], 1.0, box, None, None), (1, "b", [0.20, 0.0], 2.0, box, None, None), (1, "c", [0.30, 0.0], 1.0, box, None, None)]
    rows += [(2, "a", [0.10, 0.0], 2.0, box, None, None), (2, "b", [0.20, 0.0], 1.0, box, None, None), (2, "c", [0.30, 0.0], 1.0, box, None, None)]
    rows += [(3, "a", [0.0, 0.0], 1.0, box, ["g"], None), (3, "b", [0.2, 0.0], 1.0, box, ["g", "h"], None), (3, "c", [0.4, 0.0], 1.0, aside, ["h"], None), (3, "d", [0.2, 0.2], 1.0, small, ["h"], None), (3, "e", [0.6, 0.6], 1.0, box, ["z"], None)]
    rows += [(4, "a", [0.0, 0.0], 1.0, box, None, "crop"), (4, "b", [9.0], 1.0, box, None, "crop"), (4, "c", [], 1.0, box, None, ""), (4, "d", [], 1.0, box, None, "")]
    data = [(a, v, "open", "good", p, 0.1, b, s, [k], k, 0, c, g) for k, (a, v, p, s, b, g, c) in enumerate(rows)]
    df = spark.createDataFrame(data, "album_id long, variant string, eye string, focus string, print array<double>, area double, box struct<left:double,top:double,width:double,height:double>, score double, photo_ids array<long>, first_order int, first_face int, crop_uri string, scenes array<string>")
    got = {(r.album_id, r.variant): r.merged_into for r in identity.merge_key_faces(df).collect()}
    assert {v for (a, v), m in got.items() if v != m and a == 1} == {"b", "c"} and {v for (a, v), m in got.items() if v != m and a == 2} == {"b"}
    assert {v for (a, v), m in got.items() if v != m and a == 3} == {"b"} and {v for (a, v), m in got.items() if v != m and a == 4} == {"b"}


def test_merge_of_key_faces(spark):
    rows = [(1, "a", "open", "good", [0.1, 0.2], [1], 1), (1, "b", "open", "good", [0.12, 0.2], [2], 2), (1, "c", "open", "soft", [0.1, 0.2], [3], 3), (1, "d", "open", "good", [0.11, 0.2], [2, 4], 4), (2, "a", "open", "good", [0.1, 0.2], [9], 1)]
    df = spark.createDataFrame(rows, "album_id long, variant string, eye string, focus string, print array<double>, photo_ids array<long>, first_order int").withColumns(seen())
    assert {(r.album_id, r.variant): r.merged_into for r in identity.merge_key_faces(df).collect()} == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "c", (1, "d"): "d", (2, "a"): "a"}


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "photos")
    rows = spark.createDataFrame([(1, "a", "x", "uploaded", {"size": "5"}), (1, "b", "y", None, None), (2, "c", "z", "failed", {"size": "7"})], "album_id long, photo_id string, name string, status string, file map<string,string>")
    store.write(store.encode(rows, ["name", "status", "file"], F.lit(1)), path)
    table = spark.read.parquet(path)
    assert {(r.photo_id, r.file_size, r.upload_status) for r in table.collect()} == {("a", 5, "uploaded"), ("b", 0, "pending"), ("c", 7, "failed")}
    newer = store.encode(rows.where("photo_id = 'a'").withColumn("status", F.lit("failed")), ["name", "status", "file"], F.lit(2))
    merged = store.put(spark, path, newer)
    merged = spark.createDataFrame(merged.collect(), merged.schema)
    store.write(merged, path)
    got = spark.read.parquet(path)
    assert {(r.photo_id, r.upload_status) for r in got.collect()} == {("a", "failed"), ("b", "pending"), ("c", "failed")}
    bad = got.unionByName(got.limit(1).withColumns({"data": F.lit("{oops"), "photo_id": F.lit("bad")}))
    assert store.decode(bad, "name string, status string").count() == 3
    assert [r.photo_id for r in store.photo_ids(got, 1).collect()] == ["b", "a"]
    assert store.remove(got, spark.createDataFrame([(1,)], "album_id long").select(F.col("album_id").cast(got.schema["album_id"].dataType))).count() == 1
    kv = spark.createDataFrame([(json.dumps({"7:p1": {"a": 1}}),)], "value string")
    assert [tuple(r) for r in store.import_map(kv).collect()] == [("7", "p1", '{"a":1}')]


def test_listing(spark, tmp_path):
    for name in ("1/a.JPG", "1/.hidden", "1/thumbs/a.v4.jpg", "2/b.png"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    assert {(r.name, r.size, r.type) for r in store.list_photos(spark, str(tmp_path)).collect()} == {("a.JPG", 5, "image/jpeg"), ("b.png", 5, "image/png")}
    raw = spark.createDataFrame([(bytearray(b"12345"),)], "c binary")
    assert [bytes(r[0]) if r[0] else None for r in raw.select(store.content_slice(F.col("c"), F.lit(1), F.lit(3))).collect() + raw.select(store.content_slice(F.col("c"), F.lit(1), F.lit(9))).collect()] == [b"23", None]


def test_merge_rules(spark):
    cols = "album_id long, photo_id long, status string, analysis_status string, server_upload_status string, tag string"
    a = spark.createDataFrame([(1, 1, "uploaded", "idle", "uploaded", "c"), (1, 2, "pending", "idle", "idle", "c"), (1, 3, None, None, None, "c")], cols)
    b = spark.createDataFrame([(1, 1, "uploaded", "analyzed", "idle", "i"), (1, 2, "uploaded", "idle", "idle", "i"), (1, 4, None, None, None, "i")], cols)
    assert {r.photo_id: r.tag for r in merge.merged(a, b).collect()} == {1: "c", 2: "i", 3: "c", 4: "i"}
    again = spark.createDataFrame([("uploading", "analyzing", "uploading", 2), (None, "pending", None, 0)], "status string, analysis_status string, server_upload_status string, n_faces int")
    assert [tuple(r)[:3] for r in merge.recovered(again).collect()] == [("pending", "analyzed", "pending"), ("pending", "idle", "idle")]


def test_streams(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "album_id long, photo_id long, seq long, status string, storage_delta long"
    spark.createDataFrame([(1, 1, 1, "pending", 5), (1, 1, 2, "uploaded", None), (1, 2, 1, "pending", 7)], schema).coalesce(1).write.parquet(source)
    sink = updates.writer(table)

    def run():
        q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(1, 2, 2, "failed", 0), (2, 9, 1, "pending", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    want = {(1, 1): "uploaded", (1, 2): "failed", (2, 9): "pending"}
    assert {(r.album_id, r.photo_id): r.status for r in updates.latest(spark, table).collect()} == want
    before = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending")], "album_id long, photo_id long, status string")
    new = updates.coalesced(spark.createDataFrame([(1, 1, 1, "uploaded", 1), (1, 3, 1, "pending", 1)], schema))
    assert {(r.status, r["shift"]) for r in updates.shifts(new, before).collect()} == {("uploaded", 1)}


def test_streamed_clusters_equal_the_batch(spark, tmp_path):
    f = catalogue._album_faces(spark, DIR).where("album_id <= 2")
    rows = f.groupBy("album_id", "photo_id", "captured_at").agg(F.array_sort(F.collect_list(F.struct("face_index", "print", "area"))).alias("faces"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = updates.clustered(stream).writeStream.format("memory").queryName("clustered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in identity.cluster_faces(f).collect()}
    assert {tuple(r) for r in spark.table("clustered").collect()} == want


def test_images(spark):
    ramp = np.repeat(np.arange(255, 0, -1, dtype=np.uint8)[None, :, None], 64, 0).repeat(3, 2)
    assert image.dhash(ramp) == "f" * 16 and image.dhash(ramp[:, ::-1]) == "0" * 16
    flat = np.full((100, 100), 7.0)
    noise = np.random.default_rng(1).integers(0, 255, (100, 100)).astype(float)
    assert image.sharpness(flat) == 0 and image.sharpness(noise) > 60 and image.sharpness(flat[:2]) == 30
    df = spark.createDataFrame([(bytearray(ramp.tobytes()), 255, 64), (None, 1, 1), (bytearray(b"xx"), 3, 3)], "c binary, w int, h int")
    assert [r[0] for r in df.select(image.hashes(F.col("c"), F.col("w"), F.col("h"))).collect()] == ["f" * 16, None, None]


def plain(v):
    """A value as text that tells 0.0 from -0.0."""
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    return repr(v.item() if isinstance(v, np.generic) else v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    db.sql("set timezone='UTC'")
    for t in ("events", "lineitem"):
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql_agrees(spark, duck, name):
    """Every query with SQL has its rows, bit for bit, the sign of zero included."""
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.ORACLES[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(plain([r[c] for c in order]) for r in got.collect()) == sorted(plain([r[columns.index(c)] for c in order]) for r in rows)



def test_the_older_detector_equals_its_two_loops(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(4)]

    def change(h, bits):
        for _ in range(bits):
            h ^= 1 << r.randrange(64)
        return h

    rows = [(0, 1, 0, "0" * 16, 5), (0, 2, 10_000, "f" * 16, 5), (0, 3, 10_001, "f" * 16, 5)]
    for album in range(1, 9):
        t = 0
        for k in range(120):
            t += r.choice([0, 1, 900, 2500, 4999, 5000, 5001] + ([1_790_000, 9_000_000] if album % 2 else []))
            rows.append((album, 1000 * album + r.randrange(10) * 100_000 + k, None if r.random() < 0.05 else t, f"{change(r.choice(base), r.randrange(7)):016x}", r.randrange(4)))
    want = set()
    for album in range(9):
        mine = sorted((t or 0, p, h, s) for a, p, t, h, s in rows if a == album)
        lost = set()
        for i, a in enumerate(mine):
            if a[1] in lost:
                continue
            for b in mine[i + 1 :]:
                if b[1] not in lost and bin(int(a[2], 16) ^ int(b[2], 16)).count("1") <= 8 and b[0] - a[0] < 5000:
                    keep = (a if a[3] > b[3] else b) if a[3] != b[3] else (a if a[0] < b[0] else b)
                    lost.add(b[1] if keep is a else a[1])
        want |= {(album, p) for p in lost}
    photos = spark.createDataFrame(rows, "album_id long, photo_id long, captured_at long, perceptual_hash string, file_size long")
    got = duplicates.greedy_duplicates(photos).collect()
    assert (0, 3) in want and len(got) == len(rows)
    assert {(x.album_id, x.photo_id) for x in got if x.keeper != x.photo_id} == want


def eye_rows(spark, rows):
    """(photo_id, face_index, side of the box, eyes_open, eye_conf, left_prob, right_prob)."""
    data = [(p, i, (0.1, 0.1, side, side), *rest) for p, i, side, *rest in rows]
    return spark.createDataFrame(data, f"photo_id long, face_index int, box struct<{BOX}>, eyes_open boolean, eye_conf double, left_prob double, right_prob double")


def test_crowd_partial(spark):
    tiny = 0.02
    rows = [(1, 0, 0.3, True, 90.0, 0.22, 0.14), (1, 1, 0.3, False, 90.0, 0.05, 0.28), (1, 2, 0.3, True, 91.0, 0.2, 0.15), (1, 3, tiny, True, 74.0, 0.06, 0.05), (1, 4, tiny, True, 70.0, 0.01, 0.01)]
    rows += [(1, 5, tiny, True, 60.0, 0.03, 0.01), (1, 6, tiny, True, 61.0, 0.03, 0.01), (1, 7, 0.05, True, 60.0, 0.0, 0.0), (1, 8, tiny, False, 60.0, 0.0, 0.0), (1, 9, tiny, True, 75.0, 0.0, 0.0), (1, 10, tiny, True, 60.0, 0.9, 0.9), (1, 11, tiny, True, math.nan, 0.0, 0.0)]
    rows += [(2, k, tiny, True, 50.0, 0.06 - k / 100, 0.0) for k in range(7)] + [(3, k, 0.3, False, 80.0, 0.3, 0.0) for k in range(6)] + [(3, 6, tiny, True, 50.0, 0.0, 0.0)]
    got = faces.crowd_partial(eye_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.photo_id, r.face_index) for r in got if r.crowd_partial} == {(1, k) for k in (0, 1, 4, 5, 6)} | {(2, k) for k in range(2, 7)} | {(3, k) for k in range(6)}
    assert {(r.eyes_open, r.eye_conf) for r in got if r.crowd_partial} == {(False, 72.0)}


def test_closed_eyes_once(spark):
    small = 0.04
    rows = [(1, 0, small, False, 80.0, 0.1, 0.2), (1, 1, small, False, 90.0, 0.1, 0.2), (1, 2, small, False, 95.0, 0.3, 0.0), (1, 3, small, True, 99.0, 0.0, 0.0), (1, 4, 0.0501, False, 99.0, 0.0, 0.0), (1, 5, 0.2, False, 99.0, 0.0, 0.0), (1, 6, 0.03, False, 99.0, 0.0, 0.0), (2, 0, small, False, 95.0, 0.0, 0.0), (2, 1, small, None, 95.0, 0.0, 0.0)]
    got = faces.closed_eyes_once(eye_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.photo_id, r.face_index): (r.eyes_open, r.eye_conf) for r in got if r.reopened} == {(1, 0): (True, 72.0), (1, 2): (True, 72.0)}
    assert {(r.photo_id, r.face_index): (r.eyes_open, r.eye_conf) for r in got if not r.reopened} == {(p, i): (v, c) for p, i, _, v, c, *_ in rows if (p, i) not in {(1, 0), (1, 2)}}


def test_key_faces_are_grouped_by_what_can_merge(spark, capsys):
    rows = [(1, f"{p}::{e}", e, "good", [x, 0.0], [p], p) for p, x in ((1, 0.1), (2, 0.11), (3, 0.9)) for e in ("open", "closed")]
    variants = spark.createDataFrame(rows, "album_id long, variant string, eye string, focus string, print array<double>, photo_ids array<long>, first_order long").withColumns(seen())
    merged = identity.merge_key_faces(variants)
    assert {r.variant: r.merged_into for r in merged.collect()} == {f"{p}::{e}": f"{1 if p < 3 else 3}::{e}" for p in (1, 2, 3) for e in ("open", "closed")}
    merged.explain()
    assert re.search(r"FlatMapGroupsInPandas \[album_id#\d+L?, eye#\d+, focus#\d+\]", capsys.readouterr().out)


def test_only_groups_with_a_first_merge_are_walked(spark):
    """Random groups against plain loops; those where no two can merge as given never reach Python, which would fail on their boxes."""
    r, box, rows, want = random.Random(5), (0.3, 0.2, 0.25, 0.3), [], {}
    for album in range(60):
        kept, given = [], []
        for k in range(r.randint(1, 7)):
            print_ = [round(r.uniform(0, 0.6), 3) for _ in range(r.choice((2, 2, 2, 3)))] if r.random() < 0.9 else []
            given.append((f"v{k}", print_, r.uniform(0, 2), r.sample(range(30), r.randint(1, 4)), r.choice((None, ["g"], ["g", "h"], [])), r.choice((None, None, "", "c1", "c2", "c3"))))
        near = lambda p, q: identity.rms(p, q) if p and len(p) == len(q) else math.inf
        one = lambda a, b: not set(a[3]) & set(b[3]) and ((a[5] and a[5] == b[5]) or near(a[1], b[1]) < 0.08 or (near(a[1], b[1]) < 0.18 and set(a[4] or []) & set(b[4] or [])))
        merging = any(one(a, b) for k, a in enumerate(given) for b in given[:k])
        for name, print_, score, photos, scenes, crop in given:
            v = [name, print_, score, photos, scenes or [], crop]
            k = next((k for k in kept if one(k, v)), None)
            want[album, name] = (k or v)[0]
            if k is None:
                kept.append(v)
                continue
            if score > k[2]:
                k[1], k[2], k[5] = print_, score, crop
            elif print_ and len(print_) == len(k[1]):
                k[1] = [o * 0.65 + n * 0.35 for o, n in zip(k[1], print_)]
            k[3], k[4] = [*k[3], *photos], [*k[4], *(scenes or [])]
        rows += [(album, v[0], "open", "good", v[1], 0.1, box if merging else None, v[2], v[3], k, 0, v[5], v[4]) for k, v in enumerate(given)]
    df = spark.createDataFrame(rows, "album_id long, variant string, eye string, focus string, print array<double>, area double, box struct<left:double,top:double,width:double,height:double>, score double, photo_ids array<long>, first_order int, first_face int, crop_uri string, scenes array<string>")
    assert {(x.album_id, x.variant): x.merged_into for x in identity.merge_key_faces(df).collect()} == want
    still = {a for a, _ in want} - {a for (a, v), m in want.items() if v != m}
    assert 5 < len(still) < 55


def test_key_faces_carry_columns_of_the_best_face(spark):
    box = (0.3, 0.2, 0.25, 0.3)
    rows = [(1, p, p, i, "c", "open", "good", s, 0.0, 0.0, box, [float(s)]) for p, i, s in ((1, 0, 70), (2, 1, 99), (3, 0, 40))]
    f = spark.createDataFrame(rows, "album_id long, photo_id long, photo_order int, face_index int, cluster string, eye string, focus string, sharpness int, yaw double, pitch double, box struct<left:double,top:double,width:double,height:double>, print array<double>")
    (got,) = identity.key_faces(f, carried=("print", "box")).collect()
    assert (got.best.photo_id, got.best.face_index, got.best.print, tuple(got.best.box)) == (2, 1, [99.0], box)


def test_writer_folds_its_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(updates, "FOLD", 3)
    table, sink, want = str(tmp_path / "t"), updates.writer(str(tmp_path / "t")), {}
    for epoch in range(8):
        rows = [(1, k, 10 * epoch + k, f"s{epoch}", 5) for k in range(epoch, epoch + 3)] + [(1, epoch, 10 * epoch + 9, f"t{epoch}", 1)]
        for album, photo, seq, status, _ in rows:
            want[photo] = max(want.get(photo, (0, "")), (seq, status))
        batch = spark.createDataFrame(rows, "album_id long, photo_id long, seq long, status string, storage_delta long")
        sink(batch, epoch)
        if epoch % 2:
            sink(batch, epoch)  # a batch that is repeated
        got = updates.latest(spark, table).collect()
        assert {r.photo_id: (r.seq, r.status) for r in got} == want and sum(r.storage_delta for r in got) == 16 * (epoch + 1)
    assert updates._epochs(spark, table + "/base") == [2, 5] and updates._epochs(spark, table + "/delta")[0] == 2


def test_counters_never_go_below_zero(spark):
    counters = spark.createDataFrame([(1, "pending", 2), (1, "failed", 1)], "album_id long, status string, n int")
    moved = spark.createDataFrame([(1, "pending", -3), (1, "uploaded", 3), (2, "pending", 1)], "album_id long, status string, shift int")
    storage = spark.createDataFrame([(1, 10, -30), (2, None, 7)], "album_id long, bytes long, storage_delta long")
    got = {r.album_id: (r.counts, r.bytes) for r in updates.counted(counters, moved, storage).collect()}
    assert got == {1: ({"failed": 1, "pending": 0, "uploaded": 3}, 0), 2: ({"pending": 1}, 7)}


def test_scenes_and_source_faces(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["c"]), ([], ["c"]), (None, ["c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(identity.share_scene(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    variants = spark.createDataFrame([(1, "p::open::good", 3, [7, 8, 9], (7, 2)), (1, "q::open::good", 1, [7], (7, 0)), (1, "r::open::good", 2, [7, 9], (7, 1)), (1, "s::open::good", 2, [7, 9], (7, 5))], "album_id long, variant string, occurrences long, photo_ids array<long>, best struct<photo_id:long,face_index:int>")
    faces_ = spark.createDataFrame([(1, 8, 0, "x::open::good", "x"), (1, 8, 1, "p::closed::good", "p"), (1, 9, 0, "x::open::good", "x"), (1, 9, 1, "y::open::good", "y")], "album_id long, photo_id long, face_index int, variant string, cluster string")
    gone = spark.createDataFrame([(1, 7)], "album_id long, photo_id long")
    got = {r.variant[0]: (r.occurrences, r.photo_ids, r.source_photo_id, r.source_face_index) for r in incremental.key_faces_after_delete(variants, gone, faces_).collect()}
    assert got == {"p": (2, [8, 9], 8, 1), "r": (1, [9], 9, 1), "s": (1, [9], 9, 0)}
