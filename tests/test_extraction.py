"""Pixels, contours, passes of detection, composed updates and backfill against plain loops."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cullspark.functions import detector, image
from cullspark.functions import scalar as S
from cullspark.operators import detection, faces
from cullspark.sources import backfill, store
from cullspark.streaming import compose

# --- pixels


def gray_at(p, x, y):
    return p[y, x, 0] * 0.114 + p[y, x, 1] * 0.587 + p[y, x, 2] * 0.299


def between(p, x, y):
    h, w = p.shape[:2]
    x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
    x0, y0 = math.floor(x), math.floor(y)
    x1, y1 = min(w - 1, x0 + 1), min(h - 1, y0 + 1)
    top = gray_at(p, x0, y0) + (gray_at(p, x1, y0) - gray_at(p, x0, y0)) * (x - x0)
    low = gray_at(p, x0, y1) + (gray_at(p, x1, y1) - gray_at(p, x0, y1)) * (x - x0)
    return top + (low - top) * (y - y0)


def laplace(rows, base):
    found = [4 * rows[y][x] - rows[y - 1][x] - rows[y + 1][x] - rows[y][x - 1] - rows[y][x + 1] for y in range(1, len(rows) - 1) for x in range(1, len(rows[0]) - 1)]
    mean = sum(found) / len(found)
    return min(100, max(0, math.log(sum(v * v for v in found) / len(found) - mean * mean + 1) / math.log(base) * 100))


def plain_sharpness(p, box):
    """The desktop's rule, pixel by pixel."""
    up = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
    h, w = p.shape[:2]
    if box[2] < 3 or box[3] < 3:
        return 30
    left, top = max(0, up(box[0] + box[2] * 0.24)), max(0, up(box[1] + box[3] * 0.24))
    right, bottom = min(w, left + max(1, up(box[2] * 0.52))), min(h, top + max(1, up(box[3] * 0.52)))
    if right - left < 3 or bottom - top < 3:
        return 30
    if right - left >= 32 or bottom - top >= 32:
        return laplace([[between(p, left + (x + 0.5) * (right - left - 1) / 32 - 0.5, top + (y + 0.5) * (bottom - top - 1) / 32 - 0.5) for x in range(32)] for y in range(32)], 50000)
    score = laplace([[gray_at(p, x, y) for x in range(left, right)] for y in range(top, bottom)], 50000)
    return 48 + (score - 48) * 0.4 if (right - left) * (bottom - top) < 280 else score


def test_sharpness_of_the_desktop():
    r = np.random.default_rng(2)
    p = r.integers(0, 255, (120, 160, 3)).astype(np.uint8)
    smooth = np.floor(image.bilinear(p[:30, :40].astype(float), image.centres(120, 30), image.centres(160, 40))).astype(np.uint8)
    for picture in (p, smooth):
        for box in [(0, 0, 160, 120), (10.5, 7.2, 70.3, 60.9), (3, 3, 20, 18), (100, 90, 300, 200), (5, 5, 40, 62), (150, 110, 5, 5), (1, 1, 2.9, 50), (-20, -20, 60, 60), (40, 40, 30, 61)]:
            assert image.sharpness(image.luma(picture), box) == pytest.approx(plain_sharpness(picture, box), abs=1e-6), box
    assert image.sharpness(np.zeros((50, 50)), profile="vision") == 0 and image.sharpness(np.zeros((2, 50)), profile="android") == 50
    noise = image.luma(p)
    assert image.sharpness(noise, profile="vision") == pytest.approx(laplace(noise.tolist(), 1000))
    wide = image.bilinear(noise, image.centres(96, 120), image.centres(128, 160))
    assert image.sharpness(noise, profile="android") == pytest.approx(laplace(wide.tolist(), 1000))


def test_orientation_and_sizes():
    p = np.arange(6, dtype=np.uint8).reshape(2, 3, 1).repeat(3, 2)
    flat = lambda o: image.oriented(p, o)[..., 0].tolist()
    assert flat(1) == flat(None) == flat(9) == [[0, 1, 2], [3, 4, 5]]
    assert flat(2) == [[2, 1, 0], [5, 4, 3]] and flat(3) == [[5, 4, 3], [2, 1, 0]] and flat(4) == [[3, 4, 5], [0, 1, 2]]
    assert flat(5) == [[0, 3], [1, 4], [2, 5]] and flat(6) == [[3, 0], [4, 1], [5, 2]] and flat(7) == [[5, 2], [4, 1], [3, 0]] and flat(8) == [[2, 5], [1, 4], [0, 3]]
    assert image.fitted_size(100, 50, 100) == (100, 50) and image.fitted_size(8192, 5, 4096) == (4096, 3) and image.fitted_size(9000, 1, 100) == (100, 1)
    whole = np.random.default_rng(1).random((7, 11))
    assert image.area_mean(whole, 7, 11) == pytest.approx(whole) and image.area_mean(whole, 1, 1)[0, 0] == pytest.approx(whole.mean())
    assert image.area_mean(np.array([[0.0, 3.0, 6.0]]), 1, 2)[0] == pytest.approx([1, 5])


def test_hash_sources():
    ramp = np.repeat(np.arange(255, 0, -1, dtype=np.uint8)[None, :, None], 700, 0).repeat(3, 2)
    for profile in image.SOURCES:
        assert image.dhash(ramp, profile) == "f" * 16 and image.dhash(ramp[:, ::-1], profile) == "0" * 16
        assert image.dhash(ramp, profile, 2) == "0" * 16 and image.dhash(ramp.swapaxes(0, 1), profile, 5) == "f" * 16
    # a pattern between the sampled points is seen by means alone
    stripes = np.zeros((80, 90, 3), np.uint8)
    stripes[:, ::10] = 255
    assert image.dhash(stripes) == "0" * 16
    p = np.random.default_rng(3).integers(0, 255, (50, 61, 3)).astype(np.uint8)
    spots = [[int(gray_at(p, min(60, max(0, math.floor((x + 0.5) * 61 / 9))), math.floor((y + 0.5) * 50 / 8))) for x in range(9)] for y in range(8)]
    assert image.dhash(p) == f"{int(''.join('1' if a > b else '0' for row in spots for a, b in zip(row, row[1:])), 2):016x}"


# --- contours


def test_contours(spark):
    def face(ratio, gone=None):
        pts = [(float(k), 0.0) for k in range(106)]
        for start in (33, 87):
            for k in range(10):
                pts[start + k] = (50 + 2.0 * k, 50 + (18 * ratio if k % 2 else 0.0))
        return [None if k == gone else p for k, p in enumerate(pts)]

    rows = [(0, face(0.3)), (1, face(0.1)), (2, face(0.19)), (3, face(0.18)), (4, face(0.3, 40)), (5, face(0.3, 5)), (6, None), (7, face(0.0)), (8, face(0.22)), (9, face(0.3)[:80])]
    df = spark.createDataFrame(rows, "k int, p array<struct<x: double, y: double>>")
    got = {r.k: r.s for r in df.select("k", detector.contour_eyes(F.col("p")).alias("s")).collect()}
    assert [got[k].open for k in range(10)] == [True, False, True, False, None, True, None, False, True, None]
    assert got[0].ratio == pytest.approx(0.3) and got[0].confidence == 95 and got[1].confidence == 95 and got[2].confidence == pytest.approx(48) and got[3].confidence == pytest.approx(48 + 20 / 6) and got[8].probability == pytest.approx(1)


# --- two passes


def overlap(a, b):
    w = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    return max(0, w) * max(0, h)


def same_face(a, b, w, h):
    a, b = ((d[0], d[1] / w, d[2] / h, d[3] / w, d[4] / h) for d in (a, b))
    both = overlap(a, b)
    if both <= 0:
        return False
    x, y = a[3] * a[4], b[3] * b[4]
    iou, ratio = both / (x + y - both), max(x, y) / min(x, y)
    near = math.hypot(a[1] + a[3] / 2 - b[1] - b[3] / 2, a[2] + a[4] / 2 - b[2] - b[4] / 2)
    return iou >= 0.55 or (ratio >= 2.4 and (both / min(x, y) >= 0.70 or (iou >= 0.32 and near < 0.35 * min(math.hypot(a[3], a[4]), math.hypot(b[3], b[4])))))


def plain_passes(picture, detect, least):
    h, w = picture.shape[:2]

    def once(found):
        kept = []
        for d in sorted(found, key=lambda d: (-d[0], -d[3] * d[4])):
            if not any(same_face(d, k, w, h) for k in kept):
                kept.append(d)
        return kept

    def enough(found):
        top = max((d[3] * d[4] / (w * h) for d in found), default=0)
        return bool(found) and (len(found) >= 3 or top >= 0.004 or (top >= 0.0009 and len(found) >= 2))

    found = once(detect([picture])[0])
    for side in (2, 3):
        if w * h < least or enough(found):
            return found
        tw, th = w / side * 1.35, h / side * 1.35
        for row in range(side):
            for col in range(side):
                x, y = col * w / side, row * h / side
                x, y = max(0, w - tw) if x + tw > w else x, max(0, h - th) if y + th > h else y
                x, y = math.floor(x), math.floor(y)
                part = picture[y : y + min(h - y, math.ceil(th)), x : x + min(w - x, math.ceil(tw))]
                found = [*found, *((s, a + x, b + y, c, d) for s, a, b, c, d in detect([part])[0])]
        found = once(found)
    return found


def spot_detector():
    def spots(images):
        """Finds pixels of 250 and more, the brighter the surer, where they are no speck in the image given."""
        out = []
        for i in images:
            found = []
            for y, x in zip(*np.nonzero(i[..., 0] >= 250)):
                if 2.0 / i.shape[1] >= 0.045:
                    found.append((float(i[y, x, 0]) / 255, float(x), float(y), 2.0, 2.0, [(float(x), float(y))] * 5))
            out.append(found)
        return out

    return spots


def test_two_passes_equal_plain_loops(spark):
    spots = spot_detector()
    r = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(30):
        w, h = (int(x) for x in r.integers(30, 70, 2))
        p = r.integers(0, 249, (h, w, 3)).astype(np.uint8)
        for _ in range(int(r.integers(0, 5))):
            p[int(r.integers(0, h)), int(r.integers(0, w)), 0] = int(r.integers(250, 256))
        rows.append((k, bytearray(p.tobytes()), w, h))
        want[k] = sorted(plain_passes(p, lambda i: [[d[:5] for d in f] for f in spots(i)], 1200))
    rows += [(100, None, 5, 5), (101, bytearray(b"xx"), 5, 5), (102, bytearray(12), None, 2)]
    df = spark.createDataFrame(rows, "k int, content binary, width int, height int").repartition(3)
    got = {x.k: x.found for x in detection.detected(df, spots, least_pixels=1200).collect()}
    assert all(got[k] is None for k in (100, 101, 102))
    for k, found in want.items():
        assert sorted((d.score, d.left, d.top, d.width, d.height) for d in got[k]) == found, k
        assert all(len(d.points) == 5 and (d.points[0].x, d.points[0].y) == (d.left, d.top) for d in got[k])
    assert any(len(plain) and not spots([np.frombuffer(c, np.uint8).reshape(h, w, 3)])[0] for (k, c, w, h), plain in zip(rows, want.values()))


def test_tiles_of_a_size(spark):
    one = spark.range(1).select(detector.tiles(F.lit(1000), F.lit(601), 2).alias("d"), detector.tiles(F.lit(1000), F.lit(601), 3, "android").alias("a"), detector.tiles(F.lit(1), F.lit(1), 3).alias("tiny")).first()
    assert [tuple(t) for t in one.d] == [(0, 0, 675, 406), (325, 0, 675, 406), (0, 195, 675, 406), (325, 195, 675, 406)]
    assert [tuple(t)[:3] for t in one.a[:3]] == [(0, 0, 416), (333, 0, 416), (584, 0, 416)] and len(one.a) == 9
    assert all(tuple(t) == (0, 0, 1, 1) for t in one.tiny)


def test_a_constant_detector(spark):
    df = spark.createDataFrame([(bytearray(100 * 80 * 3), 100, 80)], "content binary, width int, height int")
    found = detection.detected(df, detection.constant([(0.9, 0.35, 0.1, 0.3, 0.4)])).first().found
    assert [(d.score, d.left, d.top, d.width, d.height) for d in found] == [(0.9, 35.0, 8.0, 30.0, 32.0)]


def test_all_passes_are_one_python_step(spark, capsys):
    """A task holds one worker for detection, however many passes, and only columns that are wanted come back."""
    df = spark.createDataFrame([(7, bytearray(100 * 80 * 3), 100, 80), (8, bytearray(1), 100, 80)], "k int, content binary, width int, height int")
    found = detection.detected(df, detection.constant([(0.9, 0.35, 0.1, 0.03, 0.04)]), least_pixels=1, columns=("k",))
    assert found.columns == ["k", "found"]
    assert {r.k: r.found and len(r.found) for r in found.collect()} == {7: 5, 8: None}  # one, then one a tile of four, which is enough
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert detection.detected(df, detection.constant([]), least_pixels=1).columns == [*df.columns, "found"]


@pytest.mark.parametrize("profile", ["desktop", "ios", "android"])
def test_odd_numbers_of_detections_are_judged_as_columns_do(spark, profile):
    """Numbers that are none or without end: ranks and overlaps equal those of the expressions over one photo."""
    r = random.Random(9)
    value = lambda: r.choice([math.nan, math.inf, -math.inf, 0.0, -3.0, *(r.uniform(0, 40) for _ in range(12))])
    photos = [[tuple(r.choice([value(), 1.0, 0.5]) if k == 0 else value() for k in range(5)) for _ in range(r.randint(0, 7))] for _ in range(300)]
    rows = [(k, 50, 40, [(*d, None) for d in p]) for k, p in enumerate(photos)]
    d = spark.createDataFrame(rows, f"k int, w int, h int, found array<{detection.DETECTION}>")
    area = lambda x: x["width"] * x["height"]
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(area(a) > area(b), -1).when(area(a) < area(b), 1).otherwise(0)
    ranked = F.col("found") if profile == "android" else F.array_sort("found", order)
    box = lambda x: F.struct((x["left"] / F.col("w")).alias("left"), (x["top"] / F.col("h")).alias("top"), (x["width"] / F.col("w")).alias("width"), (x["height"] / F.col("h")).alias("height"))
    overlap = detector.PROFILES[profile]["overlap"]
    kept = faces.folded(F.transform(ranked, lambda x: F.struct(box(x).alias("box"), x.alias("d"))), None, None if overlap else S.DETECTOR, overlap, None)
    want = {x.k: [str(tuple(f["d"])[:5]) for f in x.kept] for x in d.select("k", kept.alias("kept")).collect()}
    flat = [(k, x) for k, p in enumerate(photos) for x in p]
    once = detection._Found([k for k, _ in flat], [x for _, x in flat], [None] * len(flat)).once(np.ones(300, bool), np.full(300, 50), np.full(300, 40), profile)
    got = {k: [str(tuple(x.tolist())) for x in once.flat[once.owner == k]] for k in range(300)}
    assert got == want and 0 < sum(map(len, got.values())) < len(flat)


# --- composed updates

UPDATE = "album_id long, photo_id long, seq long, `set` array<string>, status string, stars int, storage_delta long, immediate boolean, batch struct<`from`: string, `to`: string>"


def test_updates_compose_in_any_grouping(spark):
    r = random.Random(1)
    rows, want = [], {}
    for seq in range(120):
        photo, fields = r.randint(1, 9), r.sample(["status", "stars"], r.randint(0, 2))
        status, stars, delta = r.choice([None, "a", "b"]), r.choice([None, 1, 2]), r.choice([None, -5, 7])
        at_once, move = r.choice([None, True, False]), r.choice([None, ("p", "q"), ("q", "p"), (None, "q")])
        rows.append((1, photo, seq, fields, status, stars, delta, at_once, move))
        w = want.setdefault(photo, {"delta": 0, "n": 0})
        w |= {f: {"status": status, "stars": stars}[f] for f in fields}
        w["delta"] += delta or 0
        w["n"] += 1
        if at_once is not None:
            w["immediate"] = at_once
        if move:
            w["from"] = w.get("from", (move[0],))
            w["to"] = move[1]
    r.shuffle(rows)
    made = compose.changes(spark.createDataFrame(rows, UPDATE), ["status", "stars"])
    parts = [compose.composed(made.where(F.pmod(F.hash("storage_delta", "status"), F.lit(3)) == k)) for k in range(3)]
    one, many = compose.composed(made), compose.all_of(compose.all_of(*parts[1:]), parts[0])
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    for x in one.collect():
        w = want[x.photo_id]
        value = lambda c: c and c.value
        assert (value(x.status), value(x.stars), x.storage_delta, x.updates, value(x.immediate)) == (w.get("status"), w.get("stars"), w["delta"], w["n"], w.get("immediate"))
        assert (x.status is not None) == ("status" in w) and (value(x.batch_from), value(x.batch_to)) == (w.get("from", (None,))[0], w.get("to"))
    photos = spark.createDataFrame([(1, k, "old", 0) for k in range(12)], "album_id long, photo_id long, status string, stars int")
    after = {x.photo_id: (x.status, x.stars) for x in compose.applied(photos, one, ["status", "stars"]).collect()}
    assert after == {k: (want.get(k, {}).get("status", "old"), want.get(k, {}).get("stars", 0)) for k in range(12)}


def test_shifts_from_a_to_c_are_one(spark):
    rows = [(1, 1, 1, [], None, None, 5, None, ("a", "b")), (1, 1, 2, [], None, None, None, True, ("b", "c")), (1, 2, 1, [], None, None, 1, None, ("a", "b")), (1, 2, 3, [], None, None, 1, False, ("b", "a")), (1, 3, 1, [], None, None, 0, None, None)]
    c = compose.composed(compose.changes(spark.createDataFrame(rows, UPDATE), []))
    assert {(x.status, x["shift"]) for x in compose.count_shifts(c, "batch").collect()} == {("a", -1), ("c", 1)} and compose.count_shifts(c, "analysis").count() == 0
    t = compose.totals(c).first()
    assert (t.storage_delta, t.updates, t.immediate, t.recompute_totals) == (7, 5, True, False)


# --- backfill


def test_backfill_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = [(a, str(p), '{"file":{"size":%d},"status":"uploaded"}' % (0 if a % 2 else p), 7) for a in range(1, 8) for p in range(10)]
    spark.createDataFrame(rows, "album_id int, photo_id string, data string, updated_at long").write.partitionBy("album_id").parquet(path)
    assert backfill.mark(path) is None and backfill.backfill(spark, path, chunk=20, most=2) == 2 and backfill.mark(path) == "4"
    read = lambda: {(r.album_id, r.photo_id): (r.file_size, r.upload_status) for r in spark.read.option("mergeSchema", "true").parquet(path).collect()}
    assert {k for k, v in read().items() if v[0] is None} == {(a, str(p)) for a in (5, 6, 7) for p in range(10)}

    # a run that ends after a chunk is written and before its mark is: the chunk is done again
    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(backfill, "_set_mark", stop)
        with pytest.raises(RuntimeError):
            backfill.backfill(spark, path, chunk=20)
    assert backfill.mark(path) == "4" and len(read()) == 70
    assert backfill.backfill(spark, path, chunk=20) == 2 and backfill.mark(path) == "7"
    assert read() == {(a, str(p)): (0 if a % 2 else p, "uploaded") for a in range(1, 8) for p in range(10)}
    # rows whose true size is 0 aren't done again
    assert backfill.backfill(spark, path, chunk=20) == 0
    assert not [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".new")] and store.photo(spark.read.parquet(path), 2, "3").first().file_size == 3


# --- names


def test_names_by_base_letters(spark):
    names = ["img10", "IMG9", "Img 9", "été2", "ETE10", "Ete2b", "zoë", "Zoe", "IMG_0010", "img_9", "ångström", "", None, "ß", "ss1", "9", "10"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", S.natural_key(F.col("n")))
    got = [r.n for r in df.orderBy("k", "n").collect()]
    assert got.index("IMG9") < got.index("img10") and got.index("img_9") < got.index("IMG_0010") and got.index("9") < got.index("10")
    assert got.index("été2") < got.index("Ete2b") < got.index("ETE10") and abs(got.index("zoë") - got.index("Zoe")) == 1 and got.index("ångström") < got.index("été2")
    same = df.alias("a").join(df.alias("b"), F.col("a.k") == F.col("b.k")).where("a.n < b.n").select("a.n", "b.n").collect()
    assert {tuple(r) for r in same} == {("Zoe", "zoë")}
