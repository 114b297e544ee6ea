from pyspark.sql import functions as F

from cullspark.functions import scalar as S
from cullspark.operators import incremental, stats
from cullspark.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_edits(spark):
    photos = spark.createDataFrame([(1, 1, True, 3), (1, 2, False, None), (2, 3, True, 1)], "album_id long, photo_id long, selected boolean, star_rating int")
    edits = spark.createDataFrame([(1, 1, False, None), (1, 2, None, 5), (2, 3, False, 0)], "album_id long, photo_id long, new_selected boolean, new_star int")
    albums = spark.createDataFrame([(1, False), (2, True)], "album_id long, has_uploads boolean")
    after = incremental.edited(photos, edits, albums)
    assert {r.photo_id: (r.selected, r.star_rating) for r in after.collect()} == {1: (False, 3), 2: (False, 5), 3: (True, 1)}
    s = spark.createDataFrame([(1, 1), (2, 1)], "album_id long, my_selections long")
    assert {r.album_id: r.my_selections for r in incremental.stats_after_edit(s, photos, after).collect()} == {1: 0, 2: 1}


def test_crops_prune_start(spark):
    v = spark.createDataFrame([(1, 0, None), (1, 1, "own"), (2, 0, None)], "photo_id long, face_index int, crop_uri string")
    c = spark.createDataFrame([(1, 0, "found"), (1, 1, "other"), (2, 0, None)], "photo_id long, face_index int, crop_uri string")
    assert sorted((r.photo_id, r.face_index, r.crop_uri) for r in incremental.with_crops(v, c).collect() if r.crop_uri) == [(1, 0, "found"), (1, 1, "own")]
    p = spark.createDataFrame([(1, "uploaded", "idle"), (2, "pending", "analyzed"), (4, None, None)], "album_id long, status string, analysis_status string")
    assert [r.album_id for r in incremental.pruned(p).collect()] == [1]
    albums = spark.createDataFrame([(1, False), (2, None), (3, True), (4, False)], "album_id long, completed boolean")
    assert {r.album_id for r in incremental.started(albums, p).collect() if r.started} == {2, 3}


def test_deletion_agrees_with_its_parts(spark):
    p, members = catalogue.flagged(spark, DIR), catalogue._members(spark, DIR)
    p = incremental.with_duplicate_flags(p, members)
    variants = catalogue.identity.key_faces(catalogue._album_faces(spark, DIR))
    gone = p.where("photo_id % 3 = 0").select("album_id", "photo_id")
    left, counted, _, faces = incremental.after_delete(p, stats.album_stats(p), members, variants, gone)
    assert left.count() == p.where("photo_id % 3 <> 0").count()
    whole = {r.album_id: r.total_photos for r in stats.album_stats(left).collect()}
    assert all(whole.get(r.album_id, 0) == r.total_photos for r in counted.collect())
    assert faces.where(F.exists("photo_ids", lambda x: x % 3 == 0)).count() == 0


def test_native_faces(spark):
    schema = "f struct<boundingBox:struct<left:double,top:double,width:double,height:double>,eyeStatus:string,focusLevel:string,sharpness:double,brightness:double,eyesOpen:struct<value:boolean,confidence:double,left:double,right:double>>"
    df = spark.createDataFrame([(((0.1, 0.1, 0.2, 0.2), "closed", "odd", 70.0, None, None),), (((0.1, 0.1, 0.2, 0.2), None, None, None, 5.0, (True, 80.0, None, None)),)], schema)
    got = [r.n for r in df.select(S.native_face(F.col("f"), F.lit("p"), F.lit(2)).alias("n")).collect()]
    assert [(n.eyeStatus, n.focusLevel, n.eyeConfidence, n.brightness, n.clusterId) for n in got] == [("closed", "good", 0.0, 0.0, "p-2"), ("open", "blurred", 80.0, 5.0, "p-2")]
    row = spark.range(1).select(S.eye_label(F.lit("partial")), S.focus_label(F.lit("good")), S.status_colour(F.lit("blurred"))).first()
    assert tuple(row) == ("Partial Eyes", "Good Focus", "bad")
