"""Photos and faces derived from the test tables: events are photos, line items are faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

_PHOTOS = """
  select user_id as album_id, event_id as photo_id,
    concat(case user_id % 3 when 0 then 'IMG_' when 1 then 'DSC' else 'TR5_' end,
           lpad(cast(row_number() over (partition by user_id order by ts, event_id) + 1000 as {S}), 5, '0'), '.JPG') as file_name,
    case when event_id % 40 <> 7 then {MS} end as captured_at,
    case when event_id % 3 = 0 then substr(md5(cast(event_id as {S})), 1, 16)
         else concat(substr(md5(cast(user_id as {S})), 1, 14), substr(md5(cast(event_id as {S})), 1, 2)) end as perceptual_hash,
    cast(event_id % 6 as int) as star_rating, (event_id * 7919) % 5000000 as file_size
  from events"""

# one face in five is tiny and next to closed, one in eleven half open; two in three have their eyes' places, and most of those a nose and a mouth
_FACES = """
  select f.*, case when marked then box_left + box_width * (25 + l_partkey % 11) / 100.0e0 end as lx, case when marked then box_top + box_height * (33 + l_suppkey % 7) / 100.0e0 end as ly,
    case when marked then box_left + box_width * (65 + l_suppkey % 9) / 100.0e0 end as rx, case when marked then box_top + box_height * (33 + l_partkey % 7) / 100.0e0 end as ry,
    case when marked and l_partkey % 4 <> 0 then box_left + box_width * (45 + l_partkey % 13) / 100.0e0 end as nx, case when marked and l_partkey % 4 <> 0 then box_top + box_height * 0.6e0 end as ny,
    case when marked and l_suppkey % 4 <> 0 then box_left + box_width * 0.5e0 end as mx, case when marked and l_suppkey % 4 <> 0 then box_top + box_height * (78 + l_suppkey % 5) / 100.0e0 end as my
  from (select photo_id, l_partkey, l_suppkey, cast(rn - 1 as int) as face_index, (l_partkey + l_suppkey) % 3 <> 0 as marked,
    (l_partkey % 60)/100.0e0 as box_left, (l_suppkey % 60)/100.0e0 as box_top,
    case when l_suppkey % 5 = 0 then (2 + l_partkey % 4)/100.0e0 else (5 + l_partkey % 20)/100.0e0 end as box_width,
    case when l_suppkey % 5 = 0 then (2 + (l_partkey + l_suppkey) % 4)/100.0e0 else (6 + (l_partkey + l_suppkey) % 22)/100.0e0 end as box_height,
    (l_partkey*7) % 101 as sharpness, (l_suppkey*13) % 100 as eye_conf, (l_partkey % 3) = 0 as eyes_open,
    case when l_suppkey % 5 = 0 then (l_partkey % 7)/100.0e0 when l_partkey % 11 = 3 then (12 + l_suppkey % 11)/100.0e0 else ((l_partkey*11) % 100)/100.0e0 end as left_prob,
    case when l_suppkey % 5 = 0 then (l_suppkey % 6)/100.0e0 when l_partkey % 11 = 3 then (12 + l_partkey % 9)/100.0e0 else ((l_suppkey*17) % 100)/100.0e0 end as right_prob,
    ((l_partkey*3) % 91 - 45)*1.0e0 as yaw, ((l_suppkey*5) % 61 - 30)*1.0e0 as pitch
  from (select l_orderkey as photo_id, l_partkey, l_suppkey,
          row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax) as rn
        from lineitem) t
  where photo_id in (select event_id from events)) f"""

#: What orders lines that are alike in all that a face has, and what leaves out those of no photo.
_TIES, _KNOWN = ", l_shipdate, l_extendedprice, l_discount, l_tax", "where photo_id in (select event_id from events)"

#: The same views for the other engine, as common table expressions with flags and ratings.
DUCK = (
    "with photos0 as materialized (" + _PHOTOS.format(S="varchar", MS="(epoch_us(ts) // 1000)") + "), faces0 as (" + _FACES + """),
faces as (select f.*, greatest(left_prob, right_prob) as hi, least(left_prob, right_prob) as lo,
    case when sharpness >= 65 then 'good' when sharpness >= 40 then 'soft' else 'blurred' end as focus,
    box_width * box_height as area, box_width / greatest(box_height, 1e-8) as aspect,
    case when lx is null then [box_width / greatest(box_height, 1e-8), box_left, box_top, yaw / 90, pitch / 90]
      else [box_width / greatest(box_height, 1e-8), eyes / box_width, coalesce((nx - (lx + rx) / 2) / eyes, 0), coalesce((ny - (ly + ry) / 2) / eyes, 0), coalesce((mx - (lx + rx) / 2) / eyes, 0), coalesce((my - (ly + ry) / 2) / eyes, 0), yaw / 90, pitch / 90] end as print,
    case when lx is null then 0 else 2 end + case when nx is null then 0 else 1 end + case when mx is null then 0 else 1 end as marks
  from (select *, sqrt((rx - lx)**2 + (ry - ly)**2) as eyes from faces0) f),
labelled as (select *, case
    when hi <= 0.22 and lo <= 0.18 then case when not eyes_open and eye_conf >= 88 then 'closed' when eyes_open and eye_conf >= 70 then 'open' when eye_conf >= 88 then 'closed' else 'partial' end
    when hi >= 0.45 and lo <= 0.22 then case when hi >= 0.55 then 'open' else 'partial' end
    when hi >= 0.5 and lo >= 0.35 then 'open'
    when hi <= 0.40 and lo between 0.08 and 0.25 and eye_conf < 80 then 'partial'
    when eyes_open then case when eye_conf >= 70 then 'open' else 'partial' end
    when eye_conf >= 88 then 'closed' else 'partial' end as eye from faces),
tiered as materialized (select *, case when eye = 'closed' or focus = 'blurred' then 0 when eye = 'open' and focus = 'good' then 2 else 1 end as tier from labelled),
flagged as materialized (select p.*, coalesce(n, 0) as n_faces, coalesce(c, false) as closed_eyes, coalesce(b, false) as blurred,
    coalesce(not c and not b and not s and not pt, false) as ai_selected, coalesce(not c and not b and (s or pt), false) as maybe,
    coalesce(not c and not b, false) as selected, coalesce(stars, 0) as stars
  from photos0 p left join (select photo_id, count(*) as n, bool_or(eye = 'closed') as c, bool_or(focus = 'blurred') as b, bool_or(focus = 'soft') as s, bool_or(eye = 'partial') as pt,
    case when min(tier) = 2 then 5 when min(tier) > 0 then 4 when sum(tier) <= count(*) * 2 / 3.0e0 then 1 when sum(tier) >= count(*) * 4 / 3.0e0 then 3 else 2 end as stars from tiered group by 1) g using (photo_id))
"""
)


def _view(spark: SparkSession, sf_dir: str, names: tuple[str, ...], sql: str) -> DataFrame:
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """album_id, photo_id, file_name, captured_at, perceptual_hash, star_rating, file_size."""
    sql = _PHOTOS.format(S="string", MS="unix_millis(cast(ts as timestamp))").replace("from events", "from {events}")
    return _view(spark, sf_dir, ("events",), sql)


def faces(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Faces of a photo with a box, sharpness, eye signals, pose in degrees and, for most, places of eyes, nose and mouth.

    With of (photo_id) those of its photos alone: all rows of a photo are there or none, so numbers in a photo stay.
    """
    # lines that are alike in what is read here give the same faces in any order, so no more is shuffled to order them
    sql = _FACES.replace(_TIES, "").replace(_KNOWN, "").replace("from lineitem", "from {lineitem}")
    lines, events = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "events"))
    for known in (events.select(F.col("event_id").alias("l_orderkey")), *([of.withColumnRenamed("photo_id", "l_orderkey")] if of is not None else [])):
        lines = lines.join(known, "l_orderkey", "left_semi")  # before they are numbered, as numbers go by photo
    return spark.sql(sql, lineitem=lines)


def labelled(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """faces with box, marks (kinds of places), face (as a detector gives it), eye, focus and tier."""
    f = faces(spark, sf_dir, of)
    f = f.withColumn("eye", S.eye_status(F.col("eyes_open"), F.col("eye_conf"), F.col("left_prob"), F.col("right_prob"))).withColumn("focus", S.focus_level(F.col("sharpness")))
    f = f.withColumn("tier", S.face_tier(F.col("eye"), F.col("focus"))).withColumn("box", S.box("box_left", "box_top", "box_width", "box_height"))
    mark = lambda kind, k: F.when(F.col(k + "x").isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(k + "x").alias("x"), F.col(k + "y").alias("y")))
    marks = F.array_compact(F.array(mark("eyeLeft", "l"), mark("eyeRight", "r"), mark("nose", "n"), mark("mouth", "m")))
    f = f.withColumn("face", F.struct(F.col("box").alias("boundingBox"), marks.alias("landmarks"), F.struct("pitch", F.lit(0.0).alias("roll"), "yaw").alias("pose")))
    return f.withColumn("marks", F.transform("face.landmarks", lambda m: m["type"]))
