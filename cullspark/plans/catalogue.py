"""All queries of the photo engine by name, and the SQL they are held against.

Queries without SQL depend on the order of faces or photos; tests hold them against plain loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detector, display
from ..functions import scalar as S
from ..operators import albums, duplicates, faces, identity, incremental, merge, stats
from ..sources.fixtures import DUCK, labelled, photos
from ..sources.fixtures import faces as faces_of

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = DUCK.replace("with ", "with recursive ", 1) + sql
        return f

    return put


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.flagged(photos(spark, sf_dir), labelled(spark, sf_dir))


def r9(c: Column) -> Column:
    return F.round(c, 9)


# --- classification, flags, counts

_STATS = """select album_id, count(*) as total_photos, count(*) filter (selected) as my_selections, count(*) filter (ai_selected) as ai_selected,
  count(*) filter (maybe) as maybe, count(*) filter (blurred) as blurred, count(*) filter (closed_eyes) as closed_eyes, cast(0 as bigint) as duplicated from flagged group by album_id"""


@query(_STATS)
def album_stats(spark, sf_dir):
    return stats.album_stats(flagged(spark, sf_dir))


@query("select photo_id, face_index, eye, focus, tier from tiered")
def eye_focus_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("photo_id", "face_index", "eye", "focus", "tier")


@query("select photo_id, album_id, n_faces, closed_eyes, blurred, ai_selected, maybe, selected from flagged")
def photo_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("photo_id", "album_id", "n_faces", "closed_eyes", "blurred", "ai_selected", "maybe", "selected")


@query("select photo_id, stars from flagged")
def star_rating(spark, sf_dir):
    return flagged(spark, sf_dir).select("photo_id", "stars")


@query("select photo_id from flagged where selected and star_rating in (3, 4, 5) and (maybe or blurred)")
def grid_filter(spark, sf_dir):
    return flagged(spark, sf_dir).where(S.grid_matches("selected", (3, 4, 5), ("maybe", "blurred"))).select("photo_id")


@query("select album_id, photo_id from flagged where closed_eyes")
def cull_filter(spark, sf_dir):
    return flagged(spark, sf_dir).where(S.flag_matches("closed_eyes")).select("album_id", "photo_id")


@query("select 'ai_selected' as key, count(*) as n from flagged where ai_selected union all select 'blurred', count(*) from flagged where blurred union all select 'closed_eyes', count(*) from flagged where closed_eyes union all select 'maybe', count(*) from flagged where maybe")
def key_filter_counts(spark, sf_dir):
    keys = ("ai_selected", "blurred", "closed_eyes", "maybe")
    counted = flagged(spark, sf_dir).agg(*(F.count_if(S.flag_matches(k)).alias(k) for k in keys))
    return counted.unpivot([], list(keys), "key", "n")


@query("select album_id, count(*) as photos, cast(sum(file_size) as bigint) as bytes from photos0 group by 1")
def album_totals(spark, sf_dir):
    return stats.album_totals(photos(spark, sf_dir))


_STATE = "case photo_id % 7 when 0 then 'uploading' when 1 then 'pending' when 2 then 'failed' when 3 then null when 4 then 'idle' else 'uploaded' end"


def _staged(spark, sf_dir):
    return photos(spark, sf_dir).withColumn("status", F.expr(_STATE)).withColumn("progress", (F.col("photo_id") % 101).cast("double"))


_ALBUM = """select album_id, case when album_id % 3 = 0 then null else concat('Album ', cast(album_id as {S})) end as name,
  concat('20', cast(10 + album_id % 15 as {S}), '-0', cast(1 + album_id % 9 as {S}), '-11T10:00:00.000Z') as created_at,
  case when album_id % 4 = 0 then null else 'x' end as link, case when album_id % 5 = 0 then null else album_id % 2 = 0 end as completed,
  case when album_id % 7 = 0 then null else album_id % 3 = 1 end as has_uploads, cast(7 as bigint) as total_photos, cast(null as bigint) as total_storage, album_id % 6 as updated_at
  from (select distinct user_id as album_id from {T} union all select -1 - {N} from (select distinct user_id % 3 as {N} from {T}) z) a"""
_ALBUMS = ", albums as materialized (" + _ALBUM.format(S="varchar", T="events", N="n") + ")"


def _albums(spark, sf_dir) -> DataFrame:
    return spark.sql(_ALBUM.format(S="string", T="{events}", N="n"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _states(spark, sf_dir) -> DataFrame:
    """Photos with flags, position by name and all three statuses."""
    p = flagged(spark, sf_dir).withColumn("position", F.row_number().over(Window.partitionBy("album_id").orderBy(S.natural_key(F.col("file_name")), "photo_id")))
    state = {"status": _STATE, "analysis_status": "case photo_id % 5 when 0 then 'idle' when 1 then 'pending' when 2 then 'analyzing' else 'analyzed' end", "server_upload_status": "case photo_id % 4 when 0 then 'uploading' when 1 then null when 2 then 'pending' else 'uploaded' end"}
    return p.withColumns({k: F.expr(v) for k, v in state.items()})


_STATES = f""", states as materialized (select *, row_number() over (partition by album_id order by file_name, photo_id) as position, {_STATE} as status,
  case photo_id % 5 when 0 then 'idle' when 1 then 'pending' when 2 then 'analyzing' else 'analyzed' end as analysis_status,
  case photo_id % 4 when 0 then 'uploading' when 1 then null when 2 then 'pending' else 'uploaded' end as server_upload_status from flagged)"""


@query(f"""select album_id, count(*) as total, count(*) filter (s = 'pending') as pending, count(*) filter (s = 'uploading') as uploading, count(*) filter (s = 'uploaded') as uploaded, count(*) filter (s = 'failed') as failed
  from (select album_id, case when coalesce(st, 'pending') = 'idle' then 'pending' else coalesce(st, 'pending') end as s from (select album_id, {_STATE} as st from photos0)) group by 1""")
def status_counts(spark, sf_dir):
    p = _staged(spark, sf_dir)
    return stats.status_counts(p.select("album_id", "photo_id"), p, ("pending", "uploading", "uploaded", "failed"))


@query(f"""select album_id, round(1 - count(*) filter (s in ('pending', 'uploading')) * 1e0 / count(*), 9) as progress
  from (select album_id, case when coalesce(st, 'pending') = 'idle' then 'pending' else coalesce(st, 'pending') end as s from (select album_id, {_STATE} as st from photos0)) group by 1""")
def import_progress(spark, sf_dir):
    c = status_counts(spark, sf_dir)
    return c.select("album_id", r9(stats.local_progress(F.col("total"), F.col("pending"), F.col("uploading"))).alias("progress"))


@query(f"""select album_id, round(sum(w * d) / sum(w), 9) as progress, bool_and(s in ('uploaded', 'failed')) as finished, bool_and(s = 'uploaded') as successful, bool_or(s = 'uploading') as in_flight
  from (select album_id, coalesce({_STATE}, 'idle') as s, case when file_size > 0 then file_size else 1 end as w,
    case when {_STATE} in ('uploaded', 'failed') then 1e0 when {_STATE} = 'uploading' then (photo_id % 101) / 100e0 else 0e0 end as d from photos0) group by 1""")
def upload_progress(spark, sf_dir):
    return stats.upload_progress(_staged(spark, sf_dir).fillna("idle", ["status"])).withColumn("progress", r9(F.col("progress")))


@query(_STATES + """select album_id, count(*) as total, count(*) filter (s = 'pending') as pending, count(*) filter (s = 'uploading') as uploading, count(*) filter (s = 'uploaded') as uploaded, count(*) filter (s = 'failed') as failed
  from (select album_id, coalesce(server_upload_status, 'idle') as s from states) group by 1""")
def server_upload_counts(spark, sf_dir):
    """Photos that are idle on the server count in the total alone."""
    p = _states(spark, sf_dir).select("album_id", "photo_id", F.coalesce("server_upload_status", F.lit("idle")).alias("status"))
    return stats.status_counts(p.select("album_id", "photo_id"), p, ("pending", "uploading", "uploaded", "failed"), missing="idle", idle_as=None)


# --- orders, lookups

@query("select album_id, photo_id, row_number() over (partition by album_id order by file_name, photo_id) as position from photos0")
def natural_order(spark, sf_dir):
    w = Window.partitionBy("album_id").orderBy(S.natural_key(F.col("file_name")), "photo_id")
    return photos(spark, sf_dir).select("album_id", "photo_id", F.row_number().over(w).alias("position"))


@query("select album_id, photo_id, row_number() over (partition by album_id order by captured_at desc, photo_id) as position from photos0")
def uploaded_desc(spark, sf_dir):
    w = Window.partitionBy("album_id").orderBy(F.desc("captured_at"), "photo_id")
    return photos(spark, sf_dir).select("album_id", "photo_id", F.row_number().over(w).alias("position"))


@query("""select album_id, photo_id, row_number() over (partition by album_id order by case when photo_id % 4 = 0 then -photo_id end nulls last, file_name, photo_id) as position from photos0""")
def culling_order(spark, sf_dir):
    p = photos(spark, sf_dir)
    order = p.where("photo_id % 4 = 0").select("album_id", "photo_id", (-F.col("photo_id")).alias("photo_order"))
    return merge.ordered(p, order).select("album_id", "photo_id", "position")


@query("select album_id, photo_id from (select *, row_number() over (partition by album_id order by file_name, photo_id) as r from photos0) where r > 12 and r <= 60")
def album_page(spark, sf_dir):
    w = Window.partitionBy("album_id").orderBy(S.natural_key(F.col("file_name")), "photo_id")
    return photos(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r > 12 and r <= 60").select("album_id", "photo_id")


@query("select photo_id, regexp_extract(lower(regexp_replace(file_name, '\\.[^.]+$', '')), '^(.*?)(\\d+)$', 1) as prefix, cast(regexp_extract(regexp_replace(file_name, '\\.[^.]+$', ''), '(\\d+)$', 1) as bigint) as idx, regexp_replace(file_name, '\\.[^.]*$', '') as stem from photos0")
def burst_parse(spark, sf_dir):
    n = F.col("file_name")
    return photos(spark, sf_dir).select("photo_id", S.burst_prefix(n).alias("prefix"), S.burst_index(n).cast("long").alias("idx"), S.photo_id_of_file(n).alias("stem"))


@query("""select p.photo_id, q.photo_id as other_id,
  bit_count(xor(('0x' || substr(p.perceptual_hash, 1, 8))::bigint, ('0x' || substr(q.perceptual_hash, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(p.perceptual_hash, 9, 8))::bigint, ('0x' || substr(q.perceptual_hash, 9, 8))::bigint)) as hamming
  from photos0 p join photos0 q on q.photo_id = p.photo_id + 1""")
def hash_hamming(spark, sf_dir):
    p = photos(spark, sf_dir).select("photo_id", "perceptual_hash")
    q = p.select((F.col("photo_id") - 1).alias("photo_id"), F.col("photo_id").alias("other_id"), F.col("perceptual_hash").alias("h"))
    return p.join(q, "photo_id").select("photo_id", "other_id", S.hamming(F.col("perceptual_hash"), F.col("h")).cast("int").alias("hamming"))


# --- duplicates

#: Distance of two prints, null where the second is shorter.
_APART = "case when len({b}) >= len({a}) then sqrt(list_sum(list_transform(list_zip({a}, {b}[1:len({a})]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len({a})) end"

_PAIRS = """, pairs as materialized (select a.album_id, a.photo_id as a, b.photo_id as b, coalesce(a.captured_at, 0) - coalesce(b.captured_at, 0) as dt,
    abs(cast(regexp_extract(a.file_name, '(\\d+)\\.', 1) as bigint) - cast(regexp_extract(b.file_name, '(\\d+)\\.', 1) as bigint)) as gap,
    bit_count(xor(('0x' || substr(a.perceptual_hash, 1, 8))::bigint, ('0x' || substr(b.perceptual_hash, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(a.perceptual_hash, 9, 8))::bigint, ('0x' || substr(b.perceptual_hash, 9, 8))::bigint)) as ham
  from photos0 a join photos0 b on a.album_id = b.album_id and (coalesce(b.captured_at, 0) < coalesce(a.captured_at, 0) or (coalesce(b.captured_at, 0) = coalesce(a.captured_at, 0) and b.photo_id < a.photo_id)) and coalesce(a.captured_at, 0) - coalesce(b.captured_at, 0) <= 300000),
close as materialized (select * from pairs where gap <= 10),
ranked as materialized (select photo_id, area, aspect as asp, row_number() over (partition by photo_id order by area desc, face_index) as k, count(*) over (partition by photo_id) as n from tiered),
px as materialized (select p.a, p.b, x.* from close p join ranked x on x.photo_id = p.a),
framed as (select x.a, x.b, bool_and(greatest(x.area, y.area) / least(x.area, y.area) <= 1.85 and greatest(x.asp, y.asp) / least(x.asp, y.asp) <= 1.35) as ok
  from px x join ranked y on y.photo_id = x.b where x.k = y.k and x.n = y.n group by 1, 2),
prints as materialized (select photo_id, face_index, print, count(*) over (partition by photo_id) as n from tiered),
pq as materialized (select p.a, p.b, x.* from close p join prints x on x.photo_id = p.a),
nearest as (select x.a, x.b, x.face_index, min(""" + _APART.format(a="x.print", b="y.print") + """) as d
  from pq x join prints y on y.photo_id = x.b where x.n = y.n group by 1, 2, 3),
alike as (select a, b, avg(d) < 0.06 and count(d) = count(*) as ok from nearest group by 1, 2),
links as materialized (select p.* from close p left join framed f on f.a = p.a and f.b = p.b left join alike l on l.a = p.a and l.b = p.b where
  case when ham <= 4 then true when gap <= 2 and ham <= 8 then true when ham > case when gap <= 2 then 30 else 24 end then false when gap <= 2 and coalesce(f.ok, false) then true else coalesce(l.ok, false) and coalesce(f.ok, false) end)"""

_GROUPS = _PAIRS + """, edges as (select a, b from links union select b, a from links), reach as (select a as id, a as m from edges union select r.id, e.b from reach r join edges e on e.a = r.m),
comp as (select id as photo_id, min(m) as component from reach group by 1)"""

_BEST = _GROUPS + """, ranks as (select c.photo_id, c.component, f.album_id, count(*) over (partition by component) as n,
  first(c.photo_id) over (partition by component order by case when blurred then 0 when closed_eyes then 1 else 2 end desc, coalesce(star_rating, 0) desc, captured_at nulls last, file_name, cast(c.photo_id as varchar)) as best_photo_id from comp c join flagged f on f.photo_id = c.photo_id)"""


@query(_PAIRS + "select album_id, a, b, dt from pairs")
def temporal_pairs(spark, sf_dir):
    return duplicates.pairs(photos(spark, sf_dir)).select("album_id", F.col("a_photo_id").alias("a"), F.col("b_photo_id").alias("b"), "dt")


def _links(spark, sf_dir):
    return duplicates.duplicate_pairs(photos(spark, sf_dir), lambda of: _printed(spark, sf_dir, of).select("photo_id", "face_index", "box", "print"))


@query(_PAIRS + "select album_id, a, b, gap, ham as hamming from links")
def near_dup_pairs(spark, sf_dir):
    return _links(spark, sf_dir).withColumn("gap", F.col("gap").cast("long")).withColumn("hamming", F.col("hamming").cast("int"))


@query(_GROUPS + "select photo_id, component from comp")
def dup_components(spark, sf_dir):
    return duplicates.groups(photos(spark, sf_dir), _links(spark, sf_dir)).select("photo_id", "component")


def _grouped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Duplicate groups' members, and the photos in them with flags: no other photo's faces are labelled."""
    found = duplicates.groups(photos(spark, sf_dir), _links(spark, sf_dir))
    ids = found.select("photo_id").distinct()
    ids = F.broadcast(ids) if found.count() <= duplicates.FEW else ids
    p = stats.flagged(photos(spark, sf_dir).join(ids, "photo_id", "left_semi"), labelled(spark, sf_dir, ids))
    return duplicates.best_of_groups(p, found), p


def _members(spark, sf_dir):
    return _grouped(spark, sf_dir)[0]


@query(_BEST + "select photo_id, 'dup-' || best_photo_id || '-' || n as group_id, best_photo_id, photo_id <> best_photo_id as duplicated from ranks")
def dup_best(spark, sf_dir):
    return _members(spark, sf_dir).select("photo_id", "group_id", "best_photo_id", "duplicated")


@query(_BEST + "select f.photo_id, coalesce(r.photo_id <> best_photo_id, false) as duplicated, case when coalesce(r.photo_id <> best_photo_id, false) then false else selected end as selected from flagged f left join ranks r on r.photo_id = f.photo_id")
def dup_flags(spark, sf_dir):
    return incremental.with_duplicate_flags(flagged(spark, sf_dir), _members(spark, sf_dir)).select("photo_id", "duplicated", "selected")


_PATCH = _BEST + """, left_ as (select r.photo_id, r.component, case when blurred then 0 when closed_eyes then 1 else 2 end as t, f.star_rating, f.captured_at, f.file_name, 'dup-' || best_photo_id || '-' || n as group_id from ranks r join flagged f on f.photo_id = r.photo_id where r.photo_id % 5 <> 0),
patched as (select *, count(*) over (partition by component) as left_n, max(t) over (partition by component) as top,
  first(photo_id) over (partition by component order by t desc, coalesce(star_rating, 0) desc, captured_at nulls last, file_name, cast(photo_id as varchar)) as b from left_)"""


@query(_PATCH + "select photo_id, case when left_n > 1 and top = 2 then group_id end as group_id, case when left_n > 1 and top = 2 then b end as best_photo_id, left_n > 1 and top = 2 and photo_id <> b as duplicated from patched")
def dup_patch_after_delete(spark, sf_dir):
    members, p = _grouped(spark, sf_dir)
    gone = photos(spark, sf_dir).where("photo_id % 5 = 0").select("album_id", "photo_id")
    return incremental.groups_after_delete(members, p, gone).drop("album_id")


@query(_STATS.replace("from flagged", "from flagged where photo_id % 5 <> 0") + " union all select album_id, 0, 0, 0, 0, 0, 0, 0 from photos0 group by 1 having count(*) filter (photo_id % 5 <> 0) = 0")
def stats_delta(spark, sf_dir):
    p = flagged(spark, sf_dir)
    return incremental.stats_after_delete(stats.album_stats(p), p.where("photo_id % 5 = 0"))


# --- faces

_FACE_PAIRS = """, fp as (select a.photo_id, a.face_index as a, b.face_index as b, a.area as aa, b.area as ba,
    greatest(0, least(a.box_left + a.box_width, b.box_left + b.box_width) - greatest(a.box_left, b.box_left)) * greatest(0, least(a.box_top + a.box_height, b.box_top + b.box_height) - greatest(a.box_top, b.box_top)) as inter,
    sqrt((a.box_left + a.box_width / 2 - b.box_left - b.box_width / 2)**2 + (a.box_top + a.box_height / 2 - b.box_top - b.box_height / 2)**2) as apart,
    least(sqrt(a.box_width**2 + a.box_height**2), sqrt(b.box_width**2 + b.box_height**2)) as diag
  from tiered a join tiered b on a.photo_id = b.photo_id and a.face_index < b.face_index)"""


def _face_pairs(spark, sf_dir):
    f = labelled(spark, sf_dir)
    a, b = (f.select("photo_id", F.col("face_index").alias(k), F.col("box").alias(f"{k}_box")) for k in "ab")
    return a.join(b, "photo_id").where("a < b")


@query("select photo_id, face_index, round(area, 9) as area, round(box_width / box_height, 9) as aspect, round(box_left + box_width / 2, 9) as cx, round(box_top + box_height / 2, 9) as cy from tiered")
def face_geometry(spark, sf_dir):
    b = F.col("box")
    x, y = S.centre(b)
    return labelled(spark, sf_dir).select("photo_id", "face_index", r9(S.area(b)).alias("area"), r9(S.aspect(b)).alias("aspect"), r9(x).alias("cx"), r9(y).alias("cy"))


@query(_FACE_PAIRS + """select photo_id, a, b, round(inter / (aa + ba - inter), 9) as iou from fp where inter > 0 and (inter / (aa + ba - inter) >= 0.42 or (greatest(aa, ba) / least(aa, ba) >= 1.8 and inter / least(aa, ba) >= 0.5)
  or (greatest(aa, ba) / least(aa, ba) >= 1.8 and inter / (aa + ba - inter) >= 0.18 and apart < 0.48 * diag))""")
def spatial_redundant_pairs(spark, sf_dir):
    a, b = F.col("a_box"), F.col("b_box")
    return _face_pairs(spark, sf_dir).where(S.redundant(a, b)).select("photo_id", "a", "b", r9(S.iou(a, b)).alias("iou"))


def _sets(spark, sf_dir):
    return faces.gather(labelled(spark, sf_dir), "eye", "focus", "sharpness", "eye_conf", "yaw", "marks")


def _yaw(face: Column) -> Column:
    return face["yaw"]


def _flat(sets: DataFrame, kept: Column) -> DataFrame:
    """One row per face kept. An outer explode: an inner one would push a filter on kept, and so kept itself, below all its parts."""
    return sets.select("photo_id", F.explode_outer(kept).alias("f")).where("f is not null").select("photo_id", F.col("f.face_index").alias("face_index"))


_REF = """, ord as (select photo_id, area, row_number() over (partition by photo_id order by area) as k, count(*) over (partition by photo_id) as n from tiered where area > 0),
ref as (select photo_id, avg(area) as ref from ord where k > n // 2 group by 1), cnt as (select photo_id, count(*) as n from tiered group by 1)"""


@query(_REF + """select t.photo_id, t.face_index from tiered t join ref using (photo_id) join cnt using (photo_id) where area >= 0.0004
  and not (n >= 2 and area < 0.00075 and area < ref * 0.5 and not (ref / area >= 8 and exists (select 1 from tiered o where o.photo_id = t.photo_id and o.area >= ref * 0.85 and o.box_top + o.box_height / 2 + 0.03 < t.box_top + t.box_height / 2)))
  and not (n >= 2 and focus = 'soft' and area < 0.012 and ref >= 0.012 and area < ref * 0.5) and not (eye = 'open' and focus = 'blurred')""")
def nonface_filter(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    return _flat(sets, faces.without_artifacts(F.col("faces")))


@query(""", fc as materialized (select *, box_left + box_width / 2 as x, box_top + box_height / 2 as y, count(*) over (partition by photo_id) as n, (sharpness < 48 or focus = 'blurred') as sm, case when abs(yaw) > pi() + 0.01 then radians(abs(yaw)) else abs(yaw) end as turn from tiered),
  judged as (select p.photo_id, p.face_index, bool_or(
    (p.area between 0.0035 and 0.16 and (p.sm or p.area >= 0.012) and o.area >= 0.0004 and o.area < p.area and o.y > p.y + 0.04 and p.area / o.area >= 3)
    or (p.sm and p.n <= 6 and (p.x <= 0.32 or p.x >= 0.68) and p.area between 0.0035 and 0.16 and o.area >= 0.00175 and p.area / o.area between 0.4 and 2.5 and abs(p.x - 0.5) >= abs(o.x - 0.5) + 0.2 and p.y <= o.y + 0.06)
    or (p.sm and (p.x <= 0.38 or p.x >= 0.62) and p.turn >= 0.4 and o.turn <= 0.35 and o.area >= 0.0004)
    or (p.sm and p.area >= 0.015 and (p.x <= 0.38 or p.x >= 0.62) and o.area >= 0.0008 and o.area < 0.85 * p.area and abs(o.x - 0.5) < abs(p.x - 0.5))) as bad
    from fc p left join fc o on o.photo_id = p.photo_id and o.face_index <> p.face_index group by 1, 2)
  select photo_id, face_index from judged where not coalesce(bad, false)""")
def media_filter(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    return _flat(sets, faces.without_displayed_media(F.col("faces"), yaw=_yaw))


_POSTED = _REF + """, one as materialized (select t.* from tiered t join ref using (photo_id) join cnt using (photo_id) where area >= 0.0004
    and not (n >= 2 and area < 0.00075 and area < ref * 0.5 and not (ref / area >= 8 and exists (select 1 from tiered o where o.photo_id = t.photo_id and o.area >= ref * 0.85 and o.box_top + o.box_height / 2 + 0.03 < t.box_top + t.box_height / 2)))
    and not (n >= 2 and focus = 'soft' and area < 0.012 and ref >= 0.012 and area < ref * 0.5) and not (eye = 'open' and focus = 'blurred')),
  fc as materialized (select *, box_left + box_width / 2 as x, box_top + box_height / 2 as y, count(*) over (partition by photo_id) as n, sharpness < 48 as sm, case when abs(yaw) > pi() + 0.01 then radians(abs(yaw)) else abs(yaw) end as turn from one),
  judged as (select p.photo_id, p.face_index, p.area, p.y, bool_or(
    (p.area between 0.0035 and 0.16 and (p.sm or p.area >= 0.012) and o.area >= 0.0004 and o.area < p.area and o.y > p.y + 0.04 and p.area / o.area >= 3)
    or (p.sm and p.n <= 6 and (p.x <= 0.32 or p.x >= 0.68) and p.area between 0.0035 and 0.16 and o.area >= 0.00175 and p.area / o.area between 0.4 and 2.5 and abs(p.x - 0.5) >= abs(o.x - 0.5) + 0.2 and p.y <= o.y + 0.06)
    or (p.sm and (p.x <= 0.38 or p.x >= 0.62) and p.turn >= 0.4 and o.turn <= 0.35 and o.area >= 0.0004)
    or (p.sm and p.area >= 0.015 and (p.x <= 0.38 or p.x >= 0.62) and o.area >= 0.0004 and o.area < 0.85 * p.area and abs(o.x - 0.5) < abs(p.x - 0.5))) as bad
    from fc p left join fc o on o.photo_id = p.photo_id and o.face_index <> p.face_index group by 1, 2, 3, 4),
  two as (select * from judged where not coalesce(bad, false)),
  s as (select photo_id, bool_or(y between 0.45 and 0.88) as stage, count(*) filter (not (area >= 0.012 and y < 0.40)) as keep from two group by 1),
  three as (select two.* from two join s using (photo_id) where not (stage and keep > 0) or not (area >= 0.012 and y < 0.40))"""


@query(_POSTED + " select photo_id, cast(row_number() over (partition by photo_id order by face_index) - 1 as int) as face_index, round(area, 9) as area from three")
def post_processed_faces(spark, sf_dir):
    sets = faces.post_processed(_sets(spark, sf_dir), _yaw)
    return sets.select("photo_id", F.explode_outer("faces").alias("f")).where("f is not null").select("photo_id", "f.face_index", r9(S.area(F.col("f.box"))).alias("area"))


@query(""", b as (select *, box_top + box_height / 2 as y from tiered), s as (select photo_id, bool_or(y between 0.45 and 0.88) as stage, count(*) filter (not (area >= 0.012 and y < 0.40)) as keep from b group by 1)
  select b.photo_id, face_index from b join s using (photo_id) where not (stage and keep > 0) or not (area >= 0.012 and y < 0.40)""")
def backdrop_filter(spark, sf_dir):
    return _flat(_sets(spark, sf_dir), faces.without_backdrop(F.col("faces")))


@query("select photo_id, face_index from tiered where not (eye = 'open' and focus = 'blurred')")
def open_blurred_filter(spark, sf_dir):
    return labelled(spark, sf_dir).where("not (eye = 'open' and focus = 'blurred')").select("photo_id", "face_index")


def _suppression(score: str, clash: str, name: str, source: str = "tiered", most: int | None = None) -> str:
    """CTEs for greedy suppression: faces in order of score, each kept if none kept before clashes with it. clash is on boxes b (kept) and r (next)."""
    order = f"row_number() over (partition by photo_id order by round({score}, 9) desc, face_index)"
    limit = f" where k <= {most}" if most else ""
    box = "{'i': face_index, 'l': box_left, 't': box_top, 'w': box_width, 'h': box_height}"
    return f""", {name}_r as materialized (select * from (select photo_id, {order} as k, {box} as r from {source}){limit}),
  {name}_s as (select photo_id, k, [r] as kept from {name}_r where k = 1
    union all select s.photo_id, n.k, case when len(list_filter(s.kept, lambda b: {clash.replace("r.", "n.r.")})) > 0 then s.kept else list_append(s.kept, n.r) end as kept from {name}_s s join {name}_r n on n.photo_id = s.photo_id and n.k = s.k + 1),
  {name} as materialized (select photo_id, unnest(kept).i as face_index from (select photo_id, arg_max(kept, k) as kept from {name}_s group by 1))"""


_BOTH = "greatest(0, least(b.l + b.w, r.l + r.w) - greatest(b.l, r.l)) * greatest(0, least(b.t + b.h, r.t + r.h) - greatest(b.t, r.t))"
_OVER = f"{_BOTH} / (b.w * b.h + r.w * r.h - {_BOTH})"
_UNEVEN = "greatest(b.w * b.h, r.w * r.h) / least(b.w * b.h, r.w * r.h)"
_CENTRES = "sqrt((b.l + b.w / 2 - r.l - r.w / 2)**2 + (b.t + b.h / 2 - r.t - r.h / 2)**2)"
_DIAGONAL = "least(sqrt(b.w**2 + b.h**2), sqrt(r.w**2 + r.h**2))"


def _clash(same: float, ratio: float, share: float, loose: float, near: float) -> str:
    return f"{_BOTH} > 0 and ({_OVER} >= {same} or ({_UNEVEN} >= {ratio} and {_BOTH} / least(b.w * b.h, r.w * r.h) >= {share}) or ({_UNEVEN} >= {ratio} and {_OVER} >= {loose} and {_CENTRES} < {near} * {_DIAGONAL}))"


_SAME_FACE = _clash(0.42, 1.8, 0.50, 0.18, 0.48)


@query(_suppression("marks * 1e6 + area * 1e3 + eye_conf", _SAME_FACE, "kept") + " select photo_id, face_index from kept")
def face_nms(spark, sf_dir):
    return _flat(_sets(spark, sf_dir), faces.suppressed(F.col("faces"), score=lambda f: faces.keep_score(f, f["marks"])))


@query(_suppression("sharpness", f"{_OVER} >= 0.4", "kept", most=5000) + " select photo_id, face_index from kept")
def detector_nms(spark, sf_dir):
    return _flat(_sets(spark, sf_dir), faces.suppressed(F.col("faces"), score=lambda f: f["sharpness"] * 1.0, overlap=0.4, most=5000))


@query(_suppression("sharpness * 1e3 + area", _clash(0.55, 2.4, 0.70, 0.32, 0.35), "kept") + " select photo_id, face_index from kept")
def detector_dedupe(spark, sf_dir):
    return _flat(_sets(spark, sf_dir), faces.suppressed(F.col("faces"), score=lambda f: f["sharpness"] * 1e3 + S.area(f["box"]), values=S.DETECTOR))


def _subjects(source: str) -> str:
    """CTEs for the subjects among the faces of source (photo_id, face_index, box, area, sharpness, yaw): chosen (photo_id, face_index)."""
    few = "{kept} < greatest(1, ceil({of} * 0.35))"
    return f""", m as materialized (select photo_id, face_index as i, area, box_left + box_width / 2 as x, box_top + box_height / 2 as y, box_width as w, box_height as h, cast(sharpness as double) as sharp, yaw, count(*) over (partition by photo_id) as faces,
    box_left < 0.08 or box_top < 0.06 or box_left + box_width > 0.92 or box_top + box_height > 0.94 or box_left + box_width / 2 < 0.16 or box_left + box_width / 2 > 0.84 as edge, area * (0.35e0 + 0.65e0 * sharpness / 100) as prominence from {source}),
  peers as materialized (select a.photo_id, a.i as seed, b.* exclude (photo_id) from m a join m b on a.photo_id = b.photo_id and least(a.area, b.area) > 1e-12 and greatest(a.area, b.area) <= 2.4 * least(a.area, b.area)),
  scored as (select photo_id, seed, count(*) as n, round(sum(area) * sqrt(count(*)) * (0.5e0 + 0.5e0 * sum(sharp) / count(*) / 100), 12) as score from peers group by 1, 2),
  best as (select photo_id, arg_max(seed, (score, n, -seed)) as best, arg_max(seed, (score, n, -seed)) filter (n >= 2) as dense from scored group by 1),
  lead as (select photo_id, arg_max(i, (prominence, -i)) as i from m group by 1),
  core as (select b.photo_id, median(p.area) as area, median(p.sharp) as sharp, max(p.prominence) as top, bool_or(p.i = l.i) as inside from best b join lead l using (photo_id) join peers p on p.photo_id = b.photo_id and p.seed = b.dense group by 1),
  seed as (select b.photo_id, case when dense is null then best when c.inside or (f.area >= c.area * 3.5 and f.edge) then dense
      when (f.area >= c.area * 1.55 and f.sharp >= c.sharp * 0.8 and f.sharp >= 45) or (f.prominence >= c.top * 1.2 and f.area >= c.area * 1.35 and f.sharp >= 45) then f.i else dense end as seed
    from best b join lead l on l.photo_id = b.photo_id join m f on f.photo_id = b.photo_id and f.i = l.i left join core c on c.photo_id = b.photo_id),
  g as materialized (select p.*, count(*) over (partition by p.photo_id) as size, p.x - lag(p.x) over (partition by p.photo_id order by p.x) as gap from peers p join seed s on s.photo_id = p.photo_id and s.seed = p.seed),
  mid as (select photo_id, median(x) as cx, median(y) as cy, median(w) as mw, median(h) as mh, coalesce(median(gap), 0) as gaps from g group by 1),
  off as (select g.photo_id, median(abs(x - cx)) as mx, median(abs(y - cy)) as my from g join mid using (photo_id) group by 1),
  reach as (select photo_id, cx, cy, greatest(mx * 3.25, mw * 2.5, case when my <= mh * 0.55 then greatest(gaps * 2.75, mw * 4) else 0 end) as lx, greatest(my * 3.25, mh * 1.75) as ly from mid join off using (photo_id)),
  near as (select g.*, abs(x - cx) <= lx and abs(y - cy) <= ly as near from g join reach using (photo_id)),
  g2 as materialized (select *, count(*) over (partition by photo_id) as size2 from (select *, count(*) filter (near) over (partition by photo_id) as n from near) where size <= 2 or n = 0 or near),
  keen as (select photo_id, median(sharp) as sm, max(sharp) as sx from g2 group by 1),
  g2b as (select g2.*, sm, sx, not (sharp < sm * 0.48 or (sx >= 55 and sharp < sx * 0.45 and sharp < 50)) as keen from g2 join keen using (photo_id)),
  g3 as materialized (select *, count(*) over (partition by photo_id) as size3 from (select *, count(*) filter (keen) over (partition by photo_id) as n2 from g2b) where size2 < 2 or (sm < 20 and sx < 40) or {few.format(kept="n2", of="size2")} or keen),
  true_ as (select g3.*, pm, not (abs(yaw) >= 28 and sharp < pm * 0.72) as true_, abs(yaw) < 18 and sharp >= pm * 0.9 and sharp >= 50 as frontal from g3 join (select photo_id, median(sharp) as pm from g3 group by 1) using (photo_id)),
  last as (select * from (select *, count(*) filter (true_) over (partition by photo_id) as n3, bool_or(frontal) over (partition by photo_id) as any_ from true_) where size3 < 2 or not any_ or pm < 40 or {few.format(kept="n3", of="size3")} or true_),
  chosen as (select photo_id, i as face_index from m where faces <= 1 union select photo_id, i from last where faces > 1)"""


@query(_subjects("tiered") + " select photo_id, face_index from chosen")
def dominant_cluster(spark, sf_dir):
    return _flat(faces.dominant(_sets(spark, sf_dir), _yaw), F.col("faces"))


_FILTERED = _POSTED[: _POSTED.index("  two as")].replace("sharpness < 48 as sm", "(sharpness < 48 or focus = 'blurred') as sm").replace("o.area >= 0.0004 and o.area < 0.85", "o.area >= 0.0008 and o.area < 0.85")
_CLEAN = _FILTERED + "  shown as materialized (select one.* from one join judged using (photo_id, face_index) where not coalesce(bad, false))" + _suppression("marks * 1e6 + area * 1e3 + eye_conf", _SAME_FACE, "kept", "shown") + ", left_ as materialized (select one.* from one join kept using (photo_id, face_index))" + _subjects("left_")


@query(_CLEAN + " select photo_id, face_index from chosen")
def clean_faces(spark, sf_dir):
    """Artifacts, displayed media and redundant boxes out, then the dominant group."""
    sets = _sets(spark, sf_dir)
    for step in (faces.without_artifacts, lambda f: faces.without_displayed_media(f, yaw=_yaw), lambda f: faces.suppressed(f, score=lambda x: faces.keep_score(x, x["marks"]))):
        sets = sets.withColumn("faces", step(F.col("faces")))
    return _flat(faces.dominant(sets, _yaw), F.col("faces"))


@query(""", z as (select *, not eyes_open and area >= 0.001 and area < 0.0025 as shut from tiered),
  y as (select *, row_number() over (partition by photo_id, shut order by hi, eye_conf desc, face_index) as r from z)
  select photo_id, face_index, eyes_open or (shut and r > 1) as eyes_open, case when shut and r > 1 then 72 else eye_conf end as eye_conf, shut and r > 1 as reopened from y""")
def closed_eye_dedupe(spark, sf_dir):
    return faces.closed_eyes_once(labelled(spark, sf_dir)).select("photo_id", "face_index", "eyes_open", "eye_conf", "reopened")


@query(""", g as (select *, eye_conf <= 90 and ((eyes_open and hi between 0.14 and 0.22 and lo >= 0.12 and round(hi - lo, 9) <= 0.08) or (hi between 0.28 and 0.42 and lo <= 0.05)) as forced from tiered),
  h as (select *, not forced and eyes_open and area < 0.001 and eye_conf <= 74 and hi <= 0.06 and lo <= 0.05 as tiny, count(*) filter (forced) over (partition by photo_id) as nf from g),
  k as (select *, forced or (tiny and row_number() over (partition by photo_id, tiny order by hi, eye_conf, face_index) <= 5 - nf) as taken from h)
  select photo_id, face_index, eyes_open and not taken as eyes_open, case when taken then 72 else eye_conf end as eye_conf, taken as crowd_partial from k""")
def crowd_partial_budget(spark, sf_dir):
    return faces.crowd_partial(labelled(spark, sf_dir)).select("photo_id", "face_index", "eyes_open", "eye_conf", "crowd_partial")


@query("""select photo_id, face_index, cast(round(greatest(0e0, box_left - 0.3 * box_width) * 4000) as int) as x, cast(round(greatest(0e0, box_top - 0.3 * box_height) * 3000) as int) as y,
  greatest(1, cast(round(least(1e0, box_left + box_width * 1.3) * 4000) as int) - cast(round(greatest(0e0, box_left - 0.3 * box_width) * 4000) as int)) as w, greatest(1, cast(round(least(1e0, box_top + box_height * 1.5) * 3000) as int) - cast(round(greatest(0e0, box_top - 0.3 * box_height) * 3000) as int)) as h from tiered""")
def face_crops(spark, sf_dir):
    return labelled(spark, sf_dir).select("photo_id", "face_index", S.crop(F.col("box"), F.lit(4000), F.lit(3000)).alias("c")).select("photo_id", "face_index", "c.*")


def _printed(spark, sf_dir, of: DataFrame | None = None):
    return labelled(spark, sf_dir, of).withColumn("print", S.fingerprint(F.col("face"))).withColumn("area", S.area(F.col("box")))


@query("select photo_id, face_index, list_transform(print, lambda x: round(x, 7) + 0.0e0) as print, len(print) as n from tiered")
def face_fingerprint(spark, sf_dir):
    return _printed(spark, sf_dir).select("photo_id", "face_index", F.transform("print", lambda x: F.round(x, 7) + 0.0).alias("print"), F.size("print").cast("long").alias("n"))


@query("select a.photo_id, a.face_index as a, b.face_index as b, round(" + _APART.format(a="a.print", b="b.print") + ", 7) as distance from tiered a join tiered b on a.photo_id = b.photo_id and a.face_index < b.face_index")
def fingerprint_distance(spark, sf_dir):
    f = _printed(spark, sf_dir).select("photo_id", "face_index", "print")
    b = f.select("photo_id", F.col("face_index").alias("b"), F.col("print").alias("q"))
    return f.join(b, "photo_id").where("face_index < b").select("photo_id", F.col("face_index").alias("a"), "b", F.round(S.distance(F.col("print"), F.col("q")), 7).alias("distance"))


def _album_faces(spark, sf_dir):
    p = photos(spark, sf_dir)
    w = Window.partitionBy("album_id").orderBy("captured_at", "photo_id")
    p = p.withColumn("photo_order", F.row_number().over(w)).select("album_id", "photo_id", "captured_at", "photo_order")
    return _printed(spark, sf_dir).join(p, "photo_id").withColumn("cluster", F.concat(F.lit("person-"), F.col("sharpness") % 9))


@query(""", o as (select photo_id, album_id, row_number() over (partition by album_id order by captured_at nulls first, photo_id) as photo_order from photos0),
  s as (select t.*, album_id, photo_order, 'person-' || (sharpness % 9) || '::' || eye || '::' || focus as variant,
    case eye when 'open' then 400 when 'partial' then 200 else 0 end + case focus when 'good' then 300 when 'soft' then 150 else 0 end + least(sharpness, 100) + greatest(0, 100 - abs(yaw) - abs(pitch)) + box_width * box_height * 500 - photo_order * 10 as score from tiered t join o using (photo_id))
  select album_id, variant, count(*) as occurrences, count(distinct photo_id) as photos, arg_max(photo_id, (score, -photo_order, -face_index)) as best_photo_id, min(photo_order) as first_order from s group by 1, 2""")
def key_face_groups(spark, sf_dir):
    k = identity.key_faces(_album_faces(spark, sf_dir))
    return k.select("album_id", "variant", "occurrences", F.size("photo_ids").cast("long").alias("photos"), F.col("best.photo_id").alias("best_photo_id"), F.col("first_order").cast("long").alias("first_order"))


@query(""", o as (select photo_id, album_id, row_number() over (partition by album_id order by captured_at nulls first, photo_id) as photo_order from photos0),
  s as (select t.photo_id, t.face_index, album_id, photo_order, 'person-' || (sharpness % 9) || '::' || eye || '::' || focus as variant from tiered t join o using (photo_id)),
  v as (select album_id, variant, count(*) as n, count(distinct photo_id) as np, count(distinct photo_id) filter (photo_id % 5 <> 0) as nl, arg_min(photo_id, photo_order) filter (photo_id % 5 <> 0) as src from s group by 1, 2)
  select v.album_id, v.variant, greatest(1, n - (np - nl)) as occurrences, src as source_photo_id, f.face_index as source_face_index
  from v join (select photo_id, variant, min(face_index) as face_index from s group by 1, 2) f on f.photo_id = src and f.variant = v.variant where nl > 0""")
def keyface_patch(spark, sf_dir):
    f = _album_faces(spark, sf_dir).withColumn("variant", S.variant_id(F.col("cluster"), F.col("eye"), F.col("focus")))
    gone = photos(spark, sf_dir).where("photo_id % 5 = 0").select("album_id", "photo_id")
    return incremental.key_faces_after_delete(identity.key_faces(f, indexes=True), gone).select("album_id", "variant", "occurrences", "source_photo_id", "source_face_index")


@query()
def face_clusters(spark, sf_dir):
    return identity.cluster_faces(_album_faces(spark, sf_dir))


@query()
def key_face_merge(spark, sf_dir):
    k = identity.key_faces(_album_faces(spark, sf_dir), carried=("eye", "focus", "print", "area", "box"))
    best = k.select("album_id", "variant", "photo_ids", "first_order", "first_face", "best.score", "best.eye", "best.focus", "best.print", "best.area", "best.box")
    return identity.merge_key_faces(identity.scenes_of(best, _members(spark, sf_dir)))


# --- merging and storing

_ROWS = "select album_id, photo_id, file_name, case photo_id % 3 when 0 then 'uploaded' when 1 then 'pending' else 'uploading' end as status, case photo_id % 4 when 0 then 'analyzed' when 1 then 'analyzing' else 'idle' end as analysis_status, case photo_id % 5 when 0 then 'uploaded' when 1 then 'uploading' else 'idle' end as server_upload_status, {K} as side from {T}"


def _side(spark, sf_dir, name: str, where: str, shift: int):
    p = photos(spark, sf_dir)
    sql = _ROWS.format(K=f"'{name}'", T="{p}").replace("photo_id %", f"(photo_id + {shift}) %") + f" where {where}"
    return spark.sql(sql, p=p)


_M1 = _ROWS.format(K="'current'", T="photos0") + " where photo_id % 10 <> 7"
_M2 = (_ROWS.format(K="'incoming'", T="photos0")).replace("photo_id %", "(photo_id + 1) %") + " where photo_id % 10 <> 3"


@query(f""", c as ({_M1}), i as ({_M2}), j as (select coalesce(c.album_id, i.album_id) as album_id, coalesce(c.photo_id, i.photo_id) as photo_id, c.side is not null and (i.side is null or
    case when c.server_upload_status = 'uploaded' and i.server_upload_status <> 'uploaded' then true when i.server_upload_status = 'uploaded' and c.server_upload_status <> 'uploaded' then false
      when c.server_upload_status = 'uploading' and i.server_upload_status <> 'uploading' then true when i.server_upload_status = 'uploading' and c.server_upload_status <> 'uploading' then false
      when c.analysis_status = 'analyzing' and i.analysis_status <> 'analyzing' then true when i.analysis_status = 'analyzing' and c.analysis_status <> 'analyzing' then false
      when c.analysis_status = 'analyzed' and i.analysis_status <> 'analyzed' then true when i.analysis_status = 'analyzed' and c.analysis_status <> 'analyzed' then false
      when c.status = 'uploaded' and i.status <> 'uploaded' then true else false end) as ours
  from c full join i on c.album_id = i.album_id and c.photo_id = i.photo_id)
  select album_id, photo_id, case when ours then 'current' else 'incoming' end as side from j""")
def photo_merge_prefer(spark, sf_dir):
    return merge.merged(_side(spark, sf_dir, "current", "photo_id % 10 <> 7", 0), _side(spark, sf_dir, "incoming", "photo_id % 10 <> 3", 1)).select("album_id", "photo_id", "side")


@query(""", d as (select album_id, 'file:///' || file_name as uri, file_name as name, file_size as size from photos0 where photo_id % 6 <> 1), s as (select album_id, 'file:///' || file_name as uri, photo_id, file_name as name, file_size as size, case photo_id % 3 when 0 then 'uploaded' when 1 then 'pending' else 'uploading' end as status from photos0 where photo_id % 6 <> 2)
  select coalesce(d.album_id, s.album_id) as album_id, coalesce(d.uri, s.uri) as uri, coalesce(cast(photo_id as varchar), regexp_replace(coalesce(s.name, d.name), '\\.[^.]*$', '')) as photo_id,
    case when s.uri is null then 'uploaded' when d.uri is not null and status in ('pending', 'uploading') then 'uploaded' else status end as status
  from d full join s on d.album_id = s.album_id and d.uri = s.uri where d.uri is not null or status in ('pending', 'uploading', 'failed')""")
def disk_reconcile(spark, sf_dir):
    p = photos(spark, sf_dir).withColumn("uri", F.concat(F.lit("file:///"), "file_name"))
    disk = p.where("photo_id % 6 <> 1").select("album_id", "uri", F.col("file_name").alias("name"), F.col("file_size").alias("size"))
    store = p.where("photo_id % 6 <> 2").select("album_id", "photo_id", "uri", F.col("file_name").alias("name"), F.col("file_size").alias("size"), F.expr("case photo_id % 3 when 0 then 'uploaded' when 1 then 'pending' else 'uploading' end").alias("status"))
    return merge.reconciled(disk, store).select("album_id", "uri", "photo_id", "status")


@query("select album_id, photo_id, case when photo_id % 3 = 0 then null when photo_id % 2 = 0 then star_rating + 1 else star_rating end as star_rating from photos0 where photo_id % 5 <> 1 and (photo_id % 3 = 0 or photo_id % 2 = 0)")
def server_sync_changes(spark, sf_dir):
    p = photos(spark, sf_dir)
    current = p.withColumn("server_upload_status", F.expr("case photo_id % 5 when 1 then 'uploading' else 'idle' end"))
    server = p.withColumn("star_rating", F.expr("case when photo_id % 3 = 0 then null when photo_id % 2 = 0 then star_rating + 1 else star_rating end"))
    return merge.changed(current, server, ("star_rating",))


@query("select album_id, photo_id, case when photo_id % 4 = 0 then -1 else star_rating end as star_rating from photos0")
def store_upsert(spark, sf_dir):
    p = photos(spark, sf_dir).select("album_id", "photo_id", "star_rating", F.lit(1).alias("updated_at"))
    new = p.where("photo_id % 4 = 0").withColumn("star_rating", F.lit(-1)).withColumn("updated_at", F.lit(2))
    return merge.upsert(p, new, ("album_id", "photo_id"), "updated_at").drop("updated_at")


@query("select event_id, epoch_us(date_trunc('second', ts)) // 1000 as captured_at from events")
def exif_to_millis(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", S.exif_millis(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("captured_at"))


@query("select a.photo_id as a, b.photo_id as b, bit_count(xor(('0x' || substr(a.perceptual_hash, 1, 8))::bigint, ('0x' || substr(b.perceptual_hash, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(a.perceptual_hash, 9, 8))::bigint, ('0x' || substr(b.perceptual_hash, 9, 8))::bigint)) as hamming from photos0 a join photos0 b on a.photo_id < b.photo_id and a.album_id = b.album_id where hamming <= 4")
def hash_neighbours(spark, sf_dir):
    return duplicates.hash_blocks(photos(spark, sf_dir)).select("a", "b", F.col("hamming").cast("int").alias("hamming"))


@query()
def legacy_duplicates(spark, sf_dir):
    return duplicates.greedy_duplicates(photos(spark, sf_dir))


# --- albums

def _placed(rows: DataFrame, name: str) -> DataFrame:
    """Sorted rows with their place, to hold the order against SQL; a list of albums is short."""
    return rows.withColumn("k", F.monotonically_increasing_id()).withColumn(name, F.row_number().over(Window.orderBy("k"))).drop("k")


@query(_ALBUMS + "select album_id, row_number() over (order by updated_at desc, album_id) as place from albums")
def album_ids(spark, sf_dir):
    return _placed(albums.album_ids(_albums(spark, sf_dir)), "place")


@query(_ALBUMS + "select album_id, created_at, row_number() over (order by created_at desc, album_id) as position from albums")
def albums_newest_first(spark, sf_dir):
    return _placed(albums.newest_first(_albums(spark, sf_dir)), "position")


@query(_ALBUMS + "select album_id, case when album_id % 2 = 0 then 'new' else name end as name from albums")
def album_upsert(spark, sf_dir):
    a = _albums(spark, sf_dir)
    new = a.where("album_id % 2 = 0").withColumns({"name": F.lit("new"), "updated_at": F.col("updated_at") + 1})
    return albums.put(a, new.unionByName(a.where("album_id % 3 = 0").withColumns({"name": F.lit("old"), "updated_at": F.col("updated_at") - 1}))).select("album_id", "name")


@query(_ALBUMS + """, t as (select album_id, count(*) as n, sum(file_size) as bytes from photos0 group by 1)
  select album_id, coalesce(name, 'Untitled') as name, created_at, coalesce(link, '') as link, coalesce(completed, false) as completed, coalesce(has_uploads, false) as has_uploads, coalesce(n, total_photos) as total_photos, cast(coalesce(bytes, 0) as bigint) as total_storage
  from albums left join t using (album_id)""")
def album_normalised(spark, sf_dir):
    p = _states(spark, sf_dir).withColumn("uploaded_at", F.lit(None).cast("long"))
    return albums.normalised(_albums(spark, sf_dir), p)[0].drop("updated_at")


@query(_STATES + """select album_id, photo_id, position, cast(0 as bigint) as uploaded_at, case when status = 'uploading' then 'pending' else coalesce(status, 'pending') end as status,
  case when analysis_status in ('pending', 'analyzing') then case when n_faces > 0 then 'analyzed' else 'idle' end else analysis_status end as analysis_status,
  case when server_upload_status = 'uploading' then 'pending' else coalesce(server_upload_status, 'idle') end as server_upload_status from states""")
def photos_normalised(spark, sf_dir):
    p = _states(spark, sf_dir).drop("position").withColumn("uploaded_at", F.lit(None).cast("long"))
    return albums.normalised(_albums(spark, sf_dir), p)[1].select("album_id", "photo_id", "position", "uploaded_at", "status", "analysis_status", "server_upload_status")


@query(_STATES + "select album_id, photo_id, coalesce(status in ('pending', 'uploading'), false) as uploading, analysis_status in ('pending', 'analyzing') as analyzing, coalesce(server_upload_status in ('pending', 'uploading'), false) as sending from states")
def photos_in_flight(spark, sf_dir):
    return albums.in_flight(_states(spark, sf_dir)).select("album_id", "photo_id", "uploading", "analyzing", "sending")


@query(_ALBUMS + "select p.album_id, photo_id, coalesce(has_uploads, false) as disabled from photos0 p left join albums a on a.album_id = p.album_id")
def photos_disabled(spark, sf_dir):
    return albums.disabled(photos(spark, sf_dir), _albums(spark, sf_dir)).select("album_id", "photo_id", "disabled")


@query(_STATES + "select album_id, photo_id, position from states where analysis_status = 'analyzed' and selected")
def selected_photo_ids(spark, sf_dir):
    return albums.selected_ids(_states(spark, sf_dir))


@query("select album_id, photo_id, file_name, selected, ai_selected, maybe, blurred, closed_eyes, false as duplicated, star_rating from flagged")
def culling_photos(spark, sf_dir):
    return albums.culling_photos(flagged(spark, sf_dir))


@query("""select p.album_id, p.photo_id, case when live then star_rating + 10 else star_rating end as star_rating, case when live then cast(photo_id as int) end as position, case when live then 'state' else 'stored' end as source
  from (select *, album_id % 3 <> 0 and photo_id % 4 <> 0 and photo_id % 5 <> 0 as live from photos0) p""")
def stale_state_overlay(spark, sf_dir):
    p = photos(spark, sf_dir).select("album_id", "photo_id", "star_rating")
    state = p.where("photo_id % 4 <> 0").withColumn("star_rating", F.col("star_rating") + 10)
    order = p.where("album_id % 3 <> 0 and photo_id % 5 <> 0").select("album_id", "photo_id", F.col("photo_id").cast("int").alias("position"))
    return albums.overlaid(state, p, order)


_CROPPED = """, o as (select photo_id, album_id, row_number() over (partition by album_id order by captured_at nulls first, photo_id) as photo_order from photos0),
  v as (select album_id, 'person-' || (sharpness % 9) || '::' || eye || '::' || focus as variant, min(photo_order) as first_order from tiered t join o using (photo_id) group by 1, 2)"""


@query(_CROPPED + ", r as (select *, row_number() over (partition by album_id order by first_order, variant) as place from v where first_order % 3 <> 0) select album_id, variant, place from r where place <= 9")
def shown_key_faces(spark, sf_dir):
    k = identity.key_faces(_album_faces(spark, sf_dir)).withColumn("crop_uri", F.when(F.col("first_order") % 3 != 0, "file:///crop"))
    return albums.shown_key_faces(k).select("album_id", "variant", "place")


@query(""", o as (select photo_id, album_id, row_number() over (partition by album_id order by captured_at nulls first, photo_id) as photo_order from photos0),
  f as (select t.*, album_id, photo_order, case when sharpness % 9 > 0 then 'person-' || (sharpness % 9) end as cluster_id from tiered t join o using (photo_id) where photo_id % 4 <> 0 and album_id % 5 <> 0),
  g as (select *, row_number() over (partition by album_id, cluster_id order by photo_order, face_index) as r from f where cluster_id is not null)
  select album_id, cluster_id, list_transform(print, lambda x: round(x, 7) + 0.0e0) as print, round(area, 9) as area from g where r = 1""")
def seeded_clusters(spark, sf_dir):
    f = _album_faces(spark, sf_dir).withColumns({"cluster_id": F.when(F.col("sharpness") % 9 > 0, F.col("cluster")), "analysis_status": F.when(F.col("photo_id") % 4 == 0, "idle").otherwise("analyzed")})
    known = photos(spark, sf_dir).where("album_id % 5 = 0").select("album_id")
    return albums.seeded_clusters(f, known).select("album_id", "cluster_id", F.transform("print", lambda x: F.round(x, 7) + 0.0).alias("print"), r9(F.col("area")).alias("area"))


@query("""select event_id, case event_id % 6 when 0 then cast(5 as bigint) when 1 then epoch_us(date_trunc('second', ts)) // 1000 when 2 then epoch_us(date_trunc('second', ts)) // 1000 when 3 then null
  else epoch_us(date_trunc('second', ts)) // 1000 end as captured_at from events""")
def capture_times(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.col("event_id") % 6)
    exif = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    picker = F.when(F.col("k") == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("k") == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000+00:00"))).when(F.col("k") == 3, "no time")
    tag = lambda k: F.when(F.col("k") == k, exif)
    from_image = S.exif_date(F.when(F.col("k") == 3, "0000:00:00").otherwise(tag(4)), F.lit(""), F.lit(None).cast("string"), exif)
    return e.select("event_id", S.capture_time(F.when(F.col("k") == 0, F.lit(5).cast("long")), picker, from_image).alias("captured_at"))


@query("""select p.photo_id, q.photo_id as other_id, case when q.photo_id % 3 = 0 then 9007199254740991 else bit_count(xor(('0x' || substr(p.perceptual_hash, 1, 8))::bigint, ('0x' || substr(q.perceptual_hash, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(p.perceptual_hash, 9, 8))::bigint, ('0x' || substr(q.perceptual_hash, 9, 8))::bigint)) end as distance
  from photos0 p join photos0 q on q.photo_id = p.photo_id + 1""")
def hash_distance(spark, sf_dir):
    p = photos(spark, sf_dir).select("photo_id", "perceptual_hash")
    short = F.when(F.col("photo_id") % 3 == 0, F.substring("perceptual_hash", 1, 12)).otherwise(F.upper("perceptual_hash"))
    q = p.select((F.col("photo_id") - 1).alias("photo_id"), F.col("photo_id").alias("other_id"), short.alias("h"))
    return p.join(q, "photo_id").select("photo_id", "other_id", S.hash_distance(F.col("perceptual_hash"), F.col("h")).alias("distance"))


# --- detector output and display

@query(_REF + """, d as (select t.*, ref, n, sharpness / 100e0 as score, box_left + box_width / 2 as x, box_top + box_height / 2 as y, box_width / box_height as shape from tiered t join ref using (photo_id) join cnt using (photo_id)),
  j as (select *, (score >= 0.55 and area >= 0.0025) or (score >= 0.70 and area >= 0.0015) or (score >= 0.68 and area >= 0.00045) or not (
      (area < 0.0015 and score < 0.55) or (area < 0.00090 and score < 0.68) or ((shape < 0.48 or shape > 1.75) and score < 0.65)
      or (n >= 3 and area < ref * 0.18 and area < 0.0030 and score < 0.60) or (n >= 8 and area < 0.0018 and score < 0.58)
      or (least(x, 1 - x, y, 1 - y) < 0.06 and area < 0.0035 and score < 0.58) or (area < 0.0060 and score < 0.50)) as keep from d),
  k as (select *, count(*) filter (keep) over (partition by photo_id) as kept from j)
  select photo_id, face_index from k where keep or n <= 1 or kept = 0""")
def detector_filter(spark, sf_dir):
    sets = faces.gather(labelled(spark, sf_dir).withColumn("score", F.col("sharpness") / 100), "score")
    sets = sets.withColumn("ref", faces.reference_area(F.col("faces")))
    return _flat(sets, detector.without_weak(F.col("faces"), F.col("ref")))


@query("""select photo_id, face_index, not (hi <= 0.05 and (left_prob + right_prob) / 2 <= 0.05) as open,
  round(least(99, case when hi <= 0.05 and (left_prob + right_prob) / 2 <= 0.05 then 88 + 11 * greatest(0e0, least(1e0, (0.10e0 - hi) / 0.10e0))
    when lo >= 0.34 or (left_prob + right_prob) / 2 >= 0.28 or (hi >= 0.34 and lo >= 0.18) or hi >= 0.28 or (left_prob + right_prob) / 2 >= 0.16 then 86 + 12 * greatest(0e0, least(1e0, ((left_prob + right_prob) / 2 - 0.18e0) / 0.82e0)) else 74e0 end), 6) as confidence from tiered""")
def eye_probability_state(spark, sf_dir):
    s = detector.eye_state(F.col("left_prob"), F.col("right_prob"))
    return labelled(spark, sf_dir).withColumn("s", s).select("photo_id", "face_index", "s.open", F.round("s.confidence", 6).alias("confidence"))


_PLACES = """, d as (select photo_id, face_index, sharpness / 100e0 as score, box_width * 4000 as w, box_height * 3000 as h, (lx - box_left) / box_width as lx, (ly - box_top) / box_height as ly, (rx - box_left) / box_width as rx, (ry - box_top) / box_height as ry,
    (nx - box_left) / box_width as nx, (ny - box_top) / box_height as ny, (mx - box_left) / box_width - 0.15 as ax, (my - box_top) / box_height as ay, (mx - box_left) / box_width + 0.55 as bx, (my - box_top) / box_height + 0.01 as by_ from tiered),
  v as (select *, lx between -0.15 and 1.15 and ly between -0.15 and 1.15 as l, rx between -0.15 and 1.15 and ry between -0.15 and 1.15 as r, nx between -0.15 and 1.15 and ny between -0.15 and 1.15 as n, ax between -0.15 and 1.15 and ay between -0.15 and 1.15 as a, bx between -0.15 and 1.15 and by_ between -0.15 and 1.15 as b from d),
  e as (select *, coalesce(l, false) as l_, coalesce(r, false) as r_, coalesce(n, false) as n_, coalesce(a, false) or coalesce(b, false) as m_, case when l and r then (ly + ry) / 2 when l then ly when r then ry end as eyes, case when a and b then (ay + by_) / 2 when a then ay when b then by_ end as mouth, abs(lx - rx) as apart from v),
  f as (select *, l_ and r_ and n_ and apart between 0.15 and 0.65 and abs(ly - ry) <= 0.12 and abs(nx - (lx + rx) / 2) <= apart * 0.45 and eyes <= 0.64 and abs(eyes - ny) between 0.08 and 0.5 and case when m_ then eyes + 0.02 <= ny and ny + 0.02 <= mouth and mouth >= 0.32 and abs(ny - mouth) between 0.05 and 0.4 and abs(eyes - mouth) between apart * 0.55 and apart * 2.2 else eyes + 0.1 <= ny end as front,
    n_ and m_ and (l_ or r_) and eyes + 0.1 <= ny and ny + 0.1 <= mouth and abs(eyes - mouth) between 0.12 and 0.7 as side, w / greatest(1, h) as shape from e)
  select photo_id, face_index from f where score >= 0.3 and w >= 12 and h >= 12 and w * h / (4000 * 3000) >= 0.00028
    and ((shape between 0.55 and 1.8 and l_ and r_ and n_ and (score >= 0.78 or coalesce(front, false))) or (shape between 0.35 and 1.8 and (score >= 0.78 or coalesce(side, false))))"""


@query(_PLACES)
def accepted_detections(spark, sf_dir):
    c = F.col
    at = lambda x, y: F.struct((x * 4000).alias("x"), (y * 3000).alias("y"))
    points = {"left_eye": at(c("lx"), c("ly")), "right_eye": at(c("rx"), c("ry")), "nose": at(c("nx"), c("ny")), "left_mouth": at(c("mx") - 0.15 * c("box_width"), c("my")), "right_mouth": at(c("mx") + 0.55 * c("box_width"), c("my") + 0.01 * c("box_height"))}
    box = F.struct((c("box_left") * 4000).alias("left"), (c("box_top") * 3000).alias("top"), (c("box_width") * 4000).alias("width"), (c("box_height") * 3000).alias("height"))
    f = faces_of(spark, sf_dir).select("photo_id", "face_index", (c("sharpness") / 100).alias("score"), box.alias("box"), F.lit(4000).alias("image_width"), F.lit(3000).alias("image_height"), *(v.alias(k) for k, v in points.items()))
    return detector.accepted_faces(f).select("photo_id", "face_index")


@query("""select photo_id, face_index, coalesce(mean >= 0.65 and low >= 0.55, false) as open, round(case when high is null then 50 when mean >= 0.65 and low >= 0.55 then least(98, 86 + (mean - 0.65) * 200) when high <= 0.4 or mean <= 0.35 then least(98, 86 + (0.4 - high) * 400) else 72 end, 6) as confidence
  from (select *, least(a, b) as low, greatest(a, b) as high, (coalesce(a, b) + coalesce(b, a)) / 2 as mean from (select photo_id, face_index, case when sharpness % 7 > 0 then left_prob end as a, case when sharpness % 5 > 0 then right_prob end as b from tiered))""")
def phone_eye_states(spark, sf_dir):
    f = labelled(spark, sf_dir)
    state = detector.phone_eye_state(F.when(F.col("sharpness") % 7 > 0, F.col("left_prob")), F.when(F.col("sharpness") % 5 > 0, F.col("right_prob")))
    return f.withColumn("s", state).select("photo_id", "face_index", "s.open", F.round("s.confidence", 6).alias("confidence"))


@query(_suppression("marks * 1e6 + area * 1e3 + eye_conf", f"{_OVER} >= 0.5", "kept") + " select photo_id, face_index from kept")
def phone_dedupe(spark, sf_dir):
    return _flat(_sets(spark, sf_dir), faces.suppressed(F.col("faces"), score=lambda f: faces.keep_score(f, f["marks"]), overlap=detector.PROFILES["android"]["overlap"]))


@query("select album_id, greatest(count(*), 60) as total, case when sum(file_size) / 1073741824e0 < 1 then printf('%.2f GB', greatest(0.01e0, floor((sum(file_size) / 1073741824e0 * 1024 + 5) / 10) * 0.01e0)) else printf('%.1f GB', sum(file_size) / 1073741824e0) end as size from photos0 group by 1")
def album_cards(spark, sf_dir):
    t = stats.album_totals(photos(spark, sf_dir))
    return t.select("album_id", display.card_total(F.col("photos"), F.lit(60)).alias("total"), display.storage_size(F.col("bytes") / 1024**3).alias("size"))
