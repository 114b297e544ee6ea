"""Face sets of one photo: filters as higher-order functions, greedy suppression as a fold in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .suppression import places

# Fixed values of the filters.
TINY, RELATIVE_TINY, RELATIVE_SHARE, SOFT_AREA, DEFER_RATIO = 0.0004, 0.00075, 0.5, 0.012, 8


def gather(faces: DataFrame, *columns: str) -> DataFrame:
    """photo_id and faces, an array in order of face_index of structs with box and the given columns."""
    return faces.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("face_index", "box", *columns))).alias("faces"))


def reference_area(faces: Column) -> Column:
    """Mean of the upper half of the positive areas, 0 without any."""

    def of(areas: Column) -> Column:
        upper = F.slice(areas, F.floor(F.size(areas) / 2).cast("int") + 1, F.greatest(F.size(areas), F.lit(1)))
        return F.when(F.size(areas) == 0, 0.0).otherwise(F.aggregate(upper, F.lit(0.0), lambda s, x: s + x) / F.size(upper))

    return S.let(F.sort_array(F.filter(F.transform(faces, lambda f: S.area(f["box"])), lambda a: a > 0)), of)


def without_artifacts(faces: Column) -> Column:
    """Drops boxes too small for the photo's other faces, soft specks, and open eyes on a blurred face."""
    many = F.size(faces) >= 2

    def kept(c: Column) -> Column:
        ref, measured = c["ref"], c["m"]

        def judged(f: Column, a: Column, y: Column) -> Column:
            relative = many & (ref > 0) & (a < RELATIVE_TINY) & (a < ref * RELATIVE_SHARE)
            below = F.exists(measured, lambda o: (o["area"] >= ref * 0.85) & (o["y"] + 0.03 < y))
            deferred = (ref / F.greatest(a, F.lit(1e-8)) >= DEFER_RATIO) & below
            speck = many & (f["focus"] == "soft") & (a < SOFT_AREA) & (ref >= SOFT_AREA) & (a < ref * RELATIVE_SHARE)
            return (a >= TINY) & ~(relative & ~deferred) & ~speck & ~((f["eye"] == "open") & (f["focus"] == "blurred"))

        return F.filter(faces, lambda f, k: S.let(F.get(measured, k), lambda m: judged(f, m["area"], m["y"])))

    measure = lambda f: F.struct(S.area(f["box"]).alias("area"), S.centre(f["box"])[1].alias("y"))
    return S.let(F.struct(reference_area(faces).alias("ref"), F.transform(faces, measure).alias("m")), kept)


def without_displayed_media(faces: Column, soft_by_label: bool = True, peer_floor: float = 0.0008, yaw=None) -> Column:
    """Drops faces on posters and screens: soft ones beside, above or at the edge of real ones.

    yaw: a function from face to its yaw, for the rule on faces that look aside; without it that rule is off.
    """

    def measure(f: Column) -> Column:
        x, y = S.centre(f["box"])
        sharp = F.coalesce(f["sharpness"], F.lit(0))
        soft = (sharp < 48) | (f["focus"] == "blurred") if soft_by_label else sharp < 48
        turn = [] if yaw is None else [S.yaw_radians(yaw(f)).alias("turn")]
        return F.struct(f["face_index"].alias("i"), S.area(f["box"]).alias("area"), x.alias("x"), y.alias("y"), soft.alias("soft"), *turn)

    def displayed(f: Column, measured: Column) -> Column:
        a, x, y, soft = (f[c] for c in ("area", "x", "y", "soft"))
        sized = a.between(0.0035, 0.16)
        others = lambda test: F.exists(measured, lambda o: (o["i"] != f["i"]) & test(o, o["area"], o["x"], o["y"]))
        above = others(lambda o, b, ox, oy: (b >= TINY) & (b < a) & (oy > y + 0.04) & (a / F.greatest(b, F.lit(1e-8)) >= 3))
        edge = lambda v: F.abs(v - 0.5)
        beside = others(lambda o, b, ox, oy: (b >= 0.00175) & (a / F.greatest(b, F.lit(1e-8))).between(0.4, 2.5) & (edge(x) >= edge(ox) + 0.2) & (y <= oy + 0.06))
        centred = others(lambda o, b, ox, oy: (b >= peer_floor) & (b < 0.85 * a) & (F.abs(ox - 0.5) < F.abs(x - 0.5)))
        side = (x <= 0.38) | (x >= 0.62)
        second = soft & (F.size(faces) <= 6) & ((x <= 0.32) | (x >= 0.68)) & sized & beside
        turned = F.lit(False)
        if yaw is not None:
            turned = soft & side & (f["turn"] >= 0.4) & others(lambda o, b, ox, oy: (o["turn"] <= 0.35) & (b >= TINY))
        return (sized & above & (soft | (a >= 0.012))) | second | turned | (soft & (a >= 0.015) & side & centred)

    kept = S.let(F.transform(faces, measure), lambda measured: F.filter(faces, lambda f, k: S.let(F.get(measured, k), lambda m: ~displayed(m, measured))))
    return F.when(F.size(faces) < 2, faces).otherwise(kept)


def without_backdrop(faces: Column) -> Column:
    """Drops large faces high in the frame if one stands on stage level; never drops all."""
    stage = F.exists(faces, lambda f: S.centre(f["box"])[1].between(0.45, 0.88))
    kept = F.filter(faces, lambda f: ~((S.area(f["box"]) >= 0.012) & (S.centre(f["box"])[1] < 0.40)))
    return F.when(stage & (F.size(kept) > 0), kept).otherwise(faces)


def post_processed(sets: DataFrame, yaw=None) -> DataFrame:
    """sets (photo_id, faces) without artifacts, displayed media by sharpness alone, and backdrops; face_index is the place in order.

    A step of its own that the usual course leaves out.
    """
    steps = (without_artifacts, lambda f: without_displayed_media(f, soft_by_label=False, peer_floor=TINY, yaw=yaw), without_backdrop, lambda f: F.transform(f, lambda x, k: x.withField("face_index", k.cast("int"))))
    for step in steps:
        sets = sets.withColumn("faces", step(F.col("faces")))
    return sets


def keep_score(f: Column, marks: Column | None = None) -> Column:
    """Landmark kinds, then area, then eye confidence."""
    kinds = F.lit(0) if marks is None else F.size(F.array_distinct(marks))
    return kinds * 1e6 + S.area(f["box"]) * 1e3 + f["eye_conf"]


def suppressed(faces: Column, score=keep_score, values: tuple | None = None, overlap: float | None = None, most: int | None = None) -> Column:
    """Greedy suppression in order of score, then index; survivors in that order. Without a score faces come in the order given.

    A face joins if no survivor makes it redundant. values are those of scalar.redundant; with overlap, plain
    intersection over union decides. Photos are judged in batches; a fold over the ranked places judges those with a
    number that is null or not finite.
    """
    ranks = () if score is None else (F.transform(faces, lambda f: score(f).cast("double")), faces["face_index"])
    kept = places(faces["box"], *ranks, values=values, overlap=overlap, most=most)
    return F.when(kept.isNotNull(), F.transform(kept, lambda k: F.get(faces, k))).otherwise(folded(faces, score, values, overlap, most))


def folded(faces: Column, score, values: tuple | None, overlap: float | None, most: int | None) -> Column:
    """suppressed, photo by photo; scores and measures are worked out once a face."""
    rank = [] if score is None else [("score", score), ("face_index", lambda f: f["face_index"])]
    measured = F.transform(faces, lambda f, k: F.struct(k.alias("k"), S.measures(f["box"]).alias("m"), *(of(f).alias(n) for n, of in rank)))
    if score is not None:
        measured = F.array_sort(measured, lambda a, b: F.when(a["score"] > b["score"] + 1e-9, -1).when(a["score"] < b["score"] - 1e-9, 1).otherwise(a["face_index"] - b["face_index"]))
    ranked = F.transform(F.slice(measured, 1, most) if most else measured, lambda x: F.struct(x["k"].alias("k"), x["m"].alias("m")))
    clash = (lambda a, b: S.overlapping(a, b, overlap)) if overlap is not None else (lambda a, b: S.clashing(a, b, values or S.REDUNDANT))
    fold = lambda kept, f: F.when(F.exists(kept, lambda k: clash(k["m"], f["m"])), kept).otherwise(F.concat(kept, F.array(f)))
    return S.let(ranked, lambda r: F.aggregate(r, F.slice(r, 1, 0), fold, lambda kept: F.transform(kept, lambda x: F.get(faces, x["k"]))))


# Fixed values of the choice of subjects.
PEER_RATIO, SPREAD, PHOTOBOMB, FOREGROUND, FOREGROUND_SHARP = 2.4, 3.25, 3.5, 1.55, 0.8
SHARP_RATIO, RELATIVE_SHARP, SOFT_CEILING, PRINT_YAW, PRINT_SHARP, LEAST_SHARE = 0.48, 0.45, 50, 28, 0.72, 0.35


def _sorted(values: Column) -> Column:
    """In ascending order, nulls last."""
    return S.let(values, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), F.sort_array(v)).otherwise(F.array_sort(v)))


def _median(values: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n == 0, 0.0).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return S.let(_sorted(values), of)


def _of(group: Column, field: str) -> Column:
    return F.transform(group, lambda m: m[field])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dominant(sets: DataFrame, yaw=lambda f: F.lit(0.0)) -> DataFrame:
    """sets (photo_id, faces) with faces cut down to the subjects, in order.

    Faces of like size form groups; the best by total area, number and sharpness is the subjects' unless
    a clear foreground face outdoes it and is no photobomb at the edge. Then faces far off the group, much
    softer than it, or turned and soft as on a print are left out, never most of it. Each step is a
    column of its own, so that no step is worked out again inside the next.
    """

    def measures(f: Column) -> Column:
        b = f["box"]
        x, y = S.centre(b)
        sharp = F.coalesce(f["sharpness"].cast("double"), F.lit(0.0))
        edge = (b["left"] < 0.08) | (b["top"] < 0.06) | (b["left"] + b["width"] > 0.92) | (b["top"] + b["height"] > 0.94) | (x < 0.16) | (x > 0.84)
        return F.struct(f["face_index"].alias("i"), S.area(b).alias("area"), x.alias("x"), y.alias("y"), b["width"].alias("w"), b["height"].alias("h"), sharp.alias("sharp"), yaw(f).alias("yaw"), edge.alias("edge"), (S.area(b) * (0.35 + 0.65 * sharp / 100)).alias("prominence"))

    m = F.col("_m")
    like = lambda a, b: (F.least(a, b) > 1e-12) & (F.greatest(a, b) <= PEER_RATIO * F.least(a, b))
    peers = lambda seed: F.filter(m, lambda o: like(o["area"], seed["area"]))
    score = lambda g: _sum(_of(g, "area")) * F.sqrt(F.size(g)) * (0.5 + 0.5 * _sum(_of(g, "sharp")) / F.greatest(F.size(g), F.lit(1)) / 100)
    df = sets.withColumn("_m", F.transform("faces", measures))
    df = df.withColumn("_groups", F.transform(m, lambda seed: F.struct((-seed["i"]).alias("i"), peers(seed).alias("g"))))
    df = df.withColumn("_ranked", F.transform("_groups", lambda g: F.struct(F.round(score(g["g"]), 12).alias("score"), F.size(g["g"]).alias("n"), g["i"].alias("i"), g["g"].alias("g"))))
    df = df.withColumn("_best", F.array_max("_ranked")["g"]).withColumn("_dense", F.array_max(F.filter("_ranked", lambda r: r["n"] >= 2))["g"])
    df = df.withColumn("_first", F.array_max(F.transform(m, lambda f: F.struct(f["prominence"].alias("p"), (-f["i"]).alias("i"), f.alias("f"))))["f"])
    first, dense = F.col("_first"), F.col("_dense")
    df = df.withColumn("_area", _median(_of(dense, "area"))).withColumn("_sharp", _median(_of(dense, "sharp"))).withColumn("_top", F.array_max(_of(dense, "prominence"))).withColumn("_peers", peers(first))
    large = F.col("_area")
    bomb = (first["area"] >= large * PHOTOBOMB) & first["edge"]
    front = (first["area"] >= large * FOREGROUND) & (first["sharp"] >= F.col("_sharp") * FOREGROUND_SHARP) & (first["sharp"] >= 45)
    winner = (first["prominence"] >= F.col("_top") * 1.2) & (first["area"] >= large * 1.35) & (first["sharp"] >= 45)
    inside = F.exists(dense, lambda f: f["i"] == first["i"])
    df = df.withColumn("_g", F.when(dense.isNull(), F.col("_best")).when(inside | bomb, dense).when(front | winner, F.col("_peers")).otherwise(dense))
    g = F.col("_g")
    df = df.withColumn("_cx", _median(_of(g, "x"))).withColumn("_cy", _median(_of(g, "y"))).withColumn("_w", _median(_of(g, "w"))).withColumn("_h", _median(_of(g, "h")))
    df = df.withColumn("_mx", _median(F.transform(g, lambda f: F.abs(f["x"] - F.col("_cx"))))).withColumn("_my", _median(F.transform(g, lambda f: F.abs(f["y"] - F.col("_cy")))))
    steps = lambda xs: F.zip_with(F.slice(xs, 2, F.greatest(F.size(g) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: a - b)
    df = df.withColumn("_gaps", S.let(_sorted(_of(g, "x")), steps))
    wide = F.greatest(F.col("_mx") * SPREAD, F.col("_w") * 2.5)
    df = df.withColumn("_lx", F.when(F.col("_my") <= F.col("_h") * 0.55, F.greatest(wide, _median(F.col("_gaps")) * 2.75, F.col("_w") * 4)).otherwise(wide)).withColumn("_ly", F.greatest(F.col("_my") * SPREAD, F.col("_h") * 1.75))
    near = F.filter(g, lambda f: (F.abs(f["x"] - F.col("_cx")) <= F.col("_lx")) & (F.abs(f["y"] - F.col("_cy")) <= F.col("_ly")))
    df = df.withColumn("_near", near).withColumn("_g2", F.when((F.size(g) <= 2) | (F.size("_near") == 0), g).otherwise(F.col("_near")))
    few = lambda kept, of: F.size(kept) < F.greatest(F.lit(1), F.ceil(F.size(of) * LEAST_SHARE))
    df = df.withColumn("_sm", _median(_of(F.col("_g2"), "sharp"))).withColumn("_sx", F.array_max(_of(F.col("_g2"), "sharp")))
    faint = lambda f: (f["sharp"] < F.col("_sm") * SHARP_RATIO) | ((F.col("_sx") >= 55) & (f["sharp"] < F.col("_sx") * RELATIVE_SHARP) & (f["sharp"] < SOFT_CEILING))
    df = df.withColumn("_sharper", F.filter("_g2", lambda f: ~faint(f)))
    df = df.withColumn("_g3", F.when((F.size("_g2") < 2) | ((F.col("_sm") < 20) & (F.col("_sx") < 40)) | few("_sharper", "_g2"), F.col("_g2")).otherwise(F.col("_sharper")))
    df = df.withColumn("_pm", _median(_of(F.col("_g3"), "sharp")))
    frontal = F.exists("_g3", lambda f: (F.abs(f["yaw"]) < 18) & (f["sharp"] >= F.col("_pm") * 0.9) & (f["sharp"] >= 50))
    df = df.withColumn("_real", F.filter("_g3", lambda f: ~((F.abs(f["yaw"]) >= PRINT_YAW) & (f["sharp"] < F.col("_pm") * PRINT_SHARP))))
    df = df.withColumn("_ids", _of(F.when((F.size("_g3") < 2) | ~frontal | (F.col("_pm") < 40) | few("_real", "_g3"), F.col("_g3")).otherwise(F.col("_real")), "i"))
    kept = F.filter("faces", lambda f: F.array_contains(F.col("_ids"), f["face_index"]))
    return df.withColumn("_kept", F.when(F.size("faces") <= 1, F.col("faces")).otherwise(kept)).select(*(F.col("_kept").alias(c) if c == "faces" else c for c in sets.columns))


def crowd_partial(faces: DataFrame, budget: int = 5, micro: float = 0.001) -> DataFrame:
    """All faces, those that count as partial in a crowd with eyes_open false, eye_conf 72 and crowd_partial true.

    Two tests of probabilities force a face; then tiny ones follow, the least open and least sure first,
    up to the budget. Faces with a missing or infinite signal are never taken.
    """
    from pyspark.sql import Window

    conf, left, right = (F.col(c).cast("double") for c in ("eye_conf", "left_prob", "right_prob"))
    high, low, value = F.greatest(left, right), F.least(left, right), F.coalesce("eyes_open", F.lit(False))
    finite = F.lit(True)
    for c in (conf, left, right):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    both = value & (conf <= 90) & high.between(0.14, 0.22) & (low >= 0.12) & (F.round(high - low, 9) <= 0.08)
    one = (conf <= 90) & high.between(0.28, 0.42) & (low <= 0.05)
    forced = F.coalesce(finite & (both | one), F.lit(False))
    tiny = F.coalesce(finite & value & (S.area(F.col("box")) < micro) & (conf <= 74) & (high <= 0.06) & (low <= 0.05), F.lit(False))
    f = faces.withColumn("_forced", forced).withColumn("_tiny", tiny & ~F.col("_forced"))
    f = f.withColumn("_n", F.count_if("_forced").over(Window.partitionBy("photo_id")))
    f = f.withColumn("_rank", F.row_number().over(Window.partitionBy("photo_id", "_tiny").orderBy(high, conf, "face_index")))
    taken = F.lit(budget > 0) & (F.col("_forced") | (F.col("_tiny") & (F.col("_rank") <= budget - F.col("_n"))))
    return _with_eyes(f.withColumn("crowd_partial", taken), faces, F.col("crowd_partial"), False).drop("_forced", "_tiny", "_n", "_rank")


def closed_eyes_once(faces: DataFrame, low: float = 0.001, high: float = 0.0025) -> DataFrame:
    """All faces; of a photo's faces of a size from low to below high whose eyes aren't open only the most surely closed stays so.

    The others get eyes_open true and eye_conf 72, and reopened true. Ties go to the smaller face_index.
    """
    from pyspark.sql import Window

    area = S.area(F.col("box"))
    f = faces.withColumn("_closed", F.coalesce(~F.col("eyes_open") & (area >= low) & (area < high), F.lit(False)))
    w = Window.partitionBy("photo_id", "_closed").orderBy(F.greatest("left_prob", "right_prob"), F.desc("eye_conf"), "face_index")
    f = f.withColumn("_rank", F.row_number().over(w)).withColumn("reopened", F.col("_closed") & (F.col("_rank") > 1))
    return _with_eyes(f, faces, F.col("reopened"), True).drop("_closed", "_rank")


def _with_eyes(changed: DataFrame, faces: DataFrame, where: Column, value: bool) -> DataFrame:
    """eyes_open becomes value and eye_conf 72 where the column says so."""
    kind = faces.schema["eye_conf"].dataType
    return changed.withColumn("eyes_open", F.when(where, value).otherwise(F.col("eyes_open"))).withColumn("eye_conf", F.when(where, F.lit(72).cast(kind)).otherwise(F.col("eye_conf")))
