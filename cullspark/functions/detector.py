"""What follows a face detector and an eye classifier: their outputs are columns, the decisions expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalar as S

# Eye probabilities, least face size in pixels and as a share of the image.
OPEN, SOFT_OPEN, CLOSED, CLOSED_SPAN = 0.34, 0.18, 0.05, 0.10
MEAN_OPEN, ONE_EYE_OPEN, MEAN_FLOOR = 0.28, 0.28, 0.16
LEAST_PIXELS, LEAST_SHARE = 12, 0.00028


def _held(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def yaw(left_eye_x: Column, right_eye_x: Column, nose_x: Column) -> Column:
    """Radians from how far the nose lies off the middle of the eyes, 45 degrees at most."""
    span = F.greatest(F.lit(1.0), F.abs(right_eye_x - left_eye_x))
    return F.radians(_held((nose_x - (left_eye_x + right_eye_x) / 2) / span * 35, -45.0, 45.0))


def pitch(top: Column, bottom: Column, eyes_y: Column, mouth_y: Column) -> Column:
    """Looking down where the eyes lie low in the box or the mouth above them, in radians; else 0."""
    low = (eyes_y - top) / F.greatest(F.lit(1.0), bottom - top)
    return F.when((low > 0.42) & (low < 0.68), -0.18).when(mouth_y <= eyes_y, -0.20).otherwise(0.0)


def accepted(score: Column, width: Column, height: Column, image_width: Column, image_height: Column, least_score: float) -> Column:
    """Base check of a detection: score, pixels, share of the image."""
    return (score >= least_score) & (width >= LEAST_PIXELS) & (height >= LEAST_PIXELS) & (width * height / (image_width * image_height) >= LEAST_SHARE)


def eye_state(left: Column, right: Column) -> Column:
    """open and confidence from two open probabilities: closed only if both are next to nothing."""
    left, right = _held(left, 0.0, 1.0), _held(right, 0.0, 1.0)
    low, high, mean = F.least(left, right), F.greatest(left, right), (left + right) / 2
    closed = (high <= CLOSED) & (mean <= CLOSED)
    clear = (low >= OPEN) | (mean >= MEAN_OPEN) | ((high >= OPEN) & (low >= SOFT_OPEN)) | (high >= ONE_EYE_OPEN) | (mean >= MEAN_FLOOR)
    sure = F.when(closed, 88 + 11 * _held((CLOSED_SPAN - high) / CLOSED_SPAN, 0.0, 1.0)).when(clear, 86 + 12 * _held((mean - SOFT_OPEN) / (1 - SOFT_OPEN), 0.0, 1.0)).otherwise(74.0)
    return F.struct((~closed).alias("open"), _held(sure, 0.0, 99.0).alias("confidence"))


def eye_override(state: Column, left: Column, right: Column, area: Column) -> Column:
    """eye_state corrected by the face's size: tiny closed faces open, large hesitant open ones close."""
    high, low = F.greatest(left, right), F.least(left, right)
    lifted = ~state["open"] & ((area < 0.00085) | ((area < 0.0018) & ~((high <= 0.12) & (low <= 0.10)) & (high >= 0.20)))
    is_open, sure = state["open"] | lifted, F.when(lifted, 72.0).otherwise(state["confidence"])
    unsure = is_open & (sure <= 76)
    large = unsure & (area >= 0.015) & (high <= 0.12) & (low <= 0.10)
    middle = unsure & (area >= 0.0018) & (area < 0.0040) & (high > 0.12) & (high <= 0.19) & (low <= 0.05)
    return F.struct((is_open & ~large & ~middle).alias("open"), F.when(large, 95.0).when(middle, 90.0).otherwise(sure).alias("confidence"))


def ear_state(ratio: Column) -> Column:
    """open, closed or unknown from the height of an eye's contour over its width."""
    return F.when(ratio >= 0.22, "open").when(ratio <= 0.16, "closed").otherwise("unknown")


#: Places of the eyes' contours among the 106 points of a face, and heights over widths that are open and closed.
LEFT_CONTOUR, RIGHT_CONTOUR = tuple(range(33, 43)), tuple(range(87, 97))
OPEN_RATIO, CLOSED_RATIO, HALF_OPEN = 0.22, 0.16, 0.45


def _mean(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Means of rows' values where they count, added in order."""
    total = np.zeros(len(values))
    for k in range(values.shape[1]):
        total = np.where(where[:, k], total + values[:, k], total)
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / where.sum(axis=1)


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Height over width of contours (rows of x and y): between the means of their upper and lower half."""
    with np.errstate(invalid="ignore"):
        middle = _mean(y, np.ones(y.shape, bool))[:, None]
        return np.abs(_mean(y, y >= middle) - _mean(y, y <= middle)) / np.maximum(1e-3, x.max(axis=1) - x.min(axis=1))


def contour_ratio(points: Column, *contours: tuple[int, ...]) -> Column:
    """Mean of heights over widths of contours, given by the places of their points (structs of x and y in pixels of the eye's input).

    Null where one of the points is missing. Faces are judged in Arrow batches.
    """

    def run(faces: pa.Array) -> pa.Array:
        starts, n = faces.offsets.to_numpy()[:-1], np.diff(faces.offsets.to_numpy())
        values = faces.values
        known = ~faces.is_null().to_numpy(zero_copy_only=False) & (n > max(map(max, contours)))
        rows = np.flatnonzero(known)
        sides = {}
        for c in "xy":
            of = values.field(c).cast(pa.float64())
            there = [x.is_valid().to_numpy(zero_copy_only=False) for x in (of, values)]
            sides[c] = of.fill_null(0.0).to_numpy(zero_copy_only=False), there[0] & there[1]
        out, seen = np.zeros(len(faces)), known.copy()
        for places in contours:
            at = starts[rows, None] + np.array(places)
            out[rows] += _ratio(sides["x"][0][at], sides["y"][0][at])
            seen[rows] &= (sides["x"][1][at] & sides["y"][1][at]).all(axis=1)
        return pa.array(out / len(contours), mask=~seen)

    run.__annotations__ = {"faces": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(points)


def contour_eyes(points: Column) -> Column:
    """ratio, probability, open and confidence from the contours of both eyes; all null where a point is missing."""
    ratio = contour_ratio(points, LEFT_CONTOUR, RIGHT_CONTOUR)

    def judged(r: Column) -> Column:
        p = _held((r - CLOSED_RATIO) / (OPEN_RATIO - CLOSED_RATIO), 0.0, 1.0)
        wide, shut = r >= OPEN_RATIO, r <= CLOSED_RATIO
        sure = F.when(wide, _held(55 + p * 40, 55.0, 95.0)).when(shut, _held(55 + (1 - p) * 40, 55.0, 95.0)).otherwise(48 + F.abs(p - 0.5) * 20)
        known = lambda c: F.when(r.isNotNull(), c)
        return F.struct(r.alias("ratio"), known(p).alias("probability"), known(wide | (~shut & (p >= HALF_OPEN))).alias("open"), known(sure).alias("confidence"))

    return judged(ratio)


def without_weak(faces: Column, reference: Column) -> Column:
    """Drops weak detections of a photo by score, size, shape and place; a photo's only face stays, and never all go.

    faces: structs with box and score. reference: mean area of the larger half.
    """
    n = F.size(faces)

    def keep(f: Column) -> Column:
        b, score, area = f["box"], f["score"], S.area(f["box"])
        x, y = S.centre(b)
        edge = F.least(x, 1 - x, y, 1 - y)
        shape = F.when(b["height"] > 1e-6, b["width"] / b["height"]).otherwise(0.0)
        strong = ((score >= 0.55) & (area >= 0.0025)) | ((score >= 0.70) & (area >= 0.0015)) | ((score >= 0.68) & (area >= 0.00045))
        speck = ((area < 0.0015) & (score < 0.55)) | ((area < 0.00090) & (score < 0.68))
        odd = ((shape < 0.48) | (shape > 1.75)) & (score < 0.65)
        relative = (n >= 3) & (reference > 0) & (area < reference * 0.18) & (area < 0.0030) & (score < 0.60)
        crowd = (n >= 8) & (area < 0.0018) & (score < 0.58)
        strip = (edge < 0.06) & (area < 0.0035) & (score < 0.58)
        return strong | ~(speck | odd | relative | crowd | strip | ((area < 0.0060) & (score < 0.50)))

    kept = F.filter(faces, keep)
    return F.when((n <= 1) | (F.size(kept) == 0), faces).otherwise(kept)


# --- platform profiles

#: Fixed values by platform: least box side in pixels and share of the image, overlap of one face's boxes alone or all five tests,
#: and tiles of a second pass: their overlap, least pixels of an image, and faces from which it isn't needed.
PROFILES = {
    "desktop": {"pixels": 12, "share": 0.00028, "overlap": None, "tiles": (0.35, 400_000, 3)},
    "ios": {"pixels": 12, "share": 0.00028, "overlap": 0.50, "tiles": (0.25, 2_000_000, 8)},
    "android": {"pixels": 30, "share": 0.0003, "overlap": 0.50, "tiles": (0.25, 2_000_000, 8)},
}
#: Fixed values of the eye rule on phones without a classifier of their own.
PHONE_OPEN, PHONE_OPEN_LEAST, PHONE_CLOSED, PHONE_CLOSED_MEAN = 0.65, 0.55, 0.40, 0.35


def phone_eye_state(left: Column, right: Column) -> Column:
    """open and confidence from one or two open probabilities; without any, closed with 50."""
    low, high = F.least(left, right), F.greatest(left, right)
    mean = (F.coalesce(left, right) + F.coalesce(right, left)) / 2
    is_open = (mean >= PHONE_OPEN) & (low >= PHONE_OPEN_LEAST)
    shut = (high <= PHONE_CLOSED) | (mean <= PHONE_CLOSED_MEAN)
    sure = F.when(high.isNull(), 50.0).when(is_open, F.least(F.lit(98.0), 86 + (mean - PHONE_OPEN) * 200)).when(shut, F.least(F.lit(98.0), 86 + (PHONE_CLOSED - high) * 400)).otherwise(72.0)
    return F.struct(F.coalesce(is_open, F.lit(False)).alias("open"), sure.alias("confidence"))


#: Fixed values of the desktop's rule: the largest face from which tiles add nothing, and the one from which a pair doesn't need them.
SUBJECT_AREA, PAIR_AREA = 0.0040, 0.0009


def tiled(pixels: Column, faces: Column, profile: str = "desktop", largest: Column | None = None, least_pixels: int | None = None) -> Column:
    """Whether an image is looked at again in tiles: large enough, and too few faces found, whose largest (as a share of the image) is small."""
    _, least, enough = PROFILES[profile]["tiles"]
    least = least if least_pixels is None else least_pixels
    need = (pixels >= least) & (faces < enough)
    if profile == "desktop" and largest is not None:
        need = need & ((faces == 0) | ((largest < SUBJECT_AREA) & ~((largest >= PAIR_AREA) & (faces >= 2))))
    return need


def tiles(width: Column, height: Column, side: int, profile: str = "desktop") -> Column:
    """side x side overlapping tiles of an image in pixels, row by row: structs of left, top, width, height.

    A tile is larger than its cell by the overlap; those that would stick out are moved in.
    """
    over, whole = 1 + PROFILES[profile]["tiles"][0], profile != "desktop"

    def spans(length: Column) -> Column:
        tile = F.least(length.cast("double"), (length / side * over).cast("double"))
        tile = F.floor(tile) if whole else tile
        step = F.floor(length / side) if whole else length / side
        begin = lambda k: F.floor(F.when(k * step + tile > length, F.greatest(F.lit(0.0), length - tile)).otherwise(k * step)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.struct(begin(k).alias("at"), F.greatest(F.lit(1), F.least(length - begin(k), F.ceil(tile))).cast("int").alias("size")))

    return F.flatten(F.transform(spans(height), lambda y: F.transform(spans(width), lambda x: F.struct(x["at"].alias("left"), y["at"].alias("top"), x["size"].alias("width"), y["size"].alias("height")))))


# --- acceptance of detections by their five points

# Shapes, and where points of a face may lie in units of its box.
FRONTAL_SHAPE, PROFILE_SHAPE, PLAIN_SCORE = (0.55, 1.8), (0.35, 1.8), 0.78
MARGIN, EYES_APART, EYES_LEVEL, NOSE_OFF = 0.15, (0.15, 0.65), 0.12, 0.45


def _both(a: Column, b: Column) -> Column:
    """The mean of two numbers, or the one that isn't null."""
    return (F.coalesce(a, b) + F.coalesce(b, a)) / 2


POINTS = ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")


_let = S.let


def accepted_faces(detections: DataFrame, least_score: float = 0.3, layout: bool = True, profile: str = "desktop") -> DataFrame:
    """The detections that are faces, seen from the front or the side.

    detections: score, box (struct of left, top, width, height in pixels), image_width, image_height and the
    five POINTS as structs of x and y in pixels; null ones, and those off the box by more than MARGIN of it,
    count as unseen. With layout, eyes, nose and mouth must lie as in a face, unless the score is high.
    """
    limits = PROFILES[profile]
    box, score = F.col("box"), F.col("score")
    w, h = box["width"], box["height"]
    base = (score >= least_score) & (w >= limits["pixels"]) & (h >= limits["pixels"]) & (w * h / (F.col("image_width") * F.col("image_height")) >= limits["share"])
    inside = lambda v: v.between(-MARGIN, 1 + MARGIN)
    local = lambda n: _let(F.struct(((F.col(n)["x"] - box["left"]) / w).alias("x"), ((F.col(n)["y"] - box["top"]) / h).alias("y")), lambda p: F.when(inside(p["x"]) & inside(p["y"]), p))

    def measured(p: Column) -> Column:
        one, two = p["left_eye"], p["right_eye"]
        return F.struct(F.abs(one["x"] - two["x"]).alias("apart"), F.abs(one["y"] - two["y"]).alias("tilt"), F.abs(p["nose"]["x"] - (one["x"] + two["x"]) / 2).alias("off"), _both(one["y"], two["y"]).alias("eyes"), p["nose"]["y"].alias("nose"), _both(p["left_mouth"]["y"], p["right_mouth"]["y"]).alias("mouth"))

    def judged(m: Column) -> Column:
        eyes, nose, mouth, apart = m["eyes"], m["nose"], m["mouth"], m["apart"]
        down = F.when(mouth.isNotNull(), (eyes + 0.02 <= nose) & (nose + 0.02 <= mouth) & (mouth >= 0.32) & F.abs(nose - mouth).between(0.05, 0.40) & F.abs(eyes - mouth).between(apart * 0.55, apart * 2.20)).otherwise(eyes + 0.10 <= nose)
        front = apart.between(*EYES_APART) & (m["tilt"] <= EYES_LEVEL) & (m["off"] <= apart * NOSE_OFF) & down & (eyes <= 0.64) & F.abs(eyes - nose).between(0.08, 0.50)
        side = (eyes + 0.10 <= nose) & (nose + 0.10 <= mouth) & F.abs(eyes - mouth).between(0.12, 0.70)
        plain, shape = F.lit(not layout) | (score >= PLAIN_SCORE), w / F.greatest(F.lit(1.0), h)
        frontal = shape.between(*FRONTAL_SHAPE) & apart.isNotNull() & nose.isNotNull() & (plain | F.coalesce(front, F.lit(False))) & (score >= 0.12)
        return frontal | (shape.between(*PROFILE_SHAPE) & (plain | F.coalesce(side, F.lit(False))) & (score >= 0.10))

    places = F.struct(*(local(n).alias(n) for n in POINTS))
    return detections.where(base & _let(places, lambda p: _let(measured(p), judged)))
