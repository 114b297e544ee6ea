"""Column functions of faces, hashes, file names and times; all stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds that results depend on.
EYE_OPEN, EYE_CLOSED = 70, 88
FOCUS_GOOD, FOCUS_SOFT = 65, 40
REDUNDANT_IOU, NESTED_RATIO, NESTED_SHARE, LOOSE_IOU, CENTRE_SHARE = 0.42, 1.8, 0.5, 0.18, 0.48
#: Detector variant of the same five values: IoU, area ratio, contained share, loose IoU, centre distance.
DETECTOR = (0.55, 2.4, 0.70, 0.32, 0.35)
CURRENT_ENGINE = {"desktop": "scrfd-ocec-15", "ios": "macos-vision-1", "android": "fallback-1"}


def eye_status(value: Column, confidence: Column, left: Column, right: Column) -> Column:
    """open, partial or closed; null or NaN confidence is partial, null or NaN probabilities are not looked at."""
    high, low = F.greatest(left, right), F.least(left, right)
    known = left.isNotNull() & right.isNotNull() & ~F.isnan(left) & ~F.isnan(right)
    value = F.coalesce(value, F.lit(False))
    sure_open, sure_closed = confidence >= EYE_OPEN, confidence >= EYE_CLOSED
    shut = F.when(~value & sure_closed, "closed").when(value & sure_open, "open").when(sure_closed, "closed").otherwise("partial")
    plain = F.when(value, F.when(sure_open, "open").otherwise("partial")).when(sure_closed, "closed").otherwise("partial")
    seen = F.when((high <= 0.22) & (low <= 0.18), shut)
    seen = seen.when((high >= 0.45) & (low <= 0.22), F.when(high >= 0.55, "open").otherwise("partial"))
    seen = seen.when((high >= 0.5) & (low >= 0.35), "open")
    seen = seen.when((high <= 0.40) & low.between(0.08, 0.25) & (confidence < EYE_OPEN + 10), "partial")
    return F.when(confidence.isNull() | F.isnan(confidence), "partial").when(known, seen.otherwise(plain)).otherwise(plain)


def focus_level(sharpness: Column) -> Column:
    s = F.coalesce(sharpness, F.lit(0))
    return F.when(s >= FOCUS_GOOD, "good").when(s >= FOCUS_SOFT, "soft").otherwise("blurred")


def face_tier(eye: Column, focus: Column) -> Column:
    """0 for closed or blurred, 2 for open and sharp, else 1."""
    return F.when((eye == "closed") | (focus == "blurred"), 0).when((eye == "open") & (focus == "good"), 2).otherwise(1)


# --- boxes: structs of left, top, width, height


def box(left, top, width, height) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(n) for c, n in ((left, "left"), (top, "top"), (width, "width"), (height, "height"))))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["width"]) * F.greatest(F.lit(0.0), b["height"])


def aspect(b: Column) -> Column:
    return b["width"] / F.greatest(b["height"], F.lit(1e-8))


def centre(b: Column) -> tuple[Column, Column]:
    return b["left"] + b["width"] / 2, b["top"] + b["height"] / 2


def let(value: Column, use) -> Column:
    """use(value), with value worked out once; higher-order functions work out all that a lambda names anew for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    high = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    every = area(a) + area(b) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def measures(b: Column) -> Column:
    """What pairs of boxes are judged by, worked out once a box."""
    x, y = centre(b)
    parts = {"left": b["left"], "top": b["top"], "right": b["left"] + b["width"], "bottom": b["top"] + b["height"], "area": area(b), "x": x, "y": y, "diagonal": F.sqrt(b["width"] * b["width"] + b["height"] * b["height"])}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def _shared(a: Column, b: Column, judge) -> Column:
    """judge(area in common, share of it in both) of two boxes' measures."""
    wide, high = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])

    def of(both: Column) -> Column:
        every = a["area"] + b["area"] - both
        return judge(both, F.when(every > 0, both / every).otherwise(0.0))

    return let(F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high), of)


def overlapping(a: Column, b: Column, least: float) -> Column:
    """Whether intersection over union of two boxes' measures reaches least."""
    return _shared(a, b, lambda both, over: over >= least)


#: Fixed values of redundant: IoU, area ratio, contained share, loose IoU, centre distance.
REDUNDANT = (REDUNDANT_IOU, NESTED_RATIO, NESTED_SHARE, LOOSE_IOU, CENTRE_SHARE)


def redundant(a: Column, b: Column, values: tuple = REDUNDANT) -> Column:
    """Whether two boxes show one face: close overlap, or a much larger box that holds or sits on the smaller."""
    return clashing(measures(a), measures(b), values)


def clashing(a: Column, b: Column, values: tuple = REDUNDANT) -> Column:
    """redundant by two boxes' measures."""
    same, ratio, share, loose, near = values
    small, large = F.least(a["area"], b["area"]), F.greatest(a["area"], b["area"])
    uneven = large / F.greatest(small, F.lit(1e-8)) >= ratio
    apart = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    near_ = apart < near * F.least(a["diagonal"], b["diagonal"])
    return _shared(a, b, lambda both, over: (both > 0) & ((over >= same) | (uneven & ((both / F.greatest(small, F.lit(1e-8)) >= share) | ((over >= loose) & near_)))))


def crop(b: Column, width: Column, height: Column, side: float = 0.3, top: float = 0.3, bottom: float = 0.5) -> Column:
    """Pixel rectangle around a box, padded by shares of its size and held inside the image."""
    x0 = F.round(F.greatest(F.lit(0.0), b["left"] - side * b["width"]) * width)
    y0 = F.round(F.greatest(F.lit(0.0), b["top"] - top * b["height"]) * height)
    x1 = F.round(F.least(F.lit(1.0), b["left"] + b["width"] * (1 + side)) * width)
    y1 = F.round(F.least(F.lit(1.0), b["top"] + b["height"] * (1 + bottom)) * height)
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), F.greatest(F.lit(1), (x1 - x0).cast("int")).alias("w"), F.greatest(F.lit(1), (y1 - y0).cast("int")).alias("h"))


def yaw_radians(yaw: Column) -> Column:
    """Absolute yaw in radians; larger values than a half turn are degrees."""
    y = F.abs(yaw)
    return F.when(y > F.pi() + 0.01, F.radians(y)).otherwise(y)


# --- fingerprints


def _mark(face: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(face["landmarks"], lambda m: m["type"] == kind), F.lit(1))


def fingerprint(face: Column, pose_weight: float = 1.0, identity: bool = False) -> Column:
    """Eight numbers from landmarks in eye-distance units, or a short fallback without both eyes."""
    b, pose = face["boundingBox"], face["pose"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    yaw, pitch = (zero(pose[k]) / 90 * pose_weight for k in ("yaw", "pitch"))

    def of(marks: Column) -> Column:
        left, right, nose, mouth = (marks[k] for k in ("left", "right", "nose", "mouth"))
        dx, dy = right["x"] - left["x"], right["y"] - left["y"]

        def with_eyes(eyes: Column) -> Column:
            unit = F.greatest(eyes["span"], F.lit(1e-6))
            off = lambda p, k: F.when(p.isNull(), 0.0).otherwise((p[k] - eyes[k]) / unit)
            return F.array(aspect(b), eyes["span"] / F.greatest(b["width"], F.lit(1e-6)), off(nose, "x"), off(nose, "y"), off(mouth, "x"), off(mouth, "y"), yaw, pitch)

        full = let(F.struct(F.sqrt(dx * dx + dy * dy).alias("span"), ((left["x"] + right["x"]) / 2).alias("x"), ((left["y"] + right["y"]) / 2).alias("y")), with_eyes)
        short = F.array(aspect(b), yaw, pitch) if identity else F.array(aspect(b), b["left"], b["top"], yaw, pitch)
        return F.when(left.isNull() | right.isNull(), short).otherwise(full)

    return let(F.struct(*(_mark(face, k).alias(n) for n, k in (("left", "eyeLeft"), ("right", "eyeRight"), ("nose", "nose"), ("mouth", "mouth")))), of)


def distance(a: Column, b: Column) -> Column:
    """Root mean square difference over a's length; null where b is shorter, which never matches."""
    squares = F.zip_with(a, F.slice(b, 1, F.size(a)), lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(b) >= F.size(a), F.sqrt(total / F.size(a)))


def faces_similar(a: Column, b: Column, limit: float = 0.06) -> Column:
    """Mean over a's faces of the distance to the nearest of b's, for equally many faces."""
    near = F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: distance(x, y))))
    mean = F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(near)
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & F.coalesce(mean < limit, F.lit(False))


def framings_similar(a: Column, b: Column, max_area: float = 1.85, max_aspect: float = 1.35) -> Column:
    """Boxes of both, ranked by area, agree in size and shape rank by rank."""
    ranked = lambda boxes: F.array_sort(boxes, lambda x, y: F.when(area(x) > area(y), -1).when(area(x) < area(y), 1).otherwise(0))

    def fits(x: Column, y: Column) -> Column:
        small, thin = F.least(area(x), area(y)), F.least(aspect(x), aspect(y))
        return (small > 1e-8) & (thin > 1e-8) & (F.greatest(area(x), area(y)) / small <= max_area) & (F.greatest(aspect(x), aspect(y)) / thin <= max_aspect)

    both = F.size(a) == F.size(b)
    return (F.size(a) > 0) & both & F.when(both, F.forall(F.zip_with(ranked(a), ranked(b), fits), lambda ok: ok)).otherwise(False)


# --- hashes, names, times


def valid_hash(h: Column) -> Column:
    """16 hex digits in lower case, else null."""
    low = F.lower(F.trim(h))
    return F.when(low.rlike("^[0-9a-f]{16}$"), low)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes of 16 hex digits differ; halves keep clear of the sign bit."""
    half = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return reduce(lambda x, y: x + y, (F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)))


def burst_prefix(name: Column) -> Column:
    return F.when(_stem(name).rlike(r"\d$"), F.lower(F.regexp_extract(_stem(name), r"^(.*?)(\d+)$", 1)))


def burst_index(name: Column) -> Column:
    return F.when(_stem(name).rlike(r"\d$"), F.regexp_extract(_stem(name), r"(\d+)$", 1).try_cast("decimal(38,0)"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


#: Order of names: letters by their base, whatever their case and accents.
NAMES = "UNICODE_CI_AI"


def natural_key(name: Column) -> Column:
    """Sorts without regard to case and accents and with runs of digits as numbers of any length: a run is led by how many digits it has.

    The length has four places, and a zero before it keeps runs in the place of digits among other signs. The key is
    compared by the collation NAMES, so it is for sorting; names that differ in case or accents alone are equal.
    """
    parts = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(\d+|\D+)"), 1)

    def number(x: Column) -> Column:
        plain = F.regexp_replace(x, r"^0+(?=\d)", "")
        return F.concat(F.lit("0"), F.lpad(F.length(plain).cast("string"), 4, "0"), plain)

    return F.collate(F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x)), ""), NAMES)


def exif_millis(text: Column, zone: str = "UTC") -> Column:
    """Milliseconds of "yyyy:MM:dd HH:mm:ss", or null; days beyond a month's end roll over. Desktops read it as UTC, phones in their zone."""
    pattern = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})"
    part = [F.regexp_extract(text, pattern, k).try_cast("int") for k in range(1, 7)]
    year, month, day, hour, minute, second = part
    fine = text.rlike(pattern) & (year >= 1970) & month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    date = F.date_add(F.make_date(year, F.when(month.between(1, 12), month), F.lit(1)), day - 1)
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + hour * 3600 + minute * 60 + second
    return F.when(fine, (seconds if zone == "UTC" else F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(seconds), zone))) * 1000)


def iso_millis(text: Column) -> Column:
    """Milliseconds of an ISO time, UTC where it names no zone, or null."""
    zoned = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    full = F.when(zoned | ~text.contains("T"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(full))


def exif_date(original: Column, digitized: Column, date: Column, tiff: Column) -> Column:
    """Milliseconds of the first of four tags that isn't empty; a tag that is no time gives null, and the next isn't asked."""
    first = F.coalesce(*(F.nullif(c, F.lit("")) for c in (original, digitized, date, tiff)))
    return exif_millis(first)


def capture_time(known: Column, picker: Column, exif: Column) -> Column:
    """What is known stays, else the picker's ISO time, else the image's."""
    return F.coalesce(known, iso_millis(picker), exif)


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes in hex of any one length; hashes of unequal lengths are 2 ** 53 - 1 apart."""
    digits = lambda h: F.transform(F.split(F.lower(h), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    bits = F.zip_with(digits(a), digits(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.length(a) != F.length(b), F.lit((1 << 53) - 1)).otherwise(F.aggregate(bits, F.lit(0), lambda s, x: s + x).cast("long"))


def supported_format(name: Column, kind: Column) -> Column:
    """Not WebP, by extension or type."""
    return (F.lower(F.substring_index(name, ".", -1)) != "webp") & ~F.coalesce(F.lower(F.trim(kind)).isin("image/webp", "public.webp"), F.lit(False))


def photo_id_of_file(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def needs_reanalysis(version: Column, profile: str = "desktop") -> Column:
    return F.coalesce(version, F.lit("")) != CURRENT_ENGINE[profile]


def variant_id(cluster: Column, eye: Column, focus: Column) -> Column:
    return F.concat_ws("::", cluster, eye, focus)


def parse_variant(text: Column) -> Column:
    """Cluster, eye and focus of a variant id of exactly three valid parts, else null."""
    p = F.split(text, "::")
    fine = (F.size(p) == 3) & (p[0] != "") & p[1].isin("open", "partial", "closed") & p[2].isin("good", "soft", "blurred")
    return F.when(fine, F.struct(p[0].alias("cluster"), p[1].alias("eye"), p[2].alias("focus")))


def backoff_bound(attempt: Column, base: int = 500, cap: int = 8000) -> Column:
    """Largest wait in milliseconds before a retry."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2), attempt)).cast("long")


# --- flags and filters


def flag_matches(key: str) -> Column:
    """A photo under a filter key: duplicates only show under duplicated."""
    return F.col("duplicated") if key == "duplicated" else F.col(key) & ~F.col("duplicated")


def grid_matches(selection: str | None = None, stars: tuple[int, ...] = (), keys: tuple[str, ...] = ()) -> Column:
    """Selection and stars, and any of the active keys."""
    chosen = {"selected": F.col("selected"), "unselected": ~F.col("selected"), None: F.lit(True)}[selection]
    rated = F.coalesce("star_rating", F.lit(0)).isin(*stars) if stars else F.lit(True)
    return chosen & rated & (reduce(lambda a, b: a | b, map(flag_matches, keys)) if keys else F.lit(True))


def native_face(face: Column, photo_id: Column, index: Column) -> Column:
    """A detector's face as the engine holds it: its own labels if they are valid, else ours, and defaults."""
    eyes, sharp = face["eyesOpen"], F.coalesce(face["sharpness"], F.lit(0.0))
    eye = F.when(face["eyeStatus"].isin("open", "closed", "partial"), face["eyeStatus"]).otherwise(eye_status(eyes["value"], eyes["confidence"], eyes["left"], eyes["right"]))
    focus = F.when(face["focusLevel"].isin("good", "soft", "blurred"), face["focusLevel"]).otherwise(focus_level(sharp))
    return F.struct(face["boundingBox"].alias("boundingBox"), eye.alias("eyeStatus"), F.coalesce(eyes["confidence"], F.lit(0.0)).alias("eyeConfidence"), focus.alias("focusLevel"), sharp.alias("sharpness"), F.coalesce(face["brightness"], F.lit(0.0)).alias("brightness"), F.concat_ws("-", photo_id, index).alias("clusterId"))


def eye_label(eye: Column) -> Column:
    return F.when(eye == "closed", "Closed Eyes").when(eye == "partial", "Partial Eyes").otherwise("Open Eyes")


def focus_label(focus: Column) -> Column:
    return F.when(focus == "blurred", "Blurred").when(focus == "soft", "Soft Focus").otherwise("Good Focus")


def status_colour(status: Column) -> Column:
    """good, warning or bad for an eye or focus status."""
    return F.when(status.isin("closed", "blurred"), "bad").when(status.isin("partial", "soft"), "warning").otherwise("good")
