"""Columns that a grid of photos shows: addresses of derived images, sizes, rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable_thumb(uri: Column) -> Column:
    u = F.translate(uri, "\\", "/")
    return F.coalesce(u.contains("/thumbs/") & u.endswith(".v4.jpg"), F.lit(False))


def usable_detail(uri: Column) -> Column:
    u = F.substring_index(F.translate(uri, "\\", "/"), "?", 1)
    return F.coalesce(u.contains("/details/") & u.endswith(".d1.jpg"), F.lit(False))


def grid_uri(thumb: Column) -> Column:
    return F.when(usable_thumb(thumb), thumb)


def display_uri(uri: Column, thumb: Column) -> Column:
    return F.coalesce(grid_uri(thumb), uri)


def detail_uri(uri: Column, thumb: Column, detail: Column) -> Column:
    return F.when(usable_detail(detail), detail).otherwise(display_uri(uri, thumb))


def card_total(local: Column, synced: Column) -> Column:
    return F.greatest(local, F.coalesce(synced, F.lit(0)))


def storage_size(gigabytes: Column) -> Column:
    """As text: hundredths under a gigabyte, at least 0.01, else tenths."""
    small = F.greatest(F.lit(0.01), F.floor((gigabytes * 1024 + 5) / 10) * 0.01)
    return F.when(gigabytes <= 0, "0.0 GB").when(gigabytes < 1, F.format_string("%.2f GB", small.cast("double"))).otherwise(F.format_string("%.1f GB", gigabytes))


def contained(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Rectangle of an image scaled to fit and centred."""
    scale = F.least(width / image_width, height / image_height)
    w, h = image_width * scale, image_height * scale
    return F.struct(((width - w) / 2).alias("left"), ((height - h) / 2).alias("top"), w.alias("width"), h.alias("height"))


def on_display(box: Column, layout: Column) -> Column:
    """A box of an image in the coordinates of its rectangle."""
    return F.struct((layout["left"] + box["left"] * layout["width"]).alias("left"), (layout["top"] + box["top"] * layout["height"]).alias("top"), (box["width"] * layout["width"]).alias("width"), (box["height"] * layout["height"]).alias("height"))


def visible(position: Column, first: Column, last: Column, total: Column, pad: int = 3) -> Column:
    """Whether a row is near enough to the rows on screen to be loaded."""
    return (position >= F.greatest(F.lit(0), first - pad)) & (position < F.least(total, last + pad + 1))


# Fixed values of the view of a face: padding at the sides, above and below in shares of its box, and how much of the part below counts for the middle; a thumbnail's shape.
SIDE, ABOVE, BELOW, ANCHOR_BELOW = 0.30, 0.30, 0.50, 0.12
THUMBNAIL = 4 / 3


def _placed(scale: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Rectangle of a scaled image, centred."""
    w, h = image_width * scale, image_height * scale
    return F.struct(((width - w) / 2).alias("left"), ((height - h) / 2).alias("top"), w.alias("width"), h.alias("height"))


def covered(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Rectangle of an image scaled to cover all of its place and centred."""
    return _placed(F.greatest(width / image_width, height / image_height), width, height, image_width, image_height)


def thumbnail(width: Column, image_width: Column, image_height: Column) -> Column:
    """Rectangle of an image in an album's thumbnail: upright images whole, others cover it."""
    height = width / THUMBNAIL
    across, down = width / image_width, height / image_height
    scale = F.when(image_height > image_width, F.least(across, down)).otherwise(F.greatest(across, down))
    return _placed(scale, width, height, image_width, image_height)


def face_zoomed(width: Column, height: Column, image_width: Column, image_height: Column, box: Column) -> Column:
    """Rectangle of an image scaled and moved so that a face and its surroundings fill the view, which may go beyond the image."""
    w, h = (F.greatest(box[s] * n, F.lit(1.0)) for s, n in (("width", image_width), ("height", image_height)))
    left, top = box["left"] * image_width - SIDE * w, box["top"] * image_height - ABOVE * h
    wide, high = w * (1 + 2 * SIDE), h * (1 + ABOVE + BELOW)
    scale = F.least(width / wide, height / high)
    x, y = left + wide / 2, top + h * (1 + ABOVE + ANCHOR_BELOW) / 2
    return F.struct((width / 2 - x * scale).alias("left"), (height / 2 - y * scale).alias("top"), (image_width * scale).alias("width"), (image_height * scale).alias("height"))
