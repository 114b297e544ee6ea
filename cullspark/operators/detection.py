"""Face detection in two passes, with the detector as a parameter: the whole image, then tiles of it where too few faces were found.

A detector is a function of images (a list of arrays of rows, columns, blue-green-red) that gives a list of
detections for each: (score, left, top, width, height) in pixels of the image given, and if it has them five points.
It is called in Arrow batches where the images are. All passes over a batch, with what is redundant between them, are one step of one
Python worker: with a step for each pass a task would hold a worker for each, and images would go in and out of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detector as D
from ..functions import scalar as S
from ..functions.image import pixels_of
from .suppression import kept_places

#: A detection in pixels of the whole image: points are those of detector.POINTS, or none.
DETECTION = "struct<score: double, left: double, top: double, width: double, height: double, points: array<struct<x: double, y: double>>>"

_ARROW = pa.list_(pa.struct([*((c, pa.float64()) for c in ("score", "left", "top", "width", "height")), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))

#: Photos whose detections a worker holds at once.
_TOGETHER = 1000

Detector = Callable[[list[np.ndarray]], list[list[tuple]]]


def constant(detections: list[tuple]) -> Detector:
    """A detector that finds the same in every image, in shares of its sides: a double for tests."""
    def run(images: list[np.ndarray]) -> list[list[tuple]]:
        return [[(s, x * i.shape[1], y * i.shape[0], w * i.shape[1], h * i.shape[0]) for s, x, y, w, h in detections] for i in images]

    return run


class _Found:
    """Detections of a batch's photos, in order of photo: whose they are, score, left, top, width and height, and points."""

    def __init__(self, owner: list[int], flat: list[tuple], points: list):
        self.owner, self.flat, self.points = np.array(owner, np.int64), np.array(flat, float).reshape(-1, 5), points

    def added(self, more: _Found) -> _Found:
        """Each photo's detections, then its further ones."""
        out = _Found([], [], [])
        owner = np.concatenate([self.owner, more.owner])
        order = np.argsort(owner, kind="stable")
        out.owner, out.flat, points = owner[order], np.concatenate([self.flat, more.flat])[order], [*self.points, *more.points]
        out.points = [points[k] for k in order]
        return out

    def once(self, photos: np.ndarray, width: np.ndarray, height: np.ndarray, profile: str) -> _Found:
        """Of the photos told, without those that a better one makes redundant: by score, then area, as the platform judges boxes; on Android in the order found. Others' stay."""
        n = np.bincount(self.owner, minlength=len(photos))
        starts = np.concatenate([[0], np.cumsum(n)])
        score, left, top, wide, high = self.flat.T
        w, h = np.repeat(width, n), np.repeat(height, n)
        with np.errstate(invalid="ignore", over="ignore"):
            given = {"left": left / w, "top": top / h, "width": wide / w, "height": high / h} | ({} if profile == "android" else {"score": score})
            area = wide * high
        overlap = D.PROFILES[profile]["overlap"]
        ends, places = kept_places(n, starts, given, area, photos, None if overlap else S.DETECTOR, overlap)
        kept = np.repeat(starts[:-1], np.diff(ends)) + places
        rest = np.flatnonzero(~photos[self.owner])
        at = np.concatenate([kept, rest])
        at = at[np.argsort(self.owner[at], kind="stable")]
        out = _Found([], [], [])
        out.owner, out.flat, out.points = self.owner[at], self.flat[at], [self.points[k] for k in at]
        return out

    def array(self, seen: np.ndarray) -> pa.Array:
        """An array of DETECTION for each photo, null where it isn't seen."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=len(seen)))])
        fields = [*(pa.array(c) for c in self.flat.T), pa.array(self.points, _ARROW.value_type.field("points").type)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ARROW.value_type)), type=_ARROW, mask=pa.array(~seen))


def _looked_at(detect: Detector, photos: Iterator[tuple]) -> _Found:
    """Detections in parts of photos (place, image, parts), mapped to the whole image."""
    owner, flat, points_ = [], [], []
    for k, image, parts in photos:
        for (x, y, _, _), some in zip(parts, detect([image[y : y + high, x : x + wide] for x, y, wide, high in parts])):
            for score, left, top, wide, high, *points in some:
                owner.append(k)
                flat.append((score, left + x, top + y, wide, high))
                points_.append([{"x": float(p + x), "y": float(q + y)} for p, q in points[0]] or None if points and points[0] is not None else None)
    return _Found(owner, flat, points_)


def detected(images: DataFrame, detect: Detector, profile: str = "desktop", tiling: bool = True, least_pixels: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """images (content of raw pixels, width, height and columns of their own) with found, an array of DETECTION.

    Null where content doesn't fit the sizes. Tiles are 2 x 2, then 3 x 3; each round is added to what was found
    and what is redundant goes, and an image with enough faces isn't looked at again. columns: those of images that are
    wanted, all if not told.
    """
    if "found" in images.columns:
        raise ValueError("images have a column found already")
    wanted = images.columns if columns is None else list(columns)
    sides = (2, 3) if tiling else ()
    inputs = [f"`{c}`" for c in wanted]
    given = images.select(*inputs, F.col("content").alias("_content"), F.col("width").alias("_width"), F.col("height").alias("_height"), *(D.tiles(F.col("width"), F.col("height"), k, profile).alias(f"_tiles{k}") for k in sides))

    names = given.columns[len(wanted) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, _TOGETHER) for b in batches for k in range(0, b.num_rows, _TOGETHER)):
            at = dict(zip(names, batch.columns[len(wanted) :]))
            pixels = [pixels_of(*x) for x in zip(*(at[c].to_pylist() for c in ("_content", "_width", "_height")))]
            seen = np.array([p is not None for p in pixels], bool)
            width, height = (np.array([1 if p is None else p.shape[k] for p in pixels], np.int64) for k in (1, 0))
            found = _looked_at(detect, ((k, p, [(0, 0, p.shape[1], p.shape[0])]) for k, p in enumerate(pixels) if p is not None)).once(seen, width, height, profile)
            for side in sides:
                n, largest = np.bincount(found.owner, minlength=len(pixels)), np.zeros(len(pixels))
                with np.errstate(invalid="ignore", over="ignore"):
                    np.maximum.at(largest, found.owner, found.flat[:, 3] * found.flat[:, 4] / (width * height)[found.owner])
                again = np.flatnonzero(D.tiled(width * height, n, profile, largest, least_pixels) & seen)
                cuts = at[f"_tiles{side}"].take(pa.array(again)).to_pylist()
                more = _looked_at(detect, ((k, pixels[k], [(t["left"], t["top"], t["width"], t["height"]) for t in parts]) for k, parts in zip(again.tolist(), cuts)))
                found = found.added(more).once(np.bincount(more.owner, minlength=len(pixels)) > 0, width, height, profile)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(wanted)], found.array(seen)], [*wanted, "found"])

    schema = images.select(*inputs, F.lit(None).cast(f"array<{DETECTION}>").alias("found")).schema
    return given.mapInArrow(run, schema)
