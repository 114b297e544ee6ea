"""Hashes and sharpness of decoded images, in Arrow batches, with one family of resamplers over raw pixel arrays.

Images are rows, columns, blue-green-red, 8 bits each, as a binary column of width * height * 3 bytes. What is read
of an image, and how, differs by platform: see SOURCES and SHARPNESS. Only a photo's own pixels are in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of blue, green and red, in the order in which they are added.
BLUE, GREEN, RED = 0.114, 0.587, 0.299

#: Fixed values by platform: what a hash is taken of (cap: long side of the image at most; thumbnail: of a smaller
#: mean of areas; halved: of means of k x k pixels, k a power of two, while the short side has 256), and how its 9 x 8 samples are taken.
SOURCES = {
    "desktop": {"cap": 4096, "samples": "point"},
    "ios": {"thumbnail": 256, "samples": "area"},
    "android": {"halved": 256, "samples": "bilinear"},
}
#: Fixed values by platform: share of a box left out at each side, base of the logarithm, score of a box too small to judge;
#: side of the square that larger boxes are resampled to, or the longest side that isn't; and for small boxes
#: (pixels below the first number) a score that is trusted by the last number only, the rest being the middle one.
SHARPNESS = {
    "desktop": {"inset": 0.24, "base": 50_000, "unknown": 30.0, "square": 32, "small": (20 * 14, 48.0, 0.40)},
    "vision": {"inset": 0.0, "base": 1_000, "unknown": 30.0},
    "android": {"inset": 0.0, "base": 1_000, "unknown": 50.0, "longest": 128},
}


def luma(pixels: np.ndarray) -> np.ndarray:
    """Brightness of pixels, not rounded."""
    return pixels[..., 0] * BLUE + pixels[..., 1] * GREEN + pixels[..., 2] * RED


def oriented(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """An image the right way up, from the tag's values 1 to 8; others change nothing."""
    o = orientation if orientation in range(1, 9) else 1
    if o >= 5:
        pixels = pixels.swapaxes(0, 1)
    rows = {1: 1, 2: 1, 3: -1, 4: -1, 5: 1, 6: 1, 7: -1, 8: -1}[o]
    columns = {1: 1, 2: -1, 3: -1, 4: 1, 5: 1, 6: -1, 7: -1, 8: 1}[o]
    return pixels[::rows, ::columns]


def fitted_size(width: int, height: int, most: int) -> tuple[int, int]:
    """Sides of an image whose long side is most at most; halves are rounded up, a side has a pixel at least."""
    if max(width, height) <= most:
        return width, height
    scale = most / max(width, height)
    return tuple(max(1, int(np.floor(x * scale + 0.5))) for x in (width, height))


def centres(n: int, size: int) -> np.ndarray:
    """Places of n samples over size pixels, at the middle of equal cells."""
    return (np.arange(n) + 0.5) * size / n - 0.5


def point(plane: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest pixels to rows y and columns x, those of the edge beyond it."""
    at = lambda v, n: np.clip(np.floor(v + 0.5).astype(int), 0, n - 1)
    return plane[np.ix_(at(y, plane.shape[0]), at(x, plane.shape[1]))]


def bilinear(plane: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Between the four pixels about rows y and columns x, those of the edge beyond it."""
    def around(v, n):
        v = np.clip(v, 0.0, n - 1.0)
        low = np.floor(v).astype(int)
        return low, np.minimum(n - 1, low + 1), v - low

    (y0, y1, ty), (x0, x1, tx) = around(y, plane.shape[0]), around(x, plane.shape[1])
    tx = tx.reshape(-1, *[1] * (plane.ndim - 2))
    at = lambda i, j: plane[np.ix_(i, j)]
    upper, lower = at(y0, x0) + (at(y0, x1) - at(y0, x0)) * tx, at(y1, x0) + (at(y1, x1) - at(y1, x0)) * tx
    return upper + (lower - upper) * ty.reshape(-1, *[1] * (plane.ndim - 1))


def area_mean(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal cells; a pixel on a border counts in each cell by its share."""
    def shares(n, size):
        low, high = np.arange(n)[:, None] * size / n, (np.arange(n)[:, None] + 1) * size / n
        at = np.arange(size)[None, :]
        cover = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    rows = np.tensordot(shares(height, plane.shape[0]), plane, axes=(1, 0))
    return np.moveaxis(np.tensordot(shares(width, plane.shape[1]), rows, axes=(1, 1)), 0, 1)


def _seen(pixels: np.ndarray, profile: str) -> np.ndarray:
    """The image that a platform hashes."""
    how = SOURCES[profile]
    high, wide = pixels.shape[:2]
    if "cap" in how and max(high, wide) > how["cap"]:
        w, h = fitted_size(wide, high, how["cap"])
        return np.floor(bilinear(pixels.astype(float), centres(h, high), centres(w, wide)) + 0.5)
    if "thumbnail" in how and max(high, wide) > how["thumbnail"]:
        w, h = fitted_size(wide, high, how["thumbnail"])
        return area_mean(pixels.astype(float), h, w)
    if "halved" in how:
        k = 1 << max(1, min(high, wide) // how["halved"]).bit_length() - 1
        return area_mean(pixels.astype(float), max(1, high // k), max(1, wide // k)) if k > 1 else pixels
    return pixels


def dhash(pixels: np.ndarray, profile: str = "desktop", orientation: int | None = 1) -> str:
    """64-bit difference hash of an image: 9 x 8 samples, left brighter than right, as 16 hex digits."""
    return dhashes(pixels[:, :, None], profile, orientation)[0]


def dhashes(pixels: np.ndarray, profile: str = "desktop", orientation: int | None = 1) -> list[str]:
    """dhash of images of one size: rows, columns, images, blue-green-red."""
    seen = _seen(oriented(pixels, orientation), profile)
    high, wide = seen.shape[:2]
    if SOURCES[profile]["samples"] == "point":
        gray = luma(point(seen, centres(8, high), centres(9, wide)))
    elif SOURCES[profile]["samples"] == "area":
        gray = area_mean(luma(seen), 8, 9) + 1e-9
    else:
        gray = luma(np.floor(bilinear(seen.astype(float), centres(8, high), centres(9, wide)) + 0.5))
    gray = gray.astype(np.uint8)
    bits = (gray[:, :-1] > gray[:, 1:]).reshape(64, -1)
    return [x.tobytes().hex() for x in np.packbits(bits, axis=0).T]


def _spread(gray: np.ndarray, base: float) -> np.ndarray:
    """0 to 100 from the variance of the Laplacian, for an image or for each of rows, columns, images."""
    lap = 4.0 * gray[1:-1, 1:-1] - gray[:-2, 1:-1] - gray[2:, 1:-1] - gray[1:-1, :-2] - gray[1:-1, 2:]
    variance = np.maximum(0.0, (lap * lap).mean(axis=(0, 1)) - lap.mean(axis=(0, 1)) ** 2)
    return np.clip(np.log(variance + 1) / np.log(base) * 100, 0, 100)


def _rounded(x: float) -> int:
    return int(np.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def sharpness(gray: np.ndarray, box: tuple[float, float, float, float] | None = None, profile: str = "desktop") -> float | np.ndarray:
    """0 to 100 for a face's box (left, top, width, height in pixels) of an image's brightness; without a box all of it.

    For images of one size (rows, columns, images) a score of each, or the one number that all have.
    """
    how = SHARPNESS[profile]
    high, wide = gray.shape[:2]
    x, y, w, h = box or (0.0, 0.0, float(wide), float(high))
    if w < 3 or h < 3:
        return how["unknown"]
    cut = how["inset"]
    left, top = max(0, _rounded(x + w * cut)), max(0, _rounded(y + h * cut))
    right = min(wide, left + max(1, _rounded(w * (1 - 2 * cut))))
    bottom = min(high, top + max(1, _rounded(h * (1 - 2 * cut))))
    across, down = right - left, bottom - top
    if across < 3 or down < 3:
        return how["unknown"]
    side = how.get("square")
    if side and (across >= side or down >= side):
        spots = lambda at, n: at + (np.arange(side) + 0.5) * max(1, n - 1) / side - 0.5
        return _spread(bilinear(gray.astype(float), spots(top, down), spots(left, across)), how["base"])
    part = gray[top:bottom, left:right].astype(float)
    longest = how.get("longest")
    if longest and max(across, down) > longest:
        scale = longest / max(across, down)
        w, h = max(1, int(across * scale)), max(1, int(down * scale))
        part = bilinear(part, centres(h, down), centres(w, across))
        if min(part.shape[:2]) < 3:
            return how["unknown"]
    score = _spread(part, how["base"])
    if "small" in how and across * down < how["small"][0]:
        _, prior, trust = how["small"]
        score = prior + (score - prior) * trust
    return score


def pixels_of(content, width, height) -> np.ndarray | None:
    """The pixels, or None where the sizes don't fit the bytes."""
    if content is None or pd.isna(width) or pd.isna(height) or width <= 0 or height <= 0 or len(content) != width * height * 3:
        return None
    return np.frombuffer(content, np.uint8).reshape(int(height), int(width), 3)


#: Images of one size that are worked on at once take so many bytes at most, or are one image.
_TOGETHER = 4 << 20


def _alike(raw, w, h, how: Iterable) -> Iterator[tuple]:
    """Images of one size and one value of how, in groups: that value, their places in the batch, and rows, columns, images, blue-green-red."""
    groups: dict[tuple, list] = {}
    for k, (content, wide, high, x) in enumerate(zip(raw, w, h, how)):
        image = pixels_of(content, wide, high)
        if image is not None:
            groups.setdefault((image.shape, x), []).append((k, image))
    for (shape, x), found in groups.items():
        most = max(1, _TOGETHER // (shape[0] * shape[1] * 3))
        for at in range(0, len(found), most):
            places, images = zip(*found[at : at + most])
            yield x, places, np.stack(images).transpose(1, 2, 0, 3)


def hashes(content: Column, width: Column, height: Column, orientation: Column | None = None, profile: str = "desktop") -> Column:
    """dhash of raw pixels in a binary column; null where sizes don't fit."""

    def run(raw: pd.Series, w: pd.Series, h: pd.Series, o: pd.Series) -> pd.Series:
        out = [None] * len(raw)
        turns = (None if pd.isna(turn) else int(turn) for turn in o)
        for turn, places, pixels in _alike(raw, w, h, turns):
            for k, found in zip(places, dhashes(pixels, profile, turn)):
                out[k] = found
        return pd.Series(out, dtype=object)

    run.__annotations__ = dict.fromkeys(("raw", "w", "h", "o", "return"), pd.Series)
    return F.pandas_udf(run, "string")(content, width, height, F.lit(1) if orientation is None else orientation)


def sharpnesses(content: Column, width: Column, height: Column, boxes: Column, profile: str = "desktop") -> Column:
    """sharpness of each box (structs of left, top, width, height in pixels) of an image of raw pixels; null where sizes don't fit."""

    def run(raw: pd.Series, w: pd.Series, h: pd.Series, found: pd.Series) -> pd.Series:
        out = [None] * len(raw)
        sides = ("left", "top", "width", "height")
        asked = (None if boxes_ is None else tuple(None if x is None else tuple(x[c] for c in sides) for x in boxes_) for boxes_ in found)
        for boxes_, places, pixels in _alike(raw, w, h, asked):
            if boxes_ is None:
                continue
            gray = luma(pixels)
            scores = [None if x is None else np.broadcast_to(sharpness(gray, x, profile), len(places)).tolist() for x in boxes_]
            for n, k in enumerate(places):
                out[k] = [None if x is None else x[n] for x in scores]
        return pd.Series(out, dtype=object)

    run.__annotations__ = dict.fromkeys(("raw", "w", "h", "found", "return"), pd.Series)
    return F.pandas_udf(run, "array<double>")(content, width, height, boxes)
