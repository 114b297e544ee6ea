"""Greedy suppression of boxes in Arrow batches: photos with equally many boxes are judged at once, box by box in order of rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Boxes that are judged at once, or those of one photo.
_TOGETHER = 1 << 18
_SIDES = ("left", "top", "width", "height")


def _ranks(score: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places of each row's boxes by falling score, those within 1e-9 of the one before by index."""
    order = np.argsort(-score, axis=1, kind="stable")
    s = np.take_along_axis(score, order, 1)
    group = np.zeros(order.shape, np.int64)
    np.cumsum(s[:, :-1] > s[:, 1:] + 1e-9, axis=1, out=group[:, 1:])
    by_index = np.argsort(np.take_along_axis(index, order, 1), axis=1, kind="stable")
    by_group = np.argsort(np.take_along_axis(group, by_index, 1), axis=1, kind="stable")
    return np.take_along_axis(order, np.take_along_axis(by_index, by_group, 1), 1)


def _clash(one: dict, rest: dict, values: tuple, overlap: float | None) -> np.ndarray:
    """scalar.clashing, or overlapping, of a box of each row and others of the row; as in columns, what is no number is the greatest."""
    wide = np.fmin(one["right"], rest["right"]) - np.maximum(one["left"], rest["left"])
    high = np.fmin(one["bottom"], rest["bottom"]) - np.maximum(one["top"], rest["top"])
    both = np.maximum(0.0, wide) * np.maximum(0.0, high)
    every = one["area"] + rest["area"] - both
    over = np.divide(both, every, out=np.zeros_like(both), where=~(every <= 0))
    if overlap is not None:
        return ~(over < overlap)
    same, ratio, share, loose, near = values
    small, large = np.fmin(one["area"], rest["area"]), np.maximum(one["area"], rest["area"])
    floor = np.maximum(small, 1e-8)
    uneven = ~(large / floor < ratio)
    dx, dy = one["x"] - rest["x"], one["y"] - rest["y"]
    apart, most = np.sqrt(dx * dx + dy * dy), near * np.fmin(one["diagonal"], rest["diagonal"])
    close = (apart < most) | (np.isnan(most) & ~np.isnan(apart))
    return ~(both <= 0) & (~(over < same) | (uneven & (~(both / floor < share) | (~(over < loose) & close))))


def _kept(box: dict, values: tuple, overlap: float | None) -> np.ndarray:
    """Which boxes of rows in order of rank stay."""
    left, top, width, height = (box[c] for c in _SIDES)
    with np.errstate(invalid="ignore", over="ignore"):
        m = {"left": left, "top": top, "right": left + width, "bottom": top + height, "area": np.maximum(0.0, width) * np.maximum(0.0, height)}
        m |= {"x": left + width / 2, "y": top + height / 2, "diagonal": np.sqrt(width * width + height * height)}
    kept = np.ones(left.shape, bool)
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(left.shape[1] - 1):
            rows = np.flatnonzero(kept[:, k])
            if len(rows):
                one, rest = {c: v[rows, k, None] for c, v in m.items()}, {c: v[rows, k + 1 :] for c, v in m.items()}
                kept[rows, k + 1 :] &= ~_clash(one, rest, values, overlap)
    return kept


def kept_places(n: np.ndarray, starts: np.ndarray, given: dict, area: np.ndarray, known: np.ndarray, values: tuple, overlap: float | None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For photos of n boxes each, that begin at starts: where each photo's boxes that stay end, and their places in it, in order of rank.

    given: sides of all boxes and, if they are ranked, score, and with it index; area breaks ties of score. Photos that aren't known have none.
    """
    many, found = np.zeros(len(n), np.int64), []
    for size in np.unique(n[known & (n > 0)]).tolist():
        rows_ = np.flatnonzero(known & (n == size))
        for rows in np.array_split(rows_, max(1, len(rows_) * size // _TOGETHER)):
            at = starts[rows, None] + np.arange(size)
            if "index" in given:
                order = _ranks(given["score"][at], given["index"][at])
            elif "score" in given:  # what is no number comes first, as columns have it
                order = np.lexsort([k for x in (area[at], given["score"][at]) for k in (-x, ~np.isnan(x))], axis=1)
            else:
                order = np.broadcast_to(np.arange(size), at.shape)
            order = order[:, :most] if most else order
            at = np.take_along_axis(at, order, 1)
            kept = _kept({c: given[c][at] for c in _SIDES}, values, overlap)
            many[rows] = kept.sum(axis=1)
            found.append((rows, kept.sum(axis=1), order[kept]))
    ends = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(ends[-1], np.int32)
    for rows, count, which in found:
        out[np.repeat(ends[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))] = which
    return ends, out


def places(boxes: Column, score: Column | None = None, index: Column | None = None, values: tuple | None = None, overlap: float | None = None, most: int | None = None, sides: tuple[Column, Column] | None = None) -> Column:
    """Places of the boxes that stay, in order of score, then index; without an index by score, then area, and without both as they come.

    boxes: an array of structs of left, top, width and height, which should be a column, as each is taken out of it; score and index:
    arrays as long. With sides boxes are in pixels of an image of that width and height, and judged as shares of it. Null where a number is
    null or not finite, which is for the caller to judge.
    """
    values, names = values or S.REDUNDANT, [*_SIDES, *(n for n, c in (("score", score), ("index", index)) if c is not None)]
    scaled = sides is not None

    def run(*lists: pa.Array) -> pa.Array:
        first = lists[0]
        starts = first.offsets.to_numpy()
        n, begin = np.diff(starts), starts[0]
        given = {c: x.values.slice(x.offsets[0].as_py(), starts[-1] - begin).to_numpy(zero_copy_only=False).astype(float) for c, x in zip(names, lists)}
        starts = starts - begin
        if scaled:
            wide, high = (x.to_numpy(zero_copy_only=False).astype(float) for x in lists[-2:])
            area = given["width"] * given["height"]
            with np.errstate(divide="ignore", invalid="ignore"):
                given |= {c: given[c] / np.repeat(wide if c in ("left", "width") else high, n) for c in _SIDES}
        else:
            area = given["width"] * given["height"]
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(sum(x * 0 for x in given.values())))])
        known = ~first.is_null().to_numpy(zero_copy_only=False) & (odd[starts[1:]] == odd[starts[:-1]])
        ends, out = kept_places(n, starts, given, area, known, values, overlap, most)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out), mask=pa.array(~known))

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    arrays = [*(boxes[c] for c in _SIDES), *(c for c in (score, index) if c is not None)]
    return F.arrow_udf(run, "array<int>")(*(c.cast("array<double>") for c in arrays), *(c.cast("double") for c in sides or ()))
