"""Search over albums, page by page: filters, any sort column, and cursors in place of offsets.

A page is the first rows behind a key, so no page reads or counts those before it. A cursor is the sort key and
the id of a row, opaque to callers; keys that are null come last in either direction, and equal keys go by id.
Filters on ids and times and the cursor's condition are plain comparisons of columns, so they reach the files.
"""

from __future__ import annotations

import base64
import json
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a search sorts by, by the names that callers use.
SORTS = {"default": "created_at", "creation_time": "created_at", "size": "total_storage"}
LIMIT = 48


class BadCursor(ValueError):
    """A cursor that can't be read or belongs to another order."""


def cursor_of(given: str | None) -> str | None:
    """The cursor itself, where a whole address with a cursor parameter is given."""
    if given and given.startswith("http"):
        return next(iter(parse_qs(urlparse(given).query).get("cursor", [])), None)
    return given or None


def _read(cursor: str, key: str, order: str) -> tuple[str | None, str]:
    try:
        found = json.loads(base64.b64decode(cursor.replace("-", "+").replace("_", "/"), validate=True))
        by, way, value, row = found["by"], found["order"], found.get("key"), found["id"]
    except (ValueError, KeyError, TypeError) as e:
        raise BadCursor("the cursor can't be read") from e
    if (by, way) != (key, order):
        raise BadCursor(f"the cursor is of a search by {by} {way}, not {key} {order}")
    return value, row


def _written(key: str, order: str, row_id: str) -> Column:
    """The cursor of a row, made where the row is."""
    text = F.to_json(F.struct(F.lit(key).alias("by"), F.lit(order).alias("order"), F.col(key).cast("string").alias("key"), F.col(row_id).cast("string").alias("id")))
    return F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", ""), "+/", "-_")


def page_after(rows: DataFrame, key: str, order: str = "desc", limit: int = LIMIT, cursor: str | None = None, row_id: str = "album_id", backward: bool = False) -> DataFrame:
    """The limit rows behind a cursor (or before it, if backward) in order of key and row_id, each with its own cursor.

    row_id tells rows apart and isn't null. A page comes in the order of the search in both directions; a
    page before a row is the one that ends right before it.
    """
    if order not in ("asc", "desc"):
        raise ValueError(f"order is asc or desc, not {order}")
    if limit < 1:
        raise ValueError("a page has a row at least")
    k, i = F.col(key), F.col(row_id)
    cursor = cursor_of(cursor)
    if cursor:
        value, last = _read(cursor, key, order)
        last = F.lit(last).cast(rows.schema[row_id].dataType)
        up = (order == "asc") != backward
        behind = (lambda c, v: c < v) if backward else (lambda c, v: c > v)
        if value is None:
            rows = rows.where((k.isNull() & behind(i, last)) | (k.isNotNull() if backward else F.lit(False)))
        else:
            value = F.lit(value).cast(rows.schema[key].dataType)
            same, beyond = k == value, k > value if up else k < value
            if rows.schema[key].dataType.typeName() in ("float", "double"):  # files' figures leave out what is no number, which is the largest
                odd = F.isnan(value)
                same = (same & ~odd) | (F.isnan(k) & odd)
                beyond = (((k > value) | F.isnan(k)) & ~odd) if up else (((k < value) | odd) & ~F.isnan(k) & k.isNotNull())
            after = beyond | (same & behind(i, last))
            rows = rows.where(after if backward else after | k.isNull())
    forward = [k.asc_nulls_last() if order == "asc" else k.desc_nulls_last(), i.asc()]
    if backward:
        reverse = [k.desc_nulls_first() if order == "asc" else k.asc_nulls_first(), i.desc()]
        rows = rows.orderBy(*reverse).limit(limit)
        return rows.withColumn("cursor", _written(key, order, row_id)).orderBy(*forward)
    return rows.orderBy(*forward).limit(limit).withColumn("cursor", _written(key, order, row_id))


def _like(column: Column, text: str) -> Column:
    return F.lower(column).contains(text.strip().lower())


def matching(albums: DataFrame, *, keyword: str | None = None, year: int | None = None, month: int | None = None, ids: str | list | None = None, text: str | None = None, face: str | None = None, photos: DataFrame | None = None, faces: DataFrame | None = None) -> DataFrame:
    """The albums (album_id, name, created_at in ISO 8601, ...) that match every filter given.

    keyword is in the name, whatever the case; a year alone is a range of created_at, a month also goes without a
    year; ids are a list or one text with commas, and none match none. text is in the name of one of the album's
    photos (album_id, file_name), face is a cluster of one of its faces (album_id, cluster_id). Empty texts don't filter.
    """
    created = F.col("created_at")
    if keyword and keyword.strip():
        albums = albums.where(_like(F.col("name"), keyword))
    if year is not None:
        low, high = (f"{year:04d}-{month:02d}", f"{year:04d}-{month:02d}~") if month is not None else (f"{year:04d}-", f"{year:04d}-~")
        albums = albums.where((created >= low) & (created < high))
    elif month is not None:
        albums = albums.where(F.substring(created, 6, 2) == f"{month:02d}")
    if ids is not None:
        wanted = [x.strip() for x in ids.split(",") if x.strip()] if isinstance(ids, str) else list(ids)
        kind = albums.schema["album_id"].dataType
        albums = albums.where(F.col("album_id").isin(*(F.lit(x).cast(kind) for x in wanted)) if wanted else F.lit(False))
    if text and text.strip():
        if photos is None:
            raise ValueError("a search for text needs photos")
        albums = albums.join(photos.where(_like(F.col("file_name"), text)).select("album_id"), "album_id", "left_semi")
    if face and face.strip():
        if faces is None:
            raise ValueError("a search for a face needs faces")
        albums = albums.join(faces.where(F.col("cluster_id") == face).select("album_id"), "album_id", "left_semi")
    return albums


def album_search(albums: DataFrame, *, sort: str = "default", order: str = "desc", limit: int = LIMIT, cursor: str | None = None, backward: bool = False, **filters) -> DataFrame:
    """One page of the albums that match, in order, each with the cursor of the page behind it."""
    key = SORTS.get(sort, sort)
    if key not in albums.columns:
        raise ValueError(f"no column to sort by: {sort}")
    return page_after(matching(albums, **filters), key, order, limit, cursor, backward=backward)


def walk(page, limit: int = LIMIT):
    """Pages of a search one after another: page(cursor) gives one; ends at a page that isn't full."""
    cursor = None
    while True:
        rows = page(cursor)
        found = rows.select("cursor").collect()  # limit at most
        if not found:
            return
        yield rows
        if len(found) < limit:
            return
        cursor = found[-1]["cursor"]
