"""Backfill of promoted columns in chunks of albums, which goes on where it was stopped.

A chunk is the next albums behind a mark, as many as have about CHUNK rows that aren't done; the mark is stored once
they are written. A row counts as done by its place before the mark and not by its values, so rows whose true value
is the default are done once. A run that ends in the middle of a chunk leaves the mark, and the chunk is done again
with the same result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .photofiles import _address, _files, _put
from .scratch import forget, written

#: Rows of a chunk, about; an album is never split.
CHUNK = 1_000_000
MARK = "_backfill.json"


def mark(path: str) -> str | None:
    """The last album that is done, as text, or None."""
    found, at = _files(path)
    if found.get_file_info(f"{at}/{MARK}").is_file:
        with found.open_input_stream(f"{at}/{MARK}") as f:
            return json.loads(f.read())["album"]
    return None


def _set_mark(path: str, album: str) -> None:
    found, at = _files(path)
    _put(found, f"{at}/{MARK}.new", json.dumps({"album": album}).encode())
    found.move(f"{at}/{MARK}.new", f"{at}/{MARK}")


def _next(table: DataFrame, after: str | None, chunk: int) -> tuple[str, str] | None:
    """The first and last album of the next chunk: by a count of rows for each album, read from the files' footers and folders."""
    kind = table.schema["album_id"].dataType
    rest = table if after is None else table.where(F.col("album_id") > F.lit(after).cast(kind))
    counts = rest.groupBy("album_id").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("album_id").rowsBetween(Window.unboundedPreceding, -1))
    found = counts.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < chunk)
    low, high = found.agg(F.min("album_id").cast("string"), F.max("album_id").cast("string")).first()
    return None if low is None else (low, high)


def backfill(spark: SparkSession, path: str, chunk: int = CHUNK, most: int | None = None) -> int:
    """Promotes the rows (album_id, photo_id, data, ...) of a table of store.write() from the mark on; gives the number of chunks done, at most most.

    Columns that the table lacks are added. The table must not be written by others meanwhile.
    """
    done, after = 0, mark(path)
    while most is None or done < most:
        table = spark.read.option("mergeSchema", "true").parquet(_address(path))
        span = _next(table, after, chunk)
        if span is None:
            return done
        kind = table.schema["album_id"].dataType
        part = table.where((F.col("album_id") >= F.lit(span[0]).cast(kind)) & (F.col("album_id") <= F.lit(span[1]).cast(kind)))
        # what is read is replaced, so it is written aside first
        aside = written(part.select("album_id", "photo_id", "data", "updated_at"), "chunk")
        store.write(store.promote(aside), _address(path))
        forget(aside)
        after = span[1]
        _set_mark(path, after)
        done += 1
    return done
