"""Updates of photos composed in order: what many changes of a photo come to, as one.

A change sets some fields, adds to storage, and shifts a photo from one count to another. Composed, a field has its
last value, storage the sum, and a shift goes from the first one's beginning to the last one's end. Each part
carries the sequence numbers that decided it, so parts of parts compose to the same, in any order and grouping:
partial aggregates are merged before the shuffle, and a stream's batches can be composed as they come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that a change may set and what it says about its own handling; the last that is said counts.
OPTIONS = ("recompute_totals", "immediate")
#: Counts that a change may shift a photo between.
SHIFTS = ("batch", "analysis")
KEYS = ("album_id", "photo_id")


def changes(updates: DataFrame, fields: list[str]) -> DataFrame:
    """Updates as changes that compose.

    updates: album_id, photo_id, seq, set (names of the fields that it sets, to null too), the fields themselves,
    storage_delta, the OPTIONS, and for each of SHIFTS a struct of from and to. Columns that are missing set nothing.
    """
    have = set(updates.columns)
    seq = F.col("seq").cast("long")
    said = lambda value, when: F.when(when, F.struct(seq.alias("seq"), value.alias("value")))
    made = [said(F.col(f), F.array_contains("set", f)).alias(f) for f in fields]
    made += [said(F.col(o), F.col(o).isNotNull()).alias(o) if o in have else F.lit(None).cast("struct<seq: long, value: boolean>").alias(o) for o in OPTIONS]
    for s in SHIFTS:
        for end in ("from", "to"):
            made.append(said(F.col(s)[end], F.col(s).isNotNull()).alias(f"{s}_{end}") if s in have else F.lit(None).cast("struct<seq: long, value: string>").alias(f"{s}_{end}"))
    delta = F.coalesce(F.col("storage_delta"), F.lit(0)).cast("long") if "storage_delta" in have else F.lit(0).cast("long")
    return updates.select(*KEYS, *made, delta.alias("storage_delta"), F.lit(1).cast("long").alias("updates"))


def composed(made: DataFrame) -> DataFrame:
    """One change a photo from changes, or from what composed() gave of parts of them."""
    first = {f"{s}_from" for s in SHIFTS}
    totals = ("storage_delta", "updates")
    rest = [c for c in made.columns if c not in (*KEYS, *totals)]
    return made.groupBy(*KEYS).agg(*((F.min(c) if c in first else F.max(c)).alias(c) for c in rest), *(F.sum(c).alias(c) for c in totals)).select(*made.columns)


def applied(photos: DataFrame, change: DataFrame, fields: list[str]) -> DataFrame:
    """Photos (album_id, photo_id, fields) after their change; changes of photos that aren't there do nothing."""
    c = change.select(*KEYS, *(F.col(f).alias(f"_{f}") for f in fields))
    out = photos.join(c, list(KEYS), "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["value"]).otherwise(F.col(f)))
    return out.select(*photos.columns)


def count_shifts(change: DataFrame, kind: str) -> DataFrame:
    """album_id, status and shift of a kind of counts: photos that end where they began shift nothing."""
    begin, end = F.col(f"{kind}_from")["value"], F.col(f"{kind}_to")["value"]
    moved = change.where(F.col(f"{kind}_to").isNotNull() & ~begin.eqNullSafe(end))
    ends = F.explode(F.array(F.struct(begin.alias("status"), F.lit(-1).alias("n")), F.struct(end.alias("status"), F.lit(1).alias("n"))))
    return moved.select("album_id", ends.alias("m")).where("m.status is not null").groupBy("album_id", "m.status").agg(F.sum("m.n").alias("shift")).where("shift <> 0")


def totals(change: DataFrame) -> DataFrame:
    """album_id, storage_delta, updates, and whether any photo's change asks for totals or to be done at once."""
    flag = lambda o: F.coalesce(F.bool_or(F.col(o)["value"]), F.lit(False)).alias(o)
    return change.groupBy("album_id").agg(F.sum("storage_delta").alias("storage_delta"), F.sum("updates").alias("updates"), *(flag(o) for o in OPTIONS))


def all_of(*parts: DataFrame) -> DataFrame:
    """Changes of several batches as one."""
    return composed(reduce(DataFrame.unionByName, parts))


def last(column: Column | str) -> Column:
    """The value of a composed field."""
    return (F.col(column) if isinstance(column, str) else column)["value"]
