"""Packing of tokenised documents: shortest-pack-first over the length histogram.

Only the histogram (one count per length up to the limit) reaches the driver. It is packed longest
length first; equal packs are one pattern with a count. Documents then find their place by their
rank within their length, numbered over ranges of rows, and the plan, whose size depends on the limit
alone, is looked up by binary search in the tasks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered
from .tokens import WordEncoder

LIMIT = 4096
END = 2
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """The documents' tokens with the end id, cut into pieces of limit and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.shared(vocabulary)
        end = END.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                out += [(doc, s, min(limit, n - s), zlib.crc32(ids[4 * s : 4 * (s + limit)]), n) for s in range(0, n, limit)]
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 5)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (count, [(length, times)]). Each length goes to the open packs with most room."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    most: list[int] = []  # heap of -room, with stale entries

    def put(left: int, count: int, pattern: list[tuple[int, int]]) -> None:
        room.setdefault(left, []).append((count, pattern))
        heapq.heappush(most, -left)

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            while most and not room.get(-most[0]):
                heapq.heappop(most)
            left = -most[0] if most else 0
            if left < length:
                times = max(1, limit // length)
                whole, rest = divmod(todo, times)
                # packs that only hold this length: worst fit spreads them one by one, so open as many as needed
                if whole:
                    put(limit - times * length, whole, [(length, times)])
                if rest:
                    put(limit - rest * length, 1, [(length, rest)])
                todo = 0
                continue
            count, pattern = room[left].pop()
            used = min(count, todo)
            if used < count:
                put(left, count - used, pattern)
            last, times = pattern[-1]
            put(left - length, used, pattern[:-1] + [(last, times + 1)] if last == length else pattern + [(length, 1)])
            todo -= used
    return [x for packs in room.values() for x in packs]


def _lookup(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times, first offset), sorted by length and rank."""
    rows, ranks, first = [], {}, 0
    for count, pattern in patterns:
        at = 0
        for length, times in pattern:
            rank = ranks.get(length, 0)
            rows.append((length, rank, first, times, at))
            ranks[length] = rank + count * times
            at += length * times
        first += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...). cut_pieces is read twice, so it should be a written table."""
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most limit rows
    ranked = numbered(cut_pieces, ["length"], [F.asc_nulls_first("doc_id"), F.asc("start"), F.asc("ids_crc32")], "rank")
    shared = spark.sparkContext.broadcast(_lookup(plan(histogram, limit)))
    names = [*cut_pieces.columns, "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        step = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * step + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(names.index(x)).to_numpy() for x in ("length", "rank"))
            length, rank0, first, times, at = table[np.searchsorted(keys, length * step + np.minimum(rank, step - 1), "right") - 1].T
            inside = rank - rank0
            where = [pa.array(first + inside // times), pa.array(at + length * (inside % times))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *where], [*names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Long texts become full pieces and a rest, each id in
    exactly one piece. Rows without doc_id are packed too, with a null doc_id. Repeated rows are
    packed as often as they come; ties in rank between them do not change the result. Other columns
    are not read. No rows in, no rows out.
    """
    return pack(cut(pieces(docs, vocabulary, limit), "pieces"), limit)
