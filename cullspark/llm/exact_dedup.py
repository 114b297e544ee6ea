"""Exact dedup with a cuckoo-filter index over digests of normalised texts.

The index is sharded by digest. A shard holds a cuckoo filter and its bucketed content: the live
digests with the id to keep and the number of copies. Copies find each other by the filter: a digest
that it doesn't hold is new, a hit is verified against the content and adds to the digest found there.
An insertion that overflows the filter rebuilds it at twice the size from the shard's stored keys, and
shards that have grown too large are dealt anew from theirs. Each task adds up its own batches' copies
before anything is shuffled, so a group with a third of all rows is a row for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests that a shard is laid out for; the number of shards follows the number of rows to insert, and of those inserted.
SHARD_KEYS = 4096
#: Rows that a task adds up before it sends them on, at most twice as many.
PARTIAL_ROWS = 100_000
SLOTS, KICKS = 4, 200
_STATE = "shard int, kind int, digest string, keep_id long, group_size long, slots binary"
KEY, INSERT, REPLACE, FILTER = 0, 1, 2, 3


class CuckooFilter:
    """16-bit fingerprints, 4 slots a bucket, partial-key cuckoo hashing; 0 is an empty slot."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.mask = buckets - 1
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots
        self.rng = np.random.default_rng(buckets)

    def places(self, digest: str) -> tuple[int, int, int]:
        mark = int(digest[:4], 16) or 1
        first = int(digest[4:20], 16) & self.mask
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, digest: str) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.slots[a] or mark in self.slots[b]

    def add(self, digest: str) -> bool:
        """False on overflow; the filter then lacks one mark and must be rebuilt."""
        mark, a, b = self.places(digest)
        for at in (a, b):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        at = a
        for _ in range(KICKS):
            k = int(self.rng.integers(SLOTS))
            mark, self.slots[at, k] = int(self.slots[at, k]), mark
            at = self.other(at, mark)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        return False

    def remove(self, digest: str) -> None:
        """Only for digests known to be live, as any cuckoo filter demands."""
        mark, a, b = self.places(digest)
        for at in (a, b):
            found = np.flatnonzero(self.slots[at] == mark)
            if len(found):
                self.slots[at, found[0]] = 0
                return

    @classmethod
    def of(cls, digests, buckets: int = 16) -> CuckooFilter:
        """Built from stored keys, doubling until all fit."""
        while True:
            made = cls(buckets)
            if all(made.add(d) for d in digests):
                return made
            buckets *= 2


def _update(shard: pd.DataFrame) -> pd.DataFrame:
    """New state of one shard from its state and the batch."""
    by = dict(tuple(shard.groupby("kind")))
    keys = {d: (k, n) for d, k, n in by[KEY][["digest", "keep_id", "group_size"]].itertuples(index=False)} if KEY in by else {}
    if FILTER in by:
        raw = np.frombuffer(by[FILTER]["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()
        marks = CuckooFilter(len(raw), raw)
    else:
        marks = CuckooFilter.of(keys)
    for kind in (INSERT, REPLACE):
        if kind not in by:
            continue
        for digest, keep, n in by[kind][["digest", "keep_id", "group_size"]].itertuples(index=False):
            live = digest in marks and digest in keys  # a hit is verified against the content
            if n == 0:
                if live:
                    marks.remove(digest)
                    del keys[digest]
                continue
            if live and kind == INSERT:
                keep, n = _larger(keep, keys[digest][0]), n + keys[digest][1]
            keys[digest] = (keep, n)
            if not live and not marks.add(digest):
                marks = CuckooFilter.of(keys, 2 * len(marks.slots))
    at = int(shard["shard"].iloc[0])
    out = pd.DataFrame([(at, KEY, d, k, n, None) for d, (k, n) in keys.items()] + [(at, FILTER, None, None, None, marks.slots.tobytes())], columns=["shard", "kind", "digest", "keep_id", "group_size", "slots"])
    return out.astype({"keep_id": "Int64", "group_size": "Int64"})


def _larger(a, b):
    return b if pd.isna(a) else a if pd.isna(b) else max(a, b)


def _probe(shard: pd.DataFrame) -> pd.DataFrame:
    """Which of a batch's digests the filter may hold."""
    by = dict(tuple(shard.groupby("kind")))
    if FILTER not in by or INSERT not in by:
        return pd.DataFrame({"digest": []}, dtype=str)
    raw = np.frombuffer(by[FILTER]["slots"].iloc[0], np.uint16).reshape(-1, SLOTS)
    marks = CuckooFilter(len(raw), raw)
    return pd.DataFrame({"digest": [d for d in by[INSERT]["digest"] if d in marks]}, dtype=str)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text as it is) and the digest of the text with A-Z lower-cased; a null text counts as empty."""
    raw = F.col("text").cast("string")
    text = F.translate(F.coalesce(raw, F.lit("")), UPPER, LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw).alias("text_hash"), F.sha2(text, 256).alias("digest"))


class CuckooIndex:
    """members: doc_id, text_hash, digest of every live document. state: the shards' filters and content.

    Each method returns a new index or a result and leaves this one as it is, so a job that is run
    again after a loss gives the same index.
    """

    def __init__(self, members: DataFrame, state: DataFrame | None, shards: int):
        self.members, self.state, self.shards = members, state, shards

    @classmethod
    def build(cls, docs: DataFrame) -> CuckooIndex:
        members = cut(digests(docs), "members")
        return cls(members, None, 0)._inserted(members)

    @property
    def content(self) -> DataFrame:
        """One row per live digest: digest, keep_id, group_size."""
        return self.state.where(F.col("kind") == KEY).select("digest", "keep_id", "group_size")

    def _inserted(self, new: DataFrame) -> CuckooIndex:
        """With the partial sums of new inserted; where shards get too large, there are more, filled from the stored keys."""
        batch = cut(_partial(new), "batch")
        old = 0 if self.state is None else self.state.where(F.col("kind") == KEY).count()
        shards = max(1, -(-(batch.count() + old) // SHARD_KEYS))
        if self.state is None or shards > self.shards:
            kept = None if self.state is None else _tagged(self.content, KEY, shards)
        else:
            shards, kept = self.shards, self.state
        members = self.members if new is self.members else self.members.unionByName(new)
        return CuckooIndex(members, cut(_apply(batch, INSERT, kept, shards), "shards"), shards)

    def insert(self, docs: DataFrame) -> CuckooIndex:
        return self._inserted(cut(digests(docs), "members"))

    def delete(self, ids: DataFrame) -> CuckooIndex:
        """Deletes the documents of ids (doc_id); a digest without live documents leaves filter and content."""
        gone = self.members.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("digest").distinct()
        left = cut(self.members.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), "members")
        totals = left.join(gone, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        changed = gone.join(totals, "digest", "left").fillna(0, ["group_size"])
        return CuckooIndex(left, cut(_apply(changed, REPLACE, self.state, self.shards), "shards"), self.shards)

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id and group_size of the documents whose text is live in the index."""
        asked = cut(digests(docs).drop("text_hash"), "asked")
        rows = _tagged(asked.select("digest").distinct().withColumns({"keep_id": F.lit(None).cast("long"), "group_size": F.lit(1).cast("long")}), INSERT, self.shards)
        filters = self.state.where(F.col("kind") == FILTER)
        hits = rows.unionByName(filters).groupBy("shard").applyInPandas(_probe, "digest string")
        return asked.join(hits.join(self.content, "digest"), "digest")


def _partial(members: DataFrame) -> DataFrame:
    """digest, keep_id and group_size, added up for each PARTIAL_ROWS rows of a task, not yet over all."""

    def added(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by("digest").aggregate([("keep_id", "max"), ("group_size", "sum")])
        return pa.table({"digest": found["digest"], "keep_id": found["keep_id_max"], "group_size": found["group_size_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.table({"digest": batch.column(0).cast(pa.string()), "keep_id": batch.column(1), "group_size": pa.array(np.ones(batch.num_rows, np.int64))}))
            if sum(t.num_rows for t in held) >= 2 * PARTIAL_ROWS:
                held = [added(held)]
                if held[0].num_rows >= PARTIAL_ROWS:
                    yield from held.pop().to_batches()
        if held:
            yield from added(held).to_batches()

    return members.select("digest", "doc_id").mapInArrow(run, "digest string, keep_id long, group_size long")


def _tagged(batch: DataFrame, kind: int, shards: int) -> DataFrame:
    return batch.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), F.lit(kind).alias("kind"), "digest", "keep_id", "group_size", F.lit(None).cast("binary").alias("slots"))


def _apply(batch: DataFrame, kind: int, state: DataFrame | None, shards: int) -> DataFrame:
    rows = _tagged(batch, kind, shards)
    rows = rows if state is None else rows.unionByName(state)
    return rows.groupBy("shard").applyInPandas(_update, _STATE)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_hash (Spark's xxhash64 of the text as it is).

    Texts are equal when they are so after lower-casing A-Z; the largest doc_id of a group stays.
    Null texts count as empty, so empty and null texts form one group. Rows without doc_id count in
    group_size and are kept only in a group where no row has one. doc_id is the key: repeated rows
    with one doc_id and one text share a verdict. Other columns are not read. No rows in, no rows out.
    """
    index = CuckooIndex.build(docs)
    joined = index.members.join(index.content, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "text_hash")
