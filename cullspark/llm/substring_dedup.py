"""Substring dedup over sliding spans of sentences.

Every run of SENTENCES consecutive sentences is hashed, to 128 bits on its lower-cased words, and grouped
over all documents; a run of fewer than RUN_WORDS words is lengthened to either side, and a sentence of
LONG_WORDS or more is a run by itself. The first document keeps a run, and within a document the first
place. Sentences that any other repeated run covers are removed. A repeated passage is thus covered from
its first whole sentence to its last if those have RUN_WORDS words; the words of a passage that begins or
ends inside another text's sentence stay there. Shorter runs stay, as common lines of a few words are
in many clean documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, is_row, keyed
from .minhash import GOLD, U, _mix, normal, word_hashes

#: Sentences and words of a run at least, and words of a sentence that is a run by itself.
SENTENCES, RUN_WORDS, LONG_WORDS = 2, 15, 25
_END = re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+|\n\s*")
_BASES = (U(0xC2B2AE3D27D4EB4F), U(0x9FB21C651E98DF25))
_BACKS = tuple(U(pow(int(b), -1, 1 << 64)) for b in _BASES)


def sentences(text: str) -> list[int]:
    """Offsets where sentences begin, and the text's length; sentences end with their white space."""
    cuts = [0, *(m.end() for m in _END.finditer(text) if m.end() < len(text)), len(text)]
    return cuts if text else [0]


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the runs, given the words of each sentence: the shortest that begins and that ends at each."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    at, alone = np.arange(n), words >= LONG_WORDS
    end = np.where(alone, at, np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS) - 1, at + SENTENCES - 1))
    start = np.where(alone, at, np.minimum(np.searchsorted(total, total[1:] - RUN_WORDS, "right") - 1, at - SENTENCES + 1))
    ok, ok_back = end < n, start >= 0
    both = np.unique(np.concatenate([at[ok] * n + end[ok], start[ok_back] * n + at[ok_back]]))
    return both // max(n, 1), both % max(n, 1)


def _power(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def run_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the hash, first and last sentence of each run of a text."""
    cuts = sentences(text)
    words = np.array([len(text[a:b].split()) for a, b in zip(cuts, cuts[1:])], np.int64)
    first, last = runs(words)
    before = np.concatenate([[0], np.cumsum(words)])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first, last
    hashes = word_hashes(normal(text))
    a, b = before[first], before[last + 1]
    out = []
    for base, back in zip(_BASES, _BACKS):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power(base, len(hashes)), dtype=np.uint64)])
        out.append(_mix((total[b] - total[a]) * _power(back, len(total))[a] + (b - a).astype(np.uint64) * GOLD).view(np.int64))
        hashes = _mix(hashes + GOLD)
    return *out, first, last


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, hash (two longs), first, last of the runs; repeated says that the document has the run before."""
    names = ["doc_id", "text_hash", "hash", "hash2", "first", "last", "repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0

            def flush():
                columns = [np.concatenate(x) for x in zip(*parts)]  # noqa: B023
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
                return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k == pa.int32() else c, k) for c, k in zip(columns, kinds)], names)

            for doc, hashed, text in zip(*(c.to_pylist() for c in batch.columns)):
                one, two, first, last = run_hashes(text or "")
                again = np.ones(len(one), bool)
                again[np.unique(one ^ _mix(two.view(np.uint64)).view(np.int64), return_index=True)[1]] = False
                parts.append((np.full(len(one), doc, np.int64), np.full(len(one), hashed, np.int64), one, two, first, last, again))
                size += len(one)
                if size > 100_000:
                    yield flush()
                    parts, size = [], 0
            if parts:
                yield flush()

    return keyed(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, text_hash long, hash long, hash2 long, first int, last int, repeated boolean")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]))
def _without(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    out = []
    for t, a, b in zip(text, first, last):
        if t is None or a is None:
            out.append((t, 0))
            continue
        cuts = sentences(t)
        gone = np.zeros(len(cuts), np.int64)
        np.add.at(gone, np.asarray(a, int), 1)
        np.add.at(gone, np.asarray(b, int) + 1, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept = "".join(t[x:y] for x, y, g in zip(cuts, cuts[1:], gone) if not g)
        out.append((kept.rstrip() if gone.any() else t, int(gone.sum())))
    return pd.DataFrame(out, columns=["text", "n_removed"]).astype({"n_removed": "Int64"})


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated sentences taken out of text, and n_removed, how many.

    Runs within a document count as well. The smallest doc_id keeps a run, and of different texts under one
    doc_id that of the smallest text_hash (Spark's xxhash64 of the text). A text of which nothing
    stays becomes empty; no row is dropped. Null texts stay null and empty ones empty; rows without
    doc_id are left as they are; rows that repeat a doc_id and its text lose the same sentences.
    All columns pass through, save that text is rewritten and a column n_removed replaced. No rows in, no rows out.
    """
    found = cut(spans(docs), "spans")
    groups = found.where("not repeated").groupBy("hash", "hash2").agg(F.min(F.struct("doc_id", "text_hash")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = cut(groups, "owners")
    later = found.join(groups, ["hash", "hash2"]).where(F.struct("doc_id", "text_hash") != F.col("owner"))
    span = ["doc_id", "text_hash", "first", "last"]
    gone = later.select(span).unionByName(found.where("repeated").select(span))
    gone = gone.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    gone = cut(gone, "gone")
    names = [c for c in docs.columns if c not in ("text", "n_removed")]
    some, text = gone["spans"].isNotNull(), docs["text"].cast("string")  # only texts that lose sentences go to Python
    made = _without(F.when(some, text), gone["spans.first"], gone["spans.last"])
    made = F.when(some, made).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_removed")))
    both = fresh(docs, "done")
    done = docs.join(gone, is_row(docs, gone), "left").select(*(docs[f"`{c}`"] for c in names), made.alias(both))
    texts = {"text": F.col(f"`{both}`.text").alias("text")}
    return done.select(*(texts.get(c, F.col(f"`{c}`")) for c in docs.columns if c != "n_removed"), F.col(f"`{both}`.n_removed").alias("n_removed"))
