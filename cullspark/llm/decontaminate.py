"""Benchmark passages in documents, by winnowing: of the k-grams in each window of words the least hash is kept.

Two texts that share SPAN words share a fingerprint, since the window of those words keeps the same k-gram in
both; an item of fewer words is one window of its own length. A window stands for its fingerprint and so do its
neighbours that keep the same k-gram, so a text has about two fingerprints in GRAM + 2 words. Items'
fingerprints go to the tasks as a Bloom filter of at most 2^BITS bits, whatever their number; it only lets more
through as it fills. Where a document's fingerprint passes, the hit is extended over all windows that keep it,
to a span of words that is then joined with items' windows, word by word, as text. So hashes decide what is
looked at and never what is found.

Windows join by their text, and items are put to them as a set that many windows share, so a passage that a
third of documents and items hold makes no pairs of documents and items; sets of items are expanded once for
all documents that hit the same sets.

Null text has no words. Rows are told apart by doc_id and text, null ids included, rows that repeat each have
a row in the result. Rows of one item_id are one item, a null item_id is an item with an empty name. Very long
texts are worked on in steps. An empty benchmark hits nothing. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, digests, keyed, small_batches
from .wordbytes import batches, joined, mixed, words

#: Words of a window, and of a k-gram: all shared spans of SPAN words are found.
SPAN, GRAM = 10, 5
#: Bits of the filter of fingerprints: at most 2^BITS (16 MB), 32 for each fingerprint while that fits.
BITS = 27
_PART = 15


def fingerprints(hashes: np.ndarray, text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of span words: the least hash of its k-grams and whether the window lies within one text.

    The k-gram itself is the last of the least ones, which depends on the window's words alone.
    """
    k = min(GRAM, span)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = hashes[: len(hashes) - k + 1].copy()
    for j in range(1, k):
        grams = grams * np.uint64(0x100000001B3) + hashes[j : len(hashes) - k + 1 + j]
    grams = mixed(grams)
    least = grams[:n].copy()
    for j in range(1, span - k + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return mixed(least + np.uint64(span)), text[:n] == text[span - 1 : span - 1 + n]


def _texts_of(buffer: bytes, begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(begins, starts, side="right") - 1


def _items(parts):
    """Windows of items: item, n (its words), window (their text), print."""
    for part in parts:
        out = []
        texts = list(part["text"])
        for a, b in batches(texts):
            buffer, begins = joined(texts[a:b])
            low, starts, ends, hashes = words(buffer)
            text = _texts_of(buffer, begins, starts)
            for k in range(b - a):
                lo, hi = np.searchsorted(text, [k, k + 1])
                n = min(SPAN, hi - lo)
                if n == 0:
                    continue
                said = [low[s:e].decode("utf-8", "replace") for s, e in zip(starts[lo:hi], ends[lo:hi])]
                prints, _ = fingerprints(hashes[lo:hi], text[lo:hi], n)
                out += [(part["item"].iloc[a + k], n, " ".join(said[i : i + n]), int(p.view(np.int64))) for i, p in enumerate(prints)]
        yield pd.DataFrame(out, columns=["item", "n", "window", "print"])


def windows_of(items: DataFrame) -> DataFrame:
    """item, n, window and print of items (item_id, text), each window of an item once."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_items, "item string, n int, window string, print long").distinct()


def _places(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return prints & mask, (prints >> np.uint64(64 - bits)) & mask


def _filter_of(prints: DataFrame) -> tuple[int, bytes]:
    """The filter of distinct prints: its size as a power of two, and its bits. Tasks make parts of it, at most 4096 of 4 KB."""
    bits = min(BITS, max(_PART, (32 * prints.count()).bit_length()))

    def place(parts):
        for part in parts:
            a, b = _places(part["print"].to_numpy(np.int64).view(np.uint64), bits)
            at = np.unique(np.concatenate((a, b))).astype(np.int64)
            yield pd.DataFrame({"part": at >> _PART, "bit": at & ((1 << _PART) - 1)})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << _PART, np.uint8)
        on[part["bit"]] = 1
        return pd.DataFrame({"part": part["part"].iloc[:1], "bits": [np.packbits(on).tobytes()]})

    made = prints.mapInPandas(place, "part long, bit long").groupBy("part").applyInPandas(pack, "part long, bits binary").collect()
    out = bytearray(1 << (bits - 3))
    for part, on in made:
        out[part << (_PART - 3) : (part + 1) << (_PART - 3)] = on
    return bits, bytes(out)


def _passes(filter_: np.ndarray, bits: int, prints: np.ndarray) -> np.ndarray:
    a, b = _places(prints, bits)
    on = lambda at: (filter_[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    first = on(a)
    first[first] = on(b[first])
    return first


def _spans(buffer_of, lengths: list[int], filter_: np.ndarray, bits: int) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words and spans of each text: windows whose fingerprint passes, neighbours together."""
    buffer, begins = buffer_of
    low, starts, ends, hashes = words(buffer)
    text = _texts_of(buffer, begins, starts)
    firsts = np.searchsorted(text, np.arange(len(begins)))
    out: list[list[dict]] = [[] for _ in begins]
    for n in lengths:
        prints, whole = fingerprints(hashes, text, n)
        hit = whole.copy()
        hit[whole] = _passes(filter_, bits, prints[whole])
        at = np.flatnonzero(hit)
        if len(at) == 0:
            continue
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(text[at]) > 0))))
        for i, j in zip(new, np.append(new[1:], len(at))):
            a, b = at[i], at[j - 1] + n
            said = b" ".join(low[s:e] for s, e in zip(starts[a:b], ends[a:b])).decode("utf-8", "replace")
            out[text[a]].append({"n": n, "start": int(a - firsts[text[a]]), "words": said})
    return np.bincount(text, minlength=len(begins)), out


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words within a window that an item has), n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    windows = cut(windows_of(items), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most SPAN of them
    bits, made = _filter_of(windows.select("print").distinct())
    filter_ = spark.sparkContext.broadcast(made)

    def run(parts):
        on = np.frombuffer(filter_.value, np.uint8)
        for part in parts:
            texts, counts, spans = list(part["text"]), [], []
            for a, b in batches(texts):
                n, found = _spans(joined(texts[a:b]), lengths, on, bits)
                counts += n.tolist()
                spans += found
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"], "n_words": counts, "spans": spans})

    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    base = rows.mapInPandas(run, "doc_id string, text_hash long, n_words long, spans array<struct<n: int, start: long, words: string>>")
    base = cut(base.withColumn("doc_id", F.col("doc_id").cast("long")), "spans")

    # a window's items as a set that is named by its hash, and one window of each set to read its items from
    names = windows.select("window", "item").distinct()
    set_of = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("item", F.lit(1))), F.bit_xor(F.xxhash64("item", F.lit(2))))
    sets = cut(names.groupBy("window").agg(set_of.alias("set")), "sets")
    members = names.join(sets.groupBy("set").agg(F.min("window").alias("window")), "window").select("set", "item")

    spans = base.where("size(spans) > 0").select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.n", "s.start", F.split("s.words", " ").alias("w"))
    said = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    seen = spans.select("doc_id", "text_hash", "n", "start", F.posexplode(said).alias("k", "window")).select("doc_id", "text_hash", "n", (F.col("start") + F.col("k")).alias("at"), "window")
    few = sets.count() <= BROADCAST_ROWS
    hits = seen.join(F.broadcast(sets) if few else sets, "window")
    per_doc = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("_at"), F.array_join(F.array_sort(F.collect_set("set")), ",").alias("found"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    after = lambda x: x["at"] + x["n"]
    grown = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), after(x) - F.greatest(a["end"], x["at"]))).alias("n"), F.greatest(a["end"], after(x)).alias("end"))
    per_doc = cut(per_doc.select("doc_id", "text_hash", F.aggregate("_at", start, grown, lambda a: a["n"]).alias("n_hit"), "found"), "hits")

    found = per_doc.select("found").distinct()
    listed = found.select("found", F.explode(F.split("found", ",")).alias("set")).join(members, "set").select("found", "item").distinct()
    listed = cut(listed, "found")
    lists = cut(listed.groupBy("found").agg(F.count(F.lit(1)).alias("n_items")).join(digests(listed, "found", "item", "item", ","), "found"), "lists")
    few = lists.count() <= BROADCAST_ROWS
    per_doc = per_doc.join(F.broadcast(lists) if few else lists, "found").drop("found")
    same = base["doc_id"].eqNullSafe(per_doc["doc_id"]) & (base["text_hash"].eqNullSafe(per_doc["text_hash"]))
    zero = lambda c: F.coalesce(per_doc[c], F.lit(0)).cast("long").alias(c)
    return base.join(per_doc, same, "left").select(base["doc_id"], base["n_words"], zero("n_hit"), zero("n_items"), F.coalesce(per_doc["digest"], F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(per_doc["n_hit"] > 0, F.lit(False)).alias("contaminated"))
