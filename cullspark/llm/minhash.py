"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, banded and verified.

A text is a multiset of five-word shingles. A shingle with count w owns the weights [0, w). They are
discretised into units and the units gathered into the intervals [0,1), [1,2), [2,4), [4,8) and so on,
each with a Poisson process whose rate is its length; a point of a longer interval belongs to one of
its units, which the point's random number says, as if the interval had been split in halves again and
again, and counts if that unit is below w. A component of the signature is the earliest point over all
shingles that fell on it, so two texts agree in it with the probability of their weighted Jaccard
similarity. Points are made in order of time and only up to the time by which all components have one.

Exact copies are one text. Texts that share a band meet the band's smallest id first; what that links is
contracted, and buckets that still hold several components are compared in blocks, so no group gives
all its pairs. Every link is verified on the texts' shingle counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, keyed
from .graph import components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share aren't verified: this is 4.7 deviations under SIMILAR, which
#: one pair in a million at exactly SIMILAR misses.
ESTIMATE = 0.65
#: Rows of one side of a block when a bucket is compared.
BLOCK = 1024
#: Shingles that are signed at once.
SIGN_AT_ONCE = 200_000
_TEXT_BLOCK = 1 << 20

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + U(1)) * GOLD)
_STEP = U(0xD1342543DE82EF95)
_BACK = U(pow(int(_STEP), -1, 1 << 64))
_LANES = _mix((np.arange(WORDS, dtype=np.uint64) + U(77)) * GOLD) | U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the polynomial's base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, _TEXT_BLOCK + 4096)
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of single-spaced text; polynomials by prefix sums, no word is handled alone."""
    out = []
    at = 0
    while at < len(data):
        end = len(data) if at + _TEXT_BLOCK >= len(data) else data.find(b" ", at + _TEXT_BLOCK)
        end = len(data) if end < 0 else end
        raw = np.frombuffer(data, np.uint8, end - at, at)
        powers, back = _power(len(raw) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers[: len(raw)], dtype=np.uint64)])
        gaps = np.flatnonzero(raw == 32)
        first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        out.append(_mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64)))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def normal(text: str | None) -> bytes:
    """Lower case, words parted by one space."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the five-word shingles and their counts; a shorter text is one shingle, an empty one none."""
    words = word_hashes(data)
    n = len(words) - WORDS + 1
    if not len(words):
        return words, np.zeros(0, np.int64)
    if n < 1:
        words, n = np.concatenate([words, np.zeros(WORDS - len(words), np.uint64)]), 1
    total = words[:n] * _LANES[0]
    for k in range(1, WORDS):
        total = total + words[k : n + k] * _LANES[k]
    return np.unique(_mix(total), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - both
    return both / every if every else 0.0


def _points(seed, rate, low, width, weight, doc, until, signature) -> None:
    """All points before each document's time, into signature (documents x M, earliest times)."""
    at, step = np.zeros(len(seed)), 0
    m = signature.shape[1]
    flat = signature.reshape(-1)
    while len(seed):
        many = int(min(64, max(1, 16384 // len(seed))))
        x = _mix(seed[:, None] + np.arange(step + 1, step + many + 1, dtype=np.uint64) * GOLD)
        gap = -np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        gap[:, 0] += at  # one gap at a time in one order, so that times don't depend on how many are made at once
        time = np.cumsum(gap, axis=1)
        ok = time < until[doc][:, None]
        y = _mix(x + U(0x632BE59BD9B4E019))
        unit = low[:, None] + ((y >> U(32)) * width[:, None] >> U(32))
        ok_now = ok & (unit < weight[:, None])
        i, j = np.nonzero(ok_now)
        where = doc[i] * m + ((y[i, j] & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
        np.minimum.at(flat, where, time[i, j])
        on = np.flatnonzero(ok[:, -1])
        seed, rate, low, width, weight, doc, at = seed[on], rate[on], low[on], width[on], weight[on], doc[on], time[on, -1]
        step += many


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """BagMinHash signatures of multisets (hashes, counts), none of them empty: earliest times, one row each."""
    out = np.full((len(bags), m), np.inf)
    key, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.uint64)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    parts = []
    for k in range(int(count.max()).bit_length() + 1):
        low = U(0) if k == 0 else U(1) << U(k - 1)
        on = np.flatnonzero(count > low)
        width = U(1) if k < 2 else low
        if len(on):
            parts.append((_mix(key[on] + U(k * 0xA0761D6478BD642F % (1 << 64))), np.full(len(on), float(width)), np.full(len(on), low), np.full(len(on), width), count[on], doc[on]))
    process = [np.concatenate(x) for x in zip(*parts)]
    total = np.bincount(doc, weights=count.astype(float), minlength=len(bags))
    until = m * (np.log(m) + 4) / total
    todo = np.arange(len(bags))
    while len(todo):
        number = np.full(len(bags), -1)
        number[todo] = np.arange(len(todo))
        on = np.flatnonzero(number[process[5]] >= 0)
        part = np.full((len(todo), m), np.inf)
        _points(*(x[on] for x in process[:5]), number[process[5][on]], until[todo], part)
        out[todo] = part
        todo = todo[~np.isfinite(part).all(axis=1)]
        until[todo] *= 2
    return out


def band_keys(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands (documents x BANDS) and one byte of each component (documents x M)."""
    marks = _mix(times.view(np.uint64))
    rows = marks.reshape(len(times), BANDS, ROWS)
    key = np.broadcast_to(_mix((np.arange(BANDS, dtype=np.uint64) + U(5)) * GOLD), rows.shape[:2])
    for r in range(ROWS):
        key = _mix(key * GOLD + rows[:, :, r])
    return key.view(np.int64), (marks & U(255)).astype(np.uint8)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, a digest of the normalised text, the number of shingles, band keys and signature bytes; not for empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            ids, hashes, prints, bags = zip(*held)
            keys, marks = band_keys(signatures(bags))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(prints, pa.binary()), pa.array([int(b[1].sum()) for b in bags], pa.int64()), pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in marks], pa.binary())], ["doc_id", "text_hash", "print", "n", "bands", "marks"])

        for batch in batches:
            held, size = [], 0
            for doc, hashed, text in zip(*(c.to_pylist() for c in batch.columns)):
                if data := normal(text):
                    held.append((doc, hashed, hashlib.blake2b(data, digest_size=16).digest(), bag := shingles(data)))
                    size += len(bag[0])
                    if size >= SIGN_AT_ONCE:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

    return keyed(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, text_hash long, print binary, n long, bands array<long>, marks binary")


def _texts(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the representatives of nodes."""
    ids = cut(nodes.distinct().join(reps.select("node", "doc_id", "text_hash"), "node"), "ids")
    few = ids.count() <= BROADCAST_ROWS
    texts = keyed(docs).join(F.broadcast(ids) if few else ids, ["doc_id", "text_hash"])
    return cut(texts.select("node", "text").dropDuplicates(["node"]), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose texts are similar enough, on their shingles' counts."""
    texts = _texts(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if b != last:
                    last, bag = b, shingles(normal(y))
                ok.append((a, b) if similarity(shingles(normal(x)), bag) >= SIMILAR else None)
            out = [p for p in ok if p]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return cut(two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


#: A row of a block: where it is dealt to, its side there, and what pairs are judged by.
_ROW = "key long, l long, r long, side int, node long, comp long, n long, band int, marks binary, bands array<long>"


def _blocks(rows: Iterator[pa.RecordBatch], judge) -> Iterator[pa.RecordBatch]:
    """What judge makes of whole blocks. Rows come sorted by block; the last block of a batch waits for the next one."""
    held: pa.Table | None = None
    for batch in rows:
        now = pa.Table.from_batches([batch])
        held = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
        starts = _starts([held.column(k).to_numpy() for k in range(3)])
        if len(starts) > 1:
            yield judge(held.slice(0, starts[-1]), starts[:-1])
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield judge(held, np.zeros(1, np.int64))


def _likely_in(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block and right row (start, row, components in the block, left rows it may be similar to).

    A pair is looked at in the first band that it shares. The components may be joined meanwhile.
    """
    side, comp, n, band = (rows.column(c).to_numpy() for c in ("side", "comp", "n", "band"))
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(-1, M)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    for a, b in zip(starts, [*starts[1:], len(side)]):
        own = comp[a:b].copy()
        left, right = np.flatnonzero(side[a:b] != 1), np.flatnonzero(side[a:b] != 0)
        for i in right:
            j = left[(own[left] != own[i]) & (np.minimum(n[a + left], n[a + i]) >= SIMILAR * np.maximum(n[a + left], n[a + i]))]
            j = j[(marks[a + j] == marks[a + i]).mean(axis=1) >= ESTIMATE] if len(j) else j
            j = j[(bands[a + j] == bands[a + i]).argmax(axis=1) == band[a + i]] if len(j) else j
            if len(j):
                yield a, i, own, j


def _hopeful(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """The rows that may be similar to one of another component."""
    on = np.zeros(rows.num_rows, bool)
    for a, i, _, j in _likely_in(rows, starts):
        on[a + i] = on[a + j] = True
    return rows.filter(pa.array(on)).combine_chunks().to_batches()[0] if on.any() else pa.RecordBatch.from_pylist([], rows.schema)


def _close(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Verified links of rows with text; none once a link has joined the components."""
    node, text = rows.column("node").to_numpy(), rows.column("text")
    found: list[tuple[int, int]] = []
    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    block = -1
    for a, i, own, j in _likely_in(rows, starts):
        if a != block:
            block, bags = a, {}
        for k in j:
            if own[k] == own[i]:
                continue
            for x in (i, k):
                if x not in bags:
                    bags[x] = shingles(normal(text[a + x].as_py()))
            if similarity(bags[i], bags[k]) >= SIMILAR:
                found.append((max(node[a + i], node[a + k]), min(node[a + i], node[a + k])))
                own[own == own[k]] = own[i]
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _across(rows: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links between components of the buckets of rows (key, band, node, comp, n, marks, bands).

    In a bucket the largest component is one side, all others the other. Both are dealt into blocks and
    every block of the others meets each block of the largest and each of the others, once. Signatures
    are dealt first; only rows that have a likely partner are dealt again with their texts.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    buckets = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(F.greatest(n, F.lit(1)) / BLOCK).cast("long")
    buckets = cut(buckets.select("key", F.col("top.comp").alias("main"), blocks(F.col("top.c")).alias("mains"), blocks(F.col("all") - F.col("top.c")).alias("others")), "buckets")
    rows = rows.join(buckets, "key")
    main = F.col("comp") == F.col("main")
    at = F.pmod(F.xxhash64("node"), F.when(main, F.col("mains")).otherwise(F.col("others")))
    meets = F.when(main, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.col("at").alias("l"), o.alias("r"), F.lit(0).alias("side"))))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: F.struct(k.alias("l"), F.col("at").alias("r"), F.lit(1).alias("side")))
    # among the others: blocks -1-i and j with i <= j; a row of both sides of its own block is on side 2
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct((-1 - F.least(o, F.col("at"))).alias("l"), F.greatest(o, F.col("at")).alias("r"), F.when(o == F.col("at"), 2).when(o > F.col("at"), 0).otherwise(1).alias("side")))
    dealt = rows.withColumn("at", at).withColumn("m", F.explode(meets.otherwise(F.concat(with_main, among))))
    dealt = dealt.select("key", "m.l", "m.r", "m.side", "node", "comp", "n", "band", "marks", "bands")
    in_blocks = lambda df: df.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")
    hopeful = cut(in_blocks(dealt).mapInArrow(lambda b: _blocks(b, _hopeful), _ROW), "hopeful")
    texts = _texts(docs, reps, hopeful.select("node"))
    return in_blocks(hopeful.join(texts, "node").select(*hopeful.columns, "text")).mapInArrow(lambda b: _blocks(b, _close), "a long, b long")


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) for every document with words, equal normalised texts being one node, and verified links (a, b) that join all nodes of a class."""
    sign = cut(signed(docs), "signed")
    first = sign.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash", "n", "bands", "marks")).alias("r"))
    reps = cut(first.select(F.monotonically_increasing_id().alias("node"), "print", "r.*"), "reps")
    member = sign.select("doc_id", "text_hash", "print").distinct().join(reps.select("print", "node"), "print")
    member = cut(member.select("doc_id", "text_hash", "node"), "members")
    rows = reps.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    shared = cut(rows.join(buckets, "key"), "shared")
    pairs = shared.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    marks = reps.select("node", "n", "marks")
    pairs = pairs.join(marks.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma")), "a")
    pairs = pairs.join(marks.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb")), "b")
    likely = cut(pairs.where(F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")).select("a", "b", "ma", "mb").mapInArrow(_likely, "a long, b long"), "likely")
    links = _verified(likely, docs, reps)
    comps = components(links)
    known = shared.drop("b").join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = cut(known, "known")
    mixed = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_rows = known.join(mixed, "key", "left_semi").join(reps.select("node", "n", "marks", "bands"), "node")
    return member, links.unionByName(cut(_across(cut(open_rows, "open"), docs, reps), "across"))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ma, mb) whose signatures agree well enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, M) for k in (2, 3))
        ok = pa.array((x == y).mean(axis=1) >= ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size, kept, text_hash.

    A class is a connected component under weighted Jaccard similarity of at least 0.8 of the counts of
    five-word shingles, words being lower-cased runs without white space. Texts of under five words are
    one shingle. Null and empty texts have none and are classes of their own, as are rows without
    doc_id, whose class_id is null. Rows are told apart by doc_id and text: those that repeat both share
    a verdict, and of different texts under one doc_id each has its own, the one of the smaller
    text_hash (Spark's xxhash64 of the text) being the first. class_size counts rows that differ.
    Other columns are not read. No rows in, no rows out.
    """
    member, links = near_links(docs)
    comps = components(links)
    classes = member.join(comps.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "text_hash", F.coalesce("comp", "node").alias("comp"))
    classes = cut(classes, "classes")
    sizes = cut(classes.groupBy("comp").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("doc_id", "text_hash")).alias("first")), "sizes")
    classes = classes.join(sizes, "comp").drop("comp")
    every = keyed(docs).drop("text").join(classes, ["doc_id", "text_hash"], "left")
    kept = F.coalesce(F.struct("doc_id", "text_hash") == F.col("first"), F.lit(True))
    return every.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), kept.alias("kept"), "text_hash")
