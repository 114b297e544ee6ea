"""Ranked search over all documents by integer scores, with an index of shards that are visited by their bounds.

Building. Documents become vectors of terms. Recursive bisection orders them so that alike ones are near: halves
of a set trade documents while that lowers the logarithms of gaps that their terms' lists would have. A tree is
fitted to SAMPLE documents (a fixed bound; terms hashed to FEATURES), which splits the collection into at most
LEAVES parts; every document is routed down it, parts are dealt into chunks of about POSTINGS postings, and each
chunk is bisected on its own documents down to shards of SHARD. All documents are indexed, in any number of chunks.

Searching. The bound of a shard is the sum of a query's weights times the largest impact of each term in it. The
FIRST shards of each query by bound are visited, which gives the score of its tenth document so far; then, of the
SECOND by bound, those whose bound reaches that score, which raises it; then any others whose bound still reaches it,
ties included, for an equal score may have a smaller doc_id. The rest can't hold a result. Shards stay where they are: bounds are worked out beside them, and only numbers of queries and shards
and a few results for each go through shuffles. Queries go to the tasks in batches of about PAIRS pairs of query
and term; a batch is a pass over the bounds, so any number of queries is served.

Documents without a term, null texts among them, don't count. Each row of documents is a document and each row of
items an item, rows that repeat an id too; null ids stay null, and a null doc_id comes last among equal scores. Very long texts are
split at the ends of words. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, forget, small_batches

#: The tree: documents it is fitted to (in expectation, twice as many at most), features that terms are hashed to, parts at most, and documents of a part.
SAMPLE, FEATURES, LEAVES, PART = 2048, 1 << 14, 64, 1024
#: Postings of a chunk, documents of a shard, and rounds of trades at each level.
POSTINGS, SHARD, ROUNDS = 400_000, 64, 3
#: Shards that a query visits at once and those looked at next, documents it returns, and pairs of query and term of a batch.
FIRST, SECOND, TOP, PAIRS = 8, 96, 10, 500_000
#: Terms that a task counts before it passes the counts on.
HELD = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP = 1 << 20


def terms_of(text: str | None) -> Counter:
    """The terms of a text and how often each occurs."""
    low = (text or "").encode("utf-8", "replace").translate(_LOWER)
    if len(low) <= _STEP:
        return Counter(_TERM.findall(low))
    found, at = Counter(), 0
    while at < len(low):
        to = at + _STEP
        while to < len(low) and _TERM.match(low, to - 1, to) and _TERM.match(low, to, to + 1):
            to += 1
        found.update(_TERM.findall(low[at:to]))
        at = to
    return found


def _packed(terms: list[bytes], *numbers: np.ndarray) -> bytes:
    """Terms and lists of 32-bit numbers as one compressed value."""
    parts = [np.asarray(x, np.int32).tobytes() for x in numbers]
    text = b"\n".join(terms)
    sizes = np.array([len(x) for x in (*parts, text)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join((bytes([len(sizes)]), sizes.tobytes(), *parts, text)))


def _unpacked(value: bytes) -> tuple:
    """The lists of numbers and the terms of _packed()."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes = np.frombuffer(raw, np.int64, raw[0], 1)
    ends = 1 + 8 * raw[0] + np.cumsum(sizes)
    numbers = [np.frombuffer(raw, np.int32, n // 4, e - n) for n, e in zip(sizes[:-1].tolist(), ends[:-1].tolist())]
    return *numbers, raw[ends[-1] - sizes[-1] : ends[-1]].split(b"\n")


def _features(terms: list[bytes]) -> np.ndarray:
    return np.unique(np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % FEATURES)


def _trade(seg: np.ndarray, side: np.ndarray, doc: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, bool]:
    """One round: in each segment the documents that gain most by changing sides change them, pair by pair."""
    n_seg = int(seg.max()) + 1
    key, right = seg[doc] * n_terms + term, side[doc]
    r = np.bincount(key[right == 1], minlength=n_seg * n_terms)
    left = (np.bincount(key, minlength=n_seg * n_terms) - r).astype(np.int32)[key]
    r = r.astype(np.int32)[key]
    log = np.log2(np.arange(1, len(seg) + 3)).astype(np.float32)  # of a count and one; which documents are near needs no more digits
    nl, nr = (log[np.maximum(1, np.bincount(seg[side == s], minlength=n_seg)) - 1][seg[doc]] for s in (0, 1))
    cost = lambda a, b: a * (nl - log[a]) + b * (nr - log[b])
    over = (1 - 2 * right).astype(np.int32)  # what the right half gains if this document changes sides
    gain = np.bincount(doc, cost(left, r) - cost(left - over, r + over), len(seg))
    order = np.lexsort((-gain, side, seg))
    block = (seg * 2 + side)[order]
    begin = np.searchsorted(block, np.arange(2 * n_seg + 1))
    pairs = np.minimum(np.diff(begin)[0::2], np.diff(begin)[1::2])
    at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    a, b = order[np.repeat(begin[0:-1:2], pairs) + at], order[np.repeat(begin[1::2], pairs) + at]
    swap = gain[a] + gain[b] > 1e-9
    side = side.copy()
    side[a[swap]], side[b[swap]] = 1, 0
    return side, bool(swap.any())


def bisected(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int, rounds: int = ROUNDS) -> np.ndarray:
    """The path of each document through levels of bisection, as a number whose bits are its sides.

    Terms of one document, or of more than half of all, don't tell documents apart and have no say.
    """
    many = np.bincount(term, minlength=n_terms)
    on = (many > 1) & (2 * many <= n_docs)
    telling = on[term]
    doc, term, n_terms = doc[telling], (np.cumsum(on) - 1)[term[telling]], int(on.sum())
    seg = np.zeros(n_docs, np.int64)
    for _ in range(levels):
        place = np.argsort(seg, kind="stable")
        first = np.searchsorted(seg[place], np.arange(int(seg.max(initial=0)) + 2))
        rank = np.empty(n_docs, np.int64)
        rank[place] = np.arange(n_docs) - first[seg[place]]
        side = (rank >= (np.diff(first)[seg] + 1) // 2).astype(np.int64)
        for _ in range(rounds if n_terms else 0):
            side, moved = _trade(seg, side, doc, term, n_terms)
            if not moved:
                break
        seg = seg * 2 + side
    return seg


def _levels(n: int, size: int) -> int:
    return max(0, (max(1, -(-n // size)) - 1).bit_length())


def _fitted(sample: list[np.ndarray], levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and thresholds by node of a tree: a document goes right if its weights exceed the threshold."""
    nodes = (1 << levels) - 1
    weights, limits = np.zeros((max(1, nodes), FEATURES), np.float32), np.zeros(max(1, nodes), np.float32)
    if not sample or not nodes:
        return weights, limits
    doc, term = np.repeat(np.arange(len(sample)), [len(x) for x in sample]), np.concatenate(sample).astype(np.int64)
    path = bisected(doc, term, len(sample), FEATURES, levels)
    for level in range(levels):
        upper = path >> (levels - level)
        right = (path >> (levels - level - 1)) & 1
        for k in range(1 << level):
            node = (1 << level) - 1 + k
            inside = upper == k
            l, r = (np.bincount(term[(inside & (right == s))[doc]], minlength=FEATURES) for s in (0, 1))  # noqa: E741
            nl, nr = np.sum(inside & (right == 0)), np.sum(inside & (right == 1))
            weights[node] = np.log((r + 0.5) / (nr + 1)) - np.log((l + 0.5) / (nl + 1))
            scores = np.bincount(doc, weights[node][term], len(sample))[inside]
            limits[node] = np.median(scores) if len(scores) else 0
    return weights, limits


def _index_of_chunk(n_all: int, length: int):
    """A function that orders a chunk's documents and gives its shards: postings, and the largest impact of each term."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n"], na_position="last", ignore_index=True)
        counts, terms = zip(*map(_unpacked, rows["vector"]))
        doc = np.repeat(np.arange(len(rows)), [len(x) for x in terms])
        counts = np.concatenate(counts).astype(np.int64)
        term, names = pd.factorize(np.array([t for x in terms for t in x], object), sort=True)
        path = bisected(doc, term, len(rows), len(names), _levels(len(rows), SHARD))
        impact = _impact(counts, _spread(rows["n"].to_numpy(np.int64), n_all, length)[doc])
        order = np.lexsort((doc, term, path[doc]))
        doc, term, counts, impact = doc[order], term[order], counts[order], impact[order]
        ends = np.searchsorted(path[doc], np.arange(path.max() + 2))
        out = []
        for shard in np.unique(path):
            members, here = np.flatnonzero(path == shard), slice(ends[shard], ends[shard + 1])
            t, starts = np.unique(term[here], return_index=True)
            said = [names[x] for x in t]
            ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"].iloc[members]]
            bound = _packed(said, np.maximum.reduceat(impact[here], starts))
            posting = _packed([], np.append(starts, len(term[here])), np.searchsorted(members, doc[here]), counts[here])
            out.append((rows["chunk"].iloc[0], int(shard), bound, posting, ids, rows["n"].iloc[members].tolist()))
        return pd.DataFrame(out, columns=["chunk", "shard", "bound", "posting", "doc_ids", "lengths"])

    return run


def _spread(n: np.ndarray, n_all: int, length: int) -> np.ndarray:
    return 25 + (75 * n * n_all) // max(1, length)


def _impact(times: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a document's score, less than a million."""
    return (1_000_000_000 * times) // (1000 * times + 8 * spread)


_INDEX = "chunk string, shard long, bound binary, posting binary, doc_ids array<long>, lengths array<long>"


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Index:
    """Written tables: shards with their bounds and postings, and in how many documents each term is."""

    def __init__(self, shards: DataFrame, frequencies: DataFrame, documents: int, length: int):
        self.shards, self.frequencies, self.documents, self.length = shards, frequencies, documents, length


def _vectors(docs: DataFrame, tree, levels: int) -> DataFrame:
    """doc_id, n, load (terms), leaf and vector (counts and terms) of the documents that have a term; tree is a broadcast one."""

    def run(parts):
        weights, limits = tree.value
        for part in parts:
            out, found = [], []
            for d, text in zip(part["doc_id"], part["text"]):
                counted = terms_of(text)
                if counted:
                    terms = sorted(counted)
                    found.append(_features(terms))
                    out.append((d, counted.total(), len(terms), _packed(terms, np.fromiter((counted[t] for t in terms), np.int32, len(terms)))))
            node = np.zeros(len(out), np.int64)
            if out:
                doc, term = np.repeat(np.arange(len(out)), [len(x) for x in found]), np.concatenate(found)
                for _ in range(levels):
                    node = 2 * node + 1 + (np.bincount(doc, weights[node[doc], term], len(out)) > limits[node])
            yield pd.DataFrame({"doc_id": pd.array([x[0] for x in out], object), "n": [x[1] for x in out], "load": [x[2] for x in out], "leaf": node, "vector": pd.array([x[3] for x in out], object)})

    # ids go as text, since numbers with nulls would lose digits
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, n long, load long, leaf long, vector binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def _frequencies(vectors_: DataFrame) -> DataFrame:
    """term and df; tasks pass on counts of many documents."""

    def run(parts):
        held = Counter()
        for part in parts:
            for v in part["vector"]:
                held.update(_unpacked(v)[-1])
                if len(held) >= HELD:
                    yield pd.DataFrame({"term": [t.decode("utf-8", "replace") for t in held], "df": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"term": [t.decode("utf-8", "replace") for t in held], "df": list(held.values())})

    return vectors_.select("vector").mapInPandas(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def build(docs: DataFrame) -> Index:
    """The index of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.count()
    levels = min(_levels(total, PART), _levels(LEAVES, 1))
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, total)) * (1 << 30)
    features = docs.where(share).select("text").limit(2 * SAMPLE).mapInPandas(lambda parts: (pd.DataFrame({"f": [_features(list(terms_of(t))).astype(np.int32) for t in p["text"]]}) for p in parts), "f array<int>")
    sample = [np.array(r.f) for r in features.collect() if r.f] if levels else []
    tree = spark.sparkContext.broadcast(_fitted(sample, levels))
    made = cut(_vectors(docs, tree, levels), "vectors")
    n_all, length = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = cut(_frequencies(made), "df")

    loads = made.groupBy("leaf").agg(F.ceil(F.greatest(F.sum("load") / POSTINGS, F.count(F.lit(1)) / (2 * PART))).alias("_slices"))  # LEAVES rows
    slice_ = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_slices"))
    chunks = made.join(F.broadcast(loads), "leaf").withColumn("chunk", F.concat_ws("-", "leaf", slice_)).select("chunk", "doc_id", "n", "vector")
    index = cut(chunks.groupBy("chunk").applyInPandas(_index_of_chunk(n_all, length), _INDEX), "index")
    forget(made)
    return Index(index, frequencies, n_all, length)


class _Queries:
    """A batch of queries by term: for each term, the queries that have it and its weight in them."""

    def __init__(self, pairs: pd.DataFrame):
        pairs = pairs.sort_values(["term", "query"], ignore_index=True)
        names, starts = np.unique(pairs["term"].to_numpy(object), return_index=True) if len(pairs) else ([], np.zeros(0, np.int64))
        self.place = {t.encode("utf-8", "replace"): k for k, t in enumerate(names)}
        self.starts = np.append(starts, len(pairs))
        self.numbers = np.unique(pairs["query"].to_numpy(np.int64))
        self.query = np.searchsorted(self.numbers, pairs["query"].to_numpy(np.int64))
        self.weight = pairs["weight"].to_numpy(np.int64)

    def matches(self, terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a shard's term (its place) and a query (its place), with the weight."""
        get = self.place.get
        found = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
        at = np.flatnonzero(found >= 0)
        many = self.starts[found[at] + 1] - self.starts[found[at]]
        pair = np.arange(many.sum()) + np.repeat(self.starts[found[at]] - (np.cumsum(many) - many), many)
        return np.repeat(at, many), self.query[pair], self.weight[pair]


def _bounds(queries: _Queries, bound: bytes) -> np.ndarray:
    tops, terms = _unpacked(bound)
    at, query, weight = queries.matches(terms)
    out = np.zeros(len(queries.numbers), np.int64)
    np.add.at(out, query, weight * tops[at])
    return out


def _scores(queries: _Queries, row, spread: np.ndarray, wanted: np.ndarray, least: np.ndarray) -> list[tuple[int, int | None, int]]:
    """The best documents of a shard for the wanted queries (places), as far as they reach the least scores."""
    at, query, weight = queries.matches(_unpacked(row.bound)[-1])
    starts, docs, counts, _ = _unpacked(row.posting)
    impacts = _impact(counts.astype(np.int64), spread[docs])
    out, order = [], np.argsort(wanted)
    for block in np.array_split(order, max(1, -(-len(order) // 128))):
        mine = wanted[block]
        column = np.searchsorted(mine, query)
        on = mine[np.minimum(column, len(mine) - 1)] == query
        a, c, w = at[on], column[on], weight[on]
        many = starts[a + 1] - starts[a]
        posting = np.arange(many.sum()) + np.repeat(starts[a] - (np.cumsum(many) - many), many)
        scores = np.zeros((len(mine), len(row.doc_ids)), np.int64)
        np.add.at(scores, (np.repeat(c, many), docs[posting]), np.repeat(w, many) * impacts[posting])
        best = np.argsort(-scores, axis=1, kind="stable")[:, :TOP]  # documents are in order of doc_id
        for k, q in enumerate(mine):
            out += [(int(queries.numbers[q]), row.doc_ids[d], int(scores[k, d])) for d in best[k] if scores[k, d] > 0 and scores[k, d] >= least[block[k]]]
    return out


def _top(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["query", "score", "doc_id"], ascending=[True, False, True], na_position="last").groupby("query", sort=False).head(TOP)


def _visited(index: Index, visits: DataFrame, pairs) -> DataFrame:
    """query, doc_id and score of the best documents that a task finds in visited shards; visits: query, chunk, shard, bound, least.

    A task goes on with the scores that it has found: a shard whose bound doesn't reach a query's tenth is passed over.
    """
    n_all, length = index.documents, index.length
    by_shard = cut(visits.groupBy("chunk", "shard").agg(F.collect_list(F.struct("query", "bound", "least")).alias("wanted")), "visits")  # queries of a batch at most
    few = (by_shard.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_ROWS  # else shards are shuffled to them

    def run(parts):
        queries = _Queries(pairs.value)
        reach = np.ones(len(queries.numbers), np.int64)
        best = pd.DataFrame({"query": np.zeros(0, np.int64), "doc_id": pd.array([], "Int64"), "score": np.zeros(0, np.int64)})
        for part in parts:
            out = []
            for row in part.itertuples():
                at = np.searchsorted(queries.numbers, np.array([w["query"] for w in row.wanted], np.int64))
                least = np.maximum(reach[at], np.array([w["least"] for w in row.wanted], np.int64))
                on = np.array([w["bound"] for w in row.wanted], np.int64) >= least
                if on.any():
                    row = row._replace(doc_ids=[None if pd.isna(x) else int(x) for x in row.doc_ids])
                    out += _scores(queries, row, _spread(np.array(row.lengths, np.int64), n_all, length), at[on], least[on])
            found = pd.DataFrame({"query": [x[0] for x in out], "doc_id": pd.array([x[1] for x in out], "Int64"), "score": [x[2] for x in out]})
            best = _top(pd.concat([best, found]))
            full = best.groupby("query")["score"].agg(["size", "min"]).query(f"size == {TOP}")
            reach[np.searchsorted(queries.numbers, full.index.to_numpy(np.int64))] = full["min"].to_numpy(np.int64)
        yield best

    rows = index.shards.join(F.broadcast(by_shard) if few else by_shard, ["chunk", "shard"])
    return rows.select("bound", "posting", "doc_ids", "lengths", "wanted").mapInPandas(run, "query long, doc_id long, score long")


def _terms_of_queries(parts):
    for part in parts:
        found = [(q, t.decode("utf-8", "replace"), n) for q, text in zip(part["query"], part["text"]) for t, n in terms_of(text).items()]
        yield pd.DataFrame(found, columns=["query", "term", "times"])


def _best(results: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def search(index: Index, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the TOP best documents of each of items (item_id, text)."""
    spark = items.sparkSession
    rows = cut(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("query")), "items")
    terms = rows.select("query", "text").mapInPandas(_terms_of_queries, "query long, term string, times long")
    ratio = F.lit(2.0 * index.documents + 2) / (2.0 * F.col("df") + 1)
    weight = F.floor(1000 * F.log(ratio)).cast("long")
    pairs = cut(terms.join(index.frequencies, "term").select("query", "term", (weight * F.col("times")).alias("weight")), "pairs")
    batches = max(1, -(-pairs.count() // PAIRS))
    found = []
    for k in range(batches):
        found.append(_batch(spark, index, pairs.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == k)))
    results = found[0]
    for more in found[1:]:
        results = results.unionByName(more)
    return rows.select("query", "item_id").join(results, "query").select("item_id", "rank", "doc_id", "score")


def _batch(spark: SparkSession, index: Index, pairs: DataFrame) -> DataFrame:
    """Results of a batch of queries, whose pairs (about PAIRS) go to all tasks."""
    sent = spark.sparkContext.broadcast(pairs.toPandas())

    def first(parts):
        queries, kept = _Queries(sent.value), None
        for part in parts:
            found = [] if kept is None else [kept]
            for row in part.itertuples():
                bound = _bounds(queries, row.bound)
                on = np.flatnonzero(bound > 0)
                found.append(pd.DataFrame({"query": queries.numbers[on], "chunk": row.chunk, "shard": row.shard, "bound": bound[on]}))
            kept = pd.concat(found).sort_values(["bound", "chunk", "shard"], ascending=[False, True, True]).groupby("query").head(SECOND)
        if kept is not None:
            yield kept

    order = Window.partitionBy("query").orderBy(F.desc("bound"), "chunk", "shard")
    with _batches_of(spark, 64):
        bounds = index.shards.select("chunk", "shard", "bound")
        near = bounds.mapInPandas(first, "query long, chunk string, shard long, bound long").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SECOND)
        near = cut(near, "near")
        one = F.lit(1).cast("long").alias("least")
        seen = cut(_best(_visited(index, near.where(F.col("k") <= FIRST).select("query", "chunk", "shard", "bound", one), sent)), "seen")
        tenth = seen.where(F.col("rank") == TOP).select("query", F.col("score").alias("_tenth"))
        again = near.where(F.col("k") > FIRST).join(tenth, "query", "left").select("query", "chunk", "shard", "bound", F.coalesce("_tenth", one).alias("least"))
        seen = cut(_best(seen.drop("rank").unionByName(_visited(index, again.where("bound >= least"), sent))), "seen")
        # numbers of a batch's queries: the score to reach, and the last shard that was looked at in order of bounds, where there are more
        reached = {r["query"]: r["score"] for r in seen.where(F.col("rank") == TOP).select("query", "score").collect()}
        last = {r["query"]: (r["bound"], r["chunk"], r["shard"]) for r in near.where(F.col("k") == SECOND).select("query", "bound", "chunk", "shard").collect()}
        open_ = {q: (x, reached.get(q, 1)) for q, x in last.items() if x[0] >= reached.get(q, 1)}
        if not open_:
            return seen
        told = spark.sparkContext.broadcast(open_)

        def rest(parts):
            queries, open_ = _Queries(sent.value), told.value
            asked = np.flatnonzero(np.isin(queries.numbers, list(open_)))
            limits = [open_[q] for q in queries.numbers[asked].tolist()]
            least, high = np.array([x[1] for x in limits], np.int64), np.array([x[0][0] for x in limits], np.int64)
            for part in parts:
                out = []
                for row in part.itertuples():
                    bound = _bounds(queries, row.bound)[asked]
                    behind = np.array([(row.chunk, row.shard) > x[0][1:] for x in limits])
                    at = np.flatnonzero((bound >= least) & ((bound < high) | ((bound == high) & behind)))
                    out.append(pd.DataFrame({"query": queries.numbers[asked[at]], "chunk": row.chunk, "shard": row.shard, "bound": bound[at], "least": least[at]}))
                if out:
                    yield pd.concat(out)

        others = bounds.mapInPandas(rest, "query long, chunk string, shard long, bound long, least long")
        return cut(_best(seen.drop("rank").unionByName(_visited(index, others, sent))), "found")
