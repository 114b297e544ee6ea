"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more coordinate that gives all one length, so that the largest inner product is the
smallest distance on a sphere. A bounded sample is halved again and again at the median along its main
direction; the parts' means, moved out to the sphere, are the centroids, as many as the vectors need for
lists of one size. Centroids form a neighbour graph in memory that a beam search walks. A vector near
the boundary of its nearest list goes to all lists almost as near. A query reads the lists within a ratio of
its nearest one's distance, however many those are: few where vectors are clustered, a larger share where
they point evenly in all directions. Where those hold too few vectors, the ratio is taken from the list
with which there are enough. Neighbouring lists are searched together in blocks of a bounded number of vectors, so that
a vector is sent to a block once and a query, which goes to the blocks of its lists alone, brings one result
back from each; only a list that alone has more is dealt out. One rule holds at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

K, EVERY = 20, 20
#: Vectors of a list, before copies; and how much memory the centroids may take, beyond which lists grow, in blocks.
LIST, CENTROID_BYTES = 64, 32 << 20
#: Vectors of the sample for each centroid, and how much memory they may take.
SAMPLE, SAMPLE_BYTES = 16, 256 << 20
DEGREE, BEAM = 24, 32
#: Rows times centroids that a search keeps a mark for.
MARKS = 32 << 20
#: Lists that a vector goes to, at most, and how much farther than its nearest they may be (distances).
COPIES, NEAR = 8, 1.25
#: A query reads the lists within RATIO times the nearest one's distance; where those don't hold FILL times the vectors that it
#: wants, since its own are few and close, the lists within WIDE times the distance of the one with which they do.
RATIO, FILL, WIDE = 1.24, 3, 1.3
#: Parts that lists are dealt to in their order, at least, and vectors or queries of a block within one.
GROUPS, BLOCK = 64, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part; of vectors under one vec_id the smallest, number by number."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<float>" if kind == "float" else "array<double>").alias("vector"))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def of_one_width(rows: DataFrame) -> DataFrame:
    """The rows (vec_id, vector) of the width that most have, of equally many the wider."""
    found = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows if found is None else rows.where(F.size("vector") == found["width"])


def centroids(sample: np.ndarray, parts: int, radius: float) -> np.ndarray:
    """Means of the parts of sample, all halved at the median of their main direction until there are enough, moved out to the radius."""
    whole = [sample]
    while len(whole) < parts and len(whole[0]) > 1:
        halves = []
        for part in whole:
            off = part - part.mean(axis=0)
            axis = np.ones(part.shape[1], part.dtype)
            for _ in range(8):
                axis = off.T @ (off @ axis)
                axis /= np.linalg.norm(axis) or 1.0
            order = np.argsort(off @ axis, kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        whole = halves
    means = np.array([p.mean(axis=0, dtype=np.float64) for p in whole if len(p)])
    size = np.linalg.norm(means, axis=1, keepdims=True)
    return (means * np.where(size > 0, radius / np.where(size > 0, size, 1), 1)).astype(np.float32)


class Graph:
    """Centroids with edges to their nearest ones and back."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        self.size = (points**2).sum(axis=1)
        k = min(DEGREE, n - 1)
        near = np.zeros((n, k), np.int64)
        for a in range(0, n, 1024):
            d = self.size - 2 * points[a : a + 1024] @ points.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
        # long edges keep the graph in one piece
        far = (np.arange(n)[:, None] + np.unique(np.geomspace(1, max(1, n - 1), 8).astype(int))[None, :]) % n
        self.edges = np.hstack([near, far]).astype(np.int32)
        self.start = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the beam's centroids, nearest first, and their distances."""
        beam = min(beam, len(self.points))
        rows = np.arange(len(x))[:, None]
        square = (x**2).sum(axis=1)[:, None]
        dist = lambda ids: square + self.size[ids] - 2 * np.einsum("bd,bkd->bk", x, self.points[ids])
        ids = np.broadcast_to(self.start, (len(x), len(self.start))).copy()
        far, done = dist(ids), np.zeros(ids.shape, bool)
        seen = np.zeros((len(x), len(self.points)), bool)
        seen[rows, ids] = True
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = ids[rows, order], far[rows, order], done[rows, order]
            live = np.flatnonzero(~(done | np.isinf(far)).all(axis=1))
            if not len(live):
                return ids, np.sqrt(np.maximum(far, 0))
            # each row that isn't done opens its nearest few
            at = np.argsort(done[live] | np.isinf(far[live]), axis=1, kind="stable")[:, : max(4, beam // 8)]
            done[live[:, None], at] = True
            new = np.sort(self.edges[ids[live[:, None], at]].reshape(len(live), -1), axis=1)
            again = seen[live[:, None], new]
            again[:, 1:] |= new[:, 1:] == new[:, :-1]
            seen[live[:, None], new] = True
            d = square[live] + self.size[new] - 2 * np.einsum("bd,bkd->bk", x[live], self.points[new])
            d[again] = np.inf
            short = np.argsort(d, axis=1, kind="stable")[:, :beam]
            wide = np.zeros((len(x), short.shape[1]), ids.dtype)
            wide[live] = np.take_along_axis(new, short, 1)
            off = np.full(wide.shape, np.inf)
            off[live] = np.take_along_axis(d, short, 1)
            ids, far, done = np.hstack([ids, wide]), np.hstack([far, off]), np.hstack([done, np.zeros(wide.shape, bool)])

    def within(self, x: np.ndarray, ratio: float, most: int | None = None, held: np.ndarray | None = None, need: float = 0) -> list[np.ndarray]:
        """For each row the centroids found within ratio times a distance, nearest first, most of them at most.

        The distance is the nearest one's; with held (vectors of each list), where the lists that near don't hold need,
        it is that of the list with which they do, and WIDE the ratio. Where all of the beam is that near, a wider one goes out.
        """
        out: list = [None] * len(x)
        step = max(16, MARKS // len(self.points))
        for a in range(0, len(x), step):
            todo, beam = np.arange(a, min(a + step, len(x))), BEAM
            while len(todo):
                ids, far = self.search(x[todo], beam)
                limit, reached = far[:, :1] * ratio, np.ones(len(far), bool)
                if held is not None:
                    there = np.isfinite(far)
                    enough = there & (np.cumsum(np.where(there, held[ids], 0), axis=1) >= need)
                    reached = enough.any(axis=1)
                    last = np.where(reached, enough.argmax(axis=1), there.sum(axis=1) - 1)
                    filled = np.take_along_axis(far, last[:, None], 1)
                    limit = np.where(filled <= limit, limit, filled * WIDE)
                limit = limit + 1e-6
                short = reached & (far[:, -1] > limit[:, 0]) | (beam >= len(self.points)) | (most is not None and beam >= 2 * most)
                for i, found, d, m in zip(todo[short], ids[short], far[short], limit[short]):
                    out[i] = found[(d <= m) & np.isfinite(d)][:most]
                todo, beam = todo[~short], beam * 4
        return out


def _reading(lists_: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Lists and the rows that have them, sorted by list."""
    size = np.array([len(x) for x in lists_])
    flat = np.concatenate(lists_.to_list())
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(size)), size)[order]


def _nearest(asked, q, ids, v, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, of v and the scores of the k nearest of each query, and of those that tie with the last."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ v.T
        beyond = np.nonzero(~np.isfinite(s))
        if len(beyond[0]):  # where it matters in which order is added
            s[beyond] = np.add.accumulate(v[beyond[1]] * q[beyond[0]], axis=1)[:, -1]
    own = asked[:, None] == ids
    s[np.isnan(s)] = -np.inf
    s[own] = -np.inf
    k = min(k, len(ids))
    least = np.partition(s, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
    slack = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(least), least, 0)))
    row, col = np.nonzero((s >= least - slack) & ~own)
    # one order of additions, so that equal vectors tie
    with np.errstate(over="ignore", invalid="ignore"):
        return row, col, np.add.accumulate(v[col] * q[row], axis=1)[:, -1] if len(row) else np.zeros(0)


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to the smaller id; an id counts once."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, score = row[new], ids[new], score[new]
    on = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[on], ids[on], score[on]


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest vectors for each query among those of one block that are in the lists it reads."""
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    vectors = vectors.sort_values("vec_id")
    ids, v = vectors["vec_id"].to_numpy(), np.stack(vectors["vector"]).astype(np.float64)
    asked, q = queries["vec_id"].to_numpy(), np.stack(queries["vector"]).astype(np.float64)
    (wanted, reader), (list_, member) = _reading(queries["lists"]), _reading(vectors["lists"])
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    held: list[tuple] = []
    for number in np.unique(list_):
        readers = reader[slice(*np.searchsorted(wanted, [number, number + 1]))]
        members = member[slice(*np.searchsorted(list_, [number, number + 1]))]
        for a in range(0, len(readers), 64):
            rows = readers[a : a + 64]
            row, col, score = _nearest(asked[rows], q[rows], ids[members], v[members], k)
            held.append(_first(rows[row], ids[members[col]], score, k))
        if sum(len(h[0]) for h in held) > 200_000:
            best = _first(*(np.concatenate(x) for x in zip(best, *held)), k)
            held = []
    row, vec, score = _first(*(np.concatenate(x) for x in zip(best, *held)), k)
    return pd.DataFrame({"query_id": asked[row], "vec_id": vec, "score": score})


def scaled(rows: DataFrame) -> DataFrame:
    """rows with vectors over the largest component of all, so that no square of one is beyond a double."""
    top = rows.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()[0]
    return rows if top is None else rows.withColumn("vector", F.transform("vector", lambda x: (x.cast("double") / F.lit(top)).cast("float")))


def index(rows: DataFrame) -> tuple[Graph | None, float]:
    """The graph of centroids for rows (vec_id, vector) of scaled(), and the square of the largest length."""
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.max(F.size("vector")).alias("width")).first()
    if not total["n"]:
        return None, 0.0
    wide = 4 * (total["width"] + 1)
    parts = max(1, min(-(-total["n"] // LIST), CENTROID_BYTES // wide))
    size = min(parts * SAMPLE, SAMPLE_BYTES // wide)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1.0, size / total["n"]) * (1 << 30))
    flat = chosen.select("vector").toArrow().column(0).combine_chunks()
    sample = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, total["width"])
    if not len(sample):  # so few rows that none was chosen
        sample = np.array([rows.first()["vector"]], np.float32)
    return Graph(centroids(lifted(sample, total["top"]), parts, total["top"] ** 0.5)), total["top"]


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x.astype(np.float64) ** 2).sum(axis=1), 0))[:, None]]).astype(np.float32)


def aimed(x: np.ndarray, top: float) -> np.ndarray:
    """Queries on the same sphere: they have no part of their own in the added coordinate, and their length changes no order."""
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x *= top**0.5 / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)


class Blocks:
    """Blocks of neighbouring lists: the first list of each, and into how many slices its vectors are dealt."""

    def __init__(self, counts: np.ndarray):
        """counts: vectors of each list, copies included. Blocks end at the borders of GROUPS equal parts, or where BLOCK vectors are reached."""
        wide, starts, slices = -(-len(counts) // GROUPS), [], []
        room = 0
        for k, n in enumerate(counts.tolist()):
            if k % wide == 0 or n > room:
                starts.append(k)
                slices.append(max(1, -(-n // BLOCK)))
                room = BLOCK
            room -= n
        self.starts, self.slices = np.array(starts, np.int32), np.array(slices, np.int32)

    def of(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, number, side="right").astype(np.int32) - 1


def posted(rows: DataFrame, graph: Graph, top: float) -> DataFrame:
    """vec_id and lists: where vectors (vec_id, vector) of scaled() go to."""
    return _lists(rows, graph, lambda g, x: g.within(lifted(x, top), NEAR, COPIES))


def asked(rows: DataFrame, graph: Graph, top: float, held: np.ndarray, k: int) -> DataFrame:
    """vec_id and lists: what queries (vec_id, vector) of scaled() read; held are the vectors of each list, a copy counting in part."""
    return _lists(rows, graph, lambda g, x: g.within(aimed(x, top), RATIO, None, held, FILL * k))


def _lists(rows: DataFrame, graph: Graph, find) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float32)
                found = [np.sort(f).astype(np.int32) for f in find(shared.value, x)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["vec_id", "lists"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, lists array<int>")


def by_block(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """block, slices, vec_id and lists: a row of rows (vec_id, lists) for each block that it has lists of."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column, known = batch.column(1), shared.value
            number, of = column.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            block = known.of(number)
            start = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])]))
            parts = pa.ListArray.from_arrays(pa.array(np.append(start, len(of)).astype(np.int32)), pa.array(number))
            yield pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array(known.slices[block[start]]), batch.column(0).take(pa.array(of[start])), parts], ["block", "vs", "vec_id", "lists"])

    return rows.select("vec_id", "lists").mapInArrow(run, "block int, vs int, vec_id long, lists array<int>")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for vec_ids divisible by every their k nearest others found, by inner product.

    Vectors that are null, zero or hold nulls, NaN or infinities take no part, nor do rows without
    vec_id; vec_id is the key: of several vectors under one the smallest in order of its numbers counts.
    Vectors of another width than most have take no part; of widths that equally many have the larger counts.
    Components may be of any finite size; a score beyond the largest double is infinite, one that is no number
    comes last. Ties go to the smaller vec_id. Other columns are not read. No rows in, no rows out.
    """
    rows = of_one_width(cut(usable(vectors), "vectors"))
    small = cut(scaled(rows), "scaled")
    graph, top = index(small)
    if graph is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = cut(posted(small, graph, top), "posted")
    counts = np.zeros(len(graph.points), np.int64)
    for r in placed.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # a number for each list, CENTROID_BYTES bounds them
        counts[r["list"]] = r["count"]
    blocks, share = Blocks(counts), placed.count() / max(1, counts.sum())
    wanted = cut(asked(small.where(F.col("vec_id") % every == 0), graph, top, counts * share, k), "asked")
    v, q = by_block(placed, blocks), cut(by_block(wanted, blocks), "wanted")
    # queries of a block, in parts; a row for each block, of which there are as many as BLOCK fits into the vectors' copies
    parts = cut(q.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs")), "parts")
    few = parts.count() <= BROADCAST_ROWS
    parts = F.broadcast(parts) if few else parts
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    v = v.join(parts, "block").withColumn("vb", own("vs")).withColumn("qb", other("qs")).join(rows, "vec_id")
    q = q.join(parts, "block").withColumn("qb", own("qs")).withColumn("vb", other("vs")).join(rows.select("vec_id", F.col("vector").alias("vector")), "vec_id")
    keys, held = ["block", "vb", "qb"], ["vec_id", "lists", "vector"]
    best = lambda a, b: _best(a, b, k)
    found = q.select(*keys, *held).groupBy(*keys).cogroup(v.select(*keys, *held).groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    score = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
