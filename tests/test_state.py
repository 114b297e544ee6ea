"""Streams with keyed state give what the batch operators give, however they are cut."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cullspark.operators import identity
from cullspark.plans import catalogue
from cullspark.streaming import state, updates

DIR = "/root/testdata/sf0.001"
UPDATES = "album_id long, photo_id long, seq long, status string, storage_delta long"


def streamed(spark, tmp_path, parts, schema, make, mode="append"):
    """Rows of a stream whose batches are parts, and the figures of each batch."""
    for k, rows in enumerate(parts):
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    rows, figures = [], []
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = make(source).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    q = sink.foreachBatch(lambda df, epoch: rows.extend((epoch, *r) for r in df.collect())).start()
    q.awaitTermination()
    figures = [s["customMetrics"] | {"updated": s["numRowsUpdated"]} for p in q.recentProgress for s in p["stateOperators"]]
    return rows, figures


@pytest.fixture(scope="module")
def photos(spark):
    f = catalogue._album_faces(spark, DIR).where("album_id <= 3")
    rows = f.groupBy("album_id", "photo_id", "captured_at").agg(F.array_sort(F.collect_list(F.struct("face_index", "print", "area"))).alias("faces"))
    return rows.cache(), {tuple(r) for r in identity.cluster_faces(f).collect()}


@pytest.mark.parametrize("cuts", [1, 4])
def test_clusters_in_order_of_arrival(spark, photos, tmp_path, cuts):
    rows, want = photos
    ordered = rows.withColumn("k", F.ntile(cuts).over(__import__("pyspark").sql.Window.partitionBy("album_id").orderBy(F.asc_nulls_first("captured_at"), "photo_id")))
    got, _ = streamed(spark, tmp_path, [ordered.where(F.col("k") == k + 1).drop("k") for k in range(cuts)], rows.schema, state.clustered)
    assert {r[1:] for r in got} == want


def test_clusters_in_order_of_time(spark, photos, tmp_path):
    """Photos come shuffled over batches, and are matched in order of time once the watermark has passed."""
    rows, want = photos
    last = rows.agg(F.max("captured_at")).first()[0]
    parts = [rows.where((F.col("captured_at").isNull() if k == 0 else F.lit(False)) | (F.col("captured_at").isNotNull() & (F.pmod(F.hash("photo_id"), F.lit(3)) == k))) for k in range(3)]
    beyond = spark.createDataFrame([(99, 1, last + 10**11, [(0, [0.5], 1.0)])], rows.schema)
    got, _ = streamed(spark, tmp_path, [*parts, beyond], rows.schema, lambda s: state.clustered(s, "1000 days"))
    assert {r[1:] for r in got if r[1] != 99} == want  # the last one waits for the next


def test_only_touched_clusters_are_written(spark, tmp_path):
    one = lambda p, t, x: (1, p, t, [(0, [x, x], 1.0)])
    schema = "album_id long, photo_id long, captured_at long, faces array<struct<face_index: int, print: array<double>, area: double>>"
    parts = [[one(k, k, float(k)) for k in range(200)], [one(300, 300, 5.0), one(301, 301, 7.0)]]
    got, figures = streamed(spark, tmp_path, [spark.createDataFrame(p, schema) for p in parts], spark.createDataFrame([], schema).schema, state.clustered)
    assert [r[4] for r in got if r[0] == 1] == ["person-6", "person-8"]
    assert [f["updated"] for f in figures[:2]] == [201, 2]  # 200 clusters and the next number, then the two clusters met


@pytest.mark.parametrize("cuts", [1, 5])
def test_counters_equal_the_batch(spark, tmp_path, cuts):
    r = random.Random(cuts)
    rows = [(r.randint(1, 3), r.randint(1, 12), s, r.choice(["pending", "uploading", "uploaded", None]), r.choice([None, 3, 10])) for s in range(150)]
    r.shuffle(rows)
    size = -(-len(rows) // cuts)
    parts = [spark.createDataFrame(rows[k * size : (k + 1) * size], UPDATES) for k in range(cuts)]
    got, _ = streamed(spark, tmp_path, parts, spark.createDataFrame([], UPDATES).schema, state.counters, "update")
    last = {}
    for epoch, album, kind, status, n in sorted(got, key=lambda x: x[0]):
        last[(album, kind, status)] = n
    whole = updates.coalesced(spark.createDataFrame(rows, UPDATES))
    want = {(x.album_id, "status", x.status): x.n for x in whole.where("status is not null").groupBy("album_id", "status").agg(F.count("*").alias("n")).collect()}
    want |= {(x.album_id, "bytes", None): x.n for x in whole.groupBy("album_id").agg(F.sum("storage_delta").alias("n")).collect()}
    assert {k: n for k, n in last.items() if n} == want


def test_counters_stay_at_zero_and_ignore_older_updates(spark, tmp_path):
    parts = [[(1, 1, 5, "uploaded", -7)], [(1, 1, 4, "failed", 2), (1, 2, 1, "pending", None)], [(1, 2, 2, "uploaded", -9)]]
    got, _ = streamed(spark, tmp_path, [spark.createDataFrame(p, UPDATES) for p in parts], spark.createDataFrame([], UPDATES).schema, state.counters, "update")
    assert sorted(got, key=str) == sorted([(0, 1, "status", "uploaded", 1), (0, 1, "bytes", None, 0), (1, 1, "status", "pending", 1), (1, 1, "bytes", None, 2), (2, 1, "status", "pending", 0), (2, 1, "status", "uploaded", 2), (2, 1, "bytes", None, 0)], key=str)


def test_time_and_expiry_exclude_each_other(spark, photos):
    with pytest.raises(ValueError):
        state.clustered(photos[0], "1 day", 1000)


class _Store:
    """State in memory that counts the calls it gets."""

    def __init__(self):
        self.calls, self.maps = 0, {}

    def getMapState(self, name, *schema):
        return _Variable(self, self.maps.setdefault(name, {}))

    getValueState = getMapState


class _Variable:
    def __init__(self, store, held):
        self.store, self.held = store, held

    def _called(self, x):
        self.store.calls += 1
        return x

    exists = lambda self: self._called(() in self.held)
    get = lambda self: self._called(self.held[()])
    update = lambda self, v: self._called(self.held.update({(): v}))
    containsKey = lambda self, k: self._called(k in self.held)
    getValue = lambda self, k: self._called(self.held.get(k))
    updateValue = lambda self, k, v: self._called(self.held.update({k: v}))
    removeKey = lambda self, k: self._called(self.held.pop(k))


def test_counters_keep_photos_in_blocks_that_grow(spark):
    """A batch calls the store by blocks, not by photos, however large an album grows; counts are those of a plain loop."""
    r, store, last, got = random.Random(3), _Store(), {}, {}
    counters = state.PhotoCounters()
    counters.init(store)
    for seq, size in enumerate((1, 30, 500, 3, 4000, 900)):
        ids = r.sample(range(-200, 6000), size)
        rows = pd.DataFrame({"photo_id": ids, "seq": seq, "status": [r.choice(["pending", "uploaded", None]) for _ in ids], "storage_delta": 1})
        last.update(zip(ids, rows["status"]))
        for out in counters.handleInputRows((7,), iter([rows]), None):
            got.update({(k, s): n for _, k, s, n in out.itertuples(index=False)})
        want = {("status", s): sum(x == s for x in last.values()) for s in ("pending", "uploaded")}
        assert {k: n for k, n in got.items() if k[0] == "status" and n} == {k: n for k, n in want.items() if n}
    assert store.calls < 5434 / 2  # updates in all, of which each took two calls or three
    assert max(len(v[0]) for v in store.maps["photos"].values()) < 4 * state._BLOCK
