"""Streams with keyed state: clusters of faces and counters of photos, a state entry for each cluster, photo and counter.

A batch writes the entries that it touches and no others, so what is written follows the batch, not the album.
Both give what the batch operators give, however the stream is cut into batches. Entries may expire when an album
has been still for a while; without that they stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.identity import match_faces

#: Such state is kept in this store alone.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Sets the store that streams with keyed state need; streams that are started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class FaceClusters(StatefulProcessor):
    """Cluster ids of an album's faces. Photos wait until the watermark has passed their time, then come in order of time and id.

    A photo without a time doesn't wait: it is matched when it comes, before those that wait.
    """

    def __init__(self, ordered: bool, ttl_ms: int | None = None):
        self.ordered, self.ttl_ms = ordered, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", "cluster_id string", "print array<double>, area double", self.ttl_ms)
        self.next = handle.getValueState("next", "number long", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "captured_at long, photo_id long", "faces array<struct<face_index: int, print: array<double>, area: double>>", self.ttl_ms)

    def _matched(self, album, photos: list[tuple]) -> pd.DataFrame:
        """Faces of photos (photo_id, faces) in the order given; only clusters that a face met are written."""
        known = {k[0]: (list(v[0]), v[1]) for k, v in self.clusters.iterator()}
        known = dict(sorted(known.items(), key=lambda x: int(x[0].rpartition("-")[2])))  # in the order they were founded
        number = self.next.get()[0] if self.next.exists() else 1
        before, out, met = number, [], set()
        for photo, faces in photos:
            ids, number = match_faces([(list(f[1]), f[2]) for f in faces], known, number)
            met.update(ids)
            out += [(album, photo, f[0], c) for f, c in zip(faces, ids)]
        for c in met:
            self.clusters.updateValue((c,), ([float(x) for x in known[c][0]], float(known[c][1])))
        if number != before:
            self.next.update((number,))
        return pd.DataFrame(out, columns=["album_id", "photo_id", "face_index", "cluster_id"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        photos: dict[tuple, list] = {}
        for part in rows:
            for photo, at, index, print_, area in zip(part["photo_id"], part["captured_at"], part["face_index"], part["print"], part["area"]):
                photos.setdefault((not pd.isna(at), 0 if pd.isna(at) else int(at), int(photo)), []).append((int(index), [float(x) for x in print_], float(area)))
        now = []
        for (timed, at, photo), faces in sorted(photos.items(), key=lambda x: x[0]):
            if self.ordered and timed:
                self.waiting.updateValue((at, photo), (sorted(faces),))
                self.handle.registerTimer(at)
            else:
                now.append((photo, sorted(faces)))
        if now:
            yield self._matched(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= upto)
        for at, photo, _ in due:
            self.waiting.removeKey((at, photo))
        if due:
            yield self._matched(key[0], [(photo, faces) for _, photo, faces in due])

    def close(self) -> None:
        pass


_CLUSTERED = "album_id long, photo_id long, face_index int, cluster_id string"


def clustered(faces: DataFrame, delay: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Cluster ids of a stream of photos (album_id, photo_id, captured_at in milliseconds, faces of face_index, print and area).

    With a delay photos that come in any order within it are matched in order of time, as the batch operator
    matches them; photos without faces don't move the watermark. Without, photos of a batch are sorted and batches follow each other as they come, and clusters
    of an album that is still for ttl_ms expire.
    """
    keyed_state(faces.sparkSession)
    if delay is not None and ttl_ms is not None:
        raise ValueError("clusters expire by processing time, which photos in order of their own time don't have")
    if delay is not None:
        faces = faces.withColumn("_at", F.timestamp_millis("captured_at")).withWatermark("_at", delay)
    # a row for each face; those of a photo come in one batch
    rows = faces.select("album_id", "photo_id", "captured_at", *(["_at"] if delay is not None else []), F.explode("faces").alias("f")).select("*", "f.face_index", "f.print", "f.area").drop("f")
    mode = "EventTime" if delay is not None else "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("album_id").transformWithStateInPandas(FaceClusters(delay is not None, ttl_ms), _CLUSTERED, "append", mode)


#: Photos in a block of state on average, at most: every entry that is read or written is a call to the store.
_BLOCK = 64


def _block(photo: int, bits: int) -> int:
    """One of 2 ** bits blocks; with one bit more, block b is dealt to 2 * b and 2 * b + 1."""
    return (photo * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - bits


class PhotoCounters(StatefulProcessor):
    """Counts of an album's photos by status, and its bytes, from updates in any order; the last one by seq is a photo's state.

    Photos are kept in blocks by hash, whose number doubles as the album grows, so a batch reads and writes the blocks that it touches.
    A block expires as a whole, when none of its photos has changed for ttl_ms.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.photos = handle.getMapState("photos", "block long", "photos array<struct<photo_id: long, seq: long, status: string>>", self.ttl_ms)
        self.size = handle.getValueState("size", "photos long, bits int")  # stays, as blocks are found by it
        self.counts = handle.getMapState("counts", "status string", "n long", self.ttl_ms)
        self.bytes = handle.getValueState("bytes", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[int, tuple[int, str | None]] = {}
        delta = 0
        for part in rows:
            delta += int(part["storage_delta"].fillna(0).sum())
            for photo, seq, status in zip(part["photo_id"].tolist(), part["seq"].tolist(), part["status"]):
                if photo not in last or (seq, str(status)) > (last[photo][0], str(last[photo][1])):
                    last[photo] = (seq, None if pd.isna(status) else status)
        shift: dict[str, int] = {}
        known, bits = self.size.get() if self.size.exists() else (0, 0)
        before, new = (known, bits), 0
        while known + len(last) > _BLOCK << bits:
            if known:
                self._split(bits)
            bits += 1
        touched: dict[int, dict] = {}
        for photo, update in last.items():
            touched.setdefault(_block(photo, bits), {})[photo] = update
        for block, updates in touched.items():
            held = self._held(block) if known else {}
            changed = False
            for photo, (seq, status) in updates.items():
                was = held.get(photo)
                if was is not None and was[0] >= seq:
                    continue
                held[photo], changed = (seq, status), True
                for s, n in ((was[1] if was else None, -1), (status, 1)):
                    if s is not None:
                        shift[s] = shift.get(s, 0) + n
                new += was is None
            if changed:
                self._keep(block, held)
        if (known + new, bits) != before:
            self.size.update((known + new, bits))
        out = []
        for s, n in sorted(shift.items()):
            if n:
                old = self.counts.getValue((s,))[0] if self.counts.containsKey((s,)) else 0
                self.counts.updateValue((s,), (max(0, old + n),))
                out.append((key[0], "status", s, max(0, old + n)))
        if delta:
            total = max(0, (self.bytes.get()[0] if self.bytes.exists() else 0) + delta)
            self.bytes.update((total,))
            out.append((key[0], "bytes", None, total))
        yield pd.DataFrame(out, columns=["album_id", "kind", "status", "n"])

    def _held(self, block: int) -> dict[int, tuple]:
        if not self.photos.containsKey((block,)):
            return {}
        return {photo: (seq, status) for photo, seq, status in self.photos.getValue((block,))[0]}

    def _keep(self, block: int, held: dict[int, tuple]) -> None:
        self.photos.updateValue((block,), ([(photo, *state) for photo, state in held.items()],))

    def _split(self, bits: int) -> None:
        """Deals blocks to twice as many; from the last to the first, so that none is written before it was read."""
        for block in range((1 << bits) - 1, -1, -1):
            held = self._held(block)
            for half in (2 * block + 1, 2 * block):
                some = {p: x for p, x in held.items() if _block(p, bits + 1) == half}
                if some:
                    self._keep(half, some)
                elif half >> bits == 0 and self.photos.containsKey((half,)):
                    self.photos.removeKey((half,))

    def close(self) -> None:
        pass


def counters(updates: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """album_id, kind (status or bytes), status and n: the counters that a batch of updates (album_id, photo_id, seq, status, storage_delta) changes.

    Counts and bytes never go below 0. A later row of a counter replaces the earlier ones.
    """
    keyed_state(updates.sparkSession)
    return updates.groupBy("album_id").transformWithStateInPandas(PhotoCounters(ttl_ms), "album_id long, kind string, status string, n long", "update", "ProcessingTime" if ttl_ms else "None")
