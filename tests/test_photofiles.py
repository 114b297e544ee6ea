"""Photos as files: listing, ranges of bytes, taking in and deleting; capture times from headers."""

import os
import struct
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from cullspark.functions import exif
from cullspark.sources import photofiles

# --- headers


def tiff(order, main, inner=None, pointer=None, first=8):
    """A header with a directory of date tags (tag to text) and one of Exif's; pointer replaces where that one is."""
    def directory(at, entries):
        spare = at + 2 + 12 * len(entries) + 4
        out, rest = struct.pack(order + "H", len(entries)), b""
        for tag, (kind, count, value) in sorted(entries.items()):
            if len(value) > 4:
                out += struct.pack(order + "HHII", tag, kind, count, spare + len(rest))
                rest += value
            else:
                out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        return out + b"\0\0\0\0" + rest

    text = lambda v: (2, len(v) + 1, v.encode() + b"\0")
    main = {t: text(v) for t, v in main.items()}
    start = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", first)
    if inner is None and pointer is None:
        return start + directory(8, main)
    size = len(directory(8, main | {exif.EXIF: (4, 1, b"\0\0\0\0")}))
    body = directory(8, main | {exif.EXIF: (4, 1, struct.pack(order + "I", 8 + size if pointer is None else pointer))})
    return start + body + directory(8 + size, {t: text(v) for t, v in (inner or {}).items()})


def jpeg(header, *before):
    out = b"\xff\xd8"
    for mark, body in [*before, (0xE1, exif.EXIF_MARK + header)]:
        out += b"\xff\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xda\0\2rest\xff\xd9"


def png(header):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    return exif.PNG_MARK + chunk(b"IHDR", b"\0" * 13) + chunk(b"eXIf", header) + chunk(b"IEND", b"")


A, B, C, D = (f"20{y}:02:03 04:05:06" for y in (11, 12, 13, 14))
ALL = {exif.ORIGINAL: A, exif.DIGITIZED: B, exif.DATE: C}


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("wrap", [bytes, jpeg, png])
def test_tags_of_both_byte_orders(order, wrap):
    assert exif.times_of(wrap(tiff(order, {exif.DATE: D}, ALL))) == (A, B, C, D)
    assert exif.times_of(wrap(tiff(order, {exif.DATE: D}))) == (None, None, None, D)
    assert exif.times_of(wrap(tiff(order, {}, {exif.DIGITIZED: B}))) == (None, B, None, None)
    assert exif.times_of(wrap(tiff(order, {exif.DATE: "x"}, {exif.ORIGINAL: ""}))) == ("", None, None, "x")


def test_broken_headers_give_nothing():
    whole = tiff("<", {exif.DATE: D}, ALL)
    assert exif.times_of(tiff("<", {exif.DATE: D}, pointer=8)) == (None, None, None, D)  # a directory that is its own
    assert exif.times_of(tiff(">", {exif.DATE: D}, pointer=1 << 30)) == (None, None, None, D)
    assert exif.times_of(tiff("<", {exif.DATE: D}, ALL, first=1 << 31)) == (None,) * 4
    for n in range(len(whole)):
        assert all(t in (None, w) for t, w in zip(exif.times_of(whole[:n]), (A, B, C, D)))
        exif.times_of(jpeg(whole)[:n])
        exif.times_of(whole[:n] + b"\xff" * (len(whole) - n))
    for odd in (None, b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\0\0", b"II*\0", b"GIF89a", b"\xff\xd8\xff\xda" + whole):
        assert exif.times_of(odd) == (None,) * 4
    assert exif.times_of(jpeg(whole, (0xE0, b"JFIF\0"), (0xE1, b"http://ns.adobe.com/xap"))) == (A, B, C, D)


def test_chain_of_tags(spark):
    rows = [(0, tiff("<", {exif.DATE: D}, ALL)), (1, jpeg(tiff(">", {exif.DATE: D}, {exif.DIGITIZED: B}))), (2, tiff(">", {exif.DATE: D}, {exif.ORIGINAL: "", exif.DATE: C})), (3, png(tiff("<", {exif.DATE: D}))), (4, tiff("<", {exif.DATE: D}, {exif.ORIGINAL: "no time"})), (5, None), (6, b"no image")]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "k int, content binary")
    got = dict(df.select("k", exif.captured_at(F.col("content")).alias("t")).collect())
    at = lambda y: int(datetime(2000 + y, 2, 3, 4, 5, 6, tzinfo=UTC).timestamp() * 1000)
    assert got == {0: at(11), 1: at(12), 2: at(13), 3: at(14), 4: None, 5: None, 6: None}


# --- reading


@pytest.fixture()
def root(tmp_path):
    for album, name, size in [("a", "one.jpg", 10), ("a", "two.PNG", 0), ("a", ".hidden.jpg", 5), ("a", "thumbs/one.v4.jpg", 3), ("b", "IMG_1.heic", 1000), ("b", "IMG_2.jpg", 7), ("thumbs", "x.jpg", 1), (".tmp", "y.jpg", 1)]:
        path = tmp_path / "root" / album / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(bytes((len(name) + k) % 256 for k in range(size)))
    return str(tmp_path / "root")


def test_listing_of_albums(spark, root):
    got = {(r.album, r.name, r.size, r.type) for r in photofiles.photos(spark, root).collect()}
    assert got == {("a", "one.jpg", 10, "image/jpeg"), ("a", "two.PNG", 0, "image/png"), ("b", "IMG_1.heic", 1000, "image/heic"), ("b", "IMG_2.jpg", 7, "image/jpeg")}
    assert photofiles.photos(spark, root + "/nothing").count() == 0


@pytest.mark.parametrize("part,task", [(3, 5), (64, 100), (4096, 1 << 20), (1, 1000)])
def test_slices_make_the_files(spark, root, part, task):
    rows = photofiles.photos(spark, root, part_bytes=part, task_bytes=task)
    assert rows.rdd.getNumPartitions() >= min(8, 1000 // task)
    found = {}
    for r in rows.collect():
        assert r.end - r.start == len(r.content) <= part
        found.setdefault(r.uri.removeprefix("file://"), []).append((r.start, bytes(r.content)))
    assert len(found) == 4
    for path, slices in found.items():
        assert b"".join(c for _, c in sorted(slices)) == open(path, "rb").read() and len({s for s, _ in slices}) == len(slices)


def test_beginnings(spark, root):
    got = {r.name: bytes(r.content) for r in photofiles.photos(spark, root, head=8).collect()}
    assert {k: len(v) for k, v in got.items()} == {"one.jpg": 8, "two.PNG": 0, "IMG_1.heic": 8, "IMG_2.jpg": 7}


def test_filters_reach_the_listing(spark, root):
    df = photofiles.photos(spark, root)
    assert [r.name for r in df.where("album = 'b' and name = 'IMG_2.jpg'").collect()] == ["IMG_2.jpg"]
    assert {r.name for r in df.where("name in ('one.jpg', 'IMG_1.heic') and size > 5").collect()} == {"one.jpg", "IMG_1.heic"}
    assert {r.name for r in df.where("name like 'IMG%'").collect()} == {"IMG_1.heic", "IMG_2.jpg"}
    assert df.where("album = '../b'").count() == 0 and df.where("album = 'a' and album = 'b'").count() == 0
    reader = photofiles._Reader({"path": root})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("album",), "b"), GreaterThan(("size",), 3)])) == [GreaterThan(("size",), 3)]
    assert [p.album for p in reader.partitions()] == ["b"]


def test_wrong_sizes_fail(root):
    with pytest.raises(photofiles.SizeMismatch):
        photofiles.read_slice(root, f"{root}/a/one.jpg", 5, 11)
    with pytest.raises(ValueError):
        photofiles._Reader({"path": root, "head": "1", "part_bytes": "1"})


# --- taking in and deleting


def rows_of(spark, *rows):
    b = lambda x: None if x is None else bytearray(x)
    return spark.createDataFrame([(a, p, f, b(c), b(t), b(d)) for a, p, f, c, t, d in rows], photofiles.INGESTED)


def on_disk(root):
    return sorted(os.path.join(d, f).removeprefix(root) for d, _, fs in os.walk(root) for f in fs if "_manifests" not in d and not f.endswith(".crc"))


def test_ingest_and_delete(spark, tmp_path):
    root = str(tmp_path / "store")
    assert photofiles.stored(spark, root).count() == 0
    first = rows_of(spark, ("a", "p1", "x.JPG", b"one", b"t1", b"d1"), ("a", "p2", "y", b"two", b"t2", None), ("a", "p3", "z.png", b"three", None, None), ("b", "p1", "w.jpg", None, b"t", None), ("b", "", "w.jpg", b"four", b"t4", None)).repartition(3)
    failed = {(r.album, r.name, r.error) for r in photofiles.ingest(first, root).collect()}
    assert failed == {("a", "p3.png", "no thumbnail"), ("b", "p1.jpg", "no source")}
    got = {(r.album, r.name): r for r in photofiles.stored(spark, root).collect()}
    assert len(got) == 3 and {k for k in got if k[0] == "a"} == {("a", "p1.JPG"), ("a", "p2")}
    assert open(got["a", "p1.JPG"].uri.removeprefix("file://"), "rb").read() == b"one" and got["a", "p1.JPG"].type == "public.jpg" and got["a", "p2"].type == "image/jpeg"
    assert open(got["a", "p1.JPG"].detail_uri.removeprefix("file://"), "rb").read() == b"d1" and got["a", "p2"].detail_uri is None

    # a photo that is there is refused, or replaced where asked
    again = rows_of(spark, ("a", "p1", "x.JPG", b"newer", b"t9", None), ("a", "p4", "v.jpg", b"five", b"t5", None))
    assert {(r.name, r.error) for r in photofiles.ingest(again, root).collect()} == {("p1.JPG", "exists")}
    assert photofiles.ingest(again.where("photo_id = 'p1'"), root, replace=True).count() == 0
    got = {(r.album, r.name): r for r in photofiles.stored(spark, root).collect()}
    assert len(got) == 4 and got["a", "p1.JPG"].size == 5

    # crops made later go with the photo
    crops = os.path.join(os.path.dirname(got["a", "p2"].uri.removeprefix("file://")), "face-thumbs")
    os.makedirs(crops)
    for name in ("p2-0.jpg", "p2-11.jpg", "p21-0.jpg"):
        open(os.path.join(crops, name), "wb").write(b"c")
    keys = spark.createDataFrame([("a", "p2"), ("a", "nothing"), ("a", "p2")], "album string, name string")
    assert [(r.name, r.files) for r in photofiles.delete(spark, root, keys).collect()] == [("p2", 4)]
    assert {r.name for r in photofiles.stored(spark, root).where("album = 'a'").collect()} == {"p1.JPG", "p4.jpg"}
    assert [f for f in on_disk(root) if "p2" in f and "p21" not in f] == []
    assert photofiles.delete(spark, root, keys).count() == 0
    assert photofiles.ingest(rows_of(spark, ("a", "p2", "y", b"back", b"t", None)), root).count() == 0
    assert photofiles.stored(spark, root).where("name = 'p2'").first().size == 4


def test_attempts_that_fail_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "store")
    photofiles.ingest(rows_of(spark, ("a", "p1", "x.jpg", b"one", b"t1", None)), root)
    writer = photofiles._Writer({"path": root}, False)
    row = rows_of(spark, ("a", "p9", "x.jpg", b"nine", b"t9", None)).collect()
    lost, kept = writer.write(iter(row)), writer.write(iter(row))  # the task ran twice, one message came
    assert photofiles.stored(spark, root).count() == 1
    writer.commit([kept])
    got = {r.name: r.uri for r in photofiles.stored(spark, root).collect()}
    assert set(got) == {"p1.jpg", "p9.jpg"} and f".{kept.name}/" in got["p9.jpg"]
    other = photofiles._Writer({"path": root}, False)
    message = other.write(iter(row))
    other.abort([message, None])
    assert not any(message.name in f for f in on_disk(root)) and photofiles.stored(spark, root).count() == 2
    assert lost.rows == 1


def test_deleting_from_a_plain_folder(spark, root):
    photos = photofiles.photos(spark, root).where("name = 'one.jpg'")
    got = photofiles.remove_files(photos, root, "windows")
    assert [(r.name, r.files) for r in got.collect()] == [("one.jpg", 2)] and [(r.name, r.files) for r in got.collect()] == [("one.jpg", 2)]
    assert not os.path.exists(root + "/a/one.jpg") and not os.path.exists(root + "/a/thumbs/one.v4.jpg") and os.path.exists(root + "/b/IMG_2.jpg")
    assert photofiles.photos(spark, root).count() == 3
