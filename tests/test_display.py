import math

import pytest
from pyspark.sql import functions as F

from cullspark.functions import detector, display


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_addresses(spark):
    thumb, detail = "a\\thumbs\\x.v4.jpg", "/details/x.d1.jpg?v=2"
    assert one(spark, display.display_uri(F.col("u"), F.col("t")), u="o", t=thumb) == thumb
    assert one(spark, display.display_uri(F.col("u"), F.col("t")), u="o", t="/thumbs/x.v3.jpg") == "o"
    assert one(spark, display.detail_uri(F.col("u"), F.col("t"), F.col("d")), u="o", t=thumb, d=detail) == detail
    assert one(spark, display.grid_uri(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("gb, text", [(0.0, "0.0 GB"), (0.0001, "0.01 GB"), (0.5, "0.51 GB"), (2.04, "2.0 GB")])
def test_sizes(spark, gb, text):
    assert one(spark, display.storage_size(F.col("g")), g=gb) == text


def test_rectangles(spark):
    r = one(spark, display.contained(*(F.lit(v) for v in (100.0, 100.0, 200.0, 100.0))))
    assert tuple(r) == (0, 25, 100, 50)
    assert [x.id for x in spark.range(20).where(display.visible(F.col("id"), F.lit(2), F.lit(5), F.lit(20))).collect()] == list(range(9))


def test_pose_and_acceptance(spark):
    assert one(spark, detector.yaw(F.lit(0.0), F.lit(10.0), F.lit(9.0))) == pytest.approx(math.radians(14))
    assert one(spark, detector.yaw(F.lit(0.0), F.lit(10.0), F.lit(99.0))) == pytest.approx(math.pi / 4)
    assert [one(spark, detector.pitch(F.lit(0.0), F.lit(10.0), F.lit(e), F.lit(m))) for e, m in ((5.0, 8.0), (3.0, 2.0), (3.0, 8.0))] == [-0.18, -0.20, 0.0]
    ok = lambda s, w: one(spark, detector.accepted(F.lit(s), F.lit(w), F.lit(20.0), F.lit(400.0), F.lit(300.0), 0.5))
    assert ok(0.6, 20.0) and not ok(0.4, 20.0) and not ok(0.6, 11.0)


def test_eye_overrides(spark):
    def f(left, right, area):
        return tuple(one(spark, detector.eye_override(detector.eye_state(F.lit(left), F.lit(right)), F.lit(left), F.lit(right), F.lit(area))))

    assert f(0.0, 0.0, 0.01) == (False, pytest.approx(99.0))
    assert f(0.0, 0.0, 0.0005) == (True, 72.0)
    assert f(0.10, 0.08, 0.02) == (False, 95.0)
    assert f(0.15, 0.04, 0.002) == (False, 90.0)
    assert [one(spark, detector.ear_state(F.lit(v))) for v in (0.3, 0.1, 0.2)] == ["open", "closed", "unknown"]


def test_tiles_and_profiles(spark):
    df = spark.range(1).select(detector.tiles(F.lit(1000), F.lit(600), 2).alias("t"), detector.tiled(F.lit(500_000), F.lit(2)).alias("a"), detector.tiled(F.lit(500_000), F.lit(2), "ios").alias("b"), detector.tiled(F.lit(500_000), F.lit(3)).alias("c"))
    r = df.first()
    assert [(t["left"], t["top"]) for t in r.t] == [(0, 0), (325, 0), (0, 195), (325, 195)] and all((t["width"], t["height"]) == (675, 405) for t in r.t)
    assert (r.a, r.b, r.c) == (True, False, False)
