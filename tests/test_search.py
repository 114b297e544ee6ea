"""Pages of a search: the whole order once, in both directions, with nulls, ties and filters that reach the files."""

import random

import pytest
from pyspark.sql import functions as F

from cullspark.sources import search


@pytest.fixture(scope="module")
def albums(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, f"Trip {k % 7}", "ÉTÉ", "wedding"]), f"{2018 + r.randint(0, 3)}-{r.randint(1, 12):02d}-05T10:00:00.000Z" if k % 9 else None, r.choice([None, 0, 5, 5, 7 * k]), r.choice([None, float("nan"), -0.5, k / 3])) for k in range(60)]
    return spark.createDataFrame(rows, "album_id long, name string, created_at string, total_storage long, score double").cache()


def walked(page, limit):
    return [r for rows in search.walk(page, limit) for r in rows.select("album_id", "cursor").collect()]


@pytest.mark.parametrize("sort", ["default", "size", "score", "name"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_give_the_whole_order_once(albums, sort, order):
    key = F.col(search.SORTS.get(sort, sort))
    want = [r.album_id for r in albums.orderBy(key.asc_nulls_last() if order == "asc" else key.desc_nulls_last(), "album_id").collect()]
    got = walked(lambda c: search.album_search(albums, sort=sort, order=order, limit=13, cursor=c), 13)
    assert [r.album_id for r in got] == want
    # and back from any row
    for at in (0, 7, 30, 59):
        back = search.album_search(albums, sort=sort, order=order, limit=13, cursor=got[at].cursor, backward=True).collect()
        assert [r.album_id for r in back] == want[max(0, at - 13) : at]


def test_filters(spark, albums):
    ids = lambda **k: sorted(r.album_id for r in search.album_search(albums, limit=100, **k).collect())
    rows = albums.collect()
    assert ids(keyword=" TRIP 3 ") == [r.album_id for r in rows if r.name == "Trip 3"]
    assert ids(keyword="été") == [r.album_id for r in rows if r.name == "ÉTÉ"]
    assert ids(year=2019) == [r.album_id for r in rows if (r.created_at or "")[:4] == "2019"]
    assert ids(year=2019, month=3) == [r.album_id for r in rows if (r.created_at or "")[:7] == "2019-03"]
    assert ids(month=12) == [r.album_id for r in rows if (r.created_at or "")[5:7] == "12"]
    assert ids(ids="3, 5,,77") == [3, 5] and ids(ids=[]) == [] and ids(ids="") == []
    assert ids(keyword="  ") == [r.album_id for r in rows]
    photos = spark.createDataFrame([(3, "IMG_1.JPG"), (3, "IMG_2.JPG"), (9, "b.png")], "album_id long, file_name string")
    faces = spark.createDataFrame([(9, "person-1"), (5, "person-2")], "album_id long, cluster_id string")
    assert ids(text="img_", photos=photos) == [3] and ids(face="person-1", faces=faces) == [9]
    assert ids(text="b", face="person-2", photos=photos, faces=faces) == []
    with pytest.raises(ValueError):
        ids(text="x")


def test_cursors(albums):
    first = search.album_search(albums, limit=5).collect()
    again = f"https://example.org/albums?limit=5&cursor={first[-1].cursor}"
    assert search.cursor_of(again) == first[-1].cursor and search.cursor_of("https://example.org/albums") is None
    got = search.album_search(albums, limit=5, cursor=again).collect()
    plain = search.album_search(albums, limit=5, cursor=first[-1].cursor)
    assert [r.album_id for r in got] == [r.album_id for r in plain.collect()] and not {r.album_id for r in got} & {r.album_id for r in first}
    for bad in ("x", "e30=", first[0].cursor[:-4]):
        with pytest.raises(search.BadCursor):
            search.album_search(albums, cursor=bad)
    with pytest.raises(search.BadCursor):
        search.album_search(albums, sort="size", cursor=first[0].cursor)
    with pytest.raises(ValueError):
        search.album_search(albums, sort="nothing")


def test_conditions_reach_the_files(spark, albums, tmp_path):
    albums.write.parquet(str(tmp_path / "albums"))
    stored = spark.read.parquet(str(tmp_path / "albums"))
    first = search.album_search(stored, sort="size", limit=5, year=2019).collect()
    page = search.album_search(stored, sort="size", limit=5, year=2019, cursor=first[-1].cursor)
    plan = page._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    page = page.select("*")  # planned with the setting
    pushed = page._jdf.queryExecution().explainString(page._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(created_at,2019-" in pushed and "LessThan(total_storage" in pushed and "GreaterThan(album_id" in pushed
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
