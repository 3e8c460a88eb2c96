"""Pages of a feed that is stored in ranges."""

import random

from manyview.operators.stored_feed import StoredFeed

SCHEMA = "_id long, _creationTime double, firstPublishedAt double, status string"


def test_pages(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(4)), float(rng.randrange(30)), rng.choice(["published", "published", "processing"])) for i in range(400)]
    want = [r[0] for r in sorted((r for r in rows if r[3] == "published"), key=lambda r: (r[2], r[1], r[0]), reverse=True)]
    feed = StoredFeed(spark, f"file://{tmp_path}/feed")
    cursor = feed.write(spark.createDataFrame(rows, SCHEMA), 1, ranges=10)
    got = []
    for turn in range(3):
        page, read = feed.page(cursor, 9)
        got += [r["_id"] for r in page.collect()]
        assert len(read) <= 2
        cursor = feed.next(cursor, 9)
        feed.write(spark.createDataFrame(rows[: 50 * turn], SCHEMA), 2, ranges=3)  # readers of version 1 are not disturbed
    assert got == want[:27]
    deep, read = feed.page(feed.at(1, 20, 9), 9)
    assert [r["_id"] for r in deep.collect()] == want[180:189] and len(read) <= 2
    assert feed.page(feed.at(1, 900, 9), 9)[0].count() == 0
    assert {r["_id"] for r in feed.page(feed.at(1, len(want) // 9, 9), 9)[0].collect()} == set(want[len(want) // 9 * 9 :])


def test_empty_feed(spark, tmp_path):
    feed = StoredFeed(spark, f"file://{tmp_path}/feed")
    cursor = feed.write(spark.createDataFrame([(1, 1.0, 1.0, "processing")], SCHEMA), 1)
    assert feed.page(cursor)[0].count() == 0 and feed.next(cursor) == cursor
