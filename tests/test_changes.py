"""Tables that changes are merged into, the live feed, and accounts followed by a log."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from manyview.operators import account_log, stories, users
from manyview.sources import keyed
from manyview.sources.keyed import KeyedTable
from manyview.sources.schema import schema
from manyview.streaming import live


def test_merge(spark, tmp_path):
    """Against a dict: late, repeated and deleted keys; versions, repeated merges and clearing up."""
    rng = random.Random(4)
    table = KeyedTable(spark, f"{tmp_path}/t", "k STRING, v BIGINT, more STRUCT<a: STRING>", ["k"], buckets=5)
    assert table.read().count() == 0 and table.versions() == []
    state, at = {}, {}
    for number in range(4):
        rows = [(f"k{rng.randrange(12)}", rng.randrange(100), (rng.choice("xyz"),), seq := rng.randrange(30), seq % 4 == 0) for _ in range([8, 1, 0, 9][number])]
        rows = list({(r[0], r[3]): r for r in rows}.values())
        changes = spark.createDataFrame([*rows, *rows[:2]], "k string, v long, more struct<a: string>, seq long, gone boolean")
        before = dict(state)
        for k, v, more, seq, gone in rows:
            if seq > state.get(k, (-1,))[0]:
                state[k] = (seq, gone, v, more[0])
        there = lambda s: {k: (x[2], x[3]) for k, x in s.items() if not x[1]}
        flat = lambda r: None if r is None else (r["v"], r["more"]["a"])
        got = {r["k"]: (flat(r["before"]), flat(r["after"])) for r in table.merge(changes, number).collect()}
        assert got == {k: (there(before).get(k), there(state).get(k)) for k in state if state[k] != before.get(k)}
        again = {r["k"]: (flat(r["before"]), flat(r["after"])) for r in table.merge(changes.withColumn("v", F.lit(-1)), number).collect()}
        assert again == got
        at[number] = there(state)
        assert {r["k"]: flat(r) for r in table.read().collect()} == at[number]
    assert {r["k"]: flat(r) for r in table.read(1).collect()} == at[1]
    some = spark.createDataFrame([("k1",), ("k2",), ("nobody",)], "k string")
    assert {r["k"] for r in table.touched(some).collect()} == {"k1", "k2"} & set(at[3])
    table.vacuum()
    assert table.versions() == [3] and {r["k"]: flat(r) for r in table.read().collect()} == at[3]
    with pytest.raises(ValueError):
        table.read(1)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k BIGINT", ["k"], buckets=8)
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("seq"), F.lit(False).alias("gone"))
    table.merge(rows, 0)
    table.merge(rows.where("k = 7").withColumn("seq", F.lit(2).cast("long")), 1)
    assert len(list((tmp_path / "t/data/000000000000").glob("bucket=*"))) == 8 and len(list((tmp_path / "t/data/000000000001").glob("bucket=*"))) == 1
    assert table.read().count() == 200


def change(story=None, article=None, seq=1, gone=False):
    return (seq, gone, story, article)


def test_live_feed(spark, tmp_path):
    """The stored counts are those of all articles, after every batch; a batch done twice counts once."""
    rng = random.Random(6)
    feed, articles, shown = live.LiveFeed(spark, f"{tmp_path}/live", buckets=3), {}, {}
    sent = []
    watch = live.Subscription(feed, 2, lambda page, number: sent.append((number, [r["_id"] for r in page.collect()])))
    seq = 0
    for number in range(4):
        rows = []
        for _ in range(25):
            seq += 1
            key, gone = f"a{rng.randrange(14)}", rng.random() < 0.3
            row = (key, float(rng.randrange(5)), rng.choice([1, 2, 3, None]), rng.randrange(4))
            rows.append(change(article=row, seq=seq, gone=gone))
            articles[key] = None if gone else row
        if number != 2:
            rows.append(change(story=(number, 0.0, "t", "s", "published" if number else "processing", float(number)), seq=1))
            shown[number] = bool(number)
        rng.shuffle(rows)
        batch = spark.createDataFrame(rows, live.CHANGE)
        feed.apply(batch, number)
        if number == 1:
            feed.apply(batch, number)
        watch.look(number)
        kept = [a for a in articles.values() if a]
        afresh = stories.first_seen_sources(spark.createDataFrame(kept, live.ARTICLE)) if kept else None
        want = {r["eventId"]: (r["n"], r["sourceIds"]) for r in afresh.collect()}
        assert {r["eventId"]: (r["articleCount"], r["sourceIds"]) for r in feed.counts().collect()} == want
    assert sent[0] == (0, []) and sent[-1][1] == [3, 1]


def test_followed_stream_goes_on(spark, tmp_path):
    feed, sent = live.LiveFeed(spark, f"{tmp_path}/live", buckets=2), []
    watch = live.Subscription(feed, 5, lambda page, number: sent.append({r["_id"]: (r["articleCount"], r["sourceIds"]) for r in page.collect()}))
    story = (1, 1.0, "t", "s", "published", 1.0)
    runs = [[change(story=story), change(article=("a", 1.0, 1, 7))], [change(article=("a", 1.0, 1, 7))], [change(article=("a", 1.0, 1, 7), seq=2, gone=True)]]
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, live.CHANGE).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(live.CHANGE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        live.follow(stream, feed, f"{tmp_path}/c", (watch,)).awaitTermination()
    assert sent == [{1: (1, [7])}, {1: (0, [])}]  # what did not change was not sent


def test_account_log_in_any_order(spark, tmp_path):
    """All orders of batches, with repeats, come to the same accounts."""
    log = [
        (1, "create", "a", "a@1", "Ann", None), (2, "update", "a", "a@2", None, None), (3, "delete", "a", None, None, None), (4, "create", "a", "a@4", "Ann", "pic"),
        (5, "update", "a", "a@5", None, None), (1, "create", "b", "b@1", None, None), (7, "delete", "b", None, None, None), (6, "update", "b", "b@6", None, None),
        (2, "update", "c", "c@2", None, None), (9, "delete", "old", None, None, None), (3, "update", "kept", "kept@3", None, None),
    ]
    rng = random.Random(1)
    zero = (0.0, 0.0, 0.0, 0.0)
    base = spark.createDataFrame([("u1", 1.0, "old", "old@x", None, None, zero), ("u2", 1.0, "kept", "kept@x", ("K", None, None, "nurse", None), None, zero), ("u3", 1.0, "quiet", "q@x", None, None, zero)], schema("users"))
    for turn in range(3):
        rows = [*log, *rng.sample(log, 4)]
        rng.shuffle(rows)
        followed = account_log.AccountLog(spark, f"{tmp_path}/{turn}", buckets=2)
        for number in range(3):
            followed.apply(spark.createDataFrame(rows[number::3], account_log.LOG), number)
        assert {tuple(r) for r in followed.accounts().collect()} == {("a", "a@5", "Ann", "pic", 4)}
        assert {r["_id"] for r in followed.gone().collect()} == {"b", "old"}
        out = {r["authUserId"]: (r["email"], r["profile"]["job"] if r["profile"] else None) for r in account_log.followed(base, followed, 5.0).collect()}
        assert out == {"kept": ("kept@3", "nurse"), "quiet": ("q@x", None), "a": ("a@5", None)}


def test_several_rows_are_an_error(spark):
    zero = (0.0, 0.0, 0.0, 0.0)
    u = spark.createDataFrame([("u1", 1.0, "a", "x", None, None, zero), ("u2", 1.0, "a", "x", None, None, zero)], schema("users"))
    a = spark.createDataFrame([("a", "x", True, None, None)], schema("auth_users"))
    with pytest.raises(PySparkException, match="several rows"):
        users.current_user(a, u, "a").collect()


def test_repeated_updates(spark):
    zero = (0.0, 0.0, 0.0, 0.0)
    u = spark.createDataFrame([("u1", 1.0, "a", "x", None, None, zero)], schema("users"))
    changes = spark.createDataFrame([("a", "x", "z", 1), ("a", "z", "y", 2), ("a", "x", "z", 1)], "_id string, old string, new string, seq long")
    assert [r["email"] for r in users.on_update(u, changes).collect()] == ["y"]
    assert users.on_update(u, changes.drop("seq")).count() == 1


def test_counts_in_parts_and_one_version(spark, tmp_path, monkeypatch):
    """Buckets are merged one after another, in slots; of files only what the last version needs stays."""
    monkeypatch.setattr(keyed, "AT_ONCE", 1)
    monkeypatch.setattr(keyed, "SLOT", 2)
    rng, feed, kept = random.Random(3), live.LiveFeed(spark, f"{tmp_path}/live", buckets=2), {}
    for number in range(2):
        rows = [(f"a{i}", float(rng.randrange(9)), rng.randrange(4), rng.randrange(3), rng.random() < 0.3) for i in range(20 * number, 20 * number + 30)]
        kept |= {r[0]: None if r[4] else r[:4] for r in rows}
        feed.apply(spark.createDataFrame([change(article=r[:4], seq=number, gone=r[4]) for r in rows], live.CHANGE), number)
    afresh = stories.first_seen_sources(spark.createDataFrame([a for a in kept.values() if a], live.ARTICLE)).collect()
    assert {r["eventId"]: (r["articleCount"], r["sourceIds"]) for r in feed.counts().collect()} == {r["eventId"]: (r["n"], r["sourceIds"]) for r in afresh}
    for table in ("articles", "pairs"):
        assert [p.name for p in (tmp_path / "live" / table / "data").iterdir()] == ["000000000001"]
        assert not any((tmp_path / "live" / table / "taken").glob("*"))


def test_page_sent_outlives_its_version(spark, tmp_path):
    """Versions go with each batch, and a page that was sent can still be read."""
    feed, sent = live.LiveFeed(spark, f"{tmp_path}/live", buckets=1), []
    watch = live.Subscription(feed, 5, lambda page, number: sent.append(page))
    for number in range(2):
        rows = [change(story=(1, 1.0, "t", "s", "published", 1.0)), change(article=(f"a{number}", 1.0, 1, 7 + number))]
        feed.apply(spark.createDataFrame(rows, live.CHANGE), number)
        watch.look(number)
    assert [[(r["_id"], r["articleCount"], r["sourceIds"]) for r in page.collect()] for page in sent] == [[(1, 1, [7])], [(1, 2, [7, 8])]]
    assert feed.articles.versions() == feed.pairs.versions() == [1]
