"""Accounts, ingestion, similarity, statistics and streams."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from manyview.functions import urls
from manyview.operators import ingest, readers, similarity, todos, users
from manyview.sources.schema import schema
from manyview.streaming import activity

DAY = 86_400_000.0


@pytest.fixture(scope="module")
def accounts(spark):
    zero = (0.0, 0.0, 0.0, 0.0)
    rows = [
        ("u1", 1.0, "a1", "one@x", ("Ann", 30.0, None, "nurse", None), ("low", ["rent"], [], "left"), zero),
        ("u2", 2.0, "a2", "two@x", (None, None, None, None, None), None, zero),
        ("u3", 3.0, "dup", "d@x", None, None, zero),
        ("u4", 4.0, "dup", "d@x", None, None, zero),
    ]
    auth = [("a1", "one@x", True, "Ann", None), ("a2", "two@x", False, "", "pic"), ("a9", "nine@x", True, None, None)]
    return spark.createDataFrame(rows, schema("users")), spark.createDataFrame(auth, schema("auth_users"))


def test_current_user(accounts):
    u, a = accounts
    assert users.current_user(a, u, "a1").first()["profile"]["job"] == "nurse"
    assert all(users.current_user(a, u, who).count() == 0 for who in (None, "a9", "nobody"))
    assert users.auth_user(a, "a9").count() == 1
    assert users.welcome_name(users.current_user(a, u, "a2")).first()["shown"] == "two@x"


def test_profile_is_merged(accounts):
    u, _ = accounts
    once = users.update_profile(u, "a1", {"job": "pilot"})
    twice = users.update_profile(once, "a1", {"job": "pilot"})
    assert once.where("_id = 'u1'").first()["profile"].asDict() == {"name": "Ann", "age": 30.0, "avatar": None, "job": "pilot", "location": None}
    assert once.collect() == twice.collect() and once.where("_id = 'u2'").collect() == u.where("_id = 'u2'").collect()


def test_context_is_replaced(accounts):
    u, _ = accounts
    new = users.update_private_context(u, "a1", {"concerns": [], "interests": ["tech"]}).where("_id = 'u1'").first()["privateContext"]
    assert new.asDict() == {"incomeBracket": None, "concerns": [], "interests": ["tech"], "politicalLeaning": None}


@pytest.mark.parametrize("who, said", [(None, users.NOT_AUTHENTICATED), ("a9", users.NOT_FOUND), ("dup", "several rows")])
def test_refusals(accounts, who, said):
    for change in (lambda: users.update_profile(accounts[0], who, {}), lambda: users.update_private_context(accounts[0], who, {"concerns": [], "interests": []})):
        with pytest.raises(users.AccountError, match=said):
            change()


def test_bad_arguments(accounts):
    with pytest.raises(users.AccountError):
        users.update_profile(accounts[0], "a1", {"shoe": 4})
    with pytest.raises(users.AccountError):
        users.update_private_context(accounts[0], "a1", {"concerns": []})


def test_accounts_follow(spark, accounts):
    u, a = accounts
    made = users.on_create(u, a.where("_id = 'a9'"), 5.0).where("authUserId = 'a9'").first()
    assert made["email"] == "nine@x" and made["profile"]["name"] is None and made["privateContext"] is None and made["stats"]["biasBalance"] == 0
    changes = spark.createDataFrame([("a1", "one@x", "new@x"), ("a2", "two@x", "two@x"), ("a8", "p", "q")], "_id string, old string, new string")
    moved = {r["_id"]: r["email"] for r in users.on_update(u, changes).collect()}
    assert moved == {"u1": "new@x", "u2": "two@x", "u3": "d@x", "u4": "d@x"}
    assert [r["_id"] for r in users.on_delete(u, a.where("_id = 'a1'")).orderBy("_id").collect()] == ["u2", "u3", "u4"]


def test_private_context_is_private(accounts):
    u, _ = accounts
    assert users.visible_to(u, "a1").where("privateContext IS NOT NULL").count() == 1
    assert users.visible_to(u, "a2").where("privateContext IS NOT NULL").count() == users.visible_to(u, None).where("privateContext IS NOT NULL").count() == 0


URLS = [
    ("http://a.org/x?page=2&ref=x", "http://a.org/x?page=2", "a.org"),
    ("https://www.A.org/x?utm_source=f&utm_medium=g#top", "https://www.A.org/x", "a.org"),
    ("https://m.b.com:80?reference=1", "https://m.b.com:80?reference=1", "m.b.com"),
    ("no address", "no address", None),
    ("", "", None),
    (None, None, None),
]


def test_urls(spark):
    rows = spark.createDataFrame(URLS, "u string, c string, d string")
    assert [tuple(r) for r in rows.select("u", urls.canonical(F.col("u")), urls.domain(F.col("u"))).collect()] == URLS


def test_ingestion(spark):
    incoming = spark.createDataFrame([(3, "http://a.org/1?ref=q"), (2, "http://a.org/1#x"), (5, "http://b.org/")], "_id long, url string")
    known = spark.createDataFrame([("http://b.org/",)], "canonicalUrl string")
    assert [r["_id"] for r in ingest.new_articles(incoming, known).collect()] == [2]
    outlets = spark.createDataFrame([("s2", 2.0, "a.org"), ("s1", 1.0, "A.org")], "_id string, _creationTime double, domain string")
    assert {r["_id"]: r["sourceId"] for r in ingest.with_source(incoming, outlets).collect()} == {2: "s1", 3: "s1", 5: None}


def test_todos(spark):
    none = spark.createDataFrame([], todos.DDL)
    asked = spark.createDataFrame([("a", "  milk "), ("b", "   "), ("c", None), ("d", "bread")], "_id string, text string")
    made = todos.create(none, asked, 5.0)
    assert [tuple(r) for r in todos.every(made).collect()] == [("a", 5.0, "milk", False), ("d", 5.0, "bread", False)]
    done = todos.toggle(made, spark.createDataFrame([("d", True), ("z", True)], "_id string, completed boolean"))
    assert tuple(todos.completed(done).first()) == (1, 2) and tuple(todos.completed(none).first()) == (0, 0)
    assert [r["_id"] for r in todos.delete(done, asked.where("_id = 'a'")).collect()] == ["d"]


def test_similarity_of_repeated_keys_and_other_widths(spark):
    v = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.8, 0.2]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])]
    rows = spark.createDataFrame(v, "_id long, embedding array<double>")
    got = similarity.nearest(rows, rows, 2).select("query", "key").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (1, 2), (2, 1), (2, 1), (3, 4), (4, 3)]


def test_similarity(spark, monkeypatch):
    v = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("none", None)]
    rows = spark.createDataFrame([(i, x, "unprocessed", 1.0) for i, x in v], "_id string, embedding array<double>, status string, embeddingVersion double")
    pair = rows.alias("x").join(rows.alias("y"), F.lit(True)).select("x._id", similarity.cosine(F.col("x.embedding"), F.col("y.embedding")).alias("c"))
    assert pair.where("_id IN ('zero', 'none') AND c IS NOT NULL").count() == 0
    want = [("a", 1, "b"), ("b", 1, "a"), ("c", 1, "b")]
    assert sorted(tuple(r)[:3] for r in similarity.nearest(rows, rows, 1).collect()) == want
    monkeypatch.setattr(similarity, "GROUP", 2)
    monkeypatch.setattr(similarity, "SHARD", 2)
    assert sorted(tuple(r)[:3] for r in similarity.nearest(rows, rows, 1).collect()) == want
    told = {r["_id"]: r["eventId"] for r in similarity.assign(rows, rows.where("_id = 'a'").withColumn("_id", F.lit("s")), 0.9).collect()}
    assert told == {"a": "s", "b": "s", "c": None, "zero": None, "none": None}
    assert similarity.outdated(rows, 2.0).count() == 5


def test_streaks(spark):
    now = 100 * DAY
    days = {"a": [97, 98, 99, 90, 91, 92, 93], "b": [10, 11], "c": [100, 99.5]}
    rows = [(u, "view", float(d * DAY)) for u, ds in days.items() for d in ds]
    log = spark.createDataFrame(rows, "userId string, type string, timestamp double")
    assert {tuple(r) for r in readers.streaks(log, now).collect()} == {("a", 3, 4), ("b", 0, 2), ("c", 2, 2)}


def test_caches(spark):
    insights = spark.createDataFrame(
        [("i1", "u", "e", 5.0, 20.0, None), ("i2", "u", "e", 3.0, 20.0, 8.0), ("i3", "u", "e", 5.0, 10.0, 2.0)],
        "_id string, userId string, eventId string, eventLastUpdated double, expiresAt double, lastNotifiedAt double",
    )
    told = spark.createDataFrame([("e", 4.0)], "_id string, lastSummarizedAt double")
    ids = lambda df: sorted(r["_id"] for r in df.collect())
    assert ids(readers.usable_insights(insights, told, 10.0)) == ["i1"] and ids(readers.without_expired(insights, 10.0)) == ["i1", "i2"]
    assert ids(readers.may_notify(insights, 10.0, 5.0)) == ["i1", "i3"] and ids(readers.stale_summaries(told, 10.0, 5.0)) == ["e"]


def test_statistics(spark, accounts):
    u, _ = accounts
    log = spark.createDataFrame(
        [("u1", "click_source", (5.0, 1.0), ("phone",), 0.0), ("u1", "click_source", (0.0, 1.0), (None,), 5.0), ("u1", "view", (-5.0, 1.0), None, DAY)],
        "userId string, type string, context struct<biasRating: double, sourceReliability: double>, metadata struct<deviceType: string>, timestamp double",
    )
    assert tuple(readers.balance(log).first()) == ("u1", 2, 50.0)
    new = {r["_id"]: tuple(r["stats"]) for r in readers.refreshed_stats(u, log, DAY).collect()}
    assert new["u1"] == (2.0, 2.0, 2.0, 50.0) and new["u2"] == (0.0, 0.0, 0.0, 0.0)
    assert {(r["type"], r["device"], r["n"]) for r in readers.by_day(log).collect()} == {("click_source", "phone", 1), ("click_source", "unknown", 1), ("view", "unknown", 1)}


def test_stream_takes_later_files(spark, tmp_path):
    """A restart goes on where the last run stopped, and a late copy of an event is left out."""
    rows = "SELECT {0}L AS event_id, timestamp_ntz'2024-01-01 {1}' AS ts, 7L AS user_id, 'view' AS event_type, 1.5D AS value, '{{}}' AS props"
    for i, (event, at) in enumerate([(1, "00:10:00"), (2, "00:20:00"), (1, "00:10:00")]):
        spark.sql(rows.format(event, at)).write.parquet(f"{tmp_path}/in/events-{i}.parquet")
    seen = activity.once(activity.read_activity(spark, f"{tmp_path}/in", pattern="*.parquet")).select("event_id")
    sink = lambda: seen.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    sink()
    spark.sql(rows.format(3, "00:30:00")).write.parquet(f"{tmp_path}/in/events-9.parquet")
    sink()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_entry():
    found, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(found) and len(found) > 40


def test_what_a_change_gives_back(accounts):
    u, _ = accounts
    out = users.returned(users.update_profile(u, "a1", {"job": "pilot"}), "a1").collect()
    assert [(r["_id"], r["profile"]["job"], r["profile"]["name"]) for r in out] == [("u1", "pilot", "Ann")]


def test_nothing_was_streamed(spark, tmp_path):
    assert activity.written(spark, f"{tmp_path}/none", schema("topics")).count() == 0
