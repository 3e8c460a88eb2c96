"""The seed's known answers, and one case for each semantic trap."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from manyview.functions import bias, display
from manyview.operators import stories
from manyview.sources import adapters
from manyview.sources.schema import BASE, DDL, schema, violations
from manyview.sources.seed import seed
from manyview.sources.store import Store


@pytest.fixture(scope="module")
def seeded(spark):
    return seed(spark, dimension=4)


def names(rows):
    return [x["name"] for x in rows]


def test_seed_is_valid(spark, seeded):
    assert {t: df.count() for t, df in seeded.items()} == {"topics": 2, "sources": 3, "stories": 2, "articles": 6}
    for t, df in seeded.items():
        assert violations(df, t, 4).count() == 0
        assert df.schema == schema(t)


def test_violations(seeded):
    bad = seeded["stories"].withColumns({"status": F.lit("draft"), "title": F.lit(None).cast("string")})
    found = violations(bad, "stories", 3).first()["problems"]
    assert found == ["title is missing", "status is not one of processing, published", "embedding has not 3 components"]


def test_all_schemas_parse():
    assert all(schema(t).names[:2] == ["_id", "_creationTime"] for t in DDL) and schema("auth_users").names[0] == "_id" and BASE


def test_topics(seeded):
    assert [r["displayName"] for r in stories.topics_shown(seeded["topics"]).collect()] == ["Economy", "Tech"]


def test_topics_sort_as_readers_do(spark):
    shown = ["_x", "a-b", "apple", "éclair", "Economy", "Zebra"]
    rows = spark.createDataFrame([(str(i), float(i), n, n) for i, n in enumerate(sorted(shown))], schema("topics"))
    assert [r["displayName"] for r in stories.topics_shown(rows).collect()] == shown


def test_feed(seeded):
    rows = stories.feed(seeded["stories"], seeded["articles"], seeded["sources"]).collect()
    assert [r["slug"] for r in rows] == ["fed-raises-rates-2026", "ai-regulations-congress-2026"]
    assert [(r["articleCount"], names(r["sources"])) for r in rows] == [(3, ["CNN", "Fox News", "Reuters"])] * 2
    assert "embedding" not in rows[0].asDict()


def test_feed_of_one_topic(seeded):
    s, a, o = (seeded[t] for t in ("stories", "articles", "sources"))
    assert [r["slug"] for r in stories.feed(s, a, o, 6, "topics:1").collect()] == ["ai-regulations-congress-2026"]


def test_topic_is_looked_for_within_the_page(seeded):
    s, a, o = (seeded[t] for t in ("stories", "articles", "sources"))
    page = stories.feed_page(s, a, o, 1, "topics:1")
    assert page.stories.count() == 0 and not page.done
    second = stories.feed_page(s, a, o, 1, "topics:1", page.cursor)
    assert second.stories.count() == 1 and second.done
    assert stories.feed_of_topic(s, a, o, "topics:1", 1).count() == 1


def test_detail(seeded):
    s, a, o = (seeded[t] for t in ("stories", "articles", "sources"))
    page = stories.story_page(s, a, o, "fed-raises-rates-2026")
    assert [r["_id"] for r in page.select("article._id").collect()] == ["articles:0", "articles:1", "articles:2"]
    shown = stories.articles_shown(page).orderBy("_id").collect()
    assert [r["bias"] for r in shown] == ["Lean Left", "Right", "Center"] and shown[0]["date"] == "1/6/2026"
    assert stories.story_page(s, a, o, "nope").count() == 0


def test_report(seeded):
    s, a, o, t = (seeded[x] for x in ("stories", "articles", "sources", "topics"))
    told = stories.report_articles(s, a, o).orderBy("_creationTime").collect()
    assert told[0]["title"] == "Fed Hikes Rates Again as Inflation Persists, Squee..." and told[0]["story"] == "Federal Reserve Raises Interes..."
    assert [(r["topics"], r["articleCount"]) for r in stories.report_stories(s, a, t).orderBy("_creationTime").collect()] == [(["Economy"], 3), (["Tech"], 3)]
    counted = {r["name"]: r["n"] for r in stories.counts(topics=t, sources=o, events=s, articles=a).collect()}
    assert counted == {"topics": 2, "sources": 3, "events": 2, "articles": 6}


@pytest.fixture(scope="module")
def edges(spark, seeded):
    """Stories e0..e3: dangling and repeated sources, no articles, six sources, not published."""

    def story(i, first, created, status="published", topics=("t1",), slug=None):
        row = seeded["stories"].first().asDict()
        row |= {"_id": f"e{i}", "_creationTime": float(created), "slug": slug or f"e{i}", "status": status, "firstPublishedAt": float(first), "topicIds": list(topics)}
        return tuple(row[c] for c in schema("stories").names)

    def article(i, event, source, status="clustered", title="Short"):
        row = seeded["articles"].first().asDict()
        row |= {"_id": f"a{i:02}", "_creationTime": float(i), "eventId": event, "sourceId": source, "status": status, "title": title}
        return tuple(row[c] for c in schema("articles").names)

    made = [
        story(0, 10, 1, topics=("t1", "missing", "t1")),
        story(1, 10, 2, topics=()),
        story(2, 5, 3, topics=("empty",)),
        story(3, 99, 4, "processing"),
        story(4, 1, 5, slug="twice"),
        story(5, 1, 6, slug="twice"),
    ]
    rows = [("e0", "s1"), ("e0", "gone"), ("e0", "s0"), ("e0", "s1"), (None, "s0"), ("nowhere", "s0"), *[("e2", f"s{i}") for i in range(5, -1, -1)], ("e3", "s0")]
    told = [article(i, e, s, "discarded" if i == 2 else "clustered") for i, (e, s) in enumerate(rows)]
    outlets = [(f"s{i}", float(i), f"d{i}", f"S{i}", 0.0, 5.0, "") for i in range(6)]
    topics = [("t1", 1.0, "one", "One"), ("empty", 2.0, "empty", "")]
    make = spark.createDataFrame
    return make(made, schema("stories")), make(told, schema("articles")), make(outlets, schema("sources")), make(topics, schema("topics"))


def test_feed_edges(edges):
    s, a, o, _ = edges
    rows = stories.feed(s, a, o, 3).collect()
    # ties: the one created later comes first; what is not published does not come
    assert [(r["_id"], r["articleCount"], names(r["sources"])) for r in rows] == [
        ("e1", 0, []),
        ("e0", 4, ["S1", "S0"]),
        ("e2", 6, ["S5", "S4", "S3", "S2", "S1", "S0"]),
    ]


def test_cards(edges):
    s, a, o, t = edges
    rows = {r["_id"]: r for r in stories.cards(stories.feed(s, a, o, 3), t).collect()}
    assert rows["e1"]["topic"] == "General" and rows["e1"]["articles"] == "0 articles" and rows["e0"]["topic"] == "One"
    assert len(rows["e2"]["outlets"]) == 5 and rows["e2"]["topic"] == "General"


def test_topic_names(edges):
    s, _, _, t = edges
    server = {r["_id"]: r["names"] for r in stories.topic_names(s, t, "Unknown").collect()}
    client = {r["_id"]: r["names"] for r in stories.topic_names(s, t, None).collect()}
    assert server["e0"] == ["One", "Unknown", "One"] and client["e0"] == ["One", "One"]
    assert server["e1"] == [] and client["e1"] == [] and server["e2"] == [""] and client["e2"] == []


def test_detail_edges(edges):
    s, a, o, _ = edges
    page = stories.story_page(s, a, o, "e0").collect()
    assert [(r["article"]["sourceId"], r["article"]["source"] is None) for r in page] == [("s1", False), ("gone", True), ("s0", False), ("s1", False)]
    assert stories.story_page(s, a, o, "e3").count() == 1 and stories.story_page(s, a, o, "e1").first()["article"] is None
    with pytest.raises(PySparkException):
        stories.story_page(s, a, o, "twice").collect()


def test_report_edges(edges):
    s, a, o, _ = edges
    rows = {r["_id"]: r for r in stories.report_articles(s, a, o).collect()}
    assert rows["a01"]["source"] == "Unknown" and rows["a04"]["story"] == rows["a05"]["story"] == "Unclustered" and rows["a00"]["title"] == "Short..."


def test_first_seen_sources(edges):
    rows = {r["eventId"]: (r["sourceIds"], r["n"]) for r in stories.first_seen_sources(edges[1]).collect()}
    assert rows["e0"] == (["s1", "gone", "s0"], 4) and None not in rows


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_pages_make_up_the_feed(edges, size):
    s, a, o, _ = edges
    seen, cursor, done = [], None, False
    while not done:
        page = stories.feed_page(s, a, o, size, after=cursor)
        seen += [r["_id"] for r in page.stories.collect()]
        cursor, done = page.cursor, page.done
    assert seen == ["e1", "e0", "e2", "e5", "e4"]


def test_page_size_is_bounded(edges):
    with pytest.raises(ValueError):
        stories.page_of(edges[0], 0)


BOUNDARIES = [
    (-5.0, "Left"), (-2.01, "Left"), (-2.0, "Lean Left"), (-0.51, "Lean Left"), (-0.5, "Center"), (0.5, "Center"), (0.51, "Lean Right"), (2.0, "Lean Right"),
    (2.01, "Right"), (5.0, "Right"), (float("nan"), "Right"),
]


def test_bias(spark):
    rows = spark.createDataFrame(BOUNDARIES, "b double, want string").select(bias.label(F.col("b")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    places = spark.createDataFrame([(-6.0,), (0.0,), (6.0,)], "b double").select(bias.position(F.col("b"))).collect()
    assert [round(r[0], 6) for r in places] == [-10, 50, 110]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-9, 9), min_size=2, max_size=30))
def test_bias_rises(spark, scores):
    order = ["Left", "Lean Left", "Center", "Lean Right", "Right"]
    rows = spark.createDataFrame([(float(x),) for x in sorted(scores)], "b double").coalesce(1).select("b", bias.label(F.col("b")).alias("l")).orderBy("b").collect()
    places = [order.index(r["l"]) for r in rows]
    assert places == sorted(places)


def test_display(spark):
    p = "struct<center: string, left: string, right: string>"
    rows = spark.createDataFrame([(("c", "", None), 1, "2026-01-06T14:30:00Z"), (("c", "l", ""), 2, "no date"), (("c", None, "r"), 0, None)], f"p {p}, n int, d string")
    got = rows.select(display.has_perspectives(F.col("p")), display.tabs(F.col("p")), display.article_count(F.col("n")), display.date_shown(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [
        (False, ["center"], "1 article", "1/6/2026"),
        (True, ["left", "center"], "2 articles", None),
        (True, ["center", "right"], "0 articles", None),
    ]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.read("users").count() == 0
    assert store.seed() == "seeded" and store.seed() == "already seeded"
    assert {t: df.count() for t, df in store.tables().items()} == {"topics": 2, "sources": 3, "stories": 2, "articles": 6, "users": 0, "userInsights": 0, "interactions": 0}
    store.insert("users", spark.createDataFrame([("u", 1.0, "a", "m", None, None, None)], schema("users")))
    store.write("topics", store.read("topics").where("slug = 'tech'"))
    assert store.read("topics").count() == 1
    store.clear()
    assert {t: df.count() for t, df in store.tables().items()} == {t: int(t == "users") for t in DDL}
    assert store.seed() == "seeded"


def test_a_story_page_shuffles_its_own_articles_only(spark):
    """The story's key goes to the scan of the articles before anything else is joined."""
    folder = "/root/testdata/sf0.001"
    page = stories.story_page(adapters.stories(spark, folder), adapters.articles(spark, folder), adapters.sources(spark, folder), "order-7")
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    semi = next(i for i, line in enumerate(plan.splitlines()) if "LeftSemi" in line)
    outlets = next(i for i, line in enumerate(plan.splitlines()) if "l_suppkey" in line and "LeftOuter" in line or "sourceId" in line and "LeftOuter" in line)
    assert outlets < semi


def test_the_largest_page_has_a_cursor(spark):
    folder = "/root/testdata/sf0.001"
    s, a, o = adapters.stories(spark, folder, True), adapters.articles(spark, folder), adapters.sources(spark, folder)
    assert stories.feed_page(s, a, o, stories.LARGEST_PAGE).done
