"""Feed, story page, topics and the report on the seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.functions import bias, display

RECENCY = ("firstPublishedAt", "_creationTime", "_id")
#: A page never has more stories than this, so that its keys can be sent everywhere.
LARGEST_PAGE = 1000


@dataclass(frozen=True)
class Page:
    """Stories of a page, the cursor for the next one, and whether there is none."""

    stories: DataFrame
    cursor: tuple | None
    done: bool


def published(stories: DataFrame, after: tuple | None = None) -> DataFrame:
    """Published stories, those after a cursor if there is one."""
    out = stories.where(F.col("status") == "published")
    if after is None:
        return out
    at, made, key = (F.lit(x) for x in after)
    earlier = (F.col("firstPublishedAt") < at) | ((F.col("firstPublishedAt") == at) & (F.col("_creationTime") < made))
    same = (F.col("firstPublishedAt") == at) & (F.col("_creationTime") == made) & (F.col("_id") < key)
    return out.where(earlier | same)


def page_of(stories: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The next stories, newest first; ties by creation and id, latest first."""
    if not 0 < size <= LARGEST_PAGE:
        raise ValueError(f"a page has 1 to {LARGEST_PAGE} stories")
    return published(stories, after).orderBy(*[F.desc(c) for c in RECENCY]).limit(size)


def about(stories: DataFrame, topic: str | None) -> DataFrame:
    return stories if topic is None else stories.where(F.array_contains("topicIds", topic))


def first_seen_sources(articles: DataFrame) -> DataFrame:
    """(eventId, sourceIds, n): the sources of each story's articles in order of their
    first article, and the number of articles, discarded ones too.

    Grouped by story and source first, so that no list is longer than its sources.
    """
    order = F.min(F.struct("_creationTime", "_id"))
    each = articles.where(F.col("eventId").isNotNull()).groupBy("eventId", "sourceId").agg(order.alias("first"), F.count("*").alias("n"))
    lists = F.array_sort(F.collect_list(F.struct("first", "sourceId")))
    return each.groupBy("eventId").agg(F.transform(lists, lambda x: x["sourceId"]).alias("sourceIds"), F.sum("n").alias("n"))


def with_sources(page: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``articleCount`` and ``sources``, of which missing ones are left out.

    A page is at most ``LARGEST_PAGE`` stories, so its keys go to the articles and not the articles to it.
    """
    mine = articles.join(F.broadcast(page.select(F.col("_id").alias("eventId"))), "eventId", "left_semi")
    each = mine.groupBy("eventId", "sourceId").agg(F.min(F.struct("_creationTime", "_id")).alias("first"), F.count("*").alias("n"))
    outlets = sources.select(F.col("_id").alias("sourceId"), F.struct(*sources.columns).alias("source"))
    found = each.join(outlets, "sourceId", "left")
    lists = F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("first", "source"))))
    facts = found.groupBy("eventId").agg(F.sum("n").alias("articleCount"), F.transform(lists, lambda x: x["source"]).alias("sources"))
    out = page.join(facts, page["_id"] == facts["eventId"], "left").drop("eventId")
    empty = F.array().cast(facts.schema["sources"].dataType)
    return out.withColumns({"articleCount": F.coalesce("articleCount", F.lit(0).cast("bigint")), "sources": F.coalesce("sources", empty)})


def feed(
    stories: DataFrame, articles: DataFrame, sources: DataFrame, size: int = 6, topic: str | None = None, after: tuple | None = None
) -> DataFrame:
    """A page of the feed. The topic is looked for **within** the page, so a page can
    be short or empty though later ones are not. The embedding is left out."""
    page = about(page_of(stories, size, after), topic).drop("embedding")
    return with_sources(page, articles, sources).orderBy(*[F.desc(c) for c in RECENCY])


def feed_page(
    stories: DataFrame, articles: DataFrame, sources: DataFrame, size: int = 6, topic: str | None = None, after: tuple | None = None
) -> Page:
    """The page with its cursor, which is the last story's before the topic is looked for."""
    rows = published(stories.select(*RECENCY, "status"), after)
    keys = rows.orderBy(*[F.desc(c) for c in RECENCY]).limit(size + 1).collect()
    cursor = tuple(keys[min(size, len(keys)) - 1][c] for c in RECENCY) if keys else after
    return Page(feed(stories, articles, sources, size, topic, after), cursor, len(keys) <= size)


def feed_of_topic(stories: DataFrame, articles: DataFrame, sources: DataFrame, topic: str, size: int = 6, after: tuple | None = None) -> DataFrame:
    """Variant of this library: the topic is looked for **before** the page is cut, so pages are full."""
    return with_sources(page_of(about(stories, topic), size, after).drop("embedding"), articles, sources).orderBy(*[F.desc(c) for c in RECENCY])


def unique(df: DataFrame, what: str) -> DataFrame:
    """The rows; an error when they are computed if there are several."""
    n = df.agg(F.count("*").alias("found"))
    checked = n.select(F.when(F.col("found") > 1, F.raise_error(F.lit(f"several rows for {what}"))).otherwise(F.col("found")).alias("found"))
    # one row of one number meets one row at most
    return df.join(F.broadcast(checked), F.col("found") == 1).drop("found")


def story_page(stories: DataFrame, articles: DataFrame, sources: DataFrame, slug: str) -> DataFrame:
    """A row for each article of the story, with its source or null; one row with a
    null article if it has none; no row if there is no such story, whatever its status."""
    story = unique(stories.where(F.col("slug") == slug).drop("embedding"), f"slug {slug}")
    outlets = sources.select(F.col("_id").alias("sourceId"), F.struct(*sources.columns).alias("source"))
    # one story at most, so its key goes to the articles, and only its own meet the outlets
    key = F.broadcast(stories.where(F.col("slug") == slug).select(F.col("_id").alias("eventId")).limit(1))
    mine = articles.drop("embedding").join(key, "eventId", "left_semi").join(outlets, "sourceId", "left")
    packed = mine.select(F.col("eventId"), F.struct(*[c for c in mine.columns]).alias("article"))
    story = story.select(F.col("_id").alias("storyId"), F.struct(*story.columns).alias("story"))
    return story.join(packed, F.col("storyId") == F.col("eventId"), "left").select("story", "article").orderBy("article._creationTime", "article._id")


def topics_shown(topics: DataFrame) -> DataFrame:
    """By name as a reader would sort them, ties in order of creation."""
    return topics.orderBy(F.collate("displayName", "UNICODE"), "_creationTime", "_id")


def topic_names(stories: DataFrame, topics: DataFrame, missing: str | None) -> DataFrame:
    """(_id, names): names of a story's topics in its order. ``missing`` stands for
    unknown topics; if it is null they are left out, as are empty names."""
    each = stories.select("_id", F.posexplode_outer("topicIds").alias("at", "topicId"))
    known = each.join(topics.select(F.col("_id").alias("topicId"), "displayName"), "topicId", "left")
    name = F.coalesce("displayName", F.lit(missing)) if missing is not None else F.nullif("displayName", F.lit(""))
    listed = F.when(F.col("at").isNotNull() & name.isNotNull(), F.struct(F.col("at"), name.alias("name")))
    return known.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["name"]).alias("names"))


def cards(page: DataFrame, topics: DataFrame) -> DataFrame:
    """What the feed's cards show of a page."""
    named = page.join(topic_names(page, topics, None), "_id")
    primary = display.primary_topic(F.col("names"))
    return named.select(
        "_id",
        "title",
        "slug",
        primary.alias("topic"),
        display.or_if_empty(F.col("imageUrl"), primary).alias("image"),
        F.transform(F.slice("sources", 1, 5), lambda s: s["name"]).alias("outlets"),
        display.article_count(F.col("articleCount")).alias("articles"),
    )


def articles_shown(page: DataFrame) -> DataFrame:
    """What a story's page lists of its articles: the outlet's bias, not the article's."""
    a = F.col("article")
    return page.where(a.isNotNull()).select(
        a["_id"].alias("_id"),
        a["title"].alias("title"),
        a["source"]["name"].alias("outlet"),
        bias.label(a["source"]["baseBias"]).alias("bias"),
        display.date_shown(a["publishedAt"]).alias("date"),
    )


def report_stories(stories: DataFrame, articles: DataFrame, topics: DataFrame) -> DataFrame:
    counts = articles.groupBy(F.col("eventId").alias("_id")).agg(F.count("*").alias("n"))
    named = stories.select("_id", "title", "_creationTime", "topicIds")
    out = named.join(topic_names(named, topics, "Unknown"), "_id").join(counts, "_id", "left")
    return out.select("_id", "_creationTime", "title", F.col("names").alias("topics"), F.coalesce("n", F.lit(0).cast("bigint")).alias("articleCount"))


def report_articles(stories: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    known = articles.select("_id", "_creationTime", "title", "sourceId", "eventId", "aiBiasScore")
    known = known.join(sources.select(F.col("_id").alias("sourceId"), "name"), "sourceId", "left")
    known = known.join(stories.select(F.col("_id").alias("eventId"), F.col("title").alias("about")), "eventId", "left")
    return known.select(
        "_id",
        "_creationTime",
        display.shortened(F.col("title"), 50).alias("title"),
        F.coalesce("name", F.lit("Unknown")).alias("source"),
        F.coalesce(display.shortened(F.col("about"), 30), F.lit("Unclustered")).alias("story"),
        F.col("aiBiasScore").alias("biasScore"),
    )


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


def sources_reported(sources: DataFrame) -> DataFrame:
    return sources.select("name", "domain", F.col("baseBias").alias("bias"))
