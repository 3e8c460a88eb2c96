"""Queries over the stand-in tables, each beside the SQL that gives the same rows.

Results are flat: arrays and structs come as joined text, so that both engines
compare. Sizes of pages, cursors and thresholds are those of the product where it
has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.functions import bias, display, urls
from manyview.operators import ingest, readers, similarity, stories, todos, users
from manyview.sources import adapters
from manyview.sources.schema import schema
from manyview.sources.shared import new_root
from manyview.sources.store import SEEDED, Store
from manyview.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: One time for all that depends on the clock: the end of January 2024.
NOW = 1706659200000.0
#: Suppliers that are left out, so that some references dangle.
KNOWN = "s_suppkey % 7 <> 0"
S_PUBLISHED = "SELECT * FROM orders WHERE o_orderstatus = 'F'"
S_RECENCY = "o_orderdate DESC, o_orderkey DESC"
S_TOPICS = """
topical AS (
  SELECT l_orderkey AS k, list_sort(list(DISTINCT n_regionkey)) AS t FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
)"""
S_OUTLETS = """
firsts AS (
  SELECT l_orderkey AS k, l_suppkey AS s, min(row(l_shipdate, l_linenumber, l_suppkey, l_partkey)) AS f, count(*) AS n FROM lineitem GROUP BY 1, 2
), facts AS (
  SELECT k, sum(n)::BIGINT AS articles, coalesce(string_agg(s_name, ',' ORDER BY f) FILTER (s_name IS NOT NULL), '') AS outlets
  FROM firsts LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0) ON s = s_suppkey GROUP BY 1
)"""
S_LABEL = "CASE WHEN {0} < -2 THEN 'Left' WHEN {0} < -0.5 THEN 'Lean Left' WHEN {0} <= 0.5 THEN 'Center' WHEN {0} <= 2 THEN 'Lean Right' ELSE 'Right' END"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _tables(spark: SparkSession, d: str, published: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return adapters.stories(spark, d, published), adapters.articles(spark, d), adapters.sources(spark, d, F.expr(KNOWN))


def _flat(page: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("sources", lambda s: s["name"]), ",")
    return page.select(F.col("_id").alias("story"), F.col("articleCount").alias("articles"), names.alias("outlets"))


def _topic_feed_sql(inner: str, outer: str) -> str:
    return f"""
WITH {S_TOPICS}, page AS (
  SELECT o.*, coalesce(t, []) AS t FROM ({S_PUBLISHED}) o LEFT JOIN topical ON k = o_orderkey {inner} ORDER BY {S_RECENCY} LIMIT 60
), {S_OUTLETS}
SELECT o_orderkey AS story, coalesce(articles, 0)::BIGINT AS articles, coalesce(outlets, '') AS outlets
FROM page LEFT JOIN facts ON k = o_orderkey {outer}
"""


@query(_topic_feed_sql("", "WHERE list_contains(t, 2)"))
def feed_topic_within_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 60; the topic is looked for within it, so fewer are left."""
    s, a, o = _tables(spark, d, True)
    # topics are joined to the page's stories only, as the page does not depend on them
    page = stories.about(adapters.with_topics(spark, d, stories.page_of(s, 60), page=True), 2).drop("embedding")
    return _flat(stories.with_sources(page, a, o))


@query(_topic_feed_sql("WHERE list_contains(t, 2)", ""))
def feed_topic_before_page(spark: SparkSession, d: str) -> DataFrame:
    s, a, o = _tables(spark, d, True)
    return _flat(stories.feed_of_topic(adapters.with_topics(spark, d, s), a, o, 2, 60))


@query(f"""
WITH page AS (SELECT * FROM ({S_PUBLISHED}) ORDER BY {S_RECENCY} LIMIT 6), {S_OUTLETS}
SELECT o_orderkey AS story, coalesce(articles, 0)::BIGINT AS articles, coalesce(outlets, '') AS outlets FROM page LEFT JOIN facts ON k = o_orderkey
""")
def feed_first_page(spark: SparkSession, d: str) -> DataFrame:
    return _flat(stories.feed(*_tables(spark, d, True)))


@query(f"""
WITH page AS (SELECT * FROM ({S_PUBLISHED}) ORDER BY {S_RECENCY} LIMIT 6 OFFSET 12), {S_OUTLETS}
SELECT o_orderkey AS story, coalesce(articles, 0)::BIGINT AS articles, coalesce(outlets, '') AS outlets FROM page LEFT JOIN facts ON k = o_orderkey
""")
def feed_third_page(spark: SparkSession, d: str) -> DataFrame:
    """The page after two cursors."""
    s, a, o = _tables(spark, d, True)
    cursor = None
    for _ in range(2):
        cursor = stories.feed_page(s, a, o, 6, after=cursor).cursor
    return _flat(stories.feed(s, a, o, 6, after=cursor))


@query(f"""
WITH {S_TOPICS}, page AS (
  SELECT o.*, coalesce(t, []) AS t FROM ({S_PUBLISHED}) o LEFT JOIN topical ON k = o_orderkey ORDER BY {S_RECENCY} LIMIT 60
), {S_OUTLETS}, named AS (
  SELECT o_orderkey AS k2, (SELECT r_name FROM region WHERE r_regionkey = t[1]) AS topic FROM page
)
SELECT o_orderkey AS story, 'Story ' || o_orderkey || ' of ' || o_orderpriority AS title, coalesce(topic, 'General') AS topic,
       CASE WHEN o_orderkey % 2 = 0 THEN 'https://images.example.org/' || o_orderkey ELSE coalesce(topic, 'General') END AS image,
       array_to_string(string_split(coalesce(outlets, ''), ',')[1:5], ',') AS outlets,
       coalesce(articles, 0) || CASE WHEN articles = 1 THEN ' article' ELSE ' articles' END AS articles
FROM page LEFT JOIN facts ON k = o_orderkey LEFT JOIN named ON k2 = o_orderkey
""")
def feed_cards(spark: SparkSession, d: str) -> DataFrame:
    s, a, o = _tables(spark, d, True)
    page = adapters.with_topics(spark, d, stories.page_of(s, 60), page=True).drop("embedding")
    page = page.withColumn("imageUrl", F.when(F.col("_id") % 2 == 0, F.concat(F.lit("https://images.example.org/"), "_id")).otherwise(""))
    shown = stories.cards(stories.with_sources(page, a, o), adapters.topics(spark, d))
    return shown.select(F.col("_id").alias("story"), "title", "topic", "image", F.array_join("outlets", ",").alias("outlets"), "articles")


@query("""
WITH firsts AS (
  SELECT l_orderkey AS k, l_suppkey AS s, min(row(l_shipdate, l_linenumber, l_suppkey, l_partkey)) AS f, count(*) AS n FROM lineitem GROUP BY 1, 2
)
SELECT k AS story, sum(n)::BIGINT AS articles, string_agg(s, ',' ORDER BY f) AS source_ids FROM firsts GROUP BY 1
""")
def sources_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Ordered distinct sources of every story."""
    out = stories.first_seen_sources(adapters.articles(spark, d))
    return out.select(F.col("eventId").alias("story"), F.col("n").alias("articles"), F.array_join(F.col("sourceIds").cast("array<string>"), ",").alias("source_ids"))


def _detail_sql(where: str) -> str:
    return f"""
SELECT o_orderkey AS story, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS article, l_suppkey AS source_id, s_name AS source
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM supplier WHERE {KNOWN}) ON s_suppkey = l_suppkey
WHERE {where}
"""


def _detail(spark: SparkSession, d: str, slug: str) -> DataFrame:
    page = stories.story_page(*_tables(spark, d), slug)
    return page.select(
        F.col("story._id").alias("story"), F.col("article._id").alias("article"), F.col("article.sourceId").alias("source_id"), F.col("article.source.name").alias("source")
    )


@query(_detail_sql("o_orderkey = 7"))
def story_detail(spark: SparkSession, d: str) -> DataFrame:
    return _detail(spark, d, "order-7")


@query(_detail_sql("o_orderkey = -1"))
def story_detail_missing(spark: SparkSession, d: str) -> DataFrame:
    """No row where the product answers null."""
    return _detail(spark, d, "order--1")


@query(f"""
SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS article,
       'Part ' || l_partkey || ' by supplier ' || l_suppkey || ' in a line of flags ' || l_returnflag || l_linestatus AS title, s_name AS outlet,
       CASE WHEN s_name IS NULL THEN 'Right' ELSE {S_LABEL.format("(s_acctbal / 1000 - 5)")} END AS bias, strftime(l_shipdate, '%-m/%-d/%Y') AS date
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE {KNOWN}) ON s_suppkey = l_suppkey WHERE l_orderkey = 7
""")
def story_articles_shown(spark: SparkSession, d: str) -> DataFrame:
    return stories.articles_shown(stories.story_page(*_tables(spark, d), "order-7")).withColumnRenamed("_id", "article")


@query("SELECT r_regionkey AS topic, r_name AS name, row_number() OVER (ORDER BY r_name, r_regionkey)::INT AS place FROM region")
def topics_in_order(spark: SparkSession, d: str) -> DataFrame:
    """With the place in the order, since a comparison may not keep rows in order."""
    from pyspark.sql.window import Window

    rows = stories.topics_shown(adapters.topics(spark, d))
    place = F.row_number().over(Window.orderBy(F.collate("displayName", "UNICODE"), "_creationTime"))
    return rows.select(F.col("_id").alias("topic"), F.col("displayName").alias("name"), place.alias("place"))


@query(f"""
WITH {S_TOPICS}, counts AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), named AS (
  SELECT k, string_agg(coalesce(r_name, 'Unknown'), ',' ORDER BY x.i) AS names
  FROM (SELECT k, unnest(t) AS topic, unnest(range(len(t))) AS i FROM topical) x LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON r_regionkey = topic GROUP BY k
)
SELECT o_orderkey AS story, coalesce(names, '') AS topics, coalesce(n, 0)::BIGINT AS articles
FROM orders LEFT JOIN named USING (k) LEFT JOIN counts USING (k)
""".replace("FROM orders LEFT JOIN", "FROM (SELECT *, o_orderkey AS k FROM orders) LEFT JOIN"))
def report_of_stories(spark: SparkSession, d: str) -> DataFrame:
    s, a, _ = _tables(spark, d)
    known = adapters.topics(spark, d).where("_id <> 3")
    out = stories.report_stories(adapters.with_topics(spark, d, s), a, known)
    return out.select(F.col("_id").alias("story"), F.array_join("topics", ",").alias("topics"), F.col("articleCount").alias("articles"))


@query(f"""
SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS article,
       substr('Part ' || l_partkey || ' by supplier ' || l_suppkey || ' in a line of flags ' || l_returnflag || l_linestatus, 1, 50) || '...' AS title,
       coalesce(s_name, 'Unknown') AS source, coalesce(substr('Story ' || o_orderkey || ' of ' || o_orderpriority, 1, 30) || '...', 'Unclustered') AS story,
       round(l_discount * 100 - 5, 2) AS bias_score
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE {KNOWN}) ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) ON o_orderkey = l_orderkey
""")
def report_of_articles(spark: SparkSession, d: str) -> DataFrame:
    s, a, o = _tables(spark, d)
    out = stories.report_articles(s.where("_id % 5 <> 0"), a, o)
    return out.select(F.col("_id").alias("article"), "title", "source", "story", F.col("biasScore").alias("bias_score"))


@query("""
SELECT 'topics' AS name, count(*) AS n FROM region UNION ALL SELECT 'sources', count(*) FROM supplier
UNION ALL SELECT 'events', count(*) FROM orders UNION ALL SELECT 'articles', count(*) FROM lineitem
""")
def report_of_counts(spark: SparkSession, d: str) -> DataFrame:
    return stories.counts(
        topics=adapters.topics(spark, d), sources=adapters.sources(spark, d), events=adapters.stories(spark, d), articles=adapters.articles(spark, d)
    )


@query("SELECT s_name AS name, 'supplier' || s_suppkey || '.example.org' AS domain, s_acctbal / 1000 - 5 AS bias FROM supplier")
def report_of_sources(spark: SparkSession, d: str) -> DataFrame:
    return stories.sources_reported(adapters.sources(spark, d))


@query(f"""
SELECT s_suppkey AS source, {S_LABEL.format("(s_acctbal / 1000 - 5)")} AS label,
       CASE {S_LABEL.format("(s_acctbal / 1000 - 5)")} WHEN 'Left' THEN 'bg-blue-500' WHEN 'Lean Left' THEN 'bg-blue-400' WHEN 'Center' THEN 'bg-gray-500'
       WHEN 'Lean Right' THEN 'bg-red-400' ELSE 'bg-red-500' END AS colour, round((s_acctbal / 1000 - 5 + 5) / 10 * 100, 6) AS place
FROM supplier
""")
def bias_scale(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("baseBias")
    rows = adapters.sources(spark, d)
    return rows.select(F.col("_id").alias("source"), bias.label(b).alias("label"), bias.colour(b).alias("colour"), F.round(bias.position(b), 6).alias("place"))


@query("""
SELECT o_orderkey AS story, l <> '' OR r <> '' AS perspectives,
       concat_ws(',', CASE WHEN l <> '' THEN 'left' END, 'center', CASE WHEN r <> '' THEN 'right' END) AS tabs
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a' END AS l, CASE WHEN o_orderkey % 4 = 0 THEN 'b' ELSE '' END AS r FROM orders)
""")
def perspective_tabs(spark: SparkSession, d: str) -> DataFrame:
    left = F.when(F.col("_id") % 3 == 0, "").otherwise("a").alias("left")
    right = F.when(F.col("_id") % 4 == 0, "b").alias("right")
    rows = adapters.stories(spark, d).select("_id", F.struct(F.lit("c").alias("center"), left, right).alias("p"))
    return rows.select(
        F.col("_id").alias("story"), display.has_perspectives(F.col("p")).alias("perspectives"), F.array_join(display.tabs(F.col("p")), ",").alias("tabs")
    )


S_USER = "'auth:' || c_custkey"
S_MAIL = "lower(c_name) || '@example.org'"


@query(f"""
SELECT {S_USER} AS auth_id, {S_MAIL} AS email, c_acctbal > 0 AS verified, 'users:' || c_custkey AS user_id, c_name AS profile_name, c_mktsegment AS job
FROM customer WHERE c_custkey = 3
""")
def current_user(spark: SparkSession, d: str) -> DataFrame:
    out = users.current_user(adapters.auth_users(spark, d), adapters.users(spark, d), "auth:3")
    return out.select(
        F.col("authId").alias("auth_id"),
        "email",
        F.col("emailVerified").alias("verified"),
        F.col("userId").alias("user_id"),
        F.col("profile.name").alias("profile_name"),
        F.col("profile.job").alias("job"),
    )


@query(f"SELECT {S_USER} AS auth_id, {S_MAIL} AS email, c_name AS name FROM customer WHERE c_custkey = 3")
def auth_user(spark: SparkSession, d: str) -> DataFrame:
    return users.auth_user(adapters.auth_users(spark, d), "auth:3").select(F.col("_id").alias("auth_id"), "email", "name")


@query(f"SELECT 'users:' || c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN {S_MAIL} ELSE c_name END AS shown FROM customer")
def welcome_names(spark: SparkSession, d: str) -> DataFrame:
    """Everyone's, half of them without a name."""
    even = F.regexp_extract("_id", r"\d+", 0).cast("long") % 2 == 0
    rows = adapters.auth_users(spark, d).withColumn("name", F.when(even, "").otherwise(F.col("name")))
    joined = rows.alias("a").join(adapters.users(spark, d).alias("u"), F.col("a._id") == F.col("u.authUserId"))
    out = users.welcome_name(joined.select(F.col("u._id").alias("userId"), "a.name", "a.email"))
    return out.withColumnRenamed("userId", "user_id")


@query("""
SELECT 'users:' || c_custkey AS user_id, c_name AS name, CASE WHEN c_custkey = 3 THEN 'Editor' ELSE c_mktsegment END AS job,
       CASE WHEN c_custkey = 3 THEN 41.0::DOUBLE END AS age FROM customer
""")
def profile_updated(spark: SparkSession, d: str) -> DataFrame:
    out = users.update_profile(adapters.users(spark, d), "auth:3", {"job": "Editor", "age": 41})
    return out.select(F.col("_id").alias("user_id"), F.col("profile.name").alias("name"), F.col("profile.job").alias("job"), F.col("profile.age").alias("age"))


@query("""
SELECT 'users:' || c_custkey AS user_id,
       CASE WHEN c_custkey <> 3 AND c_acctbal > 0 THEN CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END END AS income,
       CASE WHEN c_custkey = 3 THEN 'rent,jobs' WHEN c_acctbal > 0 THEN c_mktsegment END AS concerns,
       CASE WHEN c_custkey = 3 THEN 'center' END AS leaning FROM customer
""")
def private_context_replaced(spark: SparkSession, d: str) -> DataFrame:
    new = {"concerns": ["rent", "jobs"], "interests": [], "politicalLeaning": "center"}
    out = users.update_private_context(adapters.users(spark, d), "auth:3", new)
    c = "privateContext"
    return out.select(
        F.col("_id").alias("user_id"),
        F.col(f"{c}.incomeBracket").alias("income"),
        F.array_join(f"{c}.concerns", ",").alias("concerns"),
        F.col(f"{c}.politicalLeaning").alias("leaning"),
    )


@query("""
SELECT 'users:' || c_custkey AS user_id, CASE WHEN c_custkey = 3 THEN CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' END END AS income FROM customer
""")
def private_context_visible(spark: SparkSession, d: str) -> DataFrame:
    out = users.visible_to(adapters.users(spark, d), "auth:3")
    return out.select(F.col("_id").alias("user_id"), F.col("privateContext.incomeBracket").alias("income"))


@query(f"""
SELECT 'users:' || CASE WHEN new THEN 'auth:' ELSE '' END || c_custkey AS user_id, {S_MAIL} AS email, c_name AS name,
       CASE WHEN new THEN NULL ELSE c_mktsegment END AS job, 0.0::DOUBLE AS streak
FROM (SELECT *, c_custkey % 4 = 0 AS new FROM customer)
""")
def accounts_created(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the accounts is new."""
    fourth = F.regexp_extract("_id", r"\d+", 0).cast("long") % 4 == 0
    out = users.on_create(adapters.users(spark, d).where(~fourth), adapters.auth_users(spark, d).where(fourth), NOW)
    return out.select(
        F.col("_id").alias("user_id"), "email", F.col("profile.name").alias("name"), F.col("profile.job").alias("job"), F.col("stats.currentStreak").alias("streak")
    )


@query(f"SELECT 'users:' || c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'new' || c_custkey || '@example.org' ELSE {S_MAIL} END AS email FROM customer")
def accounts_updated(spark: SparkSession, d: str) -> DataFrame:
    """Of two fifths that report a change, one has a new address."""
    n = F.regexp_extract("_id", r"\d+", 0).cast("long")
    rows = adapters.auth_users(spark, d).where((n % 5).isin(0, 1))
    changes = rows.select("_id", F.col("email").alias("old"), F.when(n % 5 == 0, F.concat(F.lit("new"), n, F.lit("@example.org"))).otherwise(F.col("email")).alias("new"))
    return users.on_update(adapters.users(spark, d), changes).select(F.col("_id").alias("user_id"), "email")


@query("SELECT 'users:' || c_custkey AS user_id FROM customer WHERE c_custkey % 6 <> 0")
def accounts_deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = adapters.auth_users(spark, d).where(F.regexp_extract("_id", r"\d+", 0).cast("long") % 6 == 0)
    return users.on_delete(adapters.users(spark, d), gone).select(F.col("_id").alias("user_id"))


@query("""
SELECT c_custkey AS customer, 'OK' AS health, CASE WHEN c_custkey % 3 = 0 THEN 'Not authenticated' ELSE 'This is private' END AS message FROM customer
""")
def constant_answers(spark: SparkSession, d: str) -> DataFrame:
    """What everyone is told, a third of whom has no identity."""
    n = F.col("c_custkey")
    identity = F.when(n % 3 != 0, F.concat(F.lit("auth:"), n))
    told = F.when(identity.isNull(), users.private_message(None)).otherwise(users.private_message("someone"))
    return adapters.load(spark, d, "customer").select(n.alias("customer"), F.lit(users.health()).alias("health"), told.alias("message"))


@query("SELECT 'users:3' AS user_id, c_name AS name, 'Editor' AS job, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' END AS income FROM customer WHERE c_custkey = 3")
def profile_returned(spark: SparkSession, d: str) -> DataFrame:
    """The row that a change of profile gives back."""
    out = users.returned(users.update_profile(adapters.users(spark, d), "auth:3", {"job": "Editor"}), "auth:3")
    return out.select(F.col("_id").alias("user_id"), F.col("profile.name").alias("name"), F.col("profile.job").alias("job"), F.col("privateContext.incomeBracket").alias("income"))


@query("SELECT 'users:3' AS user_id, NULL::VARCHAR AS income, 'rent' AS concerns, c_mktsegment AS job FROM customer WHERE c_custkey = 3")
def private_context_returned(spark: SparkSession, d: str) -> DataFrame:
    out = users.returned(users.update_private_context(adapters.users(spark, d), "auth:3", {"concerns": ["rent"], "interests": []}), "auth:3")
    c = "privateContext"
    return out.select(F.col("_id").alias("user_id"), F.col(f"{c}.incomeBracket").alias("income"), F.array_join(f"{c}.concerns", ",").alias("concerns"), F.col("profile.job").alias("job"))


S_CANONICAL = r"""
(SELECT page_id, url, p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM (
  SELECT page_id, url, regexp_extract(b, '^[^?]*') AS p,
         array_to_string([x FOR x IN string_split(regexp_extract(b, '\?(.*)$', 1), '&') IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=.*)?$')], '&') AS q
  FROM (SELECT *, regexp_replace(url, '#.*$', '') AS b FROM pages)))
"""
S_DOMAIN = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '')"


@query(f"SELECT page_id, canonical, {S_DOMAIN} AS domain FROM {S_CANONICAL}")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return adapters.load(spark, d, "pages").select("page_id", urls.canonical(url).alias("canonical"), urls.domain(url).alias("domain"))


@query(f"""
SELECT min(page_id) AS page_id, canonical FROM {S_CANONICAL} c
WHERE NOT EXISTS (SELECT 1 FROM {S_CANONICAL} o WHERE o.page_id % 3 = 0 AND o.canonical = c.canonical) GROUP BY canonical
""")
def articles_taken_in(spark: SparkSession, d: str) -> DataFrame:
    """A third of the pages are known already."""
    pages = adapters.load(spark, d, "pages").select(F.col("page_id").alias("_id"), "url")
    known = pages.where(F.col("_id") % 3 == 0).select(urls.canonical(F.col("url")).alias("canonicalUrl"))
    return ingest.new_articles(pages, known).select(F.col("_id").alias("page_id"), F.col("canonicalUrl").alias("canonical"))


@query(f"""
WITH d AS (SELECT page_id, {S_DOMAIN} AS domain FROM pages), s AS (SELECT domain, min(page_id) AS source_id FROM d WHERE page_id % 2 = 0 GROUP BY 1)
SELECT page_id, d.domain, source_id FROM d LEFT JOIN s ON s.domain = d.domain
""")
def article_sources(spark: SparkSession, d: str) -> DataFrame:
    """Outlets are the domains of every other page."""
    pages = adapters.load(spark, d, "pages").select(F.col("page_id").alias("_id"), "url")
    outlets = pages.where("_id % 2 = 0").select("_id", F.col("_id").alias("_creationTime"), urls.domain(F.col("url")).alias("domain"))
    return ingest.with_source(pages, outlets).select(F.col("_id").alias("page_id"), "domain", F.col("sourceId").alias("source_id"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return adapters.load(spark, d, "embeddings").select(F.col("vec_id").alias("_id"), "embedding", "label")


S_UNITS = "u AS (SELECT vec_id, label, [x::DOUBLE / n FOR x IN embedding] AS v FROM (SELECT *, sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding])) AS n FROM embeddings))"
S_PAIRS = "list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)])"


@query(f"""
WITH {S_UNITS}, s AS (SELECT a.vec_id AS query, b.vec_id AS key, {S_PAIRS} AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, key)::INT AS rank FROM s)
SELECT query, rank, key, round(c, 6) AS similarity FROM r WHERE rank <= 5
""")
def related_by_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    out = similarity.nearest(rows.where("_id % 50 = 0"), rows, 5)
    return out.select("query", "rank", "key", F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH {S_UNITS}, s AS (SELECT a.vec_id AS query, b.vec_id AS key, {S_PAIRS} AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.label = 0 AND b.label <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, key) AS rank FROM s WHERE c >= 0.2)
SELECT vec_id AS article, key AS story FROM u LEFT JOIN r ON query = vec_id AND rank = 1 WHERE label = 0
""")
def articles_clustered(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    waiting = rows.where("label = 0").withColumn("status", F.lit("unprocessed"))
    return similarity.assign(waiting, rows.where("label <> 0"), 0.2).select(F.col("_id").alias("article"), F.col("eventId").alias("story"))


@query("SELECT vec_id AS story, (label % 3)::INT AS version FROM embeddings WHERE label % 3 < 2")
def embeddings_outdated(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).withColumn("embeddingVersion", F.col("label") % 3)
    return similarity.outdated(rows, 2.0).select(F.col("_id").alias("story"), F.col("embeddingVersion").alias("version"))


def _insights(spark: SparkSession, d: str) -> DataFrame:
    """An insight for each order, with times from the order's date."""
    rows = adapters.stories(spark, d)
    made = F.col("firstPublishedAt")
    return rows.select(
        F.col("_id"),
        F.col("customer").alias("userId"),
        F.col("_id").alias("eventId"),
        (made + (F.col("_id") % 3 - 1) * readers.DAY).alias("eventLastUpdated"),
        (made + 2 * readers.DAY).alias("expiresAt"),
        F.when(F.col("_id") % 2 == 0, made).alias("lastNotifiedAt"),
    )


S_MS = "epoch_ms(o_orderdate)"
S_MID = 946684800000
S_INSIGHTS = f"(SELECT o_orderkey AS k, o_custkey AS c, {S_MS} AS t FROM orders)"


@query(f"SELECT k AS insight, c AS user_id FROM {S_INSIGHTS} WHERE t + 2 * 86400000 > {S_MID} AND k % 3 - 1 >= 0")
def insights_usable(spark: SparkSession, d: str) -> DataFrame:
    summed = adapters.stories(spark, d).select("_id", F.col("firstPublishedAt").alias("lastSummarizedAt"))
    return readers.usable_insights(_insights(spark, d), summed, float(S_MID)).select(F.col("_id").alias("insight"), F.col("userId").alias("user_id"))


@query(f"SELECT k AS insight FROM {S_INSIGHTS} WHERE t + 2 * 86400000 > {S_MID}")
def insights_kept(spark: SparkSession, d: str) -> DataFrame:
    return readers.without_expired(_insights(spark, d), float(S_MID)).select(F.col("_id").alias("insight"))


@query(f"SELECT k AS insight FROM {S_INSIGHTS} WHERE k % 2 <> 0 OR t <= {S_MID} - 86400000")
def insights_to_notify(spark: SparkSession, d: str) -> DataFrame:
    return readers.may_notify(_insights(spark, d), float(S_MID), readers.DAY).select(F.col("_id").alias("insight"))


@query(f"SELECT o_orderkey AS story FROM orders WHERE {S_MS} < {S_MID} - 365 * 86400000::BIGINT")
def summaries_stale(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.stories(spark, d).select("_id", F.col("firstPublishedAt").alias("lastSummarizedAt"))
    return readers.stale_summaries(rows, float(S_MID), 365 * readers.DAY).select(F.col("_id").alias("story"))


@query("""
SELECT user_id, count(*) AS articles_read, round(avg((event_id % 11 - 5)::DOUBLE) * 100 / 5, 6) AS bias_balance FROM events WHERE event_type = 'click' GROUP BY 1
""")
def reader_balance(spark: SparkSession, d: str) -> DataFrame:
    out = readers.balance(adapters.interactions(spark, d))
    return out.select(F.col("userId").alias("user_id"), F.col("articlesRead").alias("articles_read"), F.round("biasBalance", 6).alias("bias_balance"))


@query("""
WITH days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
runs AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g, day FROM days),
lengths AS (SELECT user_id, g, count(*) AS n, max(day) AS last FROM runs GROUP BY 1, 2)
SELECT user_id, coalesce(max(n) FILTER (last >= DATE '2024-01-31' - 1), 0)::BIGINT AS current_streak, max(n) AS longest_streak FROM lengths GROUP BY 1
""")
def reader_streaks(spark: SparkSession, d: str) -> DataFrame:
    out = readers.streaks(adapters.interactions(spark, d), NOW)
    return out.select(F.col("userId").alias("user_id"), F.col("currentStreak").alias("current_streak"), F.col("longestStreak").alias("longest_streak"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 'click_source' ELSE event_type END AS type,
       coalesce(json_extract_string(props, '$.device'), 'unknown') AS device, count(*) AS n FROM events GROUP BY 1, 2, 3
""")
def interactions_by_day(spark: SparkSession, d: str) -> DataFrame:
    return readers.by_day(adapters.interactions(spark, d)).withColumn("day", F.col("day").cast("string"))


def _streamed(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    root = new_root(spark, "streamed")
    activity.to_files(out, f"{root}/out", f"{root}/state", mode).awaitTermination()
    return activity.written(spark, f"{root}/out", out.schema, mode)


@query("""
SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def streamed_per_day(spark: SparkSession, d: str) -> DataFrame:
    out = _streamed(spark, activity.per_window(activity.read_activity(spark, d)), "complete")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})


@query("""
SELECT start, start + INTERVAL 2 DAY AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY ALL
""")
def streamed_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = _streamed(spark, activity.per_window(activity.read_activity(spark, d), "2 days", "1 day"), "complete")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})


@query("""
WITH marked AS (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, user_id, count(*) AS n, round(sum(value), 4) AS total FROM numbered GROUP BY user_id, s
""")
def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _streamed(spark, activity.sessions(activity.read_activity(spark, d), "6 hours"), "complete")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})


@query("SELECT event_id, event_type FROM events GROUP BY ALL")
def streamed_once(spark: SparkSession, d: str) -> DataFrame:
    """The log read twice over: each event comes once."""
    rows = activity.read_activity(spark, d)
    return _streamed(spark, activity.once(rows.unionByName(rows)).select("event_id", "event_type"), "append")


@query("""
WITH p AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 60)
SELECT 60 AS size, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS cursor, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') <= 60 AS done FROM p
UNION ALL SELECT 1000, -1, true
""")
def feed_cursors(spark: SparkSession, d: str) -> DataFrame:
    """The cursor of a page with more behind it; a page after the last story has no row (-1), and is done."""
    s, a, o = _tables(spark, d, True)
    page = stories.feed_page(s, a, o, 60)
    end = stories.feed_page(s, a, o, 1000, after=(float("-inf"), 0.0, 0))
    rows = [(60, page.cursor[2], page.done), (1000, end.stories.count() - 1, end.done)]
    return spark.createDataFrame(rows, "size int, cursor long, done boolean")


def _store(spark: SparkSession) -> Store:
    return Store(spark, new_root(spark, "store"))


def _rows_of(store: Store) -> DataFrame:
    return stories.counts(**{t: store.read(t) for t in (*SEEDED, "users")})


@query("""
SELECT * FROM (VALUES ('topics', 2), ('sources', 3), ('stories', 2), ('articles', 6), ('empty: seeded', 1), ('dimension', 1536),
                      ('topics there: already seeded', 1)) t(name, n)
UNION ALL SELECT 'users', count(*) FROM customer UNION ALL SELECT 'topics there', count(*) FROM region
""")
def seeded(spark: SparkSession, d: str) -> DataFrame:
    """The seed beside users, and where topics are there already, when nothing is written."""
    store, other = _store(spark), _store(spark)
    store.insert("users", adapters.users(spark, d).select(*schema("users").names))
    rows = adapters.topics(spark, d)
    other.insert("topics", rows.select(F.concat(F.lit("topics:"), "_id").alias("_id"), "_creationTime", "slug", "displayName"))
    said = [(f"{what}: {s.seed()}", 1) for what, s in (("empty", store), ("topics there", other))]
    wide = store.read("stories").agg(F.max(F.size("embedding")).cast("long").alias("n")).select(F.lit("dimension").alias("name"), "n")
    left = stories.counts(**{"topics there": other.read("topics")})
    return _rows_of(store).unionByName(spark.createDataFrame(said, "name string, n long")).unionByName(wide).unionByName(left)


@query("SELECT name, CASE WHEN name = 'users' THEN (SELECT count(*) FROM customer) ELSE 0 END AS n FROM (VALUES ('topics'), ('sources'), ('stories'), ('articles'), ('users')) t(name)")
def cleared(spark: SparkSession, d: str) -> DataFrame:
    """Clearing empties what the seed writes, and leaves users alone."""
    store = _store(spark)
    store.seed()
    store.insert("users", adapters.users(spark, d).select(*schema("users").names))
    store.clear()
    return _rows_of(store)


@query("SELECT * FROM (VALUES ('nobody', 'Not authenticated'), ('stranger', 'User not found - please refresh and try again')) t(who, error)")
def account_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for who, identity in (("nobody", None), ("stranger", "auth:none")):
        try:
            users.update_profile(adapters.users(spark, d), identity, {"job": "Editor"})
        except users.AccountError as error:
            rows.append((who, str(error)))
    return spark.createDataFrame(rows, "who string, error string")


@query("""
WITH days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
runs AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g, day FROM days),
lengths AS (SELECT user_id, g, count(*) AS n, max(day) AS last FROM runs GROUP BY 1, 2),
streaks AS (SELECT user_id, coalesce(max(n) FILTER (last >= DATE '2024-01-31' - 1), 0) AS current, max(n) AS longest FROM lengths GROUP BY 1),
opened AS (SELECT user_id, count(*) AS n, avg((event_id % 11 - 5)::DOUBLE) * 100 / 5 AS balance FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT 'users:' || c_custkey AS user_id, coalesce(current, 0)::DOUBLE AS current_streak, coalesce(longest, 0)::DOUBLE AS longest_streak,
       coalesce(n, 0)::DOUBLE AS articles_read, round(coalesce(balance, 0), 6) AS bias_balance
FROM customer LEFT JOIN streaks s ON s.user_id = c_custkey LEFT JOIN opened o ON o.user_id = c_custkey AND s.user_id IS NOT NULL
""")
def reader_stats_refreshed(spark: SparkSession, d: str) -> DataFrame:
    log = adapters.interactions(spark, d).withColumn("userId", F.concat(F.lit("users:"), "userId"))
    out = readers.refreshed_stats(adapters.users(spark, d), log, NOW)
    return out.select(
        F.col("_id").alias("user_id"),
        F.col("stats.currentStreak").alias("current_streak"),
        F.col("stats.longestStreak").alias("longest_streak"),
        F.col("stats.articlesRead").alias("articles_read"),
        F.round("stats.biasBalance", 6).alias("bias_balance"),
    )


def _todos(spark: SparkSession, d: str) -> DataFrame:
    """One for each customer, half of them done; every third is asked for with white space around it, every tenth is empty."""
    n = F.col("c_custkey")
    text = F.when(n % 10 == 0, "  ").when(n % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit("  "))).otherwise(F.col("c_name"))
    asked = adapters.load(spark, d, "customer").select(n.cast("string").alias("_id"), text.alias("text"))
    made = todos.create(spark.createDataFrame([], todos.DDL), asked, NOW)
    return todos.toggle(made, made.where(F.col("_id").cast("long") % 2 == 0).select("_id", F.lit(True).alias("completed")))


@query("SELECT c_custkey::VARCHAR AS todo, c_name AS text, c_custkey % 2 = 0 AS completed FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 <> 0")
def todos_kept(spark: SparkSession, d: str) -> DataFrame:
    """Created, toggled and every seventh deleted."""
    rows = _todos(spark, d)
    out = todos.delete(rows, rows.where(F.col("_id").cast("long") % 7 == 0))
    return todos.every(out).select(F.col("_id").alias("todo"), "text", "completed")


@query("SELECT count(*) FILTER (c_custkey % 2 = 0) AS done, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0")
def todos_counted(spark: SparkSession, d: str) -> DataFrame:
    return todos.completed(_todos(spark, d))
