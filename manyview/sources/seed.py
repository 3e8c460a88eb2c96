"""The seed: two topics, three outlets, two stories and six articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from manyview.sources.schema import DIMENSION, schema

#: When the seed is taken to be written, in milliseconds.
NOW = 1767800000000
DAY, HOUR = 86_400_000, 3_600_000
# The seed's rows.
TOPICS = [("economy", "Economy"), ("tech", "Tech")]
OUTLETS = [("cnn.com", "CNN", -2.0, 7.0), ("foxnews.com", "Fox News", 3.0, 6.0), ("reuters.com", "Reuters", 0.0, 9.0)]
STORIES = [
    ("Federal Reserve Raises Interest Rates to 5.5%", "fed-raises-rates-2026", "economy", 1, 1),
    ("Congress Proposes Comprehensive AI Regulation Framework", "ai-regulations-congress-2026", "tech", 2, 2),
]
ARTICLES = [
    (0, 0, "Fed Hikes Rates Again as Inflation Persists, Squeezing American Families", "2026/01/06/economy/fed-rate-hike-inflation", -2.0, "2026-01-06T14:30:00Z"),
    (0, 1, "Federal Reserve Takes Strong Action to Tame Inflation, Markets Rally", "2026/01/06/fed-rate-hike-markets-rally", 2.0, "2026-01-06T15:00:00Z"),
    (0, 2, "U.S. Federal Reserve Raises Rates to 5.5%, Signals Cautious Outlook", "2026/01/06/fed-rate-decision", 0.0, "2026-01-06T14:00:00Z"),
    (1, 0, "Landmark AI Bill Faces Uphill Battle as Tech Lobbyists Push Back", "2026/01/05/tech/ai-regulation-bill-congress", -1.0, "2026-01-05T10:00:00Z"),
    (1, 1, "New AI Regulations Could Cost Economy Billions, Industry Warns", "2026/01/05/ai-regulation-economic-impact", 3.0, "2026-01-05T12:00:00Z"),
    (1, 2, "U.S. Lawmakers Unveil Bipartisan AI Regulation Framework", "2026/01/05/us-ai-regulation-bill", 0.0, "2026-01-05T09:30:00Z"),
]


def seed(spark: SparkSession, now: int = NOW, dimension: int = DIMENSION) -> dict[str, DataFrame]:
    """The seeded tables. Rows are created a millisecond apart, in the order above."""
    created = float(now)

    def rows(table: str, values: list[tuple]) -> DataFrame:
        return spark.createDataFrame([(f"{table}:{i}", created + i, *v) for i, v in enumerate(values)], schema(table))

    summaries = ("What is agreed.", "What the left stresses.", "What the right stresses.")
    stories = [
        (title, slug, f"https://images.example.org/{slug}.jpg", summaries, "What it means for everyone.", [f"topics:{[t for t, _ in TOPICS].index(topic)}"],
         [0.0] * dimension, 1.0, "published", float(now - days * DAY), float(now - hours * HOUR))
        for title, slug, topic, days, hours in STORIES
    ]
    articles = []
    for story, outlet, title, path, bias, published in ARTICLES:
        url = f"https://{OUTLETS[outlet][0]}/{path}"
        facts = [f"Fact {i} of: {title}" for i in range(1, 6)]
        articles.append((f"stories:{story}", f"sources:{outlet}", title, url, url, f"Summary of: {title}", facts, bias, None, "clustered", published))
    return {
        "topics": rows("topics", TOPICS),
        "sources": rows("sources", [(*o, f"https://logo.clearbit.com/{o[0]}") for o in OUTLETS]),
        "stories": rows("stories", stories),
        "articles": rows("articles", articles),
    }
