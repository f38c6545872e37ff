"""Schemas, field roles and the fixed values of the article model."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RAW_NEWS = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("article", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("publication", T.StringType()),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("summary", T.StringType(), False),
        T.StructField("author", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("tags", T.ArrayType(T.StringType(), False), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("published_at", T.StringType()),
        T.StructField("published_ts", T.LongType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)
ARTICLE_COLUMNS = [f.name for f in ARTICLE.fields]

# Text fields of the index and their weights, in schema order.
FIELD_WEIGHTS = {"title": 5, "content": 1, "summary": 2, "author": 1, "published_at": 1}
TEXT_FIELDS = list(FIELD_WEIGHTS)
SEARCH_FIELDS = ["title", "summary"]
FIELD_BITS = {name: 1 << i for i, name in enumerate(TEXT_FIELDS)}

# Defaults and formats.
DEFAULT_CATEGORY = "General"
UNKNOWN = "Unknown"
NO_SUMMARY = "No summary available."
SUMMARY_CHARS = 250
MIN_WORDS = 10
ID_FORMAT = "nw_%07d"
KEY_PREFIX = "article:"
ALL = "All"

# Sections of each category. Keys are case-sensitive and keep their blanks.
SECTIONS_BY_CATEGORY = {
    "Politics": [
        "politics", "Politics", "opinions", "opinion", "Supreme Court", "Policy", "immigration",
        "election 2020", "2020 elections", "Elections", "Super Tuesday", "Brexit", "Vote Now",
        "nyregion", "upshot",
    ],
    "Business": [
        "Business News", "Market News", "Financials", "Bonds News", "Consumer Goods and Retail",
        "Commodities", "Company News", "Deals", "Energy", "business", "Funds News",
        "Cyclical Consumer Goods", "Basic Materials", "Industrials", "Hot Stocks", "Credit RSS",
        "Wealth", "Markets", "Money", "investing", "Retail", "Economy", "Finance", "Business",
        "finance-and-economics", "economy", "Earnings",
    ],
    "World": [
        "World News", "us", "asia", "middleeast", "africa", "Asia", "Japan", "americas", "europe",
        "China Economy", "china", "britain", "middle-east-and-africa", "india", "australia", "uk",
        "World Politics", "Asia Politics", "Europe Politics", "Europe News", "World Economy",
        "Asia Economy", "Europe Economy", "world", "U.S.", "international",
    ],
    "Technology": [
        "Tech by VICE", "Technology News", "Tech", "tech", "Communications Equipment", "Software",
        "Semiconductors", "Computer Hardware", "Mobile", "Apps", "Internet News", "Cybersecurity",
        "Internet", "Social Media", "technology", "science", "Science", "Science News",
        "science-and-technology", "Technology",
    ],
    "Entertainment": [
        "entertainment", "Entertainment", "Music by VICE", "Noisey", "Entertainment News", "arts",
        "music", "movies", "tv", "theater", "celebrities", "tv-shows", "Television", "Music News",
        "Film News", "culture", "Television News", "Arts", "books", "books-and-arts", "celebrity",
    ],
    "Sports": [
        "Sports News", "Sports", "US College Basketball", "US NBA", "US NHL", "US MLB", "US NFL",
        "Olympics News", "sport", "sports", "US College Football", "Olympics Rio", "RIO 2016",
    ],
    "Health": [
        "Healthcare", "health", "Health News", "Health", "Health and Science", "Drugs", "Health ",
        "healthcare", "Health Insurance", "Hospitals", "Cancer", "Biotechnology",
        "Biotech and Pharma", "Pharmaceuticals", "well",
    ],
    "Lifestyle": [
        "Food by VICE ", "Identity", "Travel", "Lifestyle", "dining", "fashion", "realestate",
        "travel", "Food & Beverage", "Restaurants", "Food", "parenting", "parents", "living",
        "style", "pets", "royals", "t-magazine",
    ],
    "Opinion": [
        "Editorial", "Commentary", "Voices", "perspectives", "ideas", "Comment", "letters",
        "Opinion", "leaders",
    ],
}

# Display name of each publication.
SOURCE_BY_PUBLICATION = {
    "Reuters": "Reuters",
    "CNN": "CNN",
    "TMZ": "TMZ",
    "Vice": "VICE",
    "Vice News": "VICE News",
    "Washington Post": "The Washington Post",
    "Mashable": "Mashable",
    "Vox": "Vox",
    "CNBC": "CNBC",
    "Business Insider": "Business Insider",
    "The New York Times": "The New York Times",
    "Refinery 29": "Refinery29",
    "The Hill": "The Hill",
    "Hyperallergic": "Hyperallergic",
    "The Verge": "The Verge",
    "TechCrunch": "TechCrunch",
    "Politico": "Politico",
    "Economist": "The Economist",
    "Buzzfeed News": "BuzzFeed News",
    "Wired": "Wired",
    "People": "People",
    "New Republic": "New Republic",
    "Gizmodo": "Gizmodo",
}


def section_categories() -> list[tuple[str, str]]:
    return [(s, c) for c, names in SECTIONS_BY_CATEGORY.items() for s in names]


def local_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A small constant table. Through Arrow it becomes a local relation of known size."""
    fields = pa.schema(list(columns.items()))
    arrays = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(arrays, schema=fields))


def dim_section(spark: SparkSession) -> DataFrame:
    """Section to category: a fixed table of 164 rows, safe to broadcast at any data size."""
    return local_table(
        spark, section_categories(), section_key=pa.string(), mapped_category=pa.string()
    )


def dim_publication(spark: SparkSession) -> DataFrame:
    """Publication to display name: a fixed table of 23 rows."""
    return local_table(
        spark,
        list(SOURCE_BY_PUBLICATION.items()),
        publication_key=pa.string(),
        mapped_source=pa.string(),
    )
