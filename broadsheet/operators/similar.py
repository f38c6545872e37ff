"""Vector search and similar articles as result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.filters import Filters
from broadsheet.operators.textsearch import fetch, page_of
from broadsheet.operators.vectors import by_distance, nearest, nearest_to
from broadsheet.plans.corpus import Corpus

VECTOR_COLUMNS = ["title", "author", "category", "source", "published_at", "content", "word_count"]
SIMILAR_COLUMNS = ["title", "author", "category", "source", "published_at"]


def with_similarity(df: DataFrame) -> DataFrame:
    """``distance`` is what the order goes by; ``similarity`` is one minus it."""
    return df.withColumn("similarity", F.round(1.0 - F.col("distance"), 6))


def candidates(
    corpus: Corpus, vector: list[float], categories=None, sources=None, k: int = 10
) -> DataFrame:
    """The k nearest articles; filters apply before the distance."""
    return nearest_to(Filters(categories, sources).apply(corpus.vectors), vector, k)


def vector_search(
    corpus: Corpus, vector: list[float], categories=None, sources=None, offset: int = 0,
    limit: int = 10,
) -> DataFrame:
    found = candidates(corpus, vector, categories, sources, offset + limit)
    page = page_of(found, by_distance(), offset, limit)
    results = with_similarity(fetch(corpus, page, VECTOR_COLUMNS, limit))
    return results.select("rank", "id", "distance", "similarity", *VECTOR_COLUMNS)


def vector_total(
    corpus: Corpus, vector: list[float], categories=None, sources=None, offset: int = 0,
    limit: int = 10,
) -> DataFrame:
    """Number of hits: at most ``offset + limit``, not the corpus size."""
    found = candidates(corpus, vector, categories, sources, offset + limit)
    return found.agg(F.count(F.lit(1)).alias("total"))


def similar_articles(corpus: Corpus, article_id: str, limit: int = 5) -> DataFrame:
    """The articles nearest to one article, without itself; empty when it has no vector."""
    clean = article_id.strip("/").removeprefix("article:")
    seed = corpus.vectors.filter(F.col("id") == clean).select("ord", "vector").first()
    if seed is None:
        others, vector = corpus.vectors.filter(F.lit(False)), [1.0]
    else:
        others, vector = corpus.vectors.filter(F.col("ord") != seed["ord"]), list(seed["vector"])
    page = page_of(nearest_to(others, vector, limit), by_distance(), 0, limit)
    results = with_similarity(fetch(corpus, page, SIMILAR_COLUMNS, limit))
    return results.select("rank", "id", "distance", "similarity", *SIMILAR_COLUMNS)


def similar_to_each(
    corpus: Corpus, seeds: DataFrame | None = None, k: int = 5, **sizes
) -> DataFrame:
    """``(id, rank, similar_id, distance)`` for every seed; all articles with a vector by default.

    Only keys and distances pass through the shuffle; the two id columns come from narrow joins.
    """
    corpus_side = corpus.vectors.select("ord", "vector")
    seed_side = corpus.vectors if seeds is None else corpus.vectors.join(seeds, "id", "left_semi")
    found = nearest(
        corpus_side, seed_side.select(F.col("ord").alias("query_key"), "vector"), k, "not_self",
        **sizes,
    )
    ids = corpus.vectors.select("ord", "id")
    return (
        found.join(ids.select(F.col("ord").alias("query_key"), "id"), "query_key")
        .join(ids.select("ord", F.col("id").alias("similar_id")), "ord")
        .select("id", "rank", "similar_id", "distance")
    )
