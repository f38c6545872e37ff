"""Text search over the index: matching, relevance, order, page, result rows.

A search opens only buckets that hold all its words, by ``term_blocks``. For a page by relevance the
buckets are taken in order of the most that an article in them can score: the best are read first, and of
the others only those that can still beat the last score of the page.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import scoring
from broadsheet.functions.text import highlight as highlight_words
from broadsheet.functions.text import literal_tokens, snippet
from broadsheet.operators.filters import Filters, has_text
from broadsheet.operators.skew import sized_join
from broadsheet.operators.suggest import near_pairs
from broadsheet.plans.corpus import Corpus
from broadsheet.plans.textindex import document_frequency, in_fields
from broadsheet.schemas import SEARCH_FIELDS, local_table
from broadsheet.sources.store import bucket_of_file

# Pages up to this many rows are looked up by literal key, which lets the scan skip all other buckets.
PAGE_ROWS = 1000
FUZZY_DISTANCE = 2
SORTS = ("relevance", "date_desc", "date_asc")
RESULT_COLUMNS = [
    "title", "summary", "content", "author", "category", "published_at", "source", "word_count",
]


# --- matching and scoring ----------------------------------------------------------------------


def bounded_buckets(corpus: Corpus, terms: list[str]) -> DataFrame | None:
    """``(bucket, bound)``: the buckets that hold all terms, and the most that they add up to there in title
    and summary; null where a term stands in other fields only. None where the corpus has no such table."""
    if corpus.term_blocks is None or not terms:
        return None
    blocks = corpus.term_blocks.filter(F.col("term").isin(terms))
    # At most one row per query word.
    idf = document_frequency(corpus.term_stats.filter(F.col("term").isin(terms)), SEARCH_FIELDS).select(
        "term", scoring.idf(F.col("df"), corpus.totals["n"]).alias("idf")
    )
    found = blocks.join(F.broadcast(idf), "term", "left").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count("most").alias("held"), F.sum(F.col("most") * F.col("idf")).alias("bound")
    )
    held = F.when(F.col("held") == len(terms), F.col("bound"))
    return found.filter(F.col("n") == len(terms)).select("bucket", held.alias("bound"))


def buckets_of(corpus: Corpus, terms: list[str], fields: list[str]) -> list[int] | None:
    """Buckets that can match, by number: at most as many as there are. None means all."""
    bounds = bounded_buckets(corpus, terms)
    if bounds is None:
        return None
    if set(fields) <= set(SEARCH_FIELDS):
        bounds = bounds.filter(F.col("bound").isNotNull())
    return [r["bucket"] for r in bounds.select("bucket").collect()]


def matching_postings(
    corpus: Corpus, terms: list[str], fields: list[str], buckets: list[int] | None = None
) -> DataFrame:
    """Postings of literal terms in some buckets, with the weighted count and length over ``fields``."""
    scan = corpus.postings_for(fields)
    if buckets is not None and len(buckets) < corpus.buckets:
        scan = scan.filter(bucket_of_file().isin(buckets) if buckets else F.lit(False))
    return (
        scan.filter(F.col("term").isin(terms))
        .select(
            "term", "ord",
            scoring.weighted("tf", fields).alias("tf"),
            scoring.weighted("len", fields).alias("dl"),
        )
        .filter(F.col("tf") > 0)
    )


def match_all_words(corpus: Corpus, text: str, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """``ord`` of the articles in which every word of ``text`` occurs in some field of ``fields``."""
    terms = literal_tokens(corpus.spark, text)
    return (
        matching_postings(corpus, terms, fields, buckets_of(corpus, terms, fields))
        .groupBy("ord")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") == len(terms)) & F.lit(bool(terms)))
        .select("ord")
    )


def exact_scores(
    corpus: Corpus, text: str, fields: list[str], buckets: list[int] | None = None
) -> DataFrame:
    """``(ord, score)`` of the articles, in some buckets, that hold all words. Grouped inside the buckets."""
    terms = literal_tokens(corpus.spark, text)
    if buckets is None:
        buckets = buckets_of(corpus, terms, fields)
    # At most one row per query word.
    idf = document_frequency(corpus.term_stats.filter(F.col("term").isin(terms)), fields).select(
        "term", scoring.idf(F.col("df"), corpus.totals["n"]).alias("idf")
    )
    part = scoring.contribution(
        F.col("tf"), F.col("dl"), F.col("idf"), corpus.average_length(fields)
    )
    return (
        matching_postings(corpus, terms, fields, buckets)
        .join(F.broadcast(idf), "term")
        .groupBy("ord")
        .agg(scoring.rounded(F.sum(part)).alias("score"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") == len(terms)) & F.lit(bool(terms)))
        .select("ord", "score")
    )


def fuzzy_terms(
    corpus: Corpus, text: str, fields: list[str], distance: int = FUZZY_DISTANCE,
    pairs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """``(word, term, df)``: vocabulary terms within ``distance`` edits of each query word.

    ``pairs``, or the stored edit keys, name the terms, and only their statistics are read. Where too many
    are near, or no keys are stored, the vocabulary is filtered in one scan, without a join.
    """
    words = literal_tokens(corpus.spark, text)
    if pairs is None:
        pairs = near_pairs(corpus, words, distance)
    stats = corpus.term_stats.filter(in_fields(fields))
    if pairs is not None:
        named = local_table(corpus.spark, pairs, word=pa.string(), term=pa.string())  # bounded by LITERAL_TERMS
        stats = stats.filter(F.col("term").isin(sorted({t for _, t in pairs})) if pairs else F.lit(False))
        return stats.join(F.broadcast(named), "term").groupBy("word", "term").agg(F.sum("n").alias("df"))
    term = F.col("term")
    near = F.filter(
        F.array(*[F.lit(w) for w in words]).cast("array<string>"),
        lambda w: (F.abs(F.length(term) - F.length(w)) <= distance)
        & (F.levenshtein(term, w, distance) >= 0),
    )
    return (
        stats.select("term", "n", F.explode(near).alias("word"))
        .groupBy("word", "term")
        .agg(F.sum("n").alias("df"))
    )


def fuzzy_buckets(corpus: Corpus, pairs: list[tuple[str, str]], words: int, fields: list[str]) -> list[int] | None:
    """Buckets with a near term of every word; None means all."""
    if corpus.term_blocks is None or not pairs:
        return None
    named = local_table(corpus.spark, pairs, word=pa.string(), term=pa.string())
    blocks = corpus.term_blocks.filter(F.col("term").isin(sorted({t for _, t in pairs})))
    if set(fields) <= set(SEARCH_FIELDS):
        blocks = blocks.filter(F.col("most").isNotNull())
    held = blocks.join(F.broadcast(named), "term").groupBy("bucket").agg(F.count_distinct("word").alias("n"))
    return [r["bucket"] for r in held.filter(F.col("n") == words).select("bucket").collect()]


def fuzzy_scores(
    corpus: Corpus, text: str, fields: list[str], distance: int = FUZZY_DISTANCE
) -> DataFrame:
    """``(ord, score)``: per query word the best-scoring near term, all words required."""
    words = literal_tokens(corpus.spark, text)
    pairs = near_pairs(corpus, words, distance)
    near = fuzzy_terms(corpus, text, fields, distance, pairs).select(
        "word", "term", scoring.idf(F.col("df"), corpus.totals["n"]).alias("idf")
    )
    part = scoring.contribution(
        F.col("tf"), F.col("dl"), F.col("idf"), corpus.average_length(fields)
    )
    if pairs is not None:
        buckets = fuzzy_buckets(corpus, pairs, len(words), fields)
        hits = matching_postings(corpus, sorted({t for _, t in pairs}), fields, buckets)
    else:
        hits = corpus.postings_for(fields).select(
            "term", "ord",
            scoring.weighted("tf", fields).alias("tf"),
            scoring.weighted("len", fields).alias("dl"),
        )
    return (
        sized_join(hits.filter(F.col("tf") > 0), near, ["term"])
        .groupBy("ord", "word")
        .agg(F.max(part).alias("best"))
        .groupBy("ord")
        .agg(scoring.rounded(F.sum("best")).alias("score"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") == len(words)) & F.lit(bool(words)))
        .select("ord", "score")
    )


# --- match set, order, page --------------------------------------------------------------------


def match_set(
    corpus: Corpus,
    text: str = "",
    filters: Filters = Filters(),
    fuzzy: bool = False,
    fields: list[str] = SEARCH_FIELDS,
    with_date: bool = False,
    buckets: list[int] | None = None,
) -> DataFrame:
    """``(ord, score[, published_ts])`` of every match, in some buckets, before order and page.

    Filters and dates come from the narrow ``docs`` table, which shares the bucketing of the
    postings; it is left out when neither is needed.
    """
    condition = filters.condition()
    columns = ["ord"] + (["published_ts"] if with_date else [])
    narrow = corpus.docs if condition is None else corpus.docs.filter(condition)
    if not has_text(text):
        return narrow.select(*columns, F.lit(0.0).alias("score"))
    scored = fuzzy_scores(corpus, text, fields) if fuzzy else exact_scores(corpus, text, fields, buckets)
    if condition is None and not with_date:
        return scored
    return scored.join(narrow.select(*columns), "ord")


def best_buckets(
    corpus: Corpus, text: str, filters: Filters, k: int, first: int | None = None
) -> list[int] | None:
    """The buckets that the ``k`` best matches by relevance can lie in; None means all.

    The ``first`` buckets with the highest bounds are searched for their k-th score; scores are rounded,
    so a bound counts with the last place to spare.
    """
    bounds = bounded_buckets(corpus, literal_tokens(corpus.spark, text))
    if bounds is None:
        return None
    first = first or corpus.spark.sparkContext.defaultParallelism
    order = [F.desc("bound"), F.asc("bucket")]
    found = bounds.filter(F.col("bound").isNotNull()).orderBy(*order).collect()
    if len(found) <= first:
        return [r["bucket"] for r in found]
    tried = [r["bucket"] for r in found[:first]]
    matches = match_set(corpus, text, filters, buckets=tried)
    scores = [r["score"] for r in matches.orderBy(F.desc("score")).limit(k).select("score").collect()]
    least = scores[-1] if len(scores) == k else 0.0
    return tried + [r["bucket"] for r in found[first:] if r["bound"] + 2 * 10**-scoring.PLACES >= least]


def order_columns(sort: str) -> list[Column]:
    """Unknown orders mean relevance."""
    if sort == "date_desc":
        return [F.desc("published_ts"), F.asc("ord")]
    if sort == "date_asc":
        return [F.asc("published_ts"), F.asc("ord")]
    return [F.desc("score"), F.asc("ord")]


def page_of(matches: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with its 1-based ``rank``; the window only sees the rows of the page."""
    page = matches.orderBy(*order).offset(offset).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order)).cast("long") + F.lit(offset)
    return page.withColumn("rank", rank)


def fetch(corpus: Corpus, page: DataFrame, columns: list[str], page_rows: int) -> DataFrame:
    """Attach article columns to a ranked page of ``(ord, rank, ...)``.

    A page is small, so its keys become literals: the article scan then opens only the buckets and
    row groups that hold them. Larger pages are joined, on the bucketed key.
    """
    articles = corpus.articles.select("ord", "id", *columns)
    if page_rows > PAGE_ROWS:
        return page.join(articles, "ord").drop("ord")
    rows = page.collect()
    local = corpus.spark.createDataFrame(rows, _nullable(page.schema)).coalesce(1)
    wanted = articles.filter(F.col("ord").isin([r["ord"] for r in rows]))
    return wanted.join(F.broadcast(local), "ord").drop("ord")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def search(
    corpus: Corpus,
    text: str = "",
    categories=None,
    sources=None,
    authors=None,
    fuzzy: bool = False,
    sort: str = "relevance",
    offset: int = 0,
    limit: int = 10,
    highlight: bool = True,
    fields: list[str] = SEARCH_FIELDS,
) -> DataFrame:
    """One page of results: ``rank, id, score`` and the eight result columns."""
    filters, by_date = Filters(categories, sources, authors), sort in ("date_desc", "date_asc")
    buckets = None
    if has_text(text) and not fuzzy and not by_date and set(fields) == set(SEARCH_FIELDS):
        buckets = best_buckets(corpus, text, filters, offset + limit)
    matches = match_set(corpus, text, filters, fuzzy, fields, by_date, buckets)
    page = page_of(matches, order_columns(sort), offset, limit).select("ord", "rank", "score")
    found = fetch(corpus, page, RESULT_COLUMNS, limit)
    if highlight and has_text(text):
        found = present(found, literal_tokens(corpus.spark, text), FUZZY_DISTANCE if fuzzy else 0)
    return found.select("rank", "id", "score", *RESULT_COLUMNS)


def present(results: DataFrame, terms: list[str] | Column, distance: int = 0) -> DataFrame:
    """Mark query words in titles, or for a fuzzy search all words that match one, and cut summaries to
    their best window. ``terms`` may be a column, where rows belong to different requests."""
    query = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return results.withColumn("title", highlight_words(F.col("title"), query, distance)).withColumn(
        "summary", snippet(F.col("summary"), query, distance=distance)
    )


def total(
    corpus: Corpus, text: str = "", categories=None, sources=None, authors=None,
    fuzzy: bool = False, fields: list[str] = SEARCH_FIELDS,
) -> DataFrame:
    """One row: the number of matches, whatever the page."""
    filters = Filters(categories, sources, authors)
    if has_text(text) and not fuzzy:
        matches = match_all_words(corpus, text, fields)
        if filters.condition() is not None:
            matches = matches.join(filters.apply(corpus.docs).select("ord"), "ord")
    else:
        matches = match_set(corpus, text, filters, fuzzy, fields)
    return matches.agg(F.count(F.lit(1)).alias("total"))
