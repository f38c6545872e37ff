"""Named queries over the given tables: each takes ``(spark, sf_dir)`` and returns a frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import (
    highlight,
    literal_tokens,
    snippet,
)
from broadsheet.operators import (
    cache,
    facets,
    hybrid,
    ingest,
    lookup,
    similar,
    suggest,
    textsearch,
)
from broadsheet.operators.filters import Filters
from broadsheet.plans import textindex, workload
from broadsheet.plans.corpus import corpus
from broadsheet.plans.generations import LiveCorpus
from broadsheet.schemas import ARTICLE_COLUMNS, KEY_PREFIX
from broadsheet.sources.query_log import lookup_log, phrase_log, query_log, query_vectors, typed_words
from broadsheet.sources.raw_news import raw_news, read_raw_news, table
from broadsheet.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOAD_TARGET = 500
SEED_ID = "nw_0000007"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat_articles(df: DataFrame) -> DataFrame:
    """Articles with the tags as one string, for comparison row by row."""
    return df.select(*ARTICLE_COLUMNS).withColumn("tags", F.array_join("tags", "|"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def ids_of(c, matches: DataFrame) -> DataFrame:
    return c.docs.join(matches.select("ord"), "ord", "left_semi").select("id")


# --- ingest ------------------------------------------------------------------------------------


@query
def ingest_skip_reasons(spark, sf_dir):
    return ingest.with_reasons(raw_news(spark, sf_dir)).filter("reason is not null")


@query
def ingest_dedup(spark, sf_dir):
    raw = raw_news(spark, sf_dir)
    valid = raw.filter(ingest.reject_reason().isNull())
    return ingest.first_of_each(valid)


@query
def ingest_articles(spark, sf_dir):
    return flat_articles(ingest.articles(raw_news(spark, sf_dir)))


@query
def ingest_limited(spark, sf_dir):
    limited = ingest.articles(raw_news(spark, sf_dir), target=LOAD_TARGET)
    return limited.select("id", "title", "category", "source", "published_ts")


@query
def ingest_report(spark, sf_dir):
    return ingest.report(raw_news(spark, sf_dir))


@query
def ingest_report_limited(spark, sf_dir):
    return ingest.report(raw_news(spark, sf_dir), target=LOAD_TARGET)


@query
def upsert_articles(spark, sf_dir):
    """Every World article is rewritten twice and every Sports article once."""
    stored = corpus(spark, sf_dir).articles.select(*ARTICLE_COLUMNS)
    batches = F.when(F.col("category") == "World", 2).when(F.col("category") == "Sports", 1)
    changes = (
        stored.filter(batches.isNotNull())
        .withColumn("batch", F.explode(F.sequence(F.lit(1), batches)))
        .withColumn("title", F.concat("title", F.lit(" / "), F.col("batch").cast("string")))
    )
    merged = ingest.upsert(stored, changes.select(*ARTICLE_COLUMNS, "batch"), "batch")
    return merged.select("id", "title", "category", "word_count")


def revised(spark, sf_dir) -> LiveCorpus:
    """A live index over the corpus: World articles were given a new title twice, Sports articles once."""
    base = corpus(spark, sf_dir)
    stored = base.articles.select(*ARTICLE_COLUMNS)
    batches = F.when(F.col("category") == "World", 2).when(F.col("category") == "Sports", 1)
    changes = stored.filter(batches.isNotNull()).withColumn("batch", F.explode(F.sequence(F.lit(1), batches)))
    title = F.concat(F.lit("Revised edition "), F.col("batch").cast("string"), F.lit(" of the "), F.col("category"))
    live = LiveCorpus(base, Store(spark, f"{base.store.path}/live-{uuid.uuid4().hex}"))
    for number, category in enumerate(("Sports", "World")):
        part = changes.filter(F.col("category") == category).withColumn("title", title)
        live.upsert(part.select(*ARTICLE_COLUMNS, "batch"), "batch", batch=number)
    return live


@query
def upsert_search(spark, sf_dir):
    """Changed articles are found by their new words, with the statistics of the changed index."""
    return textsearch.search(revised(spark, sf_dir), "the edition of", limit=50)


@query
def upsert_terms(spark, sf_dir):
    """Document frequencies after the change: words of replaced titles count no more."""
    return textindex.document_frequency(revised(spark, sf_dir).term_stats, ["title", "summary"])


# --- index and lookup --------------------------------------------------------------------------


@query
def index_postings(spark, sf_dir):
    c = corpus(spark, sf_dir)
    ids = c.docs.select("ord", "id")
    return textindex.posting_list(c.postings).join(ids, "ord").select("term", "field", "id", "tf")


@query
def index_doc_stats(spark, sf_dir):
    return textindex.field_lengths(corpus(spark, sf_dir).articles)


@query
def index_terms(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return textindex.document_frequency(c.term_stats, ["title", "summary"])


@query
def index_stats(spark, sf_dir):
    return facets.index_stats(corpus(spark, sf_dir))


@query
def index_sketches(spark, sf_dir):
    """Distinct terms per category and over all: exact, and whether the merged sketches' estimate holds its bound."""
    return facets.distinct_terms(corpus(spark, sf_dir))


@query
def get_articles(spark, sf_dir):
    """One lookup per vector id, with and without the key prefix; some ids do not exist."""
    number = F.col("vec_id") * 3 + 1
    plain = F.format_string("nw_%07d", number)
    ids = table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit(KEY_PREFIX), plain))
        .otherwise(plain)
        .alias("requested")
    )
    return lookup.get_articles(corpus(spark, sf_dir), ids, ["title", "category", "word_count"])


@query
def get_documents(spark, sf_dir):
    """Whole articles by id: one lookup per vector id, as for ``get_articles``."""
    number = F.format_string("nw_%07d", F.col("vec_id") * 3 + 1)
    ids = table(spark, sf_dir, "embeddings").select(number.alias("requested"))
    columns = [c for c in ARTICLE_COLUMNS if c != "id"]
    found = lookup.get_articles(corpus(spark, sf_dir), ids, columns)
    return found.withColumn("tags", F.array_join("tags", "|"))


@query
def scan_raw_news(spark, sf_dir):
    """The parquet source: raw news files written, and read back with their schema and order."""
    path = corpus(spark, sf_dir).store.location("raw_news")
    raw_news(spark, sf_dir).drop("ord").write.mode("overwrite").parquet(path)
    return read_raw_news(spark, path).drop("ord")


# --- filters and matching ----------------------------------------------------------------------


@query
def text_match(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return ids_of(c, textsearch.match_all_words(c, "the of"))


@query
def text_match_all_fields(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return ids_of(c, textsearch.match_all_words(c, "der und 2019", textindex.TEXT_FIELDS))


@query
def fuzzy_match(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return textsearch.fuzzy_terms(c, "thing onthe", ["title", "summary"])


@query
def filter_category(spark, sf_dir):
    return Filters(categories="POLITICS ").apply(corpus(spark, sf_dir).docs).select("id", "category")


@query
def filter_sources_multi(spark, sf_dir):
    return Filters(sources="vice, Wired,the economist").apply(corpus(spark, sf_dir).docs).select(
        "id", "source"
    )


@query
def filter_author(spark, sf_dir):
    return Filters(authors=["author 3", "Unknown"]).apply(corpus(spark, sf_dir).docs).select(
        "id", "author"
    )


@query
def workload_filters(spark, sf_dir):
    log = workload.parameters(query_log(spark, sf_dir))
    return log.select(
        "query_id",
        F.array_join("category_list", "|").alias("category_list"),
        F.array_join("source_list", "|").alias("source_list"),
        "has_text",
    )


# --- text search -------------------------------------------------------------------------------


@query
def text_search(spark, sf_dir):
    return textsearch.search(corpus(spark, sf_dir), "the of")


@query
def text_search_total(spark, sf_dir):
    return textsearch.total(corpus(spark, sf_dir), "the of")


@query
def search_filtered(spark, sf_dir):
    return textsearch.search(
        corpus(spark, sf_dir), "the of", categories="Politics, World,Business",
        sources=["VICE", "wired", "Unknown", "src7"],
    )


@query
def search_filtered_total(spark, sf_dir):
    return textsearch.total(
        corpus(spark, sf_dir), "the of", categories="Politics, World,Business",
        sources=["VICE", "wired", "Unknown", "src7"],
    )


@query
def search_date_desc(spark, sf_dir):
    return textsearch.search(corpus(spark, sf_dir), "le de", sort="date_desc")


@query
def search_date_asc(spark, sf_dir):
    return textsearch.search(corpus(spark, sf_dir), "der und", sort="date_asc")


@query
def search_paged(spark, sf_dir):
    return textsearch.search(corpus(spark, sf_dir), "the of", offset=20, limit=15)


@query
def search_all_recent(spark, sf_dir):
    return textsearch.search(corpus(spark, sf_dir), "", sort="date_desc")


@query
def fuzzy_search(spark, sf_dir):
    return textsearch.search(corpus(spark, sf_dir), "thing onthe", fuzzy=True)


@query
def highlight_title(spark, sf_dir):
    found = F.array(*[F.lit(t) for t in literal_tokens(spark, "the of der le")])
    return corpus(spark, sf_dir).articles.select("id", highlight(F.col("title"), found).alias("title"))


@query
def snippet_summary(spark, sf_dir):
    found = F.array(*[F.lit(t) for t in literal_tokens(spark, "the of der le")])
    return corpus(spark, sf_dir).articles.select(
        "id", snippet(F.col("summary"), found).alias("snippet")
    )


@query
def snippet_content(spark, sf_dir):
    """The same window over the whole text of every article."""
    found = F.array(*[F.lit(t) for t in literal_tokens(spark, "the of der le")])
    return corpus(spark, sf_dir).articles.select(
        "id", snippet(F.col("content"), found).alias("snippet")
    )


# --- facets ------------------------------------------------------------------------------------


@query
def facet_categories(spark, sf_dir):
    return facets.category_facet(corpus(spark, sf_dir))


@query
def facet_sources(spark, sf_dir):
    return facets.source_facet(corpus(spark, sf_dir))


@query
def category_counts_query(spark, sf_dir):
    return facets.category_counts(corpus(spark, sf_dir), "that with by", "VICE,Wired, Unknown,src8")


@query
def category_counts_top15(spark, sf_dir):
    return facets.top_category_counts(corpus(spark, sf_dir), "the of", authors="Unknown")


@query
def list_categories(spark, sf_dir):
    return facets.value_list(corpus(spark, sf_dir), "category")


@query
def list_sources(spark, sf_dir):
    return facets.value_list(corpus(spark, sf_dir), "source")


@query
def list_authors(spark, sf_dir):
    return facets.value_list(corpus(spark, sf_dir), "author")


@query
def trending_tags(spark, sf_dir):
    return facets.trending_tags(corpus(spark, sf_dir))


@query
def trending_tags_first50(spark, sf_dir):
    return facets.trending_tags(corpus(spark, sf_dir), candidates=50)


@query
def homepage_top_stories(spark, sf_dir):
    return facets.top_stories(corpus(spark, sf_dir))


@query
def homepage_sections(spark, sf_dir):
    return facets.category_sections(corpus(spark, sf_dir))


@query
def homepage(spark, sf_dir):
    """Top stories and sections as whole result rows."""
    return facets.homepage(corpus(spark, sf_dir))


# --- vector and hybrid -------------------------------------------------------------------------


@query
def vector_search(spark, sf_dir):
    return similar.vector_search(corpus(spark, sf_dir), vector_of(spark, sf_dir, 7))


@query
def vector_search_filtered(spark, sf_dir):
    return similar.vector_search(
        corpus(spark, sf_dir), vector_of(spark, sf_dir, 42), "Politics,General", ["VICE", "Unknown"]
    )


@query
def vector_search_paged(spark, sf_dir):
    return similar.vector_search(
        corpus(spark, sf_dir), vector_of(spark, sf_dir, 99), offset=10, limit=10
    )


@query
def vector_search_total(spark, sf_dir):
    return similar.vector_total(
        corpus(spark, sf_dir), vector_of(spark, sf_dir, 99), offset=10, limit=10
    )


@query
def similar_articles(spark, sf_dir):
    return similar.similar_articles(corpus(spark, sf_dir), f"{KEY_PREFIX}{SEED_ID}")


@query
def similar_all(spark, sf_dir):
    return similar.similar_to_each(corpus(spark, sf_dir))


@query
def hybrid_search(spark, sf_dir):
    return hybrid.hybrid_search(corpus(spark, sf_dir), "the of", vector_of(spark, sf_dir, 7))


@query
def hybrid_weighted(spark, sf_dir):
    return hybrid.hybrid_search(
        corpus(spark, sf_dir), "the of", vector_of(spark, sf_dir, 42),
        categories="Politics,World,General", vector_weight=0.8,
    )


@query
def hybrid_search_paged(spark, sf_dir):
    return hybrid.hybrid_search(
        corpus(spark, sf_dir), "le de", vector_of(spark, sf_dir, 99), offset=8, limit=8
    )


@query
def hybrid_search_total(spark, sf_dir):
    return hybrid.hybrid_total(corpus(spark, sf_dir), "le de", vector_of(spark, sf_dir, 99))


@query
def embedding_reuse(spark, sf_dir):
    return workload.embedding_reuse(query_vectors(spark, sf_dir))


# --- suggestions and spelling ------------------------------------------------------------------


@query
def suggestion_dictionary(spark, sf_dir):
    return corpus(spark, sf_dir).suggestions.select("suggestion", "score")


@query
def autocomplete(spark, sf_dir):
    typed = typed_words(spark, sf_dir).withColumnRenamed("text", "prefix")
    c = corpus(spark, sf_dir)
    return suggest.complete_each(c.suggestions, typed, trie=c.completions)


@query
def autocomplete_prefix(spark, sf_dir):
    return suggest.autocomplete(corpus(spark, sf_dir).suggestions, "Th")


@query
def autocomplete_spell(spark, sf_dir):
    return suggest.complete_with_spelling(corpus(spark, sf_dir), typed_words(spark, sf_dir))


@query
def spellcheck(spark, sf_dir):
    return suggest.spellcheck(corpus(spark, sf_dir), query_log(spark, sf_dir))


@query
def spell_correct_query(spark, sf_dir):
    return suggest.corrected_queries(corpus(spark, sf_dir), query_log(spark, sf_dir))


# --- cache and workload ------------------------------------------------------------------------


@query
def query_cache_key(spark, sf_dir):
    return query_log(spark, sf_dir).select("query_id", cache.cache_key("text").alias("cache_key"))


@query
def cache_hits(spark, sf_dir):
    return cache.cache_hits(lookup_log(spark, sf_dir), ttl_seconds=60)


@query
def cache_hits_hour(spark, sf_dir):
    return cache.cache_hits(lookup_log(spark, sf_dir), ttl_seconds=3600)


@query
def workload_search(spark, sf_dir):
    return workload.search_all(corpus(spark, sf_dir), query_log(spark, sf_dir))


@query
def workload_phrases(spark, sf_dir):
    """Every three words of every user turn as a request."""
    return workload.search_all(corpus(spark, sf_dir), phrase_log(spark, sf_dir))


@query
def workload_pages(spark, sf_dir):
    """The result pages of the phrases with all display fields; every second request is fuzzy."""
    log = phrase_log(spark, sf_dir).withColumn("fuzzy", F.col("query_id") % 2 == 1)
    return workload.search_pages(corpus(spark, sf_dir), log)


@query
def workload_facets(spark, sf_dir):
    """Counts per category under every word of every user turn; words of one letter restrict nothing."""
    return workload.category_counts_all(corpus(spark, sf_dir), phrase_log(spark, sf_dir, 1))


@query
def workload_fuzzy(spark, sf_dir):
    """Every user turn, searched with spelling tolerance."""
    log = query_log(spark, sf_dir).withColumn("fuzzy", F.lit(True))
    return workload.search_all(corpus(spark, sf_dir), log)


@query
def workload_vector(spark, sf_dir):
    return workload.vector_all(corpus(spark, sf_dir), query_vectors(spark, sf_dir))


@query
def workload_hybrid(spark, sf_dir):
    return workload.hybrid_all(corpus(spark, sf_dir), query_vectors(spark, sf_dir))
