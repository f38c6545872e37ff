"""Facet counts, lists, homepage, trending tags, statistics.

Each is one aggregate over the narrow ``docs`` table, pre-aggregated before its shuffle, so a value
held by a third of the articles costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.operators.filters import Filters, has_text
from broadsheet.operators.skew import top_per_key
from broadsheet.operators.textsearch import RESULT_COLUMNS, fetch, match_all_words
from broadsheet.plans.corpus import Corpus
from broadsheet.plans.textindex import SKETCH_ERROR
from broadsheet.schemas import ALL, TEXT_FIELDS, UNKNOWN

HIDDEN_CATEGORY = "other"
FACET_SOURCES = 20
LIST_VALUES = 50
TOP_CATEGORIES = 15
TRENDING = 15
MIN_TAG_CHARS = 2


def counts(df: DataFrame, name: Column) -> DataFrame:
    return df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """Number rows already reduced to a bounded list."""
    out = df if limit is None else df.orderBy(*order).limit(limit)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def by_count() -> tuple[Column, Column]:
    return F.desc("n"), F.asc("name")


def category_facet(corpus: Corpus) -> DataFrame:
    """All categories but ``other``, in title case. There are ten categories at most."""
    per_tag = counts(corpus.docs, F.col("category_tag")).filter(F.col("name") != HIDDEN_CATEGORY)
    return ranked(per_tag.select(F.initcap("name").alias("name"), "n"), *by_count())


def source_facet(corpus: Corpus, limit: int = FACET_SOURCES) -> DataFrame:
    return ranked(counts(corpus.docs.select(F.explode("source_tags").alias("s")), F.col("s")),
                  *by_count(), limit=limit)


def matching_docs(corpus: Corpus, text: str, filters: Filters) -> DataFrame:
    """Articles holding all words in any text field, and passing the filters."""
    docs = filters.apply(corpus.docs)
    if not has_text(text):
        return docs
    return docs.join(match_all_words(corpus, text, TEXT_FIELDS), "ord", "left_semi")


def category_counts(corpus: Corpus, text: str = "", sources=None) -> DataFrame:
    """Count per category under a query; categories without a match are kept with zero."""
    found = counts(
        matching_docs(corpus, text, Filters(sources=sources)), F.col("category_tag")
    )
    domain = corpus.docs.select(F.col("category_tag").alias("name")).distinct()
    return domain.join(F.broadcast(found), "name", "left").select(
        F.initcap("name").alias("name"), F.coalesce("n", F.lit(0)).alias("n")
    )


def top_category_counts(
    corpus: Corpus, text: str = "", sources=None, authors=None, limit: int = TOP_CATEGORIES
) -> DataFrame:
    docs = matching_docs(corpus, text, Filters(sources=sources, authors=authors))
    return ranked(counts(docs, F.col("category_tag")), *by_count(), limit=limit)


def value_list(corpus: Corpus, column: str, limit: int = LIST_VALUES) -> DataFrame:
    """``All`` at rank 0, then the most frequent values. ``column`` is category, source or author.

    Authors lose the blank and ``Unknown`` entries after the limit, so fewer may come back.
    """
    names = {
        "category": F.col("category_tag"),
        "source": F.explode("source_tags"),
        "author": F.col("author"),
    }
    rows = corpus.docs.select(names[column].alias("name"))
    top = counts(rows, F.col("name")).orderBy(*by_count()).limit(limit)
    if column == "author":
        top = top.filter((F.col("name") != "") & (F.col("name") != UNKNOWN))
    first = corpus.spark.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(ALL).alias("name"))
    return first.unionByName(ranked(top, *by_count()).select("rank", "name"))


def trending_tags(
    corpus: Corpus, limit: int = TRENDING, candidates: int | None = None
) -> DataFrame:
    """Most frequent tags of two characters or more.

    ``candidates`` = n ranks only the first n tag values in alphabetical order; None ranks all.
    """
    tags = counts(corpus.docs.select(F.explode("tag_values").alias("t")), F.col("t"))
    if candidates is not None:
        tags = tags.orderBy("name").limit(candidates)
    return ranked(tags.filter(F.length("name") >= MIN_TAG_CHARS), *by_count(), limit=limit).select(
        "rank", F.col("name").alias("tag"), "n"
    )


def newest_keys(corpus: Corpus, limit: int) -> DataFrame:
    order = (F.desc("published_ts"), F.asc("ord"))
    newest = corpus.docs.select("ord", "id", "category", "published_ts").orderBy(*order).limit(limit)
    return newest.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_stories(corpus: Corpus, limit: int = 3) -> DataFrame:
    return newest_keys(corpus, limit).select("rank", "id", "category", "published_ts")


def section_keys(corpus: Corpus, categories: int, per_category: int) -> DataFrame:
    """The newest articles of the largest categories.

    Only ``per_category`` rows per task and category are shuffled, so a dominant category does not
    load one task.
    """
    top = ranked(counts(corpus.docs, F.col("category_tag")), *by_count(), limit=categories).select(
        F.col("name").alias("category_tag"), F.col("rank").alias("section")
    )
    docs = corpus.docs.select("ord", "id", "category_tag", "published_ts")
    newest = [F.desc("published_ts"), F.asc("ord")]
    return (
        top_per_key(docs, ["category_tag"], newest, per_category)
        .join(F.broadcast(top), "category_tag")
        .select("section", F.initcap("category_tag").alias("shown"), "rank", "ord", "id", "published_ts")
    )


def category_sections(corpus: Corpus, categories: int = 5, per_category: int = 3) -> DataFrame:
    keys = section_keys(corpus, categories, per_category)
    return keys.select("section", F.col("shown").alias("category"), "rank", "id", "published_ts")


def homepage(corpus: Corpus, stories: int = 3, categories: int = 5, per_category: int = 3) -> DataFrame:
    """The homepage as result rows: section 0 has the newest articles of all, 1 and on the largest
    categories. ``(section, shown, rank, id)`` and the eight result fields, unmarked."""
    top = newest_keys(corpus, stories).select(
        F.lit(0).cast("long").alias("section"), F.lit(ALL).alias("shown"), "rank", "ord"
    )
    keys = section_keys(corpus, categories, per_category).select("section", "shown", "rank", "ord")
    rows = fetch(corpus, top.unionByName(keys), RESULT_COLUMNS, stories + categories * per_category)
    return rows.select("section", "shown", "rank", "id", *RESULT_COLUMNS)


def distinct_terms(corpus: Corpus) -> DataFrame:
    """``(name, num_terms, within_bound)`` per category, and for all of them under ``All``.

    ``num_terms`` is exact, at the price of a shuffle of all terms. Beside it stands the estimate, merged
    from a sketch of fixed size per category; ``within_bound`` tells whether it is off by no more than three
    standard errors.
    """
    rows = corpus.postings.select("ord", "term").join(corpus.docs.select("ord", "category_tag"), "ord")
    pairs = rows.select("category_tag", "term").distinct()
    exact = pairs.groupBy(F.col("category_tag").alias("name")).agg(F.count(F.lit(1)).alias("num_terms"))
    exact = exact.unionByName(
        corpus.term_stats.agg(F.count_distinct("term").alias("num_terms")).select(F.lit(ALL).alias("name"), "num_terms")
    )
    each = corpus.sketches.select(F.col("category_tag").alias("name"), F.hll_sketch_estimate("sketch").alias("estimate"))
    merged = corpus.sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    estimates = each.unionByName(merged.select(F.lit(ALL).alias("name"), "estimate"))
    error = F.abs(F.col("estimate") - F.col("num_terms"))
    bound = F.greatest(SKETCH_ERROR * F.col("num_terms"), F.lit(1.0))
    # Ten categories at most.
    return exact.join(F.broadcast(estimates), "name").select("name", "num_terms", (error <= bound).alias("within_bound"))


def index_stats(corpus: Corpus) -> DataFrame:
    """Articles, distinct terms and postings (one per term, field and article)."""
    stats = corpus.term_stats
    fields = F.bit_count("mask")
    terms = stats.agg(
        F.count_distinct("term").alias("num_terms"), F.sum(F.col("n") * fields).alias("num_postings")
    )
    return terms.select(F.lit(corpus.totals["n"]).cast("long").alias("num_docs"), "num_terms",
                        "num_postings")
