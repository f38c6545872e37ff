"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (input folder), BENCH_CPUS (local threads). The index is built once, as its own
entry; the queries after it are timed on the built index, each to its last row.
"""

from __future__ import annotations

import json
import os
import time

from broadsheet.plans.corpus import corpus
from broadsheet.plans.registry import QUERIES
from broadsheet.session import build_session
from broadsheet.sources.query_log import query_log, query_vectors
from broadsheet.sources.raw_news import raw_news

HEADLINES = [
    "ingest_articles", "ingest_report", "index_postings", "text_match", "text_search",
    "search_filtered", "search_date_desc", "fuzzy_search", "facet_categories", "category_counts_query",
    "trending_tags", "homepage_sections", "vector_search", "vector_search_filtered", "similar_articles",
    "similar_all", "hybrid_search", "autocomplete", "spellcheck", "autocomplete_spell", "snippet_content",
    "cache_hits", "embedding_reuse", "workload_search", "workload_vector", "workload_hybrid",
    "get_articles", "homepage", "upsert_search", "workload_phrases", "workload_pages", "workload_facets",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def build(spark, sf_dir) -> None:
    c = corpus(spark, sf_dir)
    for part in (
        c.articles, c.docs, c.postings, c.term_stats, c.totals, c.term_blocks, c.vectors, c.suggestions, c.completions,
        c.edit_keys,
    ):
        assert part is not None


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]", cpus,
        {"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm_up = timed(lambda: drain(raw_news(spark, sf_dir)))
    times = {"index_build": timed(lambda: build(spark, sf_dir))}
    for name in HEADLINES:
        times[name] = timed(lambda n=name: drain(QUERIES[n](spark, sf_dir)))
    requests = query_log(spark, sf_dir).count()
    vectors = query_vectors(spark, sf_dir).filter("vector is not null").count()
    result = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "warm_up_sec": warm_up,
        "rows": {"documents": raw_news(spark, sf_dir).count(), "requests": requests},
        "ingest_docs_per_sec": round(raw_news(spark, sf_dir).count() / times["ingest_articles"], 1),
        "search_requests_per_sec": round(requests / times["workload_search"], 1),
        "vector_requests_per_sec": round(vectors / times["workload_vector"], 1),
        "hybrid_requests_per_sec": round(vectors / times["workload_hybrid"], 1),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
