"""Layout of the index: what needs no shuffle, what is skipped, and attaching a saved one."""

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import suggest, textsearch
from broadsheet.operators.filters import Filters
from broadsheet.plans import textindex
from broadsheet.plans.corpus import Corpus
from broadsheet.session import shared_dir
from broadsheet.sources.raw_news import raw_news, table
from broadsheet.sources.store import Store, bucket_of


@pytest.fixture(scope="module")
def built(spark, sf_dir, tmp_path_factory):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"), F.col("embedding").alias("vector")
    )
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    corpus = Corpus(store, raw_news(spark, sf_dir), vectors, buckets=5)
    corpus.save_layout()
    return corpus


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attached_corpus_answers_the_same(built, spark, tmp_path):
    want = textsearch.search(built, "the of").orderBy("rank").collect()
    for name in ("articles", "docs", "postings", "vectors"):
        spark.sql(f"DROP TABLE {built.store.table_name(name)}")
    again = Corpus.attach(spark, built.store.path)
    assert again.buckets == 5 and again.totals == built.totals
    assert textsearch.search(again, "the of").orderBy("rank").collect() == want
    assert again.vectors.count() == 180
    assert "Exchange" not in plan_of(again.postings.groupBy("ord").count())


def test_index_is_built_inside_the_buckets(built):
    assert "Exchange" not in plan_of(textindex.postings(Corpus.attach(built.spark, built.store.path).articles))


def test_search_reads_only_title_and_summary_postings(built):
    c = Corpus.attach(built.spark, built.store.path)
    plan = plan_of(textsearch.exact_scores(c, "the of", ["title", "summary"]))
    assert "PartitionFilters: [isnotnull(head" in plan and "In(term, [of,the])" in plan


def test_page_lookup_prunes_buckets(built):
    """The plan shows the chosen buckets only for a bucketed scan, so that is switched on here; the
    pruning itself applies to either kind of scan."""
    c = Corpus.attach(built.spark, built.store.path)
    setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    built.spark.conf.set(setting, "false")
    try:
        df = c.articles.filter(F.col("ord").isin([1])).select("ord", "content")
        mode = built.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        assert "SelectedBucketsCount: 1 out of 5" in df._jdf.queryExecution().explainString(mode)
    finally:
        built.spark.conf.unset(setting)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


def files_read(df):
    """Files that the scan of a plan without shuffles opened."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numFiles").get().value()


def test_a_rare_word_opens_only_its_buckets(built, spark):
    c = Corpus.attach(spark, built.store.path)
    head = c.postings.filter("head = 1")
    held = head.groupBy("term").agg(F.count_distinct(bucket_of("ord", 5)).alias("b"), F.first("ord").alias("ord"))
    rare = held.filter((F.col("b") == 1) & F.col("term").rlike("^[a-z]{4,}$")).orderBy("term").first()
    spread = held.filter("b = 5").orderBy("term").first()["term"]
    fields = ["title", "summary"]

    def read(term):
        buckets = textsearch.buckets_of(c, [term], fields)
        return len(buckets), files_read(textsearch.matching_postings(c, [term], fields, buckets))

    everything = files_read(textsearch.matching_postings(c, [spread], fields))
    assert read(rare["term"]) == (1, everything / 5) and read(spread) == (5, everything)
    assert textsearch.match_all_words(c, rare["term"]).count() >= 1
    assert textsearch.match_all_words(c, f"{rare['term']} nowhereatall").count() == 0


@pytest.mark.parametrize("text", ["the of", "le", "der und", "that with by"])
@pytest.mark.parametrize("categories", [None, "Politics"])
def test_best_buckets_hold_the_page(built, text, categories):
    filters = Filters(categories)
    order = [F.desc("score"), F.asc("ord")]
    whole = textsearch.match_set(built, text, filters).orderBy(*order)
    for k in (1, 3, 10):
        buckets = textsearch.best_buckets(built, text, filters, k, first=1)
        found = textsearch.match_set(built, text, filters, buckets=buckets).orderBy(*order).limit(k)
        assert found.collect() == whole.limit(k).collect()


def test_bounds_hold_and_leave_buckets_out(built):
    scores = textsearch.match_set(built, "le").groupBy(bucket_of("ord", 5).alias("bucket")).agg(F.max("score").alias("top"))
    bounds = textsearch.bounded_buckets(built, ["le"])
    assert scores.join(bounds, "bucket").filter("top > bound + 1e-6").isEmpty()
    assert scores.join(bounds, "bucket").count() == scores.count()


def test_fuzzy_terms_come_from_stored_keys(built, monkeypatch):
    words, near = ["thing", "onthe", "gouvernementx", "qqqqqqqqqq"], []
    pairs = suggest.near_pairs(built, words, 2)
    for term in {r["term"] for r in built.term_stats.select("term").distinct().collect()}:
        near += [(w, term) for w in words if edits(w, term) <= 2]
    assert sorted(pairs) == sorted(near) and len(near) > 10
    fields = ["title", "summary"]
    plan = plan_of(textsearch.fuzzy_terms(built, "thing onthe", fields))
    assert "In(term, [" in plan
    assert "In(term, [" in plan_of(textsearch.fuzzy_scores(built, "thing onthe", fields))
    found = sorted(textsearch.fuzzy_scores(built, "thing onthe", fields).collect())
    monkeypatch.setattr(suggest, "LITERAL_TERMS", 0)  # too many near terms to name: the scan
    assert suggest.near_pairs(built, ["thing"], 2) is None
    assert sorted(textsearch.fuzzy_scores(built, "thing onthe", fields).collect()) == found


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_buckets_go_by_the_bytes_of_text(spark):
    """The task that makes postings holds them, so buckets stay small however well the files compress."""
    from pyspark.sql import functions as F

    from broadsheet.plans.corpus import BYTES_PER_BUCKET, bucket_count

    article = F.expr("repeat('a ', 500000)").alias("article")
    raw = spark.range(200).select(F.col("id").alias("ord"), article)
    assert BYTES_PER_BUCKET <= 16 * 1024 * 1024
    assert bucket_count(spark, raw) == -(-200 * 1_000_000 // BYTES_PER_BUCKET) > spark.sparkContext.defaultParallelism
