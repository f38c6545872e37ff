"""The index that takes changes: what a reader sees after each of them, and which files are written."""

import os
import re

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import suggest, textsearch
from broadsheet.plans import textindex
from broadsheet.plans.corpus import Corpus, narrow
from broadsheet.plans.generations import LiveCorpus
from broadsheet.schemas import ARTICLE, ARTICLE_COLUMNS
from broadsheet.sources.raw_news import raw_news, table
from broadsheet.sources.store import Store, bucket_of, bucket_of_file
from broadsheet.streaming.ingest import StreamIndex

BUCKETS = 16


@pytest.fixture(scope="module")
def base(spark, sf_dir, tmp_path_factory):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    corpus = Corpus(Store(spark, str(tmp_path_factory.mktemp("base"))), raw_news(spark, sf_dir), vectors, buckets=BUCKETS)
    corpus.save_layout()
    return corpus


@pytest.fixture
def live(base, tmp_path):
    return LiveCorpus(base, Store(base.spark, str(tmp_path / "live")))


def files(folder):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")
    }


def changed(corpus, ids, title, **more):
    rows = corpus.articles.where(F.col("id").isin(ids)).select(*ARTICLE_COLUMNS)
    return rows.withColumns({"title": F.lit(title), **more})


def found(corpus, text):
    return {r.id for r in textsearch.search(corpus, text, limit=500).collect()}


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def check_whole(live):
    """All tables are what a build from the live articles would give."""
    articles = live.articles
    same(live.docs, narrow(articles))
    postings = textindex.postings(articles)
    same(live.postings, postings)
    same(live.term_stats.where("n <> 0"), textindex.term_stats(postings))
    same(live.suggestions, suggest.dictionary(articles))
    assert live.totals == {"n": articles.count(), **textindex.field_totals(postings).first().asDict()}


IDS = ["nw_0000003", "nw_0000050", "nw_0000051"]


def test_a_change_is_found_and_its_old_words_are_not(base, live):
    before = files(base.store.path)
    old = {r.id: r.title for r in base.articles.where(F.col("id").isin(IDS)).collect()}
    live.upsert(changed(live, IDS, "Zyxquark zyxstory"))
    assert found(live, "zyxquark") == set(IDS) and found(base, "zyxquark") == set()
    for article, title in old.items():
        words = " ".join(re.findall(r"[^\W\d_]+", title)[:3])
        if words and article in found(base, words):
            summary = live.articles.where(F.col("id") == article).first().summary.lower()
            held = all(w.lower() in re.findall(r"[^\W\d_]+", summary) for w in words.split())
            assert (article in found(live, words)) == held
    assert live.articles.count() == base.articles.count()
    assert live.vectors.count() == base.vectors.count()
    assert files(base.store.path) == before
    check_whole(live)


def test_generations_compact_fold_and_reopen(spark, base, live):
    live.upsert(changed(live, IDS, "First zyxone"))
    live.upsert(changed(live, IDS[:2], "Second zyxtwo", category=F.lit("Opinion")))
    new = changed(live, IDS[2:], "Brand new zyxthree").withColumn("id", F.concat(F.lit("nw_09"), F.substring("id", 6, 5)))
    live.upsert(new)
    live.delete(spark.createDataFrame([("nw_0000001",), ("unknown",)], "id string"))
    expected = {"zyxone": {IDS[2]}, "zyxtwo": set(IDS[:2]), "zyxthree": {r.id for r in new.collect()}}

    def check(corpus):
        for word, ids in expected.items():
            assert found(corpus, word) == ids
        assert corpus.articles.count() == base.articles.count() == corpus.totals["n"]
        assert corpus.docs.where("id = 'nw_0000001'").isEmpty() and corpus.vectors.where("id = 'nw_0000001'").isEmpty()
        check_whole(corpus)

    check(live)
    check(LiveCorpus(base, live.store))
    live.compact()
    assert len(live.state["generations"]) == 1
    check(live)
    touched, before = live.touched(), files(base.store.path)
    assert 0 < len(touched) <= 5 < BUCKETS
    assert live.fold() == touched and live.state["generations"] == []
    assert files(base.store.path) == before
    prefix = live.state["segments"][-1]["prefix"]
    for name in ("articles", "docs", "postings", "vectors"):
        written = {int(re.search(r"_(\d{5})\.c", f).group(1)) for f in files(live.store.location(f"{prefix}_{name}"))}
        assert written <= set(touched)
    check(live)
    check(LiveCorpus(base, live.store))
    live.upsert(changed(live, IDS[:1], "After zyxfour"))
    assert found(live, "zyxfour") == {IDS[0]} and found(live, "zyxtwo") == {IDS[1]}
    live.fold()
    assert found(live, "zyxfour") == {IDS[0]} and found(live, "zyxtwo") == {IDS[1]}
    check_whole(live)


def test_buckets_are_known_by_file_name(base):
    rows = base.articles.select(bucket_of_file().alias("f"), bucket_of("ord", BUCKETS).alias("b"))
    assert rows.where("f <> b").isEmpty() and rows.where("f IS NULL").isEmpty()
    one = base.articles.where(bucket_of_file().isin([3])).select("ord")
    assert len(one.inputFiles()) >= 1 and one.count() == base.articles.where(bucket_of("ord", BUCKETS) == 3).count()


def test_highest_order_wins_and_batches_are_taken_once(live):
    rows = changed(live, IDS, "Old zyxold").withColumn("order", F.lit(1)).unionByName(
        changed(live, IDS, "New zyxnew").withColumn("order", F.lit(2))
    )
    live.upsert(rows, "order", batch=0)
    assert found(live, "zyxnew") == set(IDS) and found(live, "zyxold") == set()
    version = live.state["version"]
    live.upsert(changed(live, IDS, "Again zyxagain"), batch=0)
    assert live.state["version"] == version
    live.upsert(changed(live, [], "none"), batch=1)
    assert found(live, "zyxnew") == set(IDS)


def test_stream_of_changes(spark, live, tmp_path):
    for number, word in enumerate(("zyxalpha", "zyxbeta", "zyxgamma")):
        rows = changed(live, IDS[number:], f"Stream {word}")
        spark.createDataFrame(rows.collect(), ARTICLE).coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
        os.utime(next(iter(files(tmp_path / f"in/{number}"))), (1_000_000 + number, 1_000_000 + number))
    job = StreamIndex(live, compact_every=2)
    job.start(str(tmp_path / "in/*"), str(tmp_path / "ckpt"), max_files=1).awaitTermination(300)
    assert found(live, "zyxalpha") == {IDS[0]} and found(live, "zyxbeta") == {IDS[1]} and found(live, "zyxgamma") == {IDS[2]}
    assert len(live.state["generations"]) < 3 and live.state["batch"] == 2
    again = LiveCorpus(live.base, live.store)
    assert found(again, "stream") == set(IDS)
    check_whole(again)
