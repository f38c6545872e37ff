"""Requests against blocks of articles, against plain Python."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import suggest
from broadsheet.operators.textsearch import search
from broadsheet.plans import blocks, workload
from broadsheet.plans.corpus import Corpus, corpus
from broadsheet.session import shared_dir
from broadsheet.sources.store import Store

REQUESTS = "query_id long, text string, categories string, sources string, sort string, fuzzy boolean, offset int, limit int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_deletions_find_what_segments_find(spark):
    rng = np.random.default_rng(3)
    make = lambda n, most: {"".join(rng.choice(list("abé"), size=rng.integers(1, most))) for _ in range(n)}
    base = "abcdefghijklmnopq"
    terms = sorted(make(120, 8) | {base[:n] for n in range(13, 18)} | {base + base, base + "x" + base, "z" * 40})
    asked = sorted(make(40, 8) | {base[:16], base, base[2:], base + base[1:], "z" * 41, "zz"})
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, df long")
    got = suggest.near_by_deletions(vocabulary, spark.createDataFrame([(w,) for w in asked], "word string")).collect()
    want = {(w, t, i) for w in asked for i, t in enumerate(terms) if edits(w, t) <= 2}
    assert len(got) == len(want) and {(r["word"], r["term"], r["df"]) for r in got} == want


def test_scores_are_rounded_as_spark_does(spark):
    scores = [0.0000005, 1.0000005, 2.3456785, 1.1234565, 0.1234564999999, 12.5, 0.0, 7.0000015]
    scores += list(np.random.default_rng(1).random(500) * 40)
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i long, s double")
    want = [r["r"] for r in df.select("i", F.round("s", 6).alias("r")).orderBy("i").collect()]
    assert list(blocks.units(np.array(scores)) / 10**6) == want
    assert all(Decimal(repr(w)) == Decimal(repr(float(s))).quantize(Decimal("1.000000"), ROUND_HALF_UP) for w, s in zip(want, scores))


@pytest.mark.parametrize("every", [False, True])
def test_blocks_keep_the_best_rows(monkeypatch, every):
    monkeypatch.setattr(blocks, "WAITING_ROWS", 200)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 1 << 12)
    rng = np.random.default_rng(9)
    articles = [
        {
            "ord": i // 2 if i % 50 < 2 else i, "row": i, "category_tag": [None, "a", "b"][rng.integers(3)], "source_tags": [["x"], ["x", "y"], []][rng.integers(3)],
            "published_ts": [None, 5, 7, -3][rng.integers(4)],
            "terms": {int(t): float(rng.integers(1, 9)) / 8 for t in rng.choice(20, size=rng.integers(0, 12), replace=False)},
        }
        for i in rng.permutation(700)
    ]
    links = {w: sorted(rng.choice(20, size=1 + w % 4, replace=False).tolist()) for w in range(30)}
    asked = [
        {
            "number": 100 + n, "words": rng.choice(30, size=rng.integers(1, 5), replace=False).tolist(),
            "category_list": [[], ["a"], ["b", "c"]][rng.integers(3)], "source_list": [[], ["y"], ["x", "z"]][rng.integers(3)],
            "sort": ["relevance", "date_desc", "date_asc"][n % 3], "k": int(rng.integers(1, 9)),
        }
        for n in range(150)
    ]
    kinds = pa.schema([
        ("number", pa.int64()), ("words", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int64())), ("category_list", pa.list_(pa.string())),
        ("source_list", pa.list_(pa.string())), ("sort", pa.string()), ("k", pa.int64()),
    ])
    table = pa.Table.from_pylist([r | {"dfs": [len(links[w]) for w in r["words"]]} for r in asked], kinds)
    pairs = pa.table({"w": [w for w, ts in links.items() for _ in ts], "t": [t for ts in links.values() for t in ts]})
    kinds = pa.schema([
        ("ord", pa.int64()), ("row", pa.int64()), ("category_tag", pa.string()), ("source_tags", pa.list_(pa.string())), ("published_ts", pa.int64()),
        ("numbers", pa.list_(pa.int64())), ("parts", pa.list_(pa.float64())),
    ])
    held = [a | {"numbers": list(a["terms"]), "parts": list(a["terms"].values())} for a in articles]
    batch = pa.Table.from_pylist(held, kinds).combine_chunks().to_batches()

    class Sent:
        value = blocks.Slice(table, pairs)

    got = {}
    for out in blocks._search(Sent, every)(iter(batch)):
        for r in out.to_pylist():
            got.setdefault(r["number"], []).append((r["key"], r["ord"], r["row"], r["score"]))
    matched = 0
    for r in asked:
        rows = []
        for a in articles:
            parts = [[a["terms"][t] for t in links[w] if t in a["terms"]] for w in r["words"]]
            passes = not r["category_list"] or a["category_tag"] in r["category_list"]
            passes &= not r["source_list"] or bool(set(r["source_list"]) & set(a["source_tags"]))
            if all(parts) and passes:
                score, ts = sum(map(max, parts)), a["published_ts"] or 0
                key = {"relevance": -round(score * 10**6), "date_desc": -ts, "date_asc": ts}[r["sort"]]
                rows.append((key, a["ord"], a["row"], score))
        matched += len(rows)
        assert sorted(got.get(r["number"], [])) == sorted(rows)[: None if every else r["k"]]
    assert matched > 1000


def test_bulk_requests_make_no_row_per_article_tried(spark, sf_dir):
    """Neither exact nor fuzzy requests, of few words or many, are joined with the articles that hold a word."""
    c = corpus(spark, sf_dir)
    rows = [
        (1, "the of", "All", "All", "relevance", False, 0, 10), (2, "thet off", "Politics,General", "All", "date_desc", True, 0, 10),
        (3, "the of in and", "All", "All", "relevance", True, 0, 5),
    ]
    title = c.articles.filter(F.length("title") > 60).orderBy("ord").first()["title"]
    rows += [(4, title, "All", "All", "relevance", True, 0, 3), (5, title[:-1], "All", "All", "date_asc", True, 0, 3)]
    found = workload.search_all(c, spark.createDataFrame(rows, REQUESTS))
    assert "anchor" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    for query_id, text, categories, sources, sort, fuzzy, offset, limit in rows:
        one = search(c, text, categories, sources, fuzzy=fuzzy, sort=sort, offset=offset, limit=limit).collect()
        want = sorted((r["rank"], r["id"], r["score"]) for r in one)
        assert sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == query_id) == want
    assert any(r["query_id"] == 4 for r in got)


def test_slices_of_blocks_change_nothing(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = [(i, w, "All", "All", s, f, 0, 4) for i, (w, s, f) in enumerate(
        (w, s, f) for w in ("the of", "le de", "thing onthe", "der") for s in ("relevance", "date_asc") for f in (False, True)
    )]
    _, distinct = workload.distinct_requests(spark.createDataFrame(rows, REQUESTS))
    asked = blocks.scratch_table(spark, distinct.withColumn("number", F.monotonically_increasing_id()), "requests")

    def best(**sizes):
        out = {}
        for r in blocks.block_matches(c, asked, workload.SEARCH_FIELDS, 2, **sizes)[0].collect():
            out.setdefault(r["number"], []).append((r["key"], r["ord"], r["score"]))
        return {number: sorted(found)[:4] for number, found in out.items()}

    whole = best()
    assert best(slice_bytes=400) == whole and len(whole) > 8


def test_repeated_articles_stand_once_each(spark):
    """Articles that share a key are answered as often as they stand in the table."""
    rows = [(n, f"the title {n}", "2019-01-01 00:00:00", f"some words of {n} " * 9, "A", "Politics", "Vice") for n in (1, 2, 2, 3)]
    raw = spark.createDataFrame(rows, "ord long, title string, date string, article string, author string, section string, publication string")
    c = Corpus(Store(spark, f"{shared_dir(spark)}/repeated"), raw, buckets=2)
    asked = [(1, "the title", "All", "All", "relevance", False, 0, 10), (2, "the titel words some", "All", "All", "relevance", True, 0, 10)]
    docs = c.docs.count()
    assert docs > c.docs.select("ord").distinct().count()
    got = workload.search_all(c, spark.createDataFrame(asked, REQUESTS)).collect()
    assert sorted(r["rank"] for r in got if r["query_id"] == 1) == list(range(1, docs + 1))
