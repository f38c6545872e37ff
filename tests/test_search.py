"""Search against brute force in plain Python, and the paths taken beyond the broadcast bound."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.functions.text import BLANKS, has_words, highlight, snippet, tag_array_values, words
from broadsheet.operators import cache, facets, hybrid, similar, suggest, textsearch
from broadsheet.operators.skew import sized_join, top_per_key
from broadsheet.operators.vectors import nearest, nearest_to, norm
from broadsheet.plans import workload
from broadsheet.plans.corpus import corpus
from broadsheet.plans.textindex import TEXT_FIELDS
from broadsheet.schemas import FIELD_WEIGHTS
from broadsheet.sources.query_log import query_log, query_vectors


@pytest.fixture(scope="module")
def c(spark, sf_dir):
    return corpus(spark, sf_dir)


@pytest.fixture(scope="module")
def articles(c):
    return [r.asDict() for r in c.articles.orderBy("id").collect()]


def toks(text):
    kind = lambda ch: unicodedata.category(ch)[0]
    return "".join(ch if kind(ch) in "LN" else " " for ch in text.lower()).split(" ")


def tokens_of(text):
    return [t for t in toks(text) if t]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(articles, text, fields=("title", "summary"), fuzzy=False):
    docs = [
        {f: tokens_of(a[f]) for f in fields} for a in articles
    ]
    length = [sum(FIELD_WEIGHTS[f] * len(d[f]) for f in fields) for d in docs]
    n, average = len(docs), sum(length) / len(docs)
    vocabulary = {t for d in docs for f in fields for t in d[f]}
    df = {t: 0 for t in vocabulary}
    for d in docs:
        for t in {t for f in fields for t in d[f]}:
            df[t] += 1
    scores = {}
    query = list(dict.fromkeys(tokens_of(text)))
    near = {w: [t for t in vocabulary if (distance(t, w) <= 2 if fuzzy else t == w)] for w in query}
    for a, d, dl in zip(articles, docs, length):
        total, ok = 0.0, True
        for w in query:
            best = None
            for t in near[w]:
                tf = sum(FIELD_WEIGHTS[f] * d[f].count(t) for f in fields)
                if tf:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))
                    best = part if best is None else max(best, part)
            if best is None:
                ok = False
                break
            total += best
        if ok and query:
            scores[a["id"]] = total
    return scores


def assert_ranked(rows, scores, limit=10):
    want = sorted(scores.items(), key=lambda kv: (-round(kv[1], 6), kv[0]))[:limit]
    rows = sorted(rows, key=lambda r: r["rank"])
    assert [r["id"] for r in rows] == [i for i, _ in want]
    assert np.allclose([r["score"] for r in rows], [s for _, s in want], atol=2e-6)


@pytest.mark.parametrize("text", ["the of", "that with by", "The THE of!", "le de", "zzzzzz the", "!!"])
def test_relevance(c, articles, text):
    assert_ranked(textsearch.search(c, text).collect(), brute(articles, text))


def test_all_fields(c, articles):
    rows = textsearch.search(c, "unknown 2019 the", fields=TEXT_FIELDS).collect()
    assert_ranked(rows, brute(articles, "unknown 2019 the", TEXT_FIELDS))


def test_fuzzy(c, articles):
    rows = textsearch.search(c, "thet off", fuzzy=True).collect()
    assert_ranked(rows, brute(articles, "thet off", fuzzy=True))


def test_fuzzy_at_distance_zero_is_exact(c):
    exact = textsearch.exact_scores(c, "the of", ["title", "summary"]).collect()
    fuzzy = textsearch.fuzzy_scores(c, "the of", ["title", "summary"], distance=0).collect()
    assert sorted(exact) == sorted(fuzzy)


@pytest.mark.parametrize("sort", textsearch.SORTS)
def test_pages_join_to_the_whole_list(c, sort):
    whole = textsearch.search(c, "the of", sort=sort, limit=40).orderBy("rank").collect()
    parts = [
        row
        for start in range(0, 40, 15)
        for row in textsearch.search(c, "the of", sort=sort, offset=start, limit=15)
        .orderBy("rank").collect()
    ]
    assert parts[:40] == whole


def test_large_page_is_joined_not_looked_up(c):
    big = textsearch.search(c, "the of", limit=textsearch.PAGE_ROWS + 1).orderBy("rank").collect()
    assert len(big) == textsearch.total(c, "the of").first()["total"]
    assert big[:10] == textsearch.search(c, "the of").orderBy("rank").collect()


def test_short_text_matches_everything(c, articles):
    assert textsearch.total(c, "x").first()["total"] == len(articles)
    first = textsearch.search(c, " a ", limit=3).orderBy("rank").collect()
    assert [r["id"] for r in first] == [a["id"] for a in articles[:3]]


def test_matching_needs_no_shuffle(c):
    plan = textsearch.exact_scores(c, "the of", ["title", "summary"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    scoring = text[: text.index("BroadcastExchange")]
    assert "hashpartitioning(ord" not in text
    assert "Exchange" not in scoring.replace("BroadcastExchange", "")
    assert "PushedFilters: [In(term" in plan._jdf.queryExecution().executedPlan().toString() or "In(term" in text


def test_no_cartesian_products(c, spark, sf_dir):
    frames = [
        workload.search_all(c, query_log(spark, sf_dir)),
        suggest.spellcheck(c, query_log(spark, sf_dir)),
        facets.category_counts(c, "the of", "VICE"),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_facets_add_up(c, articles):
    total = sum(r["n"] for r in facets.category_facet(c).collect())
    assert total == len(articles)
    found = sum(r["n"] for r in facets.category_counts(c, "that with by").collect())
    assert found == textsearch.total(c, "that with by", fields=TEXT_FIELDS).first()["total"]


# --- requests in bulk --------------------------------------------------------------------------


def requests(spark):
    rows = [
        (1, "the of", "All", "All", "relevance", False, 0, 10),
        (2, "the of", "Politics, World", "All", "date_desc", False, 0, 10),
        (3, "the of", "All", "VICE,Wired", "date_asc", False, 2, 5),
        (4, "", "All", "All", "date_desc", False, 0, 4),
        (5, "x", "general", "unknown,vice", "relevance", False, 1, 4),
        (6, "le de", None, "", "nonsense", False, 0, 10),
        (7, "nothingmatches the", "All", "All", "relevance", False, 0, 10),
        (8, "the of", "All", "All", "relevance", False, 0, 10),
        (9, "!!", "All", "All", "relevance", False, 0, 10),
        (10, "thet off", "All", "All", "relevance", True, 0, 10),
        (11, "thet", "Politics,General", "All", "date_desc", True, 1, 6),
        (12, "x", "All", "wired", "date_asc", True, 0, 3),
        (13, "the of", "all", "All", "relevance", False, 0, 10),
        (14, "the of", " All ", "All", "relevance", False, 0, 10),
        (15, "the of", "Politics, World", "All", "DATE_DESC", False, 0, 10),
        (16, "the", "of:politics", "All", "relevance", False, 0, 10),
        (17, "the:of", "politics", "All", "relevance", False, 0, 10),
        (18, "the of", "All", "All", None, None, 0, 10),
    ]
    return spark.createDataFrame(
        rows,
        "query_id long, text string, categories string, sources string, sort string, "
        "fuzzy boolean, offset int, limit int",
    )


@pytest.mark.parametrize("max_bytes", [None, 0])
def test_bulk_search_equals_single_searches(c, spark, max_bytes):
    table = requests(spark)
    got = {}
    for r in workload.search_all(c, table, max_bytes=max_bytes).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q in table.collect():
        single = textsearch.search(
            c, q["text"], q["categories"], q["sources"], fuzzy=bool(q["fuzzy"]), sort=q["sort"] or "relevance",
            offset=q["offset"], limit=q["limit"],
        )
        want = sorted((r["rank"], r["id"], r["score"]) for r in single.collect())
        assert sorted(got.get(q["query_id"], [])) == want, q


def test_sized_join_gives_the_same_rows_either_way(spark):
    big = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sized_join(big, small, ["k"], how)
        b = sized_join(big, small, ["k"], how, max_bytes=0)
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_top_per_key(spark):
    rows = [(i % 3 if i % 2 else 0, (i * 7919) % 1009, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long, i long")
    order = lambda: [F.asc("v"), F.asc("i")]
    plain = top_per_key(df, ["k"], order(), 20)
    salted = top_per_key(df, ["k"], order(), 20, group_limit=0, salts=5)
    assert sorted(plain.collect()) == sorted(salted.collect())
    want = {
        (k, v, i, r)
        for key in range(3)
        for r, (v, i, k) in enumerate(sorted((v, i, k) for k, v, i in rows if k == key)[:20], 1)
    }
    assert {tuple(r) for r in plain.collect()} == want


def test_pages_are_cut_before_the_shuffle(c, spark):
    _, distinct = workload.distinct_requests(requests(spark))
    frames = [
        workload.search_distinct(c, distinct),
        facets.category_sections(c),
        similar.similar_to_each(c),
    ]
    for df in frames:
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


# --- vectors -----------------------------------------------------------------------------------


def vectors(spark, n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[n // 2 : n // 2 + n // 3] = data[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    return data.astype(np.float64), spark.createDataFrame(rows, "ord long, vector array<float>")


@pytest.mark.parametrize("rule", ["all", "not_self", "earlier"])
@pytest.mark.parametrize("query_bytes", [1 << 25, 0])
def test_nearest_against_brute_force(spark, rule, query_bytes):
    data, df = vectors(spark, 90)
    queries = df.select(F.col("ord").alias("query_key"), "vector")
    got = nearest(df, queries, 4, rule, query_bytes=query_bytes, block_rows=25).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 6) + 0.0
    want = set()
    for q in range(len(data)):
        allowed = [
            j for j in range(len(data))
            if rule == "all" or (rule == "not_self" and j != q) or (rule == "earlier" and j < q)
        ]
        for rank, j in enumerate(sorted(allowed, key=lambda j: (far[q, j], j))[:4], 1):
            want.add((q, j, float(far[q, j]), rank))
    assert {(r.query_key, r.ord, r.distance, r.rank) for r in got} == want


def test_far_cells_are_not_visited(spark, monkeypatch):
    """On vectors in clusters the bound saves most distances, without changing the answer."""
    from broadsheet.operators import vectors as module

    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 16))
    data = np.repeat(middle, 20, axis=0) + 0.05 * rng.normal(size=(600, 16))
    data = data.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "ord long, vector array<float>")
    written = {}
    keep = module.scratch_table
    monkeypatch.setattr(module, "scratch_table", lambda s, d, name: written.setdefault(name, keep(s, d, name)))
    queries = df.select(F.col("ord").alias("query_key"), "vector")
    got = {(r.query_key, r.ord, r.distance) for r in nearest(df, queries, 3, "not_self", query_bytes=0, block_rows=64).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 6) + 0.0
    want = {
        (q, j, float(far[q, j]))
        for q in range(600) for j in sorted((j for j in range(600) if j != q), key=lambda j: (far[q, j], j))[:3]
    }
    assert got == want
    sizes = written["cells"].groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    met = written["queries"].select("query_key", "cell").union(written["visits"])
    looked_at = met.join(sizes, "cell").agg(F.sum("n").alias("n")).first()["n"]
    assert looked_at < 600 * 600 / 3
    assert met.count() < 600 * sizes.count() / 3


def test_every_embedding_is_a_request(spark, sf_dir):
    log = query_vectors(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert log.select("vector").distinct().count() == n and log.select("text").distinct().count() > 1
    assert log.select("query_id").distinct().count() == log.count()


def test_similar_all_equals_similar_one(c):
    every = {}
    for r in similar.similar_to_each(c, k=5).collect():
        every.setdefault(r["id"], []).append((r["rank"], r["similar_id"], r["distance"]))
    for article in sorted(every)[:3]:
        one = [(r["rank"], r["id"], r["distance"]) for r in similar.similar_articles(c, article).collect()]
        assert sorted(every[article]) == sorted(one)
    assert similar.similar_articles(c, "nw_9999999").count() == 0


# --- fusion ------------------------------------------------------------------------------------


def lists(spark, text, vector):
    def frame(ids):
        rows = [(i, r) for r, i in enumerate(ids, 1)]
        return spark.createDataFrame(rows, "id string, rank long")

    return frame(text), frame(vector)


def test_fusion_example(spark):
    fused = hybrid.fuse(*lists(spark, ["a", "b"], ["b", "c"]), ["id"], 0.5)
    got = [(r["id"], r["hybrid_score"]) for r in fused.orderBy(*hybrid.fused_order()).collect()]
    assert got == [("b", round(0.5 / 62 + 0.5 / 61, 9)), ("a", round(0.5 / 61, 9)), ("c", round(0.5 / 62, 9))]


def test_fusion_tie_and_zero_weight(spark):
    tie = hybrid.fuse(*lists(spark, ["a"], ["c"]), ["id"], 0.5).orderBy(*hybrid.fused_order())
    assert [r["id"] for r in tie.collect()] == ["a", "c"]
    zero = hybrid.fuse(*lists(spark, ["x", "b", "a"], ["z", "b", "y"]), ["id"], 0.0)
    assert [r["id"] for r in zero.orderBy(*hybrid.fused_order()).collect()] == ["x", "b", "a", "z", "y"]


def test_vectors_without_direction_have_no_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "ord long, vector array<float>")
    normed = df.withColumn("norm", norm(F.col("vector")))
    assert [r["ord"] for r in nearest_to(normed, [1.0, 0.1], 10).collect()] == [1, 5, 4]
    assert nearest_to(normed, [0.0, 0.0], 10).count() == 0
    reuse = workload.embedding_reuse(df.withColumnRenamed("ord", "query_id")).collect()
    assert {r["query_id"]: r["reused_from"] for r in reuse} == {1: None, 2: None, 4: None, 5: 1}


@pytest.mark.parametrize("query_bytes", [1 << 25, 0])
def test_bulk_vector_equals_single(c, spark, sf_dir, query_bytes):
    log = query_vectors(spark, sf_dir).filter("vector is not null and length(text) > 3")
    log = log.orderBy(F.col("query_id") % 7, "query_id").limit(5)
    found = workload.vector_all(c, log, query_bytes=query_bytes, block_rows=40).collect()
    for q in log.collect():
        one = similar.vector_search(
            c, q["vector"], q["categories"], q["sources"], q["offset"], q["limit"]
        )
        want = sorted((r["rank"], r["id"], r["distance"]) for r in one.collect())
        assert sorted(tuple(r)[1:] for r in found if r["query_id"] == q["query_id"]) == want


def test_bulk_hybrid_equals_single(c, spark, sf_dir):
    log = query_vectors(spark, sf_dir).filter(F.col("vector").isNotNull()).orderBy("query_id").limit(3)
    got = {}
    for r in workload.hybrid_all(c, log).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["hybrid_score"]))
    for q in log.collect():
        one = hybrid.hybrid_search(
            c, q["text"], q["vector"], q["categories"], q["sources"], q["offset"], q["limit"]
        )
        want = sorted((r["rank"], r["id"], r["hybrid_score"]) for r in one.collect())
        assert sorted(got.get(q["query_id"], [])) == want


# --- presentation and suggestions --------------------------------------------------------------


def test_highlight_and_snippet(spark):
    long = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([("The cat, the CAT's hat; Étude", long)], "t string, s string")
    q = F.array(F.lit("cat"), F.lit("étude"), F.lit("w60"), F.lit("w70"))
    row = df.select(highlight(F.col("t"), q), snippet(F.col("s"), q), snippet(F.col("t"), q)).first()
    assert row[0] == "The <mark>cat</mark>, the <mark>CAT</mark>'s hat; <mark>Étude</mark>"
    assert row[1] == " ".join(f"w{i}" for i in range(21, 71))
    assert row[2] == "The cat, the CAT's hat; Étude"


def test_snippet_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c,", "The"], size=n)) for n in (5, 6, 7, 30, 90)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(snippet(F.col("t"), F.array(F.lit("c"), F.lit("the")), 6)).collect()]
    for text, cut in zip(texts, got):
        ws = text.split()
        hits = [w in ("c,", "The") for w in ws]
        if len(ws) <= 6:
            assert cut == text
            continue
        best = max(range(len(ws) - 5), key=lambda s: (sum(hits[s : s + 6]), -s))
        assert cut == " ".join(ws[best : best + 6])


def test_words_and_tags(spark):
    df = spark.createDataFrame([("a" + BLANKS + "b ", ["Food, Wine", "Health ", "food"])], "t string, g array<string>")
    row = df.select(words(F.col("t")), tag_array_values(F.col("g"))).first()
    assert row[0] == ["a", "b"] and row[1] == ["food", "wine", "health"]


def test_white_space_is_the_same_as_in_python(spark):
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([("a" + ch + "b", len(("a" + ch + "b").split())) for ch in chars], "t string, n int")
    wrong = df.filter((F.size(words(F.col("t"))) != F.col("n")) | (has_words(F.col("t"), 2) != (F.col("n") == 2)))
    assert wrong.count() == 0


@pytest.mark.parametrize("d", [1, 2])
@pytest.mark.parametrize("max_bytes", [None, 0])
def test_edit_distance_join(spark, d, max_bytes):
    rng = np.random.default_rng(5)
    make = lambda n: sorted({"".join(rng.choice(list("abé"), size=rng.integers(1, 8))) for _ in range(n)})
    terms, asked = make(150), make(40)
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, n long")
    queries = spark.createDataFrame([(w,) for w in asked], "word string")
    got = suggest.near_terms(vocabulary, queries, d, max_bytes).collect()
    want = {(w, t) for w in asked for t in terms if distance(w, t) <= d}
    assert len(got) == len(want) and {(r["word"], r["term"]) for r in got} == want


@pytest.mark.parametrize("depth", [2, 3, 24])
def test_completions_of_any_depth(spark, depth):
    rows = [(f"{a}{b}{c_}" * n, (i * 7) % 5 + n) for i, (a, b, c_) in enumerate("abc bac Abd aBc zz- éaé".replace("-", "y").split()) for n in (1, 2, 12)]
    dictionary = spark.createDataFrame([(s, int(n)) for s, n in dict(rows).items()], "suggestion string, score long")
    typed = sorted({s[:n] for s, _ in rows for n in range(1, len(s) + 1)} | {"zq", "abcq"})
    log = spark.createDataFrame(list(enumerate(typed)), "query_id long, prefix string")
    got = {}
    for r in suggest.complete_each(dictionary, log, 3, depth=depth).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.suggestion))
    for i, prefix in enumerate(typed):
        best = sorted(((-n, s) for s, n in dict(rows).items() if s.lower().startswith(prefix.lower())))[:3] if len(prefix) > 1 else []
        seen, want = set(), []
        for _, s in best:
            if s.lower() not in seen:
                seen.add(s.lower())
                want.append((len(want) + 1, s))
        assert sorted(got.get(i, [])) == want


def test_a_deep_page_leaves_short_ones_as_they_are(c, spark):
    """Requests of one depth class keep as many rows before the shuffle, whatever others ask for."""
    short = [(i, w, "All", "All", "relevance", False, 0, 10) for i, w in enumerate(("the", "le", "der"))]
    deep = [(9, "the", "All", "All", "relevance", False, 5000, 10), (10, "of", "All", "All", "relevance", False, 20, 15)]
    schema = "query_id long, text string, categories string, sources string, sort string, fuzzy boolean, offset int, limit int"
    both = workload.search_all(c, spark.createDataFrame(short + deep, schema))
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    limits = sorted({int(n) for n in re.findall(r"<= (\d+)\)", plan)})
    assert 10 in limits and 35 in limits and 5010 in limits
    got = {(r.query_id, r.rank, r.id, r.score) for r in both.collect()}
    alone = {(r.query_id, r.rank, r.id, r.score) for r in workload.search_all(c, spark.createDataFrame(short, schema)).collect()}
    assert alone == {r for r in got if r[0] < 9}
    one = textsearch.search(c, "of", offset=20, limit=15).collect()
    assert {(r["rank"], r["id"], r["score"]) for r in one} == {r[1:] for r in got if r[0] == 10}


def test_bulk_pages_equal_single_pages(c, spark):
    schema = "query_id long, text string, categories string, sources string, sort string, fuzzy boolean, offset int, limit int"
    rows = [
        (1, "the of", "All", "All", "relevance", False, 0, 5), (2, "thing", "All", "All", "relevance", True, 0, 5),
        (3, "", "Politics", "All", "date_desc", False, 0, 4), (4, "The OF", "All", "All", "relevance", False, 0, 5),
    ]
    got = workload.search_pages(c, spark.createDataFrame(rows, schema)).collect()
    for query_id, text, categories, sources, sort, fuzzy, offset, limit in rows:
        one = textsearch.search(c, text, categories, sources, fuzzy=fuzzy, sort=sort, offset=offset, limit=limit)
        want = sorted(tuple(r) for r in one.collect())
        assert sorted(tuple(r)[1:] for r in got if r.query_id == query_id) == want
    assert any("<mark>" in r.title for r in got if r.query_id == 2)


def test_bulk_facets_equal_single_counts(c, spark):
    schema = "query_id long, text string, categories string, sources string, sort string, fuzzy boolean, offset int, limit int"
    rows = [(i, t, "Politics", s, "date_desc", False, 5, 5) for i, (t, s) in enumerate([
        ("the of", "All"), ("that with by", "VICE,Wired, Unknown"), ("", "VICE,Unknown"), ("x", "All"), ("nosuchword", "All"), ("--", "All"), ("the of", "All"),
    ])]
    got = workload.category_counts_all(c, spark.createDataFrame(rows, schema)).collect()
    for query_id, text, _, sources, *_ in rows:
        want = {tuple(r) for r in facets.category_counts(c, text, sources).collect()}
        assert {(r.name, r.n) for r in got if r.query_id == query_id} == want


def test_autocomplete(c, spark):
    dictionary = spark.createDataFrame(
        [("Tech", 9), ("tech", 8), ("Technology", 7), ("Tea", 6), ("x" * 40, 3), ("x" * 41, 2)],
        "suggestion string, score long",
    )
    rows = suggest.autocomplete(dictionary, "TE", limit=3).orderBy("rank").collect()
    assert [r["suggestion"] for r in rows] == ["Tech", "Technology"]
    kinds = suggest.autocomplete(dictionary, "xx").orderBy("rank").collect()
    assert [r["type"] for r in kinds] == ["topic", "article"]
    assert suggest.autocomplete(dictionary, "a").count() == 0
    typed = spark.createDataFrame([(1, "TE"), (2, "xx"), (3, "a"), (4, "te")], "query_id long, prefix string")
    for max_bytes in (None, 0):
        bulk = suggest.complete_each(dictionary, typed, 3, max_bytes).collect()
        assert sorted((r["query_id"], r["rank"], r["suggestion"]) for r in bulk) == [
            (1, 1, "Tech"), (1, 2, "Technology"), (2, 1, "x" * 40), (2, 2, "x" * 41),
            (4, 1, "Tech"), (4, 2, "Technology"),
        ]


# --- cache -------------------------------------------------------------------------------------


def log_of(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, cache_key string, us long")
    return df.select("event_id", "cache_key", F.timestamp_micros("us").alias("ts"))


def test_cache_example(spark):
    rows = [(i, "k", s * 1_000_000) for i, s in enumerate([0, 59, 60, 119, 120])]
    hits = {r["event_id"]: r["hit"] for r in cache.cache_hits(log_of(spark, rows), 60).collect()}
    assert [hits[i] for i in range(5)] == [False, True, False, True, False]


@pytest.mark.parametrize("chunk_ttls, slot_rows", [(1, 50), (2, 1000), (60, 300)])
def test_cache_chunks_do_not_change_hits(spark, chunk_ttls, slot_rows):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1500):
        hot = rng.random() < 0.5
        rows.append((i, "hot" if hot else f"k{rng.integers(4)}", int(rng.integers(0, 900)) * 500_000))
    hits = cache.cache_hits(log_of(spark, rows), 7, chunk_ttls, slot_rows).collect()
    expiry, want = {}, {}
    for i, key, us in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = us < expiry.get(key, -1)
        if not want[i]:
            expiry[key] = us + 7_000_000
    assert {r["event_id"]: r["hit"] for r in hits} == want


def test_cache_key(spark):
    row = ("  The Of ", "All", None, "relevance", False, 0, 10)
    schema = "text string, categories string, sources string, sort string, fuzzy boolean, offset int, limit int"
    import hashlib

    df = spark.createDataFrame([row, row[:4] + (True,) + row[5:]], schema)
    keys = [r[0] for r in df.select(cache.cache_key()).collect()]
    plain = "text:the of:all:all:relevance:0:10"
    assert keys[0] == "query_cache:text:" + hashlib.md5(plain.encode()).hexdigest()
    assert keys[1] != keys[0] and re.fullmatch(r"query_cache:text:[0-9a-f]{32}", keys[1])


def test_visits_are_not_copied_per_cell(spark):
    """Without structure every cell is reached: a query travels once per block, and nothing is broadcast whole."""
    from broadsheet.operators import vectors as module

    assert module.blocks_of_cells({0: 3, 1: 4, 2: 9, 3: 2, 5: 1}, 4) == [(0, 0, 1), (1, 1, 1), (2, 2, 3), (3, 5, 1), (5, 5, 1)]
    data, df = vectors(spark, 300, dim=24, seed=3)
    queries = df.select(F.col("ord").alias("query_key"), "vector")
    seen, keep = [], module._met_away

    def counted(rows, bounded, there, *rest):
        seen.append((rows, bounded, there, rest[0]))
        return keep(rows, bounded, there, *rest)

    module._met_away = counted
    try:
        got = {(r.query_key, r.ord, r.distance) for r in nearest(df, queries, 3, "earlier", query_bytes=0, block_rows=100).collect()}
    finally:
        module._met_away = keep
    (rows, bounded, there, sizes), = seen
    blocks = {b for _, first, n in module.blocks_of_cells(sizes, 100) for b in range(first, first + n)}
    assert there.count() > 300 * 3 > 300 * len(blocks) / 2
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 6) + 0.0
    assert got == {(q, j, float(far[q, j])) for q in range(300) for j in sorted(range(q), key=lambda j: (far[q, j], j))[:3]}


def test_copied_sides_are_narrow(c, spark, monkeypatch):
    """A side too large to broadcast is copied to all slots, so it never is the one with texts or answers."""
    from broadsheet.operators import lookup

    seen, keep = [], lookup.sized_join
    note = lambda big, small, *rest, **named: seen.append(small.columns) or keep(big, small, *rest, **named)
    ids = spark.createDataFrame([("nw_0000001",), ("article:nw_0000002",), ("nw_0000001",), ("none",), (None,)], "requested string")
    monkeypatch.setattr(lookup, "sized_join", note)
    got = lookup.get_articles(c, ids, ["title", "content"]).collect()
    assert sorted((r.requested or "", r.found, r.id or "") for r in got) == [
        ("", False, ""), ("article:nw_0000002", True, "nw_0000002"), ("none", False, ""),
        ("nw_0000001", True, "nw_0000001"), ("nw_0000001", True, "nw_0000001"),
    ]
    assert not any("content" in columns for columns in seen)
    monkeypatch.setattr(workload, "sized_join", note)
    seen.clear()
    workload.give_back(spark.createDataFrame([(1, "a")], "query_id long, qkey string"), spark.createDataFrame([("a", "x")], "qkey string, content string"))
    assert seen == [["query_id", "qkey"]]


def test_slices_of_requests_change_nothing(c, spark, sf_dir, monkeypatch):
    """Requests beyond one broadcast are searched in slices; exact, fuzzy and without text."""
    rows = [
        (i, text, "All", "All", sort, fuzzy, 0, 4)
        for i, (text, sort, fuzzy) in enumerate(
            (t, s, f) for t in ("the of", "le de", "", "thing onthe", "der") for s in ("relevance", "date_asc") for f in (False, True)
        )
    ]
    requests = spark.createDataFrame(
        rows, "query_id long, text string, categories string, sources string, sort string, fuzzy boolean, offset int, limit int"
    )
    want = {tuple(r) for r in workload.search_all(c, requests).collect()}
    counts = {tuple(r) for r in workload.category_counts_all(c, requests).collect()}
    cut = lambda d, n=0: [d.filter(F.pmod(F.xxhash64("qkey"), F.lit(3)) == i) for i in range(3)]
    monkeypatch.setattr(workload, "slices", cut)
    assert {tuple(r) for r in workload.search_all(c, requests).collect()} == want and len(want) > 20
    assert {tuple(r) for r in workload.category_counts_all(c, requests).collect()} == counts
