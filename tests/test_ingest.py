"""Hand-written rows for every cleaning rule, and the counts of the fixture."""

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import ingest
from broadsheet.operators.filters import as_list
from broadsheet.schemas import RAW_NEWS, section_categories
from broadsheet.sources.raw_news import raw_news

TEN = "one two three four five six seven eight nine ten"


def raw_rows(spark, rows):
    fields = RAW_NEWS.fieldNames()
    base = {"date": "2020-01-05 10:00:00", "title": "A title", "article": TEN, "author": "Ann",
            "section": "tech", "publication": "CNN"}
    full = [(i, *({**base, **r}[f] for f in fields)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "ord long, " + ", ".join(f"{f} string" for f in fields))


def cleaned(spark, **row):
    return ingest.articles(raw_rows(spark, [row])).first()


@pytest.mark.parametrize(
    "row, reason",
    [
        ({"title": None}, "empty_title"),
        ({"title": " \t\n　"}, "empty_title"),
        ({"title": "  ", "article": None}, "empty_title"),
        ({"article": None}, "empty_article"),
        ({"article": ""}, "empty_article"),
        ({"article": "None"}, "empty_article"),
        ({"article": "   "}, "empty_article"),
        ({"article": TEN.replace(" ten", "")}, "too_short"),
        ({"article": TEN}, None),
        ({"article": TEN.replace(" ", " ")}, None),
        ({"title": "None"}, None),
    ],
)
def test_reject_reason(spark, row, reason):
    assert ingest.with_reasons(raw_rows(spark, [row])).first()["reason"] == reason


LONG = ("ab " * 100)[:251]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("x" * 250, "x" * 250),
        (LONG[:250] + "b", LONG[:250].rsplit(" ", 1)[0] + "..."),
        ("y" * 249 + " z", "y" * 249 + "..."),
        ("q" * 300, "q" * 250 + "..."),
        ("  " + "x" * 250 + "\n", "x" * 250),
        ("", "No summary available."),
        (" None ", "No summary available."),
        (None, "No summary available."),
    ],
)
def test_summary(spark, text, expected):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(ingest.summary_of(F.col("c"))).first()[0] == expected


@pytest.mark.parametrize(
    "date, ts, shown",
    [
        ("2020-01-05 10:00:00", 1578182400, "2020-01-05"),
        ("2020-1-5", 1578182400, "2020-1-5"),
        ("2020-02-30 08:00", 0, "2020-02-30 08:00"),
        ("2020-01-05T00:00:00", 0, "2020-01-05T00:00:00"),
        ("bad", 0, "bad"),
        (None, 0, None),
    ],
)
def test_date(spark, date, ts, shown):
    row = cleaned(spark, date=date)
    assert (row["published_ts"], row["published_at"]) == (ts, shown)


@pytest.mark.parametrize(
    "section, category, tags",
    [
        ("Health ", "Health", ["Health "]),
        ("Food by VICE ", "General", ["Food by VICE "]),
        ("opinion", "Politics", ["opinion"]),
        ("Opinion", "Opinion", ["Opinion"]),
        ("None", "General", []),
        (None, "General", []),
        ("", "General", []),
        ("Unheard of", "General", ["Unheard of"]),
    ],
)
def test_section(spark, section, category, tags):
    row = cleaned(spark, section=section)
    assert (row["category"], row["tags"]) == (category, tags)


@pytest.mark.parametrize(
    "publication, source",
    [("Vice", "VICE"), (" Wired ", "Wired"), (None, "Unknown"), ("", "Unknown"), ("   ", ""),
     ("Other Paper", "Other Paper"), ("None", "None")],
)
def test_publication(spark, publication, source):
    assert cleaned(spark, publication=publication)["source"] == source


@pytest.mark.parametrize("author, shown", [(None, "Unknown"), ("None", "Unknown"), ("", ""), ("Ann", "Ann")])
def test_author(spark, author, shown):
    assert cleaned(spark, author=author)["author"] == shown


def test_title_and_words(spark):
    row = cleaned(spark, title="  Big\tnews \r\n", article=f"  {TEN}\n\neleven ")
    assert (row["title"], row["word_count"], row["id"]) == ("Big\tnews", 11, "nw_0000001")
    assert row["content"] == f"  {TEN}\n\neleven "


def test_first_valid_copy_is_kept(spark):
    rows = [{"article": "too short"}, {"author": "first"}, {"author": "second"}, {"date": None},
            {"date": None, "author": "other"}, {"title": " A title"}]
    got = ingest.articles(raw_rows(spark, rows)).orderBy("ord").collect()
    assert [(r["ord"], r["author"]) for r in got] == [(1, "first"), (3, "Ann"), (5, "Ann")]
    reasons = ingest.with_reasons(raw_rows(spark, rows)).orderBy("ord").collect()
    assert [r["reason"] for r in reasons] == ["too_short", None, "duplicate", None, "duplicate", None]


def test_fixture_counts(spark, sf_dir):
    report = {r["name"]: r["n"] for r in ingest.report(raw_news(spark, sf_dir)).collect()}
    assert report == {"total_rows": 200, "loaded": 180, "skipped": 20, "duplicate": 8,
                      "empty_article": 4, "too_short": 6, "empty_title": 2}


def test_limited_report_stops_counting(spark, sf_dir):
    raw = raw_news(spark, sf_dir)
    reasons = [r["reason"] for r in ingest.with_reasons(raw).orderBy("ord").collect()]
    loaded = skipped = 0
    for reason in reasons:
        if loaded == 100:
            break
        loaded, skipped = loaded + (reason is None), skipped + (reason is not None)
    report = {r["name"]: r["n"] for r in ingest.report(raw, target=100).collect()}
    assert (report["total_rows"], report["loaded"], report["skipped"]) == (200, 100, skipped)
    assert ingest.articles(raw, target=100).count() == 100


@pytest.mark.parametrize("bucket", [1, 7, 64, 1 << 20])
def test_numbers_do_not_depend_on_bucket_size(spark, bucket):
    ords = spark.range(0, 500).select((F.col("id") * 37 + (F.col("id") % 5) * (1 << 41)).alias("ord"))
    got = ingest.numbered(ords, rows_per_bucket=bucket).orderBy("ord").collect()
    assert [r["number"] for r in got] == list(range(1, 501))


def test_dedup_and_numbering_have_no_global_sort(spark, sf_dir):
    plan = ingest.articles(raw_news(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(ord" not in plan


def test_section_table():
    table = dict(section_categories())
    assert len(table) == len(section_categories()) == 164
    assert as_list("a, b,,All ") == ["a", "b", "All"] and as_list("All") == [] == as_list(None)


def test_upsert_replaces_whole_documents(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, v int, w string")
    changes = spark.createDataFrame(
        [("b", 2, None, 1), ("b", 3, "z", 2), ("c", 9, "n", 1)], "id string, v int, w string, seq int"
    )
    got = sorted(tuple(r) for r in ingest.upsert(stored, changes, "seq").collect())
    assert got == [("a", 1, "x"), ("b", 3, "z"), ("c", 9, "n")]
