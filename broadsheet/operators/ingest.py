"""Cleaning of raw news: validity, keep-first de-duplication, numbering, transforms, report.

Shape of the job: the wide text columns are shuffled once. Reject reasons are computed in the scan;
de-duplication and numbering work on narrow rows ``(digest, ord)`` and ``(ord)``; the resulting
``ord -> number`` table is joined back to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import has_words, strip, word_count
from broadsheet.operators.skew import sized_join
from broadsheet.schemas import (
    ARTICLE_COLUMNS,
    DEFAULT_CATEGORY,
    ID_FORMAT,
    MIN_WORDS,
    NO_SUMMARY,
    SUMMARY_CHARS,
    UNKNOWN,
    dim_publication,
    dim_section,
)

ROWS_PER_BUCKET = 1 << 20
NONE_TEXT = "None"


# --- row rules ---------------------------------------------------------------------------------


def reject_reason() -> Column:
    """Why a raw row is rejected; null for a valid row. The first rule that applies wins."""
    article = F.coalesce(F.col("article"), F.lit(""))
    return (
        F.when(F.coalesce(strip(F.col("title")), F.lit("")) == "", "empty_title")
        .when((article == NONE_TEXT) | (strip(article) == ""), "empty_article")
        .when(~has_words(article, MIN_WORDS), "too_short")
    )


def summary_of(content: Column, max_chars: int = SUMMARY_CHARS) -> Column:
    """The stripped text when short, else its first ``max_chars`` cut back to the last blank."""
    text = strip(content)
    head = F.regexp_replace(F.substring(text, 1, max_chars), r" [^ ]*\z", "")
    return (
        F.when(content.isNull() | (content == "") | (text == NONE_TEXT), NO_SUMMARY)
        .when(F.length(text) <= max_chars, text)
        .otherwise(F.concat(head, F.lit("...")))
    )


def parsed_day(date: Column) -> Column:
    """The day named by the first token of the date, null when it is not ``year-month-day``."""
    token = F.substring_index(date, " ", 1)
    shaped = F.when(token.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), token)
    return F.try_to_timestamp(shaped, F.lit("yyyy-M-d")).cast("date")


def none_as(c: Column, default: str) -> Column:
    """Null and the printed null become the default."""
    return F.when(c.isNull() | (c == NONE_TEXT), F.lit(default)).otherwise(c)


# --- de-duplication and numbering --------------------------------------------------------------


def digest(*columns: str) -> Column:
    """128 bits that are equal for rows equal in all ``columns``; lengths keep fields apart, and null is
    a value of its own."""
    text = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*text).cast("binary")))


def first_of_each(valid: DataFrame) -> DataFrame:
    """``ord`` of the first row of every (title, date).

    An aggregate, not a window: copies are merged before the shuffle, so a headline repeated in a
    third of the rows costs one row per task. It goes by a digest, as headlines can be whole paragraphs.
    """
    return valid.groupBy(digest("title", "date").alias("_key")).agg(F.min("ord").alias("ord")).select("ord")


def with_reasons(raw: DataFrame) -> DataFrame:
    """Narrow frame ``(ord, reason)`` over all raw rows; reason is null for accepted rows."""
    judged = raw.select("ord", "title", "date", reject_reason().alias("reason"))
    kept = first_of_each(judged.filter(F.col("reason").isNull())).withColumn("_kept", F.lit(True))
    return judged.select("ord", "reason").join(kept, "ord", "left").select(
        "ord",
        F.when(F.col("reason").isNull() & F.col("_kept").isNull(), "duplicate")
        .otherwise(F.col("reason"))
        .alias("reason"),
    )


def numbered(
    ords: DataFrame, start: int | Column = 0, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """``(ord, number)``: 1-based position in ``ord`` order, without sorting in one partition.

    ``ord`` is unique, so a bucket of ``rows_per_bucket`` consecutive values holds at most that many
    rows, whatever the data. Buckets are numbered inside in parallel and shifted by the running
    total of the counts before them; the only global window runs over one row per bucket.
    """
    spread = ords.withColumn("_bucket", F.expr(f"ord div {rows_per_bucket}"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("ord"))
    start_at = F.lit(start) if isinstance(start, int) else start
    return (
        spread.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .select("ord", (F.col("_before") + F.col("_inside") + start_at).cast("long").alias("number"))
    )


def accepted(raw: DataFrame, target: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET):
    """``(ord, number)`` of the rows that are loaded, up to ``target`` rows."""
    valid = raw.select("ord", "title", "date", reject_reason().alias("reason"))
    firsts = first_of_each(valid.filter(F.col("reason").isNull()))
    out = numbered(firsts, rows_per_bucket=rows_per_bucket)
    return out if target is None else out.filter(F.col("number") <= target)


# --- transforms --------------------------------------------------------------------------------


def transform(rows: DataFrame) -> DataFrame:
    """Raw columns plus ``ord`` and ``number`` to article columns plus ``ord``."""
    spark = rows.sparkSession
    date, section, publication = F.col("date"), F.col("section"), F.col("publication")
    day = parsed_day(date)
    content = none_as(F.col("article"), "")
    cleaned = (
        rows.withColumn("section_key", strip(section))
        .withColumn("publication_key", strip(publication))
        .join(F.broadcast(dim_section(spark)), "section_key", "left")
        .join(F.broadcast(dim_publication(spark)), "publication_key", "left")
    )
    has_section = section.isNotNull() & (section != "") & (section != NONE_TEXT)
    return cleaned.select(
        "ord",
        F.format_string(ID_FORMAT, F.col("number")).alias("id"),
        strip(F.col("title")).alias("title"),
        content.alias("content"),
        summary_of(content).alias("summary"),
        none_as(F.col("author"), UNKNOWN).alias("author"),
        F.coalesce(F.col("mapped_category"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.when(has_section, F.array(section))
        .otherwise(F.array().cast("array<string>"))
        .alias("tags"),
        F.when(publication.isNull() | (publication == ""), UNKNOWN)
        .otherwise(F.coalesce(F.col("mapped_source"), F.col("publication_key")))
        .alias("source"),
        F.when(day.isNotNull(), F.substring_index(date, " ", 1)).otherwise(date).alias("published_at"),
        F.coalesce(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400, F.lit(0))
        .cast("long")
        .alias("published_ts"),
        word_count(content).cast("int").alias("word_count"),
    )


def articles(
    raw: DataFrame, target: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Raw news to articles. With ``partitions`` both join sides are spread by ``ord`` into that
    many parts, which is the layout a bucketed table of the same width is written from."""
    numbers = accepted(raw, target)
    if partitions:
        raw, numbers = raw.repartition(partitions, "ord"), numbers.repartition(partitions, "ord")
    return transform(raw.join(numbers, "ord"))


def article_columns(df: DataFrame) -> DataFrame:
    return df.select(*ARTICLE_COLUMNS)


# --- report ------------------------------------------------------------------------------------


def report(raw: DataFrame, target: int | None = None) -> DataFrame:
    """Load report ``(section, position, name, n)``: totals first, then reasons by frequency.

    Rows after the one that reaches the target are counted in the total but are neither loaded nor
    skipped.
    """
    judged = with_reasons(raw)
    loaded = F.col("reason").isNull()
    if target is not None:
        numbers = numbered(judged.filter(loaded).select("ord"))
        # At most one row: it exists only when the target is reached.
        stop = numbers.filter(F.col("number") == target).agg(F.max("ord").alias("stop"))
        last = F.coalesce(stop.scalar(), F.lit((1 << 63) - 1))
        judged = judged.withColumn("seen", F.col("ord") <= last)
    else:
        judged = judged.withColumn("seen", F.lit(True))
    counts = judged.groupBy("reason", "seen").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("seen")
    totals = counts.agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(seen & loaded, F.col("n"))), F.lit(0)).alias("loaded"),
        F.coalesce(F.sum(F.when(seen & ~loaded, F.col("n"))), F.lit(0)).alias("skipped"),
    ).select(
        F.lit("total").alias("section"),
        F.expr(
            "stack(3, 1, 'total_rows', total_rows, 2, 'loaded', loaded, 3, 'skipped', skipped)"
            " as (position, name, n)"
        ),
    )
    # A handful of distinct reasons: the window below never sees more rows than that.
    by_count = Window.orderBy(F.desc("n"), "name")
    reasons = (
        counts.filter(seen & ~loaded)
        .select(F.col("reason").alias("name"), "n")
        .select(
            F.lit("reason").alias("section"),
            F.row_number().over(by_count).alias("position"),
            "name",
            "n",
        )
    )
    return totals.unionByName(reasons)


# --- upsert ------------------------------------------------------------------------------------


def upsert(stored: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Replace whole documents by ``id``; within ``changes`` the highest ``order`` wins.

    The winning order per id is found by a pre-aggregated ``max`` on narrow rows, so an id that is
    rewritten over and over does not pile up in one task. The stored table is only scanned while the
    changed ids fit a broadcast. ``order`` must be unique per id.
    """
    latest = changes.groupBy("id").agg(F.max(order).alias(order))
    winners = changes.join(latest, ["id", order], "left_semi").drop(order)
    untouched = sized_join(stored, latest.select("id"), ["id"], "left_anti")
    return untouched.unionByName(winners)
