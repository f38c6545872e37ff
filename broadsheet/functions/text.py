"""Text expressions. All of them are built-in column functions and stay in the JVM.

Search semantics fixed here:

* a token is a run of letters or digits of the lower-cased text; no stemming, no stop words, and the
  same function for queries and documents;
* tag values are split on commas, trimmed and lower-cased before they are compared;
* a snippet is the window of ``length`` words holding the most query words, the earliest on ties.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Every character Python counts as white space. As a regular expression class this is Unicode white
# space plus four control characters; the short class is several times faster to match than a list.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
BLANK_CLASS = r"\s\x1c-\x1f"
NON_BLANK_RUN = rf"(?U)[^{BLANK_CLASS}]+"
TOKEN = r"[\p{L}\p{N}]+"
MARK_OPEN, MARK_CLOSE = "<mark>", "</mark>"


def strip(c: Column) -> Column:
    """Remove white space at both ends, line breaks and wide blanks included."""
    return F.btrim(c, F.lit(BLANKS))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NON_BLANK_RUN))


def has_words(c: Column, n: int) -> Column:
    """Are there ``n`` words or more? Stops at the n-th word, so long texts cost no more than short."""
    word, gap = f"[^{BLANK_CLASS}]", f"[{BLANK_CLASS}]"
    return c.rlike(rf"(?U)\A{gap}*+(?:{word}++{gap}++){{{n - 1}}}{word}")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NON_BLANK_RUN), F.lit(0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def literal_tokens(spark: SparkSession, text: str) -> list[str]:
    """Distinct tokens of one query text, in order of appearance.

    Runs the same expression as documents do; on a constant it folds to a local row, without a job.
    """
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(text))).alias("t")).first()
    return list(row["t"])


def tag_value(c: Column) -> Column:
    return F.lower(strip(c))


def tag_values(c: Column) -> Column:
    """Normalised values of one stored tag string: split on commas, no blanks, no repeats."""
    pieces = F.transform(F.split(c, ","), tag_value)
    return F.array_distinct(F.filter(pieces, lambda x: x != ""))


def tag_array_values(c: Column) -> Column:
    """Normalised values of an array of stored tag strings."""
    return F.array_distinct(F.flatten(F.transform(c, tag_values)))


def list_parameter(c: Column) -> Column:
    """``"a, b"`` to a normalised array; null, blank and ``All`` mean no filter (empty array)."""
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (c == "All"), none).otherwise(tag_values(c))


def is_near(token: Column, query_tokens: Column, distance: int = 0) -> Column:
    """Is a token one of the query's, or, with a distance, within so many edits of one of them?"""
    if not distance:
        return F.array_contains(query_tokens, token)
    return F.exists(
        query_tokens,
        lambda w: (F.abs(F.length(token) - F.length(w)) <= distance) & (F.levenshtein(token, w, distance) >= 0),
    )


def highlight(c: Column, query_tokens: Column, distance: int = 0) -> Column:
    """Wrap every word of ``c`` that matches a query token in mark tags.

    The text is split into alternating runs of word and non-word characters and joined again, so
    nothing but the tags is added.
    """
    runs = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    marked = F.transform(
        runs,
        lambda r: F.when(
            is_near(F.lower(r), query_tokens, distance) & (F.regexp_count(r, F.lit(TOKEN)) > 0 if distance else F.lit(True)),
            F.concat(F.lit(MARK_OPEN), r, F.lit(MARK_CLOSE)),
        ).otherwise(r),
    )
    return F.array_join(marked, "")


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that lambdas inside ``body`` do not evaluate it again
    for every element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _hits(all_words: Column, query_tokens: Column, distance: int = 0) -> Column:
    def hit(w: Column) -> Column:
        if not distance:
            return F.arrays_overlap(tokens(w), query_tokens)
        return F.exists(tokens(w), lambda t: is_near(t, query_tokens, distance))

    return F.transform(all_words, lambda w: F.when(hit(w), 1).otherwise(0))


def _best_start(hits: Column, length: int) -> Column:
    """Start of the window with the most hits, the earliest on ties, by one sliding total."""
    first = F.aggregate(F.slice(hits, 1, length), F.lit(0), lambda total, h: total + h)
    begin = F.struct(first.alias("total"), first.alias("best"), F.lit(0).alias("start"))

    def slide(acc: Column, s: Column) -> Column:
        total = acc["total"] + hits[s + (length - 1)] - hits[s - 1]
        better = total > acc["best"]
        return F.struct(
            total.alias("total"),
            F.when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, s).otherwise(acc["start"]).alias("start"),
        )

    starts = F.when(
        F.size(hits) > length, F.sequence(F.lit(1), F.size(hits) - length)
    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, begin, slide, lambda acc: acc["start"])


def snippet(c: Column, query_tokens: Column, length: int = 50, distance: int = 0) -> Column:
    """The best window of ``length`` words; a text that is not longer comes back unchanged."""

    def cut(ws: Column) -> Column:
        start = _let(_hits(ws, query_tokens, distance), lambda hits: _best_start(hits, length))
        window = F.array_join(F.slice(ws, start + 1, length), " ")
        return F.when(F.size(ws) > length, window)

    return F.coalesce(_let(words(c), cut), c)
