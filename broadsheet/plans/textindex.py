"""The inverted index as tables.

* ``postings``: one row per (term, article) with the term's count in each text field and the length
  of each field. Bucketed by ``ord`` and sorted by ``term`` inside a bucket: a search reads only the
  row groups that hold its terms, and everything about one article sits in one bucket, so matching
  and scoring need no shuffle. A word found in every second article is spread over all buckets.
  ``head`` = 1 marks rows whose term occurs in title or summary; it is a partition column, so the
  default search does not read the postings of the bodies.
* ``term_stats``: per term and set of fields, the number of articles. Summing the sets that touch the
  searched fields gives the exact document frequency for any choice of fields.
* totals: article count and total length of each field, one row.
* ``term_blocks``: per term and bucket of articles, the largest saturated count that an article of the
  bucket has in title and summary, null where it only occurs elsewhere. It tells which buckets hold a rare
  word, and, times the word's weight, the most that a bucket can add to a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import scoring
from broadsheet.functions.text import tokens
from broadsheet.schemas import FIELD_BITS, SEARCH_FIELDS, TEXT_FIELDS
from broadsheet.sources.store import bucket_of

#: Sketches of distinct terms have 2^12 registers: a standard error of 1.04 / 2^6, about 1.6 %.
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def _tagged(field: str, bit: int) -> Column:
    return F.transform(F.col(field), lambda t: F.struct(t.alias("term"), F.lit(bit).alias("bit")))


def postings(articles: DataFrame) -> DataFrame:
    """Postings of all articles.

    Grouping by (ord, term) on a table bucketed by ``ord`` runs inside the bucket.
    """
    tokenised = articles.select("ord", *[tokens(F.col(f)).alias(f) for f in TEXT_FIELDS])
    lengths = [F.size(f).alias(f"len_{f}") for f in TEXT_FIELDS]
    tagged = F.flatten(F.array(*[_tagged(f, bit) for f, bit in FIELD_BITS.items()]))
    rows = tokenised.select("ord", *lengths, F.explode(tagged).alias("t")).select(
        "ord", *[f"len_{f}" for f in TEXT_FIELDS], "t.term", "t.bit"
    )
    counted = rows.groupBy("ord", "term", *[f"len_{f}" for f in TEXT_FIELDS]).agg(
        *[
            F.count(F.when(F.col("bit") == bit, 1)).cast("int").alias(f"tf_{f}")
            for f, bit in FIELD_BITS.items()
        ]
    )
    in_head = sum((F.col(f"tf_{f}") for f in SEARCH_FIELDS), F.lit(0)) > 0
    return counted.select(
        "term",
        "ord",
        *[f"tf_{f}" for f in TEXT_FIELDS],
        *[f"len_{f}" for f in TEXT_FIELDS],
        F.when(in_head, 1).otherwise(0).alias("head"),
    )


def term_stats(postings_table: DataFrame) -> DataFrame:
    """``(term, mask, n)``: articles in which the term occurs in exactly the fields of ``mask``."""
    mask = sum(
        (F.when(F.col(f"tf_{f}") > 0, bit).otherwise(0) for f, bit in FIELD_BITS.items()), F.lit(0)
    )
    return postings_table.groupBy("term", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def term_blocks(postings_table: DataFrame, buckets: int, average: float) -> DataFrame:
    """``(term, bucket, most)``. A bucket is read by one task, so only one row per term and bucket is shuffled."""
    tf, dl = scoring.weighted("tf", SEARCH_FIELDS), scoring.weighted("len", SEARCH_FIELDS)
    part = scoring.contribution(tf, dl, F.lit(1.0), average)
    return postings_table.groupBy("term", bucket_of("ord", buckets).alias("bucket")).agg(
        F.max(F.when(F.col("head") == 1, part)).alias("most")
    )


def field_mask(fields: list[str]) -> int:
    unknown = set(fields) - set(TEXT_FIELDS)
    if unknown:
        raise ValueError(f"not text fields: {sorted(unknown)}")
    return sum(FIELD_BITS[f] for f in fields)


def in_fields(fields: list[str]) -> Column:
    return F.col("mask").bitwiseAND(field_mask(fields)) > 0


def document_frequency(stats: DataFrame, fields: list[str]) -> DataFrame:
    """``(term, df)`` over the articles that hold the term in any of ``fields``."""
    return stats.filter(in_fields(fields)).groupBy("term").agg(F.sum("n").alias("df"))


def field_totals(postings_table: DataFrame) -> DataFrame:
    """One row: the token count of each text field over the whole corpus.

    The counts of all postings add up to the lengths, so no text is read again.
    """
    return postings_table.agg(
        *[F.coalesce(F.sum(f"tf_{f}"), F.lit(0)).cast("long").alias(f"len_{f}") for f in TEXT_FIELDS]
    )


def posting_list(postings_table: DataFrame) -> DataFrame:
    """Postings in long form: ``(term, field, ord, tf)``, one row per field that holds the term."""
    pairs = ", ".join(f"'{f}', tf_{f}" for f in TEXT_FIELDS)
    long = postings_table.select(
        "term", "ord", F.expr(f"stack({len(TEXT_FIELDS)}, {pairs}) as (field, tf)")
    )
    return long.filter(F.col("tf") > 0)


def field_lengths(articles: DataFrame) -> DataFrame:
    """``(id, field, len)`` for every article and text field."""
    pairs = ", ".join(f"'{f}', len_{f}" for f in TEXT_FIELDS)
    lengths = articles.select("id", *[F.size(tokens(F.col(f))).alias(f"len_{f}") for f in TEXT_FIELDS])
    return lengths.select("id", F.expr(f"stack({len(TEXT_FIELDS)}, {pairs}) as (field, len)"))
