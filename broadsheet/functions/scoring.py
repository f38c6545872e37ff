"""Relevance: simple BM25F over weighted fields (Robertson, Zaragoza and Taylor, 2004).

``tf`` and ``dl`` are the weighted sums of counts and lengths over the searched fields; the document
frequency counts articles with the term in any searched field; totals are taken over the whole corpus,
before filters. Scores are rounded to six places and ordered by the rounded value, articles in ``ord``
order (that is, by id) on ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.schemas import FIELD_WEIGHTS

K1, B = 1.2, 0.75
PLACES = 6


def weighted(prefix: str, fields: list[str]) -> Column:
    return sum((F.col(f"{prefix}_{f}") * FIELD_WEIGHTS[f] for f in fields), F.lit(0))


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def contribution(tf: Column, dl: Column, idf_value: Column, average: float) -> Column:
    average = average or 1.0
    return idf_value * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def rounded(score: Column) -> Column:
    return F.round(score, PLACES)
