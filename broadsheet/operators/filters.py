"""Filters on category, source and author: any value inside a field, all fields together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import tag_value
from broadsheet.schemas import ALL

Values = str | list[str] | None
MIN_QUERY_CHARS = 2


def as_list(values: Values) -> list[str]:
    """None, blank and ``All`` mean no filter; a string may hold several values, comma separated."""
    if values is None or values == ALL:
        return []
    pieces = values.split(",") if isinstance(values, str) else values
    return [v.strip() for v in pieces if v and v.strip()]


def has_text(text: str | None) -> bool:
    """Queries shorter than two characters do not restrict a text search."""
    return bool(text) and len(text.strip()) >= MIN_QUERY_CHARS


def _any_of(column: str, values: list[str], is_array: bool) -> Column:
    wanted = [tag_value(F.lit(v)) for v in values]
    if is_array:
        return F.arrays_overlap(F.col(column), F.array(*wanted))
    return F.col(column).isin(*wanted)


@dataclass(frozen=True)
class Filters:
    categories: Values = None
    sources: Values = None
    authors: Values = None

    def predicates(self) -> list[Column]:
        fields = [
            ("category_tag", self.categories, False),
            ("source_tags", self.sources, True),
            ("author_tag", self.authors, False),
        ]
        return [_any_of(c, as_list(v), arr) for c, v, arr in fields if as_list(v)]

    def condition(self) -> Column | None:
        parts = self.predicates()
        return reduce(lambda a, b: a & b, parts) if parts else None

    def apply(self, df):
        condition = self.condition()
        return df if condition is None else df.filter(condition)
