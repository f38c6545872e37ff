"""A searchable corpus: the article table and what is derived from it, each part built on first use."""

from __future__ import annotations

import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import tag_array_values, tag_value, tag_values
from broadsheet.operators import ingest
from broadsheet.operators import vectors as vector_ops
from broadsheet.operators import suggest
from broadsheet.plans import textindex
from broadsheet.schemas import FIELD_WEIGHTS, SEARCH_FIELDS
from broadsheet.sources.raw_news import raw_news, table
from broadsheet.sources.store import Store

#: Bytes of text per bucket. The task that makes a bucket's postings holds and sorts some 55 bytes for each.
BYTES_PER_BUCKET = 16 * 1024 * 1024
# Sort and partition columns of the tables bucketed by ``ord``.
BUCKETED = {
    "articles": (("ord",), ()),
    "docs": (("ord",), ()),
    "postings": (("term",), ("head",)),
    "vectors": (("ord",), ()),
}
TABLES = [*BUCKETED, "term_stats", "term_blocks", "suggestions", "completions", "edit_keys"]
LAYOUT = "name string, columns string, buckets int"

_open: dict[tuple[str, str], "Corpus"] = {}
_lock = threading.RLock()


class built(cached_property):
    """A table built on first use; callers in other threads wait for it instead of building again."""

    def __get__(self, instance, owner=None):
        if instance is None:
            return self
        with _lock:
            return super().__get__(instance, owner)


def bucket_count(spark: SparkSession, df: DataFrame) -> int:
    """Buckets for raw news of this size, at least one wave of tasks. The text is measured, in one scan, as
    files tell little about it."""
    size = df.agg(F.sum(F.octet_length("article")).alias("b")).first()["b"] or 0
    floor = spark.sparkContext.defaultParallelism
    ceiling = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return max(1, min(max(floor, -(-size // BYTES_PER_BUCKET)), ceiling))


def narrow(articles: DataFrame) -> DataFrame:
    """The columns of ``docs``."""
    return articles.select(
        "ord",
        "id",
        "category",
        "source",
        "author",
        tag_value(F.col("category")).alias("category_tag"),
        tag_values(F.col("source")).alias("source_tags"),
        tag_value(F.col("author")).alias("author_tag"),
        tag_array_values(F.col("tags")).alias("tag_values"),
        "published_ts",
        "word_count",
    )


def directed(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The columns of ``vectors``, for ``(ord, vector)``. A null or zero vector has no direction."""
    return docs.join(vectors, "ord").select(
        "ord", "id", "vector", vector_ops.norm(F.col("vector")).alias("norm"),
        "category_tag", "source_tags",
    ).where(F.col("norm") > 0)


class Corpus:
    """Tables of one article collection.

    ``raw`` is raw news with ``ord``; ``vectors`` is ``(ord, vector)`` or None. Everything is keyed by
    ``ord`` inside the engine; it has the same order as ``id``.
    """

    def __init__(
        self,
        store: Store,
        raw: DataFrame,
        vectors: DataFrame | None = None,
        buckets: int | None = None,
    ):
        self.store = store
        self.spark = store.spark
        self._raw = raw
        self._raw_vectors = vectors
        self.buckets = buckets or bucket_count(self.spark, raw)

    @built
    def articles(self) -> DataFrame:
        """Article columns plus ``ord``."""
        rows = ingest.articles(self._raw, partitions=self.buckets)
        return self.store.write_bucketed("articles", rows, self.buckets)

    @built
    def docs(self) -> DataFrame:
        """The narrow columns of an article: filters, facets and dates, no text."""
        return self.store.write_bucketed("docs", narrow(self.articles), self.buckets)

    @built
    def postings(self) -> DataFrame:
        return self.store.write_bucketed(
            "postings",
            textindex.postings(self.articles),
            self.buckets,
            sort=("term",),
            partition_by=("head",),
        )

    @built
    def term_stats(self) -> DataFrame:
        stats = textindex.term_stats(self.postings)
        return self.store.write("term_stats", stats.repartitionByRange("term").sortWithinPartitions("term"))

    @built
    def term_blocks(self) -> DataFrame:
        blocks = textindex.term_blocks(self.postings, self.buckets, self.average_length(SEARCH_FIELDS))
        return self.store.write("term_blocks", blocks.repartitionByRange("term").sortWithinPartitions("term"))

    @built
    def sketches(self) -> DataFrame:
        """``(category_tag, sketch)``: the distinct terms of a category as a sketch that merges with others."""
        rows = self.postings.select("ord", "term").join(self.docs.select("ord", "category_tag"), "ord")
        sketch = F.hll_sketch_agg("term", F.lit(textindex.SKETCH_BITS)).alias("sketch")
        return self.store.write("sketches", rows.groupBy("category_tag").agg(sketch))

    @built
    def totals(self) -> dict[str, int]:
        """Article count and field lengths: one row, read to the driver once."""
        return {"n": self.docs.count(), **textindex.field_totals(self.postings).first().asDict()}

    @built
    def vectors(self) -> DataFrame:
        """``(ord, id, vector, norm, category_tag, source_tags)`` of the articles that have a vector.

        A null or zero vector has no direction: its article is nobody's neighbour.
        """
        if self._raw_vectors is None:
            raise ValueError("this corpus has no vectors")
        return self.store.write_bucketed("vectors", directed(self.docs, self._raw_vectors), self.buckets)

    @built
    def suggestions(self) -> DataFrame:
        return self.store.write("suggestions", suggest.dictionary(self.articles))

    @built
    def edit_keys(self) -> DataFrame:
        """Segment keys of the vocabulary, sorted, so that near terms of a word are a lookup."""
        keys = suggest.edit_keys(self.term_stats.select("term").distinct())
        return self.store.write("edit_keys", keys.repartitionByRange("key").sortWithinPartitions("key"))

    @built
    def completions(self) -> DataFrame:
        """The completion trie, sorted by key, so that a lookup skips the row groups of other keys."""
        nodes = suggest.completions(self.suggestions)
        return self.store.write("completions", nodes.repartitionByRange("key").sortWithinPartitions("key"))

    def save_layout(self) -> None:
        """Build every table and note how they are laid out, so that another session can attach."""
        tables = {name: getattr(self, name) for name in TABLES if name != "vectors" or self.has_vectors}
        rows = [
            (name, ", ".join(f"{c} {t}" for c, t in df.drop("head").dtypes), self.buckets)
            for name, df in tables.items()
        ]
        self.store.write("layout", self.spark.createDataFrame(rows, LAYOUT).coalesce(1))

    @classmethod
    def attach(cls, spark: SparkSession, path: str) -> "Corpus":
        """A corpus that an earlier session built and saved in ``path``."""
        store = Store(spark, path)
        layout = spark.read.schema(LAYOUT).parquet(store.location("layout")).collect()
        out = cls.__new__(cls)
        out.store, out.spark, out._raw, out._raw_vectors = store, spark, None, None
        out.buckets = layout[0]["buckets"]
        for name, columns, buckets in layout:
            if name not in BUCKETED:
                table_df = spark.read.schema(columns).parquet(store.location(name))
            else:
                sort, parts = BUCKETED[name]
                ddl = columns + "".join(f", {p} int" for p in parts)
                table_df = store.attach_bucketed(name, ddl, buckets, sort=sort, partition_by=parts)
            out.__dict__[name] = table_df
        return out

    @property
    def has_vectors(self) -> bool:
        return self._raw_vectors is not None or "vectors" in self.__dict__

    def average_length(self, fields: list[str]) -> float:
        total = sum(FIELD_WEIGHTS[f] * self.totals[f"len_{f}"] for f in fields)
        return total / self.totals["n"] if self.totals["n"] else 0.0

    def postings_for(self, fields: list[str]) -> DataFrame:
        """Postings that can match in ``fields``; title and summary need the head part only."""
        if set(fields) <= set(SEARCH_FIELDS):
            return self.postings.filter(F.col("head") == 1)
        return self.postings


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of one input folder; built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _lock:
        if key not in _open:
            vectors = table(spark, sf_dir, "embeddings").select(
                F.col("vec_id").alias("ord"), F.col("embedding").alias("vector")
            )
            _open[key] = Corpus(Store.for_input(spark, sf_dir), raw_news(spark, sf_dir), vectors)
        return _open[key]
