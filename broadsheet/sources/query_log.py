"""Query tables and event logs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import words
from broadsheet.operators.ingest import numbered
from broadsheet.schemas import ALL
from broadsheet.sources.raw_news import table


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per user turn of ``conversations``, with varied parameters.

    The text is the whole turn; filters, order and page vary with the conversation so that every
    branch is used.
    """
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    n = F.col("conv_id") + F.col("turn")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        "text",
        F.when(n % 5 == 1, "Politics")
        .when(n % 5 == 2, "World, politics ,Business")
        .otherwise(ALL)
        .alias("categories"),
        F.when(n % 7 == 3, "VICE,Wired").when(n % 7 == 4, " Unknown ").otherwise(ALL).alias("sources"),
        F.when(n % 4 == 1, "date_desc")
        .when(n % 4 == 3, "date_asc")
        .otherwise("relevance")
        .alias("sort"),
        F.lit(False).alias("fuzzy"),
        F.when(n % 6 == 5, 3).otherwise(0).cast("int").alias("offset"),
        F.lit(10).cast("int").alias("limit"),
    )


def phrase_log(spark: SparkSession, sf_dir: str, size: int = 3) -> DataFrame:
    """The query log with one request per ``size`` words of a turn, all words in turn, as short requests."""
    turns = query_log(spark, sf_dir).withColumn("words", words(F.col("text")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(size))
    phrases = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, F.lit(size)), " "))
    rows = turns.select("*", F.posexplode(phrases).alias("n", "phrase"))
    return rows.withColumns(
        {"query_id": F.col("query_id") * 1_000_000 + F.col("n"), "text": F.col("phrase")}
    ).drop("words", "n", "phrase")


def typed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every user turn, as typed so far: ``query_id, text``."""
    turns = query_log(spark, sf_dir).select("query_id", F.posexplode(words(F.col("text"))).alias("n", "text"))
    return turns.select((F.col("query_id") * 1_000_000 + F.col("n")).alias("query_id"), "text")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a vector: every request of the log and every row of ``embeddings`` is used.

    Both are numbered; those whose numbers agree modulo the smaller count make one request.
    """
    log = query_log(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    least = max(1, min(log.count(), vectors.count()))
    number = (F.col("number") - 1) % least

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        places = numbered(rows.select(F.col(key).alias("ord"))).select(F.col("ord").alias(key), number.alias("place"))
        return rows.join(places, key)

    both = dealt(log, "query_id").join(dealt(vectors, "vec_id"), "place")
    return both.withColumn("query_id", F.col("query_id") * 1_000_000 + F.col("vec_id")).drop("place", "vec_id")


def lookup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache lookups: one per event, keyed by event type and a group of users."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.md5(
            F.concat(
                F.lower("event_type"), F.lit(":"), (F.col("user_id") % 5).cast("string")
            ).cast("binary")
        ).alias("cache_key"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )
