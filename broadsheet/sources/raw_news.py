"""Raw news input: the parquet source, and the stand-in built from the ``documents`` table.

Every frame returned here has the six raw columns plus ``ord``, the position of the row in file
order. Later steps (keep the first duplicate, number the accepted rows) need an order that is a
column, because row order is not preserved by shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.operators.skew import sized_join
from broadsheet.schemas import RAW_NEWS

ROWS_PER_FILE_BITS = 40


def file_position(scan: DataFrame) -> DataFrame:
    """Add the place of every row, ``(file_path, row_index)``, to a parquet scan, batch or stream."""
    return scan.select(
        *RAW_NEWS.fieldNames(),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def with_file_order(placed: DataFrame) -> DataFrame:
    """Turn the place of a row into ``ord``: the rank of the file, by path, and the row's index in it.

    The rank is taken over the distinct file names, so that window sees one row per file. The list of
    files is sent to the scan when it is small, as it mostly is, so texts aren't shuffled by file.
    """
    files = placed.select("file_path").distinct()
    rank = F.row_number().over(Window.orderBy("file_path")).cast("long") - 1
    base = F.lit(1 << ROWS_PER_FILE_BITS)
    return (
        sized_join(placed, files.withColumn("file_rank", rank), ["file_path"])
        .withColumn("ord", F.col("file_rank") * base + F.col("row_index"))
        .select("ord", *RAW_NEWS.fieldNames())
    )


def read_raw_news(spark: SparkSession, path: str) -> DataFrame:
    """Read raw news parquet with an explicit schema; only the six columns are read."""
    return with_file_order(file_position(spark.read.schema(RAW_NEWS).parquet(path)))


def raw_news_from_documents(documents: DataFrame) -> DataFrame:
    """The raw news stand-in: one raw row per document, each rule a plain column expression.

    The remainder rules only spread bad values over the rows so that every cleaning branch is
    exercised; no document is left out.
    """
    n = F.col("doc_id")
    sections = [
        "politics", "Business News", "Tech", "US NBA", "Health ", "Editorial",
        "Travel", "world", "None", None, "Unmapped Section", "movies",
    ]
    first_line = F.substring_index("text", "\n", 1)
    day = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("n_chars") % 365).cast("int"))
    return documents.select(
        n.cast("long").alias("ord"),
        F.when(n % 97 == 13, "   ").otherwise(first_line).alias("title"),
        F.when(n % 89 == 5, "not-a-date")
        .otherwise(F.concat(day.cast("string"), F.lit(" 00:00:00")))
        .alias("date"),
        F.when(n % 101 == 7, F.lit(None).cast("string"))
        .when(n % 103 == 9, "None")
        .otherwise(F.col("text"))
        .alias("article"),
        F.when(n % 7 == 0, F.lit(None).cast("string"))
        .when(n % 7 == 1, "None")
        .otherwise(F.concat(F.lit("Author "), (n % 23).cast("string")))
        .alias("author"),
        F.element_at(
            F.array(*[F.lit(s).cast("string") for s in sections]), (n % 12 + 1).cast("int")
        ).alias("section"),
        F.when(n % 11 == 0, F.lit(None).cast("string"))
        .when(n % 11 == 1, "Vice")
        .when(n % 11 == 2, "Economist")
        .when(n % 11 == 3, " Wired ")
        .otherwise(F.col("source"))
        .alias("publication"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_news_from_documents(table(spark, sf_dir, "documents"))
