"""File-stream ingest: the batch rules, applied to every micro-batch against what is stored.

Each batch writes its own folders and reads only those of earlier batches, so a batch that runs again
after a failure writes the same rows to the same place.

* ``accepted/batch_id=n``: title, date key, position and article number of the rows that were loaded
* ``articles/batch_id=n``: the articles
* ``loads/batch_id=n``: one row with the number of loaded articles, written last

``StreamIndex`` takes a stream of changed articles into a live index, one generation per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.operators import ingest
from broadsheet.operators.skew import sized_join
from broadsheet.plans.generations import LiveCorpus
from broadsheet.schemas import ARTICLE, ARTICLE_COLUMNS, RAW_NEWS
from broadsheet.sources.raw_news import file_position, with_file_order

ACCEPTED = "title string, date_key string, ord long, number long, batch_id long"
LOADS = "loaded long, batch_id long"
NULL_DATE = "\x00"


def date_key() -> Column:
    """Null dates count as equal to each other, as they do in the batch job."""
    return F.coalesce("date", F.lit(NULL_DATE))


class StreamIngest:
    """Ingest into the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch_id={batch_id}"

    def _earlier(self, name: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}")
        return stored.parquet(f"{self.path}/{name}").filter(F.col("batch_id") < batch_id)

    @staticmethod
    def _days(firsts: DataFrame) -> Column:
        """The dates a batch can repeat, as constants: news arrives by date, so the statistics of
        the stored files rule out most of them. Values that don't look like a day take no part in the
        range; stored ones of that kind are always read."""
        is_day = F.col("date_key").rlike(r"^\d{4}-\d{2}-\d{2}")
        dated = F.when(is_day, F.col("date_key"))
        span = firsts.agg(F.min(dated).alias("low"), F.max(dated).alias("high")).first()
        undated = ~is_day
        if span["low"] is None:
            return undated
        return undated | F.col("date_key").between(span["low"], span["high"])

    def load(self, placed: DataFrame, batch_id: int) -> None:
        """Clean, de-duplicate against stored keys, number and write one micro-batch."""
        raw = with_file_order(placed)
        firsts = (
            raw.filter(ingest.reject_reason().isNull())
            .groupBy("title", date_key().alias("date_key"))
            .agg(F.min("ord").alias("ord"))
            .persist()
        )
        stored = self._earlier("accepted", ACCEPTED, batch_id).filter(self._days(firsts))
        stored = stored.select("title", "date_key")
        # The stored keys are the big side and are only scanned; the batch is sent to them.
        seen = sized_join(
            stored, firsts.select("title", "date_key"), ["title", "date_key"], "left_semi"
        ).distinct()
        new = firsts.join(seen, ["title", "date_key"], "left_anti")
        done = self._earlier("loads", LOADS, batch_id).agg(F.sum("loaded").alias("n")).first()["n"]
        numbers = ingest.numbered(new.select("ord"), start=int(done or 0))
        accepted = self._folder("accepted", batch_id)
        new.join(numbers, "ord").write.mode("overwrite").parquet(accepted)
        kept = self.spark.read.schema("ord long, number long").parquet(accepted)
        articles = ingest.transform(raw.join(kept, "ord")).select(*ARTICLE_COLUMNS)
        articles.write.mode("overwrite").parquet(self._folder("articles", batch_id))
        loaded = kept.agg(F.count(F.lit(1)).alias("loaded"))
        loaded.write.mode("overwrite").parquet(self._folder("loads", batch_id))
        firsts.unpersist()

    def start(self, input_path: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
        """Load all files that are there, ``max_files`` per micro-batch, then stop."""
        source = (
            self.spark.readStream.schema(RAW_NEWS)
            .option("maxFilesPerTrigger", max_files)
            .parquet(input_path)
        )
        return (
            file_position(source)
            .writeStream.foreachBatch(self.load)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def articles(self) -> DataFrame:
        return self.spark.read.schema(ARTICLE).parquet(f"{self.path}/articles").select(*ARTICLE_COLUMNS)


class StreamIndex:
    """Whole articles from files into a live index: searchable as soon as their batch is done.

    A batch that runs again after a failure finds its number in the index's state and changes nothing.
    Generations are merged into one every ``compact_every`` batches.
    """

    def __init__(self, live: LiveCorpus, compact_every: int = 8):
        self.live, self.compact_every = live, compact_every

    def load(self, changes: DataFrame, batch_id: int) -> None:
        """Within a batch the article of the last file, by path, and the last row in it wins."""
        placed = changes.select(*ARTICLE_COLUMNS, F.struct("file_path", "row_index").alias("place"))
        self.live.upsert(placed, "place", batch_id)
        if len(self.live.state["generations"]) >= self.compact_every:
            self.live.compact()

    def start(self, input_path: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
        source = self.live.spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", max_files)
        return (
            source.parquet(input_path)
            .select("*", "_metadata.file_path", "_metadata.row_index")
            .writeStream.foreachBatch(self.load)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
