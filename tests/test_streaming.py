import datetime as dt

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import cache, ingest
from broadsheet.schemas import ARTICLE_COLUMNS, RAW_NEWS
from broadsheet.sources.raw_news import raw_news, read_raw_news
from broadsheet.streaming.cache import cache_hits_stream
from broadsheet.streaming.ingest import StreamIngest


def write_files(spark, sf_dir, folder, parts):
    """Raw news cut into ``parts`` files whose path order and age order follow ``ord``."""
    raw = raw_news(spark, sf_dir).withColumn("part", F.floor(F.col("ord") * parts / 200).cast("int"))
    for part in range(parts):
        rows = raw.filter(F.col("part") == part).orderBy("ord").select(*RAW_NEWS.fieldNames())
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/p{part}")


def test_stream_ingest_equals_batch(spark, sf_dir, tmp_path):
    write_files(spark, sf_dir, str(tmp_path / "raw"), 4)
    job = StreamIngest(spark, str(tmp_path / "out"))
    job.start(str(tmp_path / "raw/*"), str(tmp_path / "ckpt"), max_files=1).awaitTermination(120)
    batch = ingest.articles(read_raw_news(spark, str(tmp_path / "raw/*"))).select(*ARTICLE_COLUMNS)
    got, want = sorted(job.articles().collect()), sorted(batch.collect())
    assert len(got) == 180
    assert got == want


def test_stream_batch_runs_again_without_change(spark, sf_dir, tmp_path):
    write_files(spark, sf_dir, str(tmp_path / "raw"), 2)
    job = StreamIngest(spark, str(tmp_path / "out"))
    job.start(str(tmp_path / "raw/*"), str(tmp_path / "ckpt"), max_files=1).awaitTermination(120)
    before = sorted(job.articles().collect())
    from broadsheet.sources.raw_news import file_position

    again = file_position(spark.read.schema(RAW_NEWS).parquet(str(tmp_path / "raw/p1")))
    job.load(again, 1)
    assert sorted(job.articles().collect()) == before


@pytest.mark.parametrize("files", [1, 5])
def test_stream_hits_equal_batch(spark, tmp_path, files):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, f"k{i % 3}", start + dt.timedelta(seconds=(i * 37) // 10, microseconds=i))
        for i in range(600)
    ]
    log = spark.createDataFrame(rows, "event_id long, cache_key string, ts timestamp")
    step = len(rows) // files
    for n in range(files):
        part = log.filter((F.col("event_id") >= n * step) & (F.col("event_id") < (n + 1) * step))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
    name = f"hits_{files}"
    query = (
        cache_hits_stream(stream.parquet(str(tmp_path / "log")), 60, "1 hour")
        .writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(r.event_id, r.hit) for r in spark.table(name).collect()}
    want = {(r.event_id, r.hit) for r in cache.cache_hits(log, 60).collect()}
    assert got == want
    assert 0 < sum(not hit for _, hit in got) < len(rows)
