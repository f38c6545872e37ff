"""WARC fixity: Merkle trees over records and offset ranges; replicas are compared from the root down.

A replica is a table of records ``file, offset, length, digest``. A leaf is the hash of a record's
place and digest. The lowest nodes cover ``RANGE`` bytes of a file's offsets, each hash being that of
the leaves in it in order of offset; a node above covers ``FANOUT`` ranges below it. As a node is known
by its offset range, building a level is one aggregation over groups bounded by range and fan-out,
never over a file. The audit compares the roots of files, goes down only where nodes differ or one is
missing, and compares records in the lowest differing ranges alone.

Rows equal in place and digest count once, so repeated pages are one record; equal ids are told apart by URL
and digest. Null URLs and contents count as empty, and a page of empty content is a record like others; very
long contents are hashed in place. A record that one replica lacks is ``missing``. An empty table has no
record, and no root differs. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stage_table

RANGE, FANOUT = 1 << 16, 16
#: Pages of one archive file, by id, and the most records of a file in all.
FILE_PAGES, FILE_RECORDS = 256, 8192


def record(url: Column, html: Column) -> Column:
    """The text of a WARC response record."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def damage(url: Column, html: Column) -> tuple[Column, Column]:
    """What the stand-in replica does to a page: ``(lost, html as stored)``, by the hash of its URL."""
    mark = F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 2)
    stored = F.when(mark == "00", F.concat(F.lit("?"), F.substring(html, 2, 2147483647))).otherwise(html)
    return mark == "01", stored


def archived(pages: DataFrame) -> DataFrame:
    """The records of pages as laid out in archive files, and the digests of two replicas.

    ``page_id, file, offset, length, digest, copy_digest``. Files hold pages of ``FILE_PAGES`` ids in
    order of id, URL and digest; where ids repeat so often that a file would pass ``FILE_RECORDS``, it
    is split by a hash. Rows that are equal in id and record are one record. The second replica stands in for a
    copy with faults: it is derived from the first by ``damage``.
    """
    url, html = F.col("url"), F.col("html")
    lost, stored = damage(url, html)
    whole = record(url, html)
    rows = pages.select(
        "page_id", "url", F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"),
        F.when(~lost, F.sha2(record(url, stored), 256)).alias("copy_digest"),
    ).distinct()
    rows = stage_table(pages.sparkSession, rows, "records")
    group = F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), F.lit(-1)).cast("long")
    rows = rows.withColumn("group", group)
    sizes = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / FILE_RECORDS).alias("parts"))
    rows = rows.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    file = F.concat_ws("-", F.lit("pages"), F.col("group").cast("string"), F.col("part").cast("string"))
    rows = rows.withColumn("file", file)
    order = Window.partitionBy("file").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.sum("length").over(order) - F.col("length")
    return rows.select("page_id", "file", offset.alias("offset"), "length", "digest", "copy_digest")


def leaves(records: DataFrame) -> DataFrame:
    place = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("digest", F.lit("-")))
    return records.select("file", "offset", F.sha2(place, 256).alias("hash")).distinct()


def levels(*replicas: DataFrame) -> int:
    """Levels above the leaves that it takes until one node covers the largest file of the replicas."""
    last = max((r.agg(F.max("offset")).first()[0] or 0 for r in replicas), default=0)
    return 1 + max(0, math.ceil(math.log(last // RANGE + 1, FANOUT) - 1e-9))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Nodes ``file, at, hash`` by level, leaves first: leaves by offset, others by number of their range."""
    spark = records.sparkSession
    nodes = [stage_table(spark, leaves(records).withColumnRenamed("offset", "at"), "leaves")]
    for level in range(height):
        width = RANGE if level == 0 else FANOUT
        children = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat_ws(":", x["at"], x["hash"]))
        parents = nodes[-1].groupBy("file", F.floor(F.col("at") / width).alias("up")).agg(
            F.sha2(F.array_join(children, "|"), 256).alias("hash")
        )
        nodes.append(stage_table(spark, parents.select("file", F.col("up").alias("at"), "hash"), f"level{level}"))
    return nodes


def audit(left: DataFrame, right: DataFrame) -> tuple[DataFrame, list[int]]:
    """Places where two replicas differ, ``file, at`` by offset, and how many nodes differed per level, roots first."""
    spark = left.sparkSession
    height = levels(left, right)
    ours, theirs = tree(left, height), tree(right, height)
    counts, differing = [], None
    for level in range(height, -1, -1):
        sides = []
        for nodes, name in ((ours[level], "a"), (theirs[level], "b")):
            nodes = nodes.select("file", "at", F.col("hash").alias(name))
            if differing is not None:  # only the children of nodes that differ
                width = RANGE if level == 0 else FANOUT
                up = differing.select(F.col("file").alias("f"), F.col("at").alias("u"))
                nodes = nodes.join(up, (F.col("file") == F.col("f")) & (F.floor(F.col("at") / width) == F.col("u")), "left_semi")
            sides.append(nodes)
        both = sides[0].join(sides[1], ["file", "at"], "full_outer")
        differing = stage_table(spark, both.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "at").distinct(), "differing")
        counts.append(differing.count())
    return differing, counts


def fixity(pages: DataFrame) -> DataFrame:
    """One row per record: ``page_id, file, offset, length, digest, status`` (ok, corrupt or missing)."""
    spark = pages.sparkSession
    rows = stage_table(spark, archived(pages), "archive")
    ours = rows.select("file", "offset", "length", "digest")
    theirs = rows.where("copy_digest IS NOT NULL").select("file", "offset", "length", F.col("copy_digest").alias("digest"))
    found, _ = audit(ours, theirs)
    found = found.select("file", F.col("at").alias("offset"), F.lit(True).alias("differs"))
    held = theirs.select("file", "offset", F.lit(True).alias("held"))
    hits = rows.select("file", "offset").join(found, ["file", "offset"]).join(held, ["file", "offset"], "left").select(
        "file", "offset", F.when(F.col("held"), "corrupt").otherwise("missing").alias("found")
    )
    return rows.join(hits, ["file", "offset"], "left").select(
        "page_id", "file", "offset", "length", "digest", F.coalesce("found", F.lit("ok")).alias("status")
    )


ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, substr(md5(coalesce(url, '')), 1, 2) AS mark, url, html FROM pages),
r AS (SELECT DISTINCT page_id, url, mark,
             strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
                    || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || repeat(chr(13) || chr(10), 2) || h || repeat(chr(13) || chr(10), 2)) AS length,
             sha256('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
                    || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || repeat(chr(13) || chr(10), 2) || h || repeat(chr(13) || chr(10), 2)) AS digest,
             (mark = '00' AND html IS NOT NULL AND substr(h, 1, 1) <> '?') AS changed FROM p),
f AS (SELECT *, 'pages-' || coalesce(floor(page_id / {FILE_PAGES})::BIGINT, -1) || '-0' AS file FROM r)
SELECT page_id, file, (sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset",
       length::BIGINT AS length, digest,
       CASE WHEN mark = '01' THEN 'missing' WHEN changed THEN 'corrupt' ELSE 'ok' END AS status
FROM f
"""
