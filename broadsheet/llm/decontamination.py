"""Benchmark decontamination by a distributed positional inverted index.

The index of a training set has one posting per occurrence of a test term: ``word, key, at``, where
``key`` is a digest of the text, so that copies share their postings' meaning, and ``at`` the word's place.
Test texts are cut into windows of ``SIZE`` consecutive words; a shorter text is one window.

*Exact phrases.* An occurrence of a window lies on a *diagonal*: place in the text less place in the
item. Every window names its two rarest words, by the index. The list of the rarest, each place less the
word's offset, gives diagonals; the list of the second, adjusted likewise, has to meet them. What is left,
mostly true matches, is intersected with the lists of all other words of the item, and runs of ``SIZE``
consecutive places on a diagonal are occurrences of windows.

*Proximity.* A window is near where its rarest word occurs and all its other words stand within ``REACH``
words of it, in any order. Lists are intersected in the same order, by stretches of the text.

Only DataFrame operators are used. Joins are on a word, or on a text and place, never on an item alone;
small sides are sent to all tasks if their size, measured, allows. Otherwise Spark merges and splits skewed
partitions.

Defined results: null and empty texts have no words and no hits; items without words have no window; items
equal in text are searched once and each counts by its id, where a null id counts as one item and is
written as nothing; copies of a text and repeated rows each get the text's result; empty tables give no
rows, or rows without hits; very long texts are read whole; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stage_table
from broadsheet.llm.neardup import node_key
from broadsheet.operators.skew import fits_broadcast

SIZE = 10
#: Words to either side of the rarest word that count as near.
REACH = 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a text in small letters, and the same before letters are made small, by its ranges: twice as fast as by what it has not.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: str | Column) -> Column:
    """The words of a text as they stand in it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_WORD), F.lit(0))


def small(word: Column) -> Column:
    """A word with A-Z in small letters, other capitals kept. Most words are ASCII, where ``lower`` does that."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _sent(df: DataFrame) -> DataFrame:
    """A written table, marked to be sent to all tasks where its measured size allows."""
    return F.broadcast(df) if fits_broadcast(df) else df


class Index:
    """The postings of a training set for the words of a set of items, as a written table.

    Texts are cut into words once. The first word of every row is written too, whether or not it is a test
    word, with the row's columns ``kept`` and its number of words: ``rows`` has these of all rows.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, kept: tuple[str, ...] = ()):
        spark = docs.sparkSession
        cut = items.select(node_key("text").alias("item"), "text")
        cut = cut.select("item", F.posexplode(words("text")).alias("q", "word"))
        cut = cut.withColumn("word", small(F.col("word")))
        self.items = stage_table(spark, cut.distinct(), "items")
        terms = stage_table(spark, self.items.select("word").distinct(), "terms")
        # Key and words come first: beside the generator they would be worked out for every word.
        row = F.struct(*kept, F.size("words").cast("long").alias("n_words")).alias("row")
        keyed = docs.select(*kept, node_key("text").alias("key"), words("text").alias("words"))
        placed = keyed.select("key", "words", row).select("key", "row", F.posexplode_outer("words").alias("at", "word"))
        placed = placed.withColumn("word", small(F.col("word")))
        first = F.coalesce(F.col("at"), F.lit(0)) == 0  # texts without words have no place
        found = placed.join(_sent(terms.withColumn("term", F.col("word"))), "word", "left")
        found = found.where(first | F.col("term").isNotNull())
        found = found.select("key", "at", F.col("term").alias("word"), F.when(first, F.col("row")).alias("row"))
        found = stage_table(spark, found, "postings")
        self.postings = found.where(F.col("word").isNotNull()).select("word", "key", "at")
        self.rows = found.where(first).select("key", "row.*")
        counts = self.postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counts = terms.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
        self.frequency = stage_table(spark, counts, "frequency")

    def windows(self, size: int = SIZE) -> DataFrame:
        """``item, start, size, ranked``: the words of every window as ``n, q, word``, rarest first."""
        word = F.struct("q", "n", "word")
        whole = self.items.join(self.frequency, "word").groupBy("item").agg(F.array_sort(F.collect_list(word)).alias("w"))
        width = F.least(F.size("w"), F.lit(size))
        starts = F.sequence(F.lit(0), F.size("w") - width)
        cut = whole.select("item", "w", width.alias("size"), F.explode(starts).alias("start"))
        inside = F.slice("w", F.col("start") + 1, F.col("size"))
        ranked = F.array_sort(F.transform(inside, lambda x: F.struct(x["n"].alias("n"), x["q"].alias("q"), x["word"].alias("word"))))
        return cut.select("item", "start", "size", ranked.alias("ranked"))

    def lists(self, chosen: DataFrame) -> DataFrame:
        """``chosen``, which has ``word``, with the postings ``key, at`` of its words."""
        return self.postings.join(_sent(chosen), "word")


def diagonals(index: Index, size: int = SIZE) -> DataFrame:
    """``item, key, d``: the diagonals on which the two rarest words of some window meet."""
    spark = index.postings.sparkSession
    ranked, last = F.col("ranked"), F.least(F.size("ranked"), F.lit(2))
    first, second = ranked[0], F.element_at(ranked, last)
    pairs = index.windows(size).select(
        "item", first["word"].alias("word"), first["q"].alias("q1"), second["word"].alias("second"), second["q"].alias("q2")
    )
    pairs = stage_table(spark, pairs.distinct(), "pairs")
    rarest = index.lists(pairs).select("item", "key", (F.col("at") - F.col("q1")).alias("d"), "q2", F.col("second").alias("word"))
    rarest = rarest.select("item", "key", "d", "word", (F.col("d") + F.col("q2")).alias("at"))
    seconds = index.lists(stage_table(spark, pairs.select(F.col("second").alias("word")).distinct(), "seconds"))
    met = rarest.join(seconds, ["key", "at", "word"], "left_semi")
    return stage_table(spark, met.select("item", "key", "d").distinct(), "diagonals")


def phrases(index: Index, size: int = SIZE) -> DataFrame:
    """``key, item, first, last``: stretches of texts that windows of an item cover, one per diagonal run."""
    spark = index.postings.sparkSession
    met = diagonals(index, size)
    expected = met.join(_sent(index.items), "item").withColumn("at", F.col("d") + F.col("q"))
    keys = stage_table(spark, met.select("key").distinct(), "keys")
    held = index.postings.join(_sent(keys), "key", "left_semi")
    equal = expected.join(held, ["key", "at", "word"], "left_semi").select("item", "key", "d", "q")
    diagonal = Window.partitionBy("item", "key", "d").orderBy("q")
    runs = equal.withColumn("run", F.col("q") - F.row_number().over(diagonal))
    lengths = index.items.groupBy("item").agg(F.least(F.count(F.lit(1)), F.lit(size)).alias("size"))
    runs = runs.groupBy("item", "key", "d", "run").agg(F.min("q").alias("a"), F.max("q").alias("b"))
    return runs.join(lengths, "item").where(F.col("b") - F.col("a") + 1 >= F.col("size")).select(
        "key", "item", (F.col("d") + F.col("a")).alias("first"), (F.col("d") + F.col("b")).alias("last")
    )


def proximity(index: Index, size: int = SIZE, reach: int = REACH) -> DataFrame:
    """``key, item, start, at``: windows all of whose words stand within ``reach`` words of their rarest.

    Texts are cut into stretches of ``reach`` places. A place looks for other words in its own stretch and
    the two beside it, so every join is on a text, a stretch and a word.
    """
    spark = index.postings.sparkSession
    windows = stage_table(spark, index.windows(size), "windows")
    anchor = F.col("ranked")[0]
    anchors = stage_table(spark, windows.select("item", "start", anchor["word"].alias("word")), "anchors")
    places = index.lists(anchors).select("item", "start", "key", "at")
    others = F.array_distinct(F.transform("ranked", lambda x: x["word"]))
    needed = windows.select("item", "start", F.posexplode(others).alias("rank", "word"))
    needed = stage_table(spark, needed.where("rank > 0"), "needed")
    stretch = lambda c: F.floor(F.col(c) / reach)
    beside = F.explode(F.sequence(stretch("at") - 1, stretch("at") + 1)).alias("stretch")
    held = index.postings.select("word", "key", F.col("at").alias("there"), stretch("at").alias("stretch"))

    def near(rows: DataFrame) -> DataFrame:
        """``rows`` of a place and a needed word, once each where the word is near the place."""
        found = rows.select("*", beside).join(held, ["key", "word", "stretch"])
        return found.where(F.abs(F.col("there") - F.col("at")) <= reach).select("item", "start", "key", "at", "word").distinct()

    single = _sent(stage_table(spark, windows.where(F.size(others) == 1).select("item", "start"), "single"))
    alone = places.join(single, ["item", "start"], "left_semi")
    second = places.join(_sent(stage_table(spark, needed.where("rank = 1").drop("rank"), "second")), ["item", "start"])
    second = stage_table(spark, near(second).drop("word"), "near")
    rest = second.join(_sent(needed.drop("rank")), ["item", "start"])
    counts = needed.groupBy("item", "start").agg(F.count(F.lit(1)).alias("n"))
    whole = near(rest).groupBy("item", "start", "key", "at").agg(F.count(F.lit(1)).alias("found"))
    whole = whole.join(counts, ["item", "start"]).where("found = n")
    return whole.select("key", "item", "start", "at").union(alone.select("key", "item", "start", "at"))


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: how many of its words lie in windows of which items.

    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.
    """
    spark = docs.sparkSession
    index = Index(docs, items.select("text"), ("doc_id",))
    found = stage_table(spark, phrases(index, size), "phrases")
    places = found.select("key", F.explode(F.sequence("first", "last")).alias("at")).distinct()
    hits = places.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = items.select(node_key("text").alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"))
    ids = stage_table(spark, ids.distinct(), "ids")
    # At most the items of the benchmark for a text.
    named = found.select("key", "item").distinct().join(ids, "item").groupBy("key").agg(
        F.array_sort(F.collect_set("id")).alias("ids")
    )
    results = stage_table(spark, hits.join(named, "key"), "results")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return index.rows.join(_sent(results), "key", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs."""
    index = Index(docs.select("text"), items.select("text"))
    found = stage_table(docs.sparkSession, phrases(index, size).select("key").distinct(), "contaminated")
    row = docs.select(F.struct(*docs.columns).alias("row"), node_key("text").alias("key"))
    return row.join(_sent(found), "key", "left_anti").select("row.*")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[s + 1:s + {SIZE}] AS win FROM (
    SELECT item_id, w, unnest(range(greatest(len(w) - {SIZE}, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
cuts AS (SELECT row, s, size, w[s + 1:s + size] AS win FROM (
  SELECT row, w, size, unnest(range(len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
found AS MATERIALIZED (SELECT c.row, c.s, c.size, x.item_id FROM cuts c JOIN windows x ON x.win = c.win),
hits AS (SELECT row, count(DISTINCT place) AS n_hit FROM (
  SELECT row, unnest(range(s, s + size)) AS place FROM found) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
  SELECT DISTINCT row, coalesce(item_id::VARCHAR, '') AS id FROM found) GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
  coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, h.row IS NOT NULL AS contaminated
FROM d LEFT JOIN hits h ON h.row = d.row LEFT JOIN named n ON n.row = d.row
"""
