"""Mixing by weighted fair queueing: virtual finish times, a global order, and a cut at the budget.

Each source has a target, its share of the budget by weight, at most ``passes`` times its size; what a
source can't take is reshared among the others by weight. Documents of a source stand in shuffled
order, by a keyed hash of id and text, and are read over again up to ``passes`` times. A reading of a
document finishes at virtual time (words of its source up to its end) / (target of its source). Readings
are taken in order of finish time while their words stay within the budget.

Running totals are made in two steps, so that no task sees a whole source: totals of hash ranges of
a few thousand rows, added up per source, and running totals within a range. The cut is found by
narrowing an interval of finish times over sums per sub-interval; only a few thousand readings are
sorted together. Rows equal in id and text have one place in the order and are taken or left together.

A null text has size 0; readings without words change nothing and are not taken. Null is a source of
its own, the last one. An empty table gives no row; columns of any name pass. All functions here are built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import WORD, stage_table
from broadsheet.operators.skew import sized_join

WEIGHTS = (1, 2, 3)
PASSES = 3
SEED = "mix"
#: Rows that a hash range or the last interval of finish times is meant to hold.
RANGE_ROWS = 4096
INTERVALS = 1024


def words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place() -> Column:
    """The shuffled place of a document: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def source_key() -> Column:
    """Sources in a form without null that keeps their order, null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``key, source_size, target`` per source of ``key, source_size``; one row per source in one task."""
    # Sources are few beside documents: these windows see one row of each.
    ordered = Window.orderBy("key")
    by_cap = Window.orderBy("fill", "key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()))
        # What a unit of weight gets if all sources with a lower fill are full; it falls from the first source that
        # isn't filled by it on, so the largest such level is the water level.
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open"))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(Window.partitionBy()))
    )
    return rows.select(
        "key", "source_size",
        F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"),
    )


@dataclass
class Mix:
    """``ranked`` has ``doc_id, key, place, size, source_size, target, done`` per row; ``cut`` is the last taken."""

    ranked: DataFrame
    cut: tuple[float, str] | None
    passes: int

    def taken(self, reading: int) -> Column:
        """Whether the reading of this number, from 0, is in the mix."""
        if self.cut is None:
            return F.lit(False)
        finish = F.try_divide(F.col("source_size") * reading + F.col("done"), F.col("target"))
        time, last = F.lit(self.cut[0]), F.lit(self.cut[1])
        inside = (finish < time) | ((finish == time) & (F.col("place") <= last))
        return F.coalesce((F.col("size") > 0) & (F.col("target") > 0) & inside, F.lit(False))

    def readings(self) -> Column:
        return sum((self.taken(i).cast("long") for i in range(self.passes)), F.lit(0).cast("long"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> Mix:
    """Rank all rows of ``docs`` and find the cut."""
    spark = docs.sparkSession
    rows = stage_table(
        spark,
        docs.select("doc_id", source_key().alias("key"), place().alias("place"), words().alias("size")),
        "sizes",
    )
    n = rows.count()
    ranges = 1
    while ranges * RANGE_ROWS < n:
        ranges *= 2
    first = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(first * ranges, 32))
    part = rows.groupBy("key", "range").agg(F.sum("size").alias("sum"))
    part = stage_table(spark, part, "ranges")
    before = part.select(
        "key", "range",
        F.coalesce(
            F.sum("sum").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("before"),
    )
    goals = targets(part.groupBy("key").agg(F.sum("sum").alias("source_size")), weights, passes)
    ranked = (
        rows.withColumn("within", F.sum("size").over(Window.partitionBy("key", "range").orderBy("place")))
        .join(before, ["key", "range"]).join(goals, "key")
        .select(
            "doc_id", "key", "place", "size", "source_size", "target",
            (F.col("before") + F.col("within")).alias("done"),
        )
    )
    ranked = stage_table(spark, ranked, "ranked")
    return Mix(ranked, _cut(ranked, passes), passes)


def _cut(ranked: DataFrame, passes: int) -> tuple[float, str] | None:
    """Finish time and place of the last reading within the budget."""
    finish = F.transform(
        F.sequence(F.lit(0), F.lit(passes - 1)),
        lambda i: F.try_divide(F.col("source_size") * i + F.col("done"), F.col("target")),
    )
    readings = ranked.where("size > 0 AND target > 0").select("place", "size", F.explode(finish).alias("finish"))
    totals = ranked.agg(F.sum("size").alias("budget"), F.max(F.try_divide(F.col("source_size") * passes, F.col("target"))).alias("end")).first()
    budget, low, high, used = totals["budget"], 0.0, totals["end"], 0
    if not budget or high is None:
        return None
    high *= 1.0 + 1e-9
    while True:
        some = readings.where((F.col("finish") >= low) & (F.col("finish") < high))
        width = (high - low) / INTERVALS
        bins = (
            some.groupBy(F.least(F.floor((F.col("finish") - low) / width), F.lit(INTERVALS - 1)).alias("bin"))
            .agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high"))
            .orderBy("bin").collect()  # at most INTERVALS rows
        )
        last = None
        for row in bins:
            if used + row["sum"] > budget:
                break
            used, last = used + row["sum"], row
        else:
            row = None
        if row is None or row["rows"] <= RANGE_ROWS or row["low"] == row["high"]:
            break
        low, high = row["low"], row["high"] * (1.0 + 1e-15) + 1e-300
    inside = Window.orderBy("finish", "place")
    if row is not None:
        edge = readings.where((F.col("finish") >= row["low"]) & (F.col("finish") <= row["high"]))
        edge = edge.groupBy("finish", "place").agg(F.sum("size").alias("size"))
        edge = edge.withColumn("used", F.sum("size").over(inside) + used).where(F.col("used") <= budget)
        found = edge.orderBy(F.desc("finish"), F.desc("place")).first()
        if found is not None:
            return found["finish"], found["place"]
    if last is None:
        below = readings.where(F.col("finish") < low).agg(F.max("finish").alias("high")).first()
        return None if below["high"] is None else (below["high"], "g")
    return last["high"], "g"  # after all hexadecimal digits


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``."""
    mix = plan(docs, weights, passes)
    return mix.ranked.select(
        "doc_id", "size", "source_size", "target", (mix.readings() * F.col("size")).alias("taken")
    )


def apply(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The rows of the mix with all columns of ``docs``; a document read k times stands k times.

    What a source takes in one reading is a prefix of its order, so one place per source and reading
    tells what stays, and the wide rows need no shuffle.
    """
    mix = plan(docs, weights, passes)
    names = [f"_to{i}" for i in range(passes)]
    ends = mix.ranked.groupBy(F.col("key").alias("_key")).agg(
        *(F.max(F.when(mix.taken(i), F.col("place"))).alias(name) for i, name in enumerate(names))
    )
    row = F.struct(*docs.columns).alias("row")  # so that no column of the documents clashes
    wide = docs.select(row, source_key().alias("_key"), place().alias("_place"), words().alias("_size"))
    wide = sized_join(wide, ends, ["_key"])
    times = sum((F.coalesce(F.col("_place") <= F.col(n), F.lit(False)).cast("int") for n in names), F.lit(0))
    wide = wide.withColumn("_times", F.when(F.col("_size") > 0, times).otherwise(0)).where("_times > 0")
    wide = wide.withColumn("_reading", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return wide.select("row.*")


def oracle_sql(weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> str:
    """The same in DuckDB SQL over ``documents``."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
                  md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))) AS place,
                  coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % {len(weights)} {weight} END AS weight,
             source_size * {passes} AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY fill, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT key, source_size,
             least(cap::DOUBLE, (max(level) FILTER (level <= fill) OVER ()) * weight) AS target FROM l),
r AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY key ORDER BY place) AS done
      FROM d JOIN t USING (key)),
v AS (SELECT key, place, size, ((source_size * e + done) / target)::DOUBLE AS finish
      FROM r, (SELECT unnest(range({passes})) AS e) WHERE size > 0 AND target > 0),
c AS (SELECT key, place, finish, sum(size) OVER (ORDER BY finish, place) AS used FROM v),
k AS (SELECT key, place, count(DISTINCT finish) AS n FROM c
      WHERE used <= (SELECT sum(size) FROM d) GROUP BY key, place)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken
FROM r LEFT JOIN k USING (key, place)
"""
