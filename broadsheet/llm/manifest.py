"""Merkle manifest of a dataset: an append log of tree nodes in postorder, and proofs read out of it.

Every row is a leaf, the hash of its own fields. The leaves of a source, by id, form a tree: ``FAN``
consecutive nodes of a level become one node, the last run may be shorter. The roots of the sources,
null first and by bytes, are the leaves of one more tree, whose root stands for the dataset.

A tree is kept as an *append log*: nodes in the order in which they are completed, that is in postorder.
A node of height h that ends at leaf e is completed after all nodes that end at or before e below it and
all that end before e above it, so its position follows from the sizes of full subtrees alone: the sum
of ``(e + 1) div FAN^l`` for l <= h and ``e div FAN^l`` for l > h, rounded up at the tree's last leaf. Any
node is addressed without an index.

*Builders* are aligned: one gets ``FAN^BLOCK`` consecutive leaves, a whole subtree, and writes its nodes
as they complete. The roots of the subtrees are the leaves of the next round of builders, so no task ever
holds more than a block, whatever a source holds. A *proof* is a leaf's siblings from the bottom up. A
task takes the leaves of a block and the block's stretch of the log, addresses the siblings, and goes on
with the path of the block's own root, which the round above has worked out.

Leaves are placed by a range sort and running totals, so a source with a third of the rows is spread over
many tasks. Defined results: null fields are written as ``-``; rows with a null id come first, rows equal
in id stand in order of their leaf, and repeated rows are leaves of their own; a tree of one leaf is that
leaf; an empty table has no root and no row; very long texts are hashed in place, never cut; other
columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stage_table

FAN = 3
#: Levels that a builder writes: a block has FAN^BLOCK leaves.
BLOCK = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- leaves ------------------------------------------------------------------------------------


def encoded(value: Column) -> Column:
    """A field with its length in front, so that no two rows are written alike; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The hash of a row of documents, 32 bytes; ``instead`` replaces fields."""
    return F.unhex(F.sha2(F.concat(*(encoded(instead.get(name, F.col(name))) for name in FIELDS)), 256))


def tree_key(source: str = "source") -> Column:
    """The tree of a source: null sorts before all others, these by their bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


# --- places ------------------------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, the 0-based rank within ``tree`` by ``order``, and ``n``, the tree's size.

    ``rows`` must be a written table: rows equal in ``order`` are told apart by where they stand in it.
    A range sort cuts trees into parts of even size; a row's place is its rank in the part and the
    running total of the parts before.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    parts = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    parts = stage_table(spark, parts, "parts")
    counts = parts.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    rank = F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order, "_tie")) - 1
    return (
        parts.withColumn("_rank", rank).join(counts, ["tree", "_part"])
        .withColumn("place", F.col("_before") + F.col("_rank")).drop("_part", "_tie", "_rank", "_before")
    )


# --- positions ---------------------------------------------------------------------------------


def position(height: int, at: int, n: int) -> int:
    """Where node ``at`` of a level stands in the log of a tree of ``n`` leaves, counted from 0."""
    end = min((at + 1) * FAN**height, n)
    total, width, level = -1, 1, 0
    while True:
        # Nodes of this level that are complete with leaf ``end``, or, further up, before it.
        if level <= height:
            total += -(-end // width) if end == n else end // width
        else:
            total += (end - 1) // width
        if width >= n and level >= height:
            return total
        width, level = width * FAN, level + 1


def siblings(height: int, at: int, n: int) -> tuple[list[int], list[int]]:
    """The nodes of the same level that the parent has before and after node ``at``."""
    last = -(-n // FAN**height)
    first = at - at % FAN
    return list(range(first, at)), list(range(at + 1, min(first + FAN, last)))


# --- builders ----------------------------------------------------------------------------------

LOG = "tree string, round int, position long, height int, place long, n long, digest binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes above sorted leaves, block by block, as they complete."""
    tree, block, open_runs = None, None, []
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("tree", "round", "place", "n", "digest"))
        for name, number, place, n, digest in zip(*columns):
            if (name, place // FAN**BLOCK) != (tree, block):
                tree, block = name, place // FAN**BLOCK
                open_runs = [[] for _ in range(BLOCK + 1)]
            height, at = 0, place
            while True:
                out.append((name, number, position(height, at, n), height, at, n, digest))
                if height == BLOCK or FAN**height >= n:
                    break
                run = open_runs[height]
                run.append(digest.hex())
                if len(run) < FAN and min((at + 1) * FAN**height, n) < n:
                    break
                digest, height, at = sha256("".join(run).encode()).digest(), height + 1, at // FAN
                run.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(zip(*out), _LOG_TYPES)] if out else [pa.array([], t) for t in _LOG_TYPES],
            names=_LOG_NAMES,
        )


_LOG_NAMES = [c.split()[0] for c in LOG.split(", ")]
_LOG_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def append_log(leaves: DataFrame) -> list[DataFrame]:
    """The log by rounds of builders, over ``tree, place, n, digest``.

    Rows of a round are ``tree, round, position, height, place, n, digest``; ``position`` and ``height``
    count from the leaves of the round, ``n`` is their number. The last round holds the root of every
    tree that reaches it; the others' roots are where their tree ends.
    """
    spark = leaves.sparkSession
    nodes = leaves.select("tree", F.lit(0).alias("round"), "place", "n", "digest")
    logs: list[DataFrame] = []
    while True:
        block = F.expr(f"place div {FAN**BLOCK}")
        aligned = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "place")
        log = stage_table(spark, aligned.drop("block").mapInArrow(_build, LOG), "log")
        logs.append(log)
        above = log.where((F.col("height") == BLOCK) & (F.col("n") > FAN**BLOCK))
        if above.isEmpty():
            return logs
        n = F.ceil(F.col("n") / FAN**BLOCK).cast("long")
        nodes = above.select("tree", (F.col("round") + 1).alias("round"), "place", n.alias("n"), "digest")


def roots(logs: list[DataFrame]) -> DataFrame:
    """``tree, digest``: the last node of every tree."""
    is_root = (F.pow(F.lit(float(FAN)), F.col("height")) >= F.col("n")) & (F.col("place") == 0)
    lowest = F.when(F.col("height") == 0, F.col("n") == 1).otherwise(
        F.pow(F.lit(float(FAN)), F.col("height") - 1) < F.col("n")
    )
    found = [log.where(is_root & lowest).select("tree", "digest") for log in logs]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


# --- proofs ------------------------------------------------------------------------------------


def _fold(digest: bytes, path: list[dict]) -> bytes:
    for step in path:
        digest = sha256((step["before"] + digest.hex() + step["after"]).encode()).digest()
    return digest


PATH_TYPE = "array<struct<before: string, after: string>>"
PATH = f"path {PATH_TYPE}"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _paths(leaves: list[int], n: int, at: dict[int, bytes], above: list[dict]) -> list[list[dict]]:
    """The paths of the leaves of one block, whose stretch of the log is ``at``, by position."""
    known: dict[tuple[int, int], dict] = {}

    def step(height: int, node: int) -> dict:
        if (height, node) not in known:
            sides = siblings(height, node, n)
            known[height, node] = dict(
                zip(("before", "after"), ("".join(at[position(height, x, n)].hex() for x in side) for side in sides))
            )
        return known[height, node]

    height = 0
    while height < BLOCK and FAN**height < n:
        height += 1
    return [[step(h, leaf // FAN**h) for h in range(height)] + above for leaf in leaves]


def paths(leaves: DataFrame, logs: list[DataFrame], beyond: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(rows, paths)`` of the leaves of every block, where ``paths`` lead up to the dataset's root.

    ``leaves`` is ``tree, place, n`` and more, ``beyond`` is ``tree, path``, the path of each tree's root in
    the tree above. Rounds are worked from the top; each hands the paths of its blocks' roots down.
    """
    spark = leaves.sparkSession
    above = beyond.select("tree", F.lit(0).cast("long").alias("block"), "path")
    block = F.expr(f"place div {FAN**BLOCK}")
    for number in range(len(logs) - 1, -1, -1):
        # A node of height h covers FAN^h places of the leaves, so this is the block that it lies in.
        log = logs[number].withColumn("block", F.expr(f"CAST(floor(place * pow({FAN}D, height) / {FAN**BLOCK}) AS LONG)"))
        last = number == 0
        rows = leaves if last else logs[number].where("height = 0").select("tree", "place", "n")
        rows = rows.withColumn("block", block)
        # Roots of trees that end in this round take the path of the tree above, the others that of the
        # block's root in the next round.
        sent = log.select("tree", "block", "position", "digest", F.lit(None).cast(PATH_TYPE).alias("path"))
        handed = [F.lit(-1).cast("long").alias("position"), F.lit(None).cast("binary").alias("digest")]
        sent = sent.unionByName(above.select("tree", "block", *handed, "path"))
        write = emit if last else _block_paths
        kind = schema if last else f"tree string, block long, {PATH}"
        both = rows.groupBy("tree", "block").cogroup(sent.groupBy("tree", "block"))
        done = both.applyInArrow(_extractor(write), kind)
        if last:
            return done
        # Trees that are done below this round keep the path of their root. Written, as the next round's plan may
        # not hold a join beside two uses of its log.
        above = done.unionByName(above.join(logs[number].select("tree").distinct(), "tree", "left_anti"))
        above = stage_table(spark, above, "paths")
    raise AssertionError("a log has a round at least")


def _extractor(write):
    """Reads the paths of a block's leaves out of its stretch of the log, and has them written."""

    def extract(ours: pa.Table, log: pa.Table) -> pa.Table:
        if not ours.num_rows:
            return write(ours, [])
        at, path = {}, []
        for p, d, steps in zip(*(log.column(c).to_pylist() for c in ("position", "digest", "path"))):
            if p < 0:
                path = steps
            else:
                at[p] = d
        n = ours.column("n")[0].as_py()
        return write(ours, _paths(ours.column("place").to_pylist(), n, at, path))

    return extract


def _block_paths(ours: pa.Table, found: list[list[dict]]) -> pa.Table:
    return pa.table({"tree": ours.column("tree").cast(pa.string()), "block": ours.column("place").cast(pa.int64()), "path": pa.array(found, _PATH)})


# --- the dataset -------------------------------------------------------------------------------


class Manifest:
    """The placed leaves of a table, the logs of its sources' trees and of the tree above them."""

    def __init__(self, rows: DataFrame):
        """``rows`` is ``tree, doc_id, digest`` and any payload; it is written, placed and built."""
        spark = rows.sparkSession
        rows = stage_table(spark, rows, "leaves")
        self.leaves = stage_table(spark, placed(rows, ["doc_id", "digest"]), "placed")
        self.logs = append_log(self.leaves)
        self.subroots = stage_table(spark, roots(self.logs), "subroots")
        top = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
        self.sources = stage_table(spark, placed(top, ["source_tree"]), "sources")
        self.top = append_log(self.sources)
        self.root = roots(self.top).select(F.col("digest").alias("root"))

    def source_paths(self) -> DataFrame:
        """``tree, path``: from each source's root to the dataset's."""
        nothing = self.root.select(F.lit("").alias("tree"), F.array().cast(PATH_TYPE).alias("path"))
        found = paths(self.sources, self.top, nothing, _source_paths, f"tree string, {PATH}")
        return stage_table(self.leaves.sparkSession, found, "source-paths")

    def proofs(self, emit, schema: str) -> DataFrame:
        """``emit(leaves, paths)`` per block of leaves, an Arrow table of ``schema``."""
        return paths(self.leaves, self.logs, self.source_paths(), emit, schema)


def _source_paths(ours: pa.Table, found: list[list[dict]]) -> pa.Table:
    return pa.table({"tree": ours.column("source_tree").cast(pa.string()), "path": pa.array(found, _PATH)})


def manifest(docs: DataFrame, **payload: Column) -> Manifest:
    """The manifest of a table of documents; ``payload`` columns travel with the leaves."""
    return Manifest(docs.select(tree_key().alias("tree"), "doc_id", leaf().alias("digest"), *(c.alias(k) for k, c in payload.items())))


def inclusion(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, digest, path`` of every row: its proof, sibling by sibling, from the bottom up."""

    def emit(ours: pa.Table, found: list[list[dict]]) -> pa.Table:
        return pa.table(
            {c: ours.column(c) for c in ("tree", "doc_id", "digest")} | {"path": pa.array(found, _PATH)}
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return manifest(docs).proofs(emit, f"tree string, doc_id {kind}, digest binary, {PATH}")


# --- the audit ---------------------------------------------------------------------------------


def tampered() -> Column:
    """What the stand-in attacker leaves of a text: no line breaks, in rows picked by their id."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(picked, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def audited(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf and proof, and whether the row as it stands now leads to the root.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as hex text. A row with
    a null id is not tampered with.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    built = manifest(docs, now=leaf(text=tampered()))

    def emit(ours: pa.Table, found: list[list[dict]]) -> pa.Table:
        proofs = [sha256("".join(s["before"] + s["after"] for s in path).encode()).hexdigest() for path in found]
        now = ours.column("now").to_pylist() if ours.num_rows else []
        return pa.table(
            {
                "tree": ours.column("tree").cast(pa.string()), "doc_id": ours.column("doc_id"),
                "leaf": pa.array([x.hex() for x in ours.column("digest").to_pylist()], pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array([_fold(d, p).hex() for d, p in zip(now, found)], pa.string()),
            }
        )

    rows = built.proofs(emit, f"tree string, doc_id {kind}, leaf string, proof_sha256 string, folded_root string")
    hexed = lambda c: F.lower(F.hex(c))
    subroots = built.subroots.select("tree", hexed("digest").alias("subroot"))
    root = built.root.select(hexed("root").alias("root"))  # one row, none for an empty table
    return (
        rows.join(subroots, "tree").join(F.broadcast(root))
        .select(
            "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


ORACLE_SQL = r"""
WITH RECURSIVE plain AS (
  SELECT *, row_number() OVER () AS rid, coalesce('=' || source, '') AS tree,
    list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c:
        [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0])), lambda acc, x:
      CASE WHEN x >= 256 THEN xor(acc, x - 256)
           ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295) & 1 AS odd
  FROM documents),
encoded AS (
  SELECT rid, doc_id, tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM plain),
hashed AS (
  SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS now FROM encoded),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes AS (
  SELECT tree, 0 AS h, place, leaf AS d, count(*) OVER (PARTITION BY tree) AS c FROM leaves
  UNION ALL
  SELECT tree, h + 1, place, d, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, h, place // 3 AS place, sha256(string_agg(d, '' ORDER BY place)) AS d
    FROM nodes WHERE c > 1 GROUP BY tree, h, place // 3)),
subroots AS (
  SELECT tree AS source_tree, d, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE c = 1),
top AS (
  SELECT 'top' AS tree, 0 AS h, place, d, count(*) OVER () AS c FROM subroots
  UNION ALL
  SELECT tree, h + 1, place, d, count(*) OVER () FROM (
    SELECT tree, h, place // 3 AS place, sha256(string_agg(d, '' ORDER BY place)) AS d
    FROM top WHERE c > 1 GROUP BY tree, h, place // 3)),
every AS (SELECT 'source' AS kind, * FROM nodes UNION ALL SELECT 'top', * FROM top),
steps AS MATERIALIZED (
  SELECT a.kind, a.tree, a.h, a.place,
    coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before,
    coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM every a JOIN every b ON a.kind = b.kind AND a.tree = b.tree AND a.h = b.h AND a.place // 3 = b.place // 3
  WHERE a.c > 1 GROUP BY ALL),
lower_walk AS (
  SELECT rid, tree, 0 AS h, place, '' AS proof, now AS folded FROM leaves
  UNION ALL
  SELECT w.rid, w.tree, w.h + 1, w.place // 3, w.proof || s.before || s.after, sha256(s.before || w.folded || s.after)
  FROM lower_walk w JOIN steps s ON s.kind = 'source' AND s.tree = w.tree AND s.h = w.h AND s.place = w.place),
upper_walk AS (
  SELECT w.rid, 0 AS h, r.place, w.proof, w.folded
  FROM (SELECT rid, tree, arg_max(proof, h) AS proof, arg_max(folded, h) AS folded FROM lower_walk GROUP BY ALL) w
  JOIN subroots r ON r.source_tree = w.tree
  UNION ALL
  SELECT w.rid, w.h + 1, w.place // 3, w.proof || s.before || s.after, sha256(s.before || w.folded || s.after)
  FROM upper_walk w JOIN steps s ON s.kind = 'top' AND s.h = w.h AND s.place = w.place),
ends AS (SELECT rid, arg_max(proof, h) AS proof, arg_max(folded, h) AS folded FROM upper_walk GROUP BY rid)
SELECT l.doc_id, l.leaf, r.d AS subroot, t.d AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
  e.folded = t.d AS verified
FROM leaves l JOIN ends e USING (rid) JOIN subroots r ON r.source_tree = l.tree, (SELECT d FROM top WHERE c = 1) t
"""
