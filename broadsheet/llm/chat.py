"""Chat formatting of reply trees: paths by iterative self-joins, ranked by score, formatted as ChatML.

Messages are nodes with a parent. The paths from all leaves to their roots are made by doubling: with
every round, a table of jumps goes twice as far up, and the known lower parts of the paths are
continued by one self-join, so trees of depth d take about log2 d rounds. A parent that doesn't exist
makes a message a root. Messages on a cycle have no root and belong to no path.

A path is written as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts ``<|`` is
kept from being read as control: between ``<`` and ``|`` one backslash is added to those that stand
there (also if none does), and reading takes one away. In roles a line break is written ``\\n`` and a
backslash twice. The loss mask is a list of spans of the written string: the texts of assistant turns.

Null texts and roles count as empty; rows of one turn stand in order of role and text; very long texts are
kept whole; a conversation is one row of the output, so it is put together in one task; an empty table gives
no row; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stage_table
from broadsheet.operators.skew import top_per_key

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def written(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(_read_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def paths(messages: DataFrame) -> DataFrame:
    """``tree, leaf, node, height`` of every message on a path; ``height`` counts from the leaf, 0.

    ``messages`` has ``tree, node, parent``, one row per tree and node; trees aren't null.
    """
    spark = messages.sparkSession
    nodes = messages.select("tree", "node", "parent")
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    jumps = nodes.join(there, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up")
    )
    jumps = stage_table(spark, jumps, "jumps")
    inner = jumps.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    known = jumps.join(inner, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height")
    )
    known = stage_table(spark, known, "paths")
    total, reach = jumps.count(), 1
    while reach <= total and not jumps.where("up IS NOT NULL").isEmpty():
        # All heights below ``reach`` are known; the table of jumps goes ``reach`` up.
        further = known.join(jumps.where("up IS NOT NULL"), ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("height") + reach).alias("height")
        )
        known = stage_table(spark, known.union(further), "paths")
        beyond = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("over"))
        jumps = stage_table(
            spark, jumps.join(beyond, ["tree", "up"], "left").select("tree", "node", F.col("over").alias("up")), "jumps"
        )
        reach *= 2
    if reach > total:  # only a cycle has jumps that long: its paths have no end
        endless = jumps.where("up IS NOT NULL").select("tree", F.col("node").alias("leaf"))
        known = known.join(endless, ["tree", "leaf"], "left_anti")
    return known


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best paths of every tree: ``tree, leaf, rank, score, turns``.

    ``messages`` has ``tree, node, parent, role, text, score``. A path's score is the sum of its
    messages' scores, null as 0; of equal ones the smaller leaf comes first. ``turns`` is an array of
    role and text in order from the root; null roles and texts count as empty.
    """
    spark = messages.sparkSession
    known = paths(messages)
    scored = known.join(messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    ranked = stage_table(spark, scored.groupBy("tree", "leaf").agg(F.sum("score").alias("score")), "scores")
    chosen = top_per_key(ranked, ["tree"], [F.desc("score"), F.asc("leaf")], branches)
    texts = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = known.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(texts, ["tree", "node"])
    turn = F.struct((-F.col("height")).alias("at"), "role", "text")
    turns = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return chosen.join(turns, ["tree", "leaf"]).select("tree", "leaf", "rank", "score", "turns")


def formatted(chosen: DataFrame) -> DataFrame:
    """``tree, leaf, rank, formatted, loss_starts, loss_ends`` of chosen paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, starts, ends = [], [], []
            for turns in batch.column("turns").to_pylist():
                text, spans = written([(t["role"], t["text"]) for t in turns])
                out.append(text)
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("tree", "leaf", "rank")), pa.array(out, pa.string()),
                    pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                ],
                names=["tree", "leaf", "rank", "formatted", "loss_starts", "loss_ends"],
            )

    kinds = [chosen.schema[c].dataType.simpleString() for c in ("tree", "leaf", "rank")]
    return chosen.select("tree", "leaf", "rank", "turns").mapInArrow(
        run,
        f"tree {kinds[0]}, leaf {kinds[1]}, rank {kinds[2]}, formatted string, loss_starts array<long>, loss_ends array<long>",
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """What can be read from formatted conversations: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            columns = (batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends"))
            for text, starts, ends in zip(*columns):
                turns = read(text)
                masked = "".join(unescape(text[s:e]) for s, e in zip(starts, ends))
                rows["n_turns"].append(len(turns))
                rows["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                rows["loss_chars"].append(len(masked))
                rows["loss_sha256"].append(hashlib.sha256(masked.encode()).hexdigest())
                rows["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *map(pa.array, rows.values())], names=["tree", *rows])

    kind = conversations.schema["tree"].dataType.simpleString()
    return conversations.select("tree", "formatted", "loss_starts", "loss_ends").mapInArrow(
        run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations ``conv_id, turn, role, text`` as trees of one path, in order of turns.

    Rows of one turn stand in order of role and text. Rows without ``conv_id`` are one conversation.
    Assistant text counts as score, so of several branches the one with most to learn would come first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn(
        "node", F.row_number().over(order).cast("long")
    ).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.when(F.col("role") == TRAINED, F.length("text")).otherwise(0).cast("double").alias("score"),
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts consist of control strings."""
    text = f"{END}{START}assistant ok"
    probe = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def digests(conversations: DataFrame) -> DataFrame:
    """Format every conversation and read the result back: one row per ``conv_id``."""
    spark = conversations.sparkSession
    messages = stage_table(spark, as_trees(conversations), "messages")
    rows = read_back(formatted(best_paths(messages)))
    conv_id = F.when(F.col("tree") != "null", F.col("tree")).cast("long")
    return rows.select(conv_id.alias("conv_id"), *rows.columns[1:])


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(head) + 1 + length(body) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
