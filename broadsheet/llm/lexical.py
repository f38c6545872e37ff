"""Ranked lexical search: term at a time over an inverted index, with a limited set of accumulators.

The index is a table of *segments*, runs of documents small enough for a task. A segment has one row per
term with the numbers of the documents that hold it and how often, and one row (term -1) with the ids and
lengths of its documents. Document frequencies, N and L are aggregates over the index.

A segment is searched item by item. The item's terms are taken rarest first, each adding its part to the
accumulators of the documents in its list. A term's *bound* is its largest part in the segment. Once the
bounds of the terms that are left add up to less than the k-th best partial score, or the k-th best score
of the segments before, a document without an accumulator can't come among the first k any more: no
accumulator is made from there on, and the ones that exist are updated to their exact scores. A task keeps
k documents per item over all its segments, and only those are shuffled.

Items are handled in blocks of at most ``BLOCK_TERMS`` terms, which bounds what is sent to the tasks; the
blocks follow one another. A word is known by a 64-bit hash and its length in bytes.

Defined results: null and empty texts have no terms, as documents and as items; an item without terms, or
without a document above score 0, has no row; equal scores go by id, null ids last; repeated rows of
documents are documents of their own, rows of items equal in id and text are one item; empty tables give no
row; very long texts are read whole, in pieces; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import chunks, span_hashes, stage_table
from broadsheet.operators.skew import top_per_key

K = 10
#: A segment is closed at so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1 << 20
#: Distinct terms of items that are sent to the tasks at once.
BLOCK_TERMS = 100_000
#: Terms of a text that has been put in small letters; the same bytes begin and end a term in UTF-8.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENTS = -1

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x41:0x5B] += 32
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and text number of every term; terms don't cross texts."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_TERM[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


# --- items -------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """The terms of a block of items, by hash, with their lengths in bytes."""

    hashes: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> "Vocabulary":
        hashes, sizes = [], []
        for _, _, data, offsets in chunks(pa.array(words, pa.string())):
            hashes.append(span_hashes(data, offsets[:-1], offsets[1:]))
            sizes.append(np.diff(offsets))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        if (hashes[order][1:] == hashes[order][:-1]).any():
            raise ValueError("two terms of the items have one hash")
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return cls(hashes[order], sizes[order], order.astype(np.int64))

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and the numbers of those."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = (self.hashes[at] == hashes) & (self.sizes[at] == sizes)
        return found, self.numbers[at[found]]


@dataclass
class Block:
    """A block of items: each a list of (term number, repeats)."""

    words: list[str]
    items: list[tuple]
    terms: list[list[tuple[int, int]]]


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """Items dealt into blocks of about ``most`` terms at most, read to the driver one after another."""
    rows = items.select("item_id", "text").distinct().select("item_id", "text", terms_of(F.col("text")).alias("terms"))
    rows = stage_table(items.sparkSession, rows.where(F.size("terms") > 0), "items")
    total = rows.agg(F.sum(F.size(F.array_distinct("terms"))).alias("n")).first()["n"] or 0
    # Half of the bound on average, as hashing doesn't deal evenly.
    parts = 1 if total <= most else -(-2 * total // most)
    for part in range(parts if total else 0):
        chosen = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = chosen.orderBy("item_id", "text").select("item_id", "terms").collect()
        number: dict[str, int] = {}
        terms = []
        for row in found:
            counts: dict[int, int] = {}
            for word in row["terms"]:
                t = number.setdefault(word, len(number))
                counts[t] = counts.get(t, 0) + 1
            terms.append(list(counts.items()))
        if found:
            yield Block(list(number), [row["item_id"] for row in found], terms)


# --- index -------------------------------------------------------------------------------------

INDEX = "segment long, term int, docs array<long>, counts array<long>"


class _Segment:
    """Documents and postings that are gathered until they fill a segment."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.keys, self.counts, self.n, self.postings = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, sizes: np.ndarray, docs: np.ndarray, terms: np.ndarray) -> None:
        keys, counts = np.unique(terms << np.int64(32) | (docs + self.n), return_counts=True)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(sizes)
        self.postings += len(keys)

    def full(self) -> bool:
        return self.n >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def rows(self, number: int) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        terms, first = np.unique(keys >> np.int64(32), return_index=True)
        offsets = np.concatenate(([0], [self.n], self.n + first[1:], [self.n + len(keys)]))[: len(terms) + 2]
        docs = pa.concat_arrays([*(i.cast(pa.int64()) for i in self.ids), pa.array(keys & np.int64(0xFFFFFFFF))])
        numbers = pa.array(np.concatenate([np.concatenate(self.sizes), counts]).astype(np.int64))
        offsets = pa.array(offsets, pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(terms) + 1, number), pa.int64()),
                pa.array(np.concatenate(([DOCUMENTS], terms)), pa.int32()),
                pa.ListArray.from_arrays(offsets, docs), pa.ListArray.from_arrays(offsets, numbers),
            ],
            names=["segment", "term", "docs", "counts"],
        )


def index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``segment, term, docs, counts``: the postings of the vocabulary's terms, and the documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most BLOCK_TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        segment, known = _Segment(), sent.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in chunks(batch.column("text")):
                starts, ends, text_of = term_spans(data, offsets)
                found, terms = known.find(span_hashes(_SMALL[data], starts, ends), ends - starts)
                sizes = np.bincount(text_of, minlength=last - first)
                segment.add(ids.slice(first, last - first), sizes, text_of[found], terms)
                if segment.full():
                    yield segment.rows(number)
                    segment, number = _Segment(), number + 1
        if segment.n:
            yield segment.rows(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def statistics(segments: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, the terms of all documents."""
    sizes = segments.where(F.col("term") == DOCUMENTS).select(F.explode("counts").alias("n"))
    row = sizes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def frequencies(segments: DataFrame) -> dict[int, int]:
    """Document frequency by term; as many as the block has terms."""
    lists = segments.where(F.col("term") != DOCUMENTS).groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    return {row["term"]: row["df"] for row in lists.collect()}


# --- search ------------------------------------------------------------------------------------


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Plan:
    """What a task needs of a block: per item its terms, rarest first, with their repeats."""

    items: list[list[tuple[int, int]]]
    weights: np.ndarray
    docs: int
    terms: int
    k: int


class _Best:
    """The best k documents of each item over the segments of a task."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.scores = [np.zeros(0, np.int64) for _ in plan.items]
        self.ids = [np.zeros(0, np.int64) for _ in plan.items]
        self.nulls = [np.zeros(0, bool) for _ in plan.items]
        self.created = 0  # accumulators made, over all items

    def add(self, ids: pa.Array, sizes: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Search one segment; ``lists`` is document numbers and counts by term."""
        plan = self.plan
        null = np.asarray(ids.is_null())
        doc_ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        short = 8 * (25 + (75 * sizes * plan.docs) // max(1, plan.terms))
        parts: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        score, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for number, terms in enumerate(plan.items):
            here = []
            for term, repeats in terms:
                if term not in lists or not plan.weights[term]:
                    continue
                if term not in parts:
                    docs, tf = lists[term]
                    part = plan.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + short[docs]))
                    parts[term] = docs, part, int(part.max())
                here.append((repeats, *parts[term]))
            if here:
                self._item(number, here, score, made, doc_ids, null)

    def _item(self, number, here, score, made, doc_ids, null) -> None:
        k = self.plan.k
        best = self.scores[number]
        least = int(best[-1]) if len(best) == k else 0
        rest = sum(repeats * top for repeats, _, _, top in here)
        touched, creating = [], True
        for repeats, docs, part, top in here:
            if creating and rest < least:
                creating = False
                if not touched:
                    return  # nothing in this segment can come among the first k
            if not creating:
                held = made[docs]
                docs, part = docs[held], part[held]
            score[docs] += part if repeats == 1 else repeats * part
            rest -= repeats * top
            if creating:
                fresh = docs[~made[docs]]
                made[fresh] = True
                touched.append(fresh)
                self.created += len(fresh)
                if rest and sum(map(len, touched)) >= k:
                    partial = score[np.concatenate(touched)]
                    least = max(least, int(np.partition(partial, len(partial) - k)[-k]))
        docs = np.concatenate(touched)
        found = docs[(score[docs] >= max(1, least))]
        if len(found):
            scores = np.concatenate([best, score[found]])
            ids = np.concatenate([self.ids[number], doc_ids[found]])
            nulls = np.concatenate([self.nulls[number], null[found]])
            order = np.lexsort((ids, nulls, -scores))[:k]
            self.scores[number], self.ids[number], self.nulls[number] = scores[order], ids[order], nulls[order]
        score[docs], made[docs] = 0, False

    def rows(self) -> pa.RecordBatch:
        items = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        flat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(items, pa.int32()),
                pa.array(flat(self.ids, np.int64), pa.int64(), mask=flat(self.nulls, bool)),
                pa.array(flat(self.scores, np.int64), pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )


def _values(lists: pa.ListArray, at: int) -> np.ndarray:
    return np.asarray(lists[at].values)


def searched(segments: DataFrame, plan: Plan) -> DataFrame:
    """``item, doc_id, score``: the best of every task; ``item`` is a number."""
    sent = segments.sparkSession.sparkContext.broadcast(plan)  # bounded as the vocabulary is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(sent.value)
        current, ids, sizes, lists = None, None, None, {}
        for batch in batches:
            numbers, terms = batch.column("segment").to_pylist(), batch.column("term").to_pylist()
            docs, counts = batch.column("docs"), batch.column("counts")
            for at, (number, term) in enumerate(zip(numbers, terms)):
                if number != current:
                    if current is not None:
                        best.add(ids, sizes, lists)
                    current, lists = number, {}
                if term == DOCUMENTS:
                    ids, sizes = docs[at].values, _values(counts, at)
                else:
                    lists[term] = _values(docs, at), _values(counts, at)
        if current is not None:
            best.add(ids, sizes, lists)
        yield best.rows()

    together = segments.repartition("segment").sortWithinPartitions("segment", "term")
    return together.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, most: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = None
    for block in blocks(items, most):
        segments = stage_table(spark, index(docs, Vocabulary.of(block.words)), "segments")
        n, length = statistics(segments)
        df = frequencies(segments)
        weights = np.array([weight(df.get(t, 0), n) for t in range(len(block.words))], dtype=np.int64)
        plan = Plan(
            [sorted(terms, key=lambda x: (df.get(x[0], 0), x[0])) for terms in block.terms], weights, n, length, k
        )
        best = top_per_key(searched(segments, plan), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        names = spark.createDataFrame(
            list(enumerate(block.items)), f"item int, item_id {kind.simpleString()}"
        )  # one row per item of the block
        found = best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT DISTINCT item_id, text FROM benchmark) b, unnest(
    regexp_extract_all(translate(b.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) u(term) GROUP BY ALL),
sizes AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
p AS MATERIALIZED (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, t GROUP BY term, docs),
parts AS (
  SELECT p.row, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS part
  FROM p JOIN w USING (term) JOIN sizes USING (row), t),
scores AS (
  SELECT item_id, row, sum(times * part)::BIGINT AS score FROM q JOIN parts USING (term) GROUP BY ALL),
r AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN sizes USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
