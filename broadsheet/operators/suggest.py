"""Suggestion dictionary, autocomplete, spelling.

Edit-distance joins use the partition rule of Li, Deng, Wang and Feng ("Pass-Join", VLDB 2012): cut a
term into ``d + 1`` segments; a string within ``d`` edits holds at least one segment unchanged, moved by
at most ``d`` places. That turns the theta join into an equi join on segments, with a check after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import strip, tokens
from broadsheet.operators.skew import sized_join, top_per_key

if TYPE_CHECKING:
    from broadsheet.plans.corpus import Corpus

MIN_PREFIX = 2
LIMIT = 7
#: Characters of the deepest nodes of the completion trie.
TRIE_CHARS = 24
TOPIC_CHARS = 40
SPARSE = 3
SPELL_DISTANCE = 1
#: The distance that keys are stored for, and the most near terms that a search names one by one.
EDIT_DISTANCE, LITERAL_TERMS = 2, 1000
#: Words up to this length are compared by what deletions leave of them, longer ones by segments.
DELETION_CHARS = 16
_BASE = 0x9DDFEA08EB382D69 | 1


# --- dictionary and autocomplete ---------------------------------------------------------------


def dictionary(articles: DataFrame) -> DataFrame:
    """``(suggestion, score)``: titles, categories, sources and tags with their article counts."""
    tags = F.flatten(F.transform("tags", lambda t: F.transform(F.split(t, ","), strip)))
    texts = F.array_distinct(F.concat(F.array("title", "category", "source"), tags))
    return (
        articles.select(F.explode(texts).alias("suggestion"))
        .filter(F.col("suggestion") != "")
        .groupBy("suggestion")
        .agg(F.count(F.lit(1)).alias("score"))
    )


def suggestion_type(c: Column) -> Column:
    return F.when(F.length(c) > TOPIC_CHARS, "article").otherwise("topic")


def completions(suggestions: DataFrame, limit: int = LIMIT, depth: int = TRIE_CHARS) -> DataFrame:
    """``(key, position, suggestion)``: a trie as a table, with the best ``limit`` entries of every node.

    A node is the lower-case beginning of a suggestion, of ``MIN_PREFIX`` to ``depth`` characters. Built once
    per dictionary, from rows bounded by its size times ``depth``; a prefix is then a lookup.
    """
    low = F.lower(F.col("suggestion"))
    lengths = F.sequence(F.lit(MIN_PREFIX), F.least(F.length(low), F.lit(depth)))
    nodes = suggestions.filter(F.length(low) >= MIN_PREFIX).select(
        "suggestion", "score", F.explode(F.transform(lengths, lambda n: F.substr(low, F.lit(1), n))).alias("key")
    )
    best = top_per_key(nodes, ["key"], [F.desc("score"), F.asc("suggestion")], limit, rank="position")
    return best.select("key", "position", "suggestion")


def deep_completions(suggestions: DataFrame, keys: DataFrame, limit: int, depth: int, max_bytes=None) -> DataFrame:
    """The same rows for ``keys`` longer than the trie is deep: suggestions meet them in the node of their
    first ``depth`` characters and are compared from there."""
    low = F.lower(F.col("suggestion"))
    held = suggestions.filter(F.length(low) > depth).select("suggestion", "score", F.substring(low, 1, depth).alias("node"))
    wanted = keys.select("key", F.substring("key", 1, depth).alias("node"))
    met = sized_join(held, wanted, ["node"], max_bytes=max_bytes).filter(F.startswith(low, F.col("key")))
    best = top_per_key(met, ["key"], [F.desc("score"), F.asc("suggestion")], limit, rank="position")
    return best.select("key", "position", "suggestion")


def complete_each(
    suggestions: DataFrame, prefixes: DataFrame, limit: int = LIMIT, max_bytes: int | None = None,
    trie: DataFrame | None = None, depth: int = TRIE_CHARS,
) -> DataFrame:
    """``(query_id, rank, suggestion, type)`` for a table ``(query_id, prefix)``.

    The best ``limit`` are taken first and repeats by letter case dropped after that, so fewer may
    come back. Prefixes are looked up in ``trie``, as ``completions`` makes it for ``limit`` and ``depth``,
    which is built here where none is given; longer ones are searched below their last node.
    """
    wanted = prefixes.filter(F.length("prefix") >= MIN_PREFIX).select(
        "query_id", F.lower("prefix").alias("key")
    )
    distinct = wanted.select("key").distinct()
    trie = completions(suggestions, limit, depth) if trie is None else trie
    in_trie = F.length("key") <= depth
    top = sized_join(trie, distinct.filter(in_trie), ["key"], max_bytes=max_bytes).unionByName(
        deep_completions(suggestions, distinct.filter(~in_trie), limit, depth, max_bytes)
    )
    first = Window.partitionBy("key", F.lower("suggestion")).orderBy("position")
    again = Window.partitionBy("key").orderBy("position")
    kept = (
        top.withColumn("copy", F.row_number().over(first))
        .filter(F.col("copy") == 1)
        .withColumn("rank", F.row_number().over(again).cast("long"))
        .select("key", "rank", "suggestion", suggestion_type(F.col("suggestion")).alias("type"))
    )
    # Of the two, requests are the narrow rows, so they are the side that may be copied.
    return sized_join(kept, wanted, ["key"], max_bytes=max_bytes).select(
        "query_id", "rank", "suggestion", "type"
    )


def autocomplete(suggestions: DataFrame, prefix: str, limit: int = LIMIT) -> DataFrame:
    """``(rank, suggestion, type)`` for one prefix; empty below two characters."""
    low = F.lower(F.lit(prefix))
    usable = F.lit(len(prefix) >= MIN_PREFIX)
    top = (
        suggestions.filter(usable & F.startswith(F.lower("suggestion"), low))
        .orderBy(F.desc("score"), F.asc("suggestion"))
        .limit(limit)
    )
    order = Window.orderBy(F.desc("score"), F.asc("suggestion"))
    first = Window.partitionBy(F.lower("suggestion")).orderBy(F.desc("score"), F.asc("suggestion"))
    return (
        top.withColumn("copy", F.row_number().over(first))
        .filter(F.col("copy") == 1)
        .select(
            F.row_number().over(order).cast("long").alias("rank"),
            "suggestion",
            suggestion_type(F.col("suggestion")).alias("type"),
        )
    )


# --- edit-distance join ------------------------------------------------------------------------


def _key(text: Column, length: Column, index: Column, parts: int, shift: Column) -> Column:
    """The key of segment ``index`` of a term of this ``length`` cut into ``parts`` even pieces, the
    longer pieces last, with the segment read from ``text`` at ``shift`` places from its own; null
    where that lies outside the text."""
    base = F.floor(length / parts).cast("int")
    longer = F.lit(parts) - length % parts
    at = (base * index + F.greatest(F.lit(0), index - longer) + shift).cast("int")
    size = (base + F.when(index >= longer, 1).otherwise(0)).cast("int")
    key = F.struct(
        length.alias("length"), index.alias("index"), F.substring(text, at + 1, size).alias("segment")
    )
    return F.when((length > 0) & (at >= 0) & (at + size <= F.length(text)), key)


def segment_keys(term: Column, distance: int) -> Column:
    """One ``(length, index, segment)`` key per segment of a vocabulary term."""
    parts = distance + 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(distance)),
        lambda i: _key(term, F.length(term), i, parts, F.lit(0)),
    )


def probe_keys(word: Column, distance: int) -> Column:
    """Every key a term within ``distance`` edits of ``word`` may have."""
    parts = distance + 1
    around = F.sequence(F.lit(-distance), F.lit(distance))
    segments = F.sequence(F.lit(0), F.lit(distance))

    def of_length(length: Column) -> Column:
        return F.flatten(
            F.transform(
                segments,
                lambda i: F.transform(around, lambda s: _key(word, length, i, parts, s)),
            )
        )

    keys = F.flatten(F.transform(around, lambda change: of_length(F.length(word) + change)))
    return F.array_distinct(F.array_compact(keys))


def key_text(key: Column) -> Column:
    """A segment key as one string, to sort and look up by."""
    return F.concat_ws(":", key["length"].cast("string"), key["index"].cast("string"), key["segment"])


def edit_keys(terms: DataFrame, distance: int = EDIT_DISTANCE) -> DataFrame:
    """``(key, term)``: the stored side of the edit-distance join, one row per segment of a distinct term."""
    keys = F.transform(segment_keys(F.col("term"), distance), key_text)
    return terms.select(F.explode(keys).alias("key"), "term")


def near_pairs(corpus: "Corpus", words: list[str], distance: int) -> list[tuple[str, str]] | None:
    """The terms within ``distance`` edits of a few words, by the stored keys, as ``(word, term)``.

    The keys of the words are literals, so the scan skips all other row groups of the sorted table. None
    where the corpus has no such table for the distance, or where more than ``LITERAL_TERMS`` terms are near.
    """
    if corpus.edit_keys is None or distance != EDIT_DISTANCE or not words:
        return None
    probes = [F.transform(probe_keys(F.lit(w), distance), key_text) for w in words]
    keys = corpus.spark.range(1).select(F.array_distinct(F.flatten(F.array(*probes))).alias("k")).first()["k"]
    term = F.col("term")
    near = F.filter(
        F.array(*[F.lit(w) for w in words]),
        lambda w: (F.abs(F.length(term) - F.length(w)) <= distance) & (F.levenshtein(term, w, distance) >= 0),
    )
    held = corpus.edit_keys.filter(F.col("key").isin(keys)).select("term").distinct()
    rows = held.filter(F.size(near) > 0).select("term", near.alias("words")).limit(LITERAL_TERMS + 1).collect()
    return None if len(rows) > LITERAL_TERMS else [(w, r["term"]) for r in rows for w in r["words"]]


def near_terms(
    vocabulary: DataFrame, words: DataFrame, distance: int, max_bytes: int | None = None
) -> DataFrame:
    """``(word, term, ...)`` pairs within ``distance`` edits.

    ``vocabulary`` has ``term`` and may carry other columns, as long as its rows are distinct; ``words``
    has distinct ``word``. Pairs that share several segments are merged before they leave the task.
    """
    probes = words.select("word", F.explode(probe_keys(F.col("word"), distance)).alias("key"))
    carried = [c for c in vocabulary.columns if c != "term"]
    keyed = vocabulary.select(
        "term", *carried, F.explode(segment_keys(F.col("term"), distance)).alias("key")
    )
    return (
        sized_join(keyed, probes, ["key"], max_bytes=max_bytes)
        .filter(F.levenshtein("term", "word", distance) >= 0)
        .select("word", "term", *carried)
        .distinct()
    )


def _remains(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what is left of words of one length after up to ``distance`` deletions, with the row of each;
    ``codes`` has a row per word and a column per character. Equal hashes of a word are named once."""
    n, length = codes.shape
    # Powers of an odd base, so that dividing by it moves a stretch down one place.
    down = np.uint64(pow(_BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(length, np.uint64(_BASE))))
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros((n, length + 1), dtype=np.uint64)
        np.cumsum(mixed * powers[:length], axis=1, out=sums[:, 1:])
        out = []
        for deleted in range(min(distance, length) + 1):
            for gaps in combinations(range(length), deleted):
                total, start, factor = np.zeros(n, dtype=np.uint64), 0, np.uint64(1)
                for end in (*gaps, length):
                    total = total + (sums[:, end] - sums[:, start]) * factor
                    start, factor = end + 1, factor * down
                total = (total + np.uint64(length - deleted)) * np.uint64(0x94D049BB133111EB)
                out.append(total ^ (total >> np.uint64(31)))
    keys = np.sort(np.stack(out, axis=1), axis=1)
    first = np.ones(keys.shape, dtype=bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, place = np.nonzero(first)
    return keys[row, place].view(np.int64), row


def deletion_keys(words: DataFrame, distance: int) -> DataFrame:
    """``words``, whose first column is a word, with ``key``: a row per hash of what deletions leave of it."""
    names = words.columns

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                codes = np.array([[ord(c) for c in texts[i]] for i in rows], dtype=np.uint64).reshape(len(rows), length)
                keys, row = _remains(codes, distance)
                columns = [c.take(pa.array(rows[row])) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys)], names=[*names, "key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(explode, f"{fields}, key long")


def near_by_deletions(
    vocabulary: DataFrame, words: DataFrame, distance: int = EDIT_DISTANCE, max_bytes: int | None = None
) -> DataFrame:
    """The same rows as ``near_terms``, for many words.

    Two strings within ``distance`` edits leave the same string after so many deletions in each at most. Hashes
    of what is left meet in an equality join that is far more selective than short segments are, and pairs
    are checked after it. A word has a number of them that grows with the square of its length, so long words,
    whose segments are selective, go by these.
    """
    low, high = F.length("word") <= DELETION_CHARS, F.length("term") <= DELETION_CHARS + distance
    least, most = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    vocabulary = vocabulary.filter(F.length("term").between((least or 0) - distance, (most or 0) + distance))
    carried = [c for c in vocabulary.columns if c != "term"]
    terms = deletion_keys(vocabulary.select("term", *carried).filter(high), distance)
    probes = deletion_keys(words.select("word").filter(low), distance)
    # Small files hold many keys, so neither side is broadcast by its estimated size.
    short = (
        terms.hint("merge").join(probes.hint("merge"), "key")
        .filter(F.levenshtein("term", "word", distance) >= 0)
        .select("word", "term", *carried)
        .distinct()
    )
    long = words.filter(~low)
    if long.isEmpty():
        return short
    far = vocabulary.filter(F.length("term") > DELETION_CHARS - distance)
    return short.unionByName(near_terms(far, long, distance, max_bytes))


# --- spelling ----------------------------------------------------------------------------------


def query_words(queries: DataFrame) -> DataFrame:
    """``(query_id, position, word)``: words of every query of two characters or more, first use."""
    return (
        queries.filter(F.length(strip(F.col("text"))) >= MIN_PREFIX)
        .select("query_id", F.posexplode(F.array_distinct(tokens(F.col("text")))))
        .select("query_id", F.col("pos").alias("position"), F.col("col").alias("word"))
    )


def corrections(
    corpus: "Corpus", words: DataFrame, distance: int = SPELL_DISTANCE, max_bytes: int | None = None
) -> DataFrame:
    """``(word, suggestion)`` for distinct ``word`` rows that are not in the vocabulary.

    The vocabulary is the big side of both joins and is only scanned. The best candidate is the most
    frequent term, then the first in alphabetical order.
    """
    stats = corpus.term_stats
    known = (
        sized_join(
            stats.select(F.col("term").alias("word")), words, ["word"], "left_semi", max_bytes
        )
    ).distinct()
    unknown = words.join(known, "word", "left_anti")
    pairs = near_terms(stats.select("term", "mask", "n"), unknown, distance, max_bytes)
    per_term = pairs.groupBy("word", "term").agg(F.sum("n").alias("df"))
    best = F.min(F.struct((-F.col("df")).alias("neg_df"), F.col("term").alias("term")))
    return per_term.groupBy("word").agg(best.alias("b")).select(
        "word", F.col("b.term").alias("suggestion"), (-F.col("b.neg_df")).alias("df")
    )


def spellcheck(corpus: "Corpus", queries: DataFrame, distance: int = SPELL_DISTANCE) -> DataFrame:
    """``(query_id, position, word, suggestion)`` for the misspelt words of a table of queries."""
    words = query_words(queries)
    fixes = corrections(corpus, words.select("word").distinct(), distance)
    return sized_join(words, fixes, ["word"]).select("query_id", "position", "word", "suggestion")


def corrected_queries(corpus: "Corpus", queries: DataFrame) -> DataFrame:
    """``(query_id, text, corrected)``: misspelt words replaced in turn, in order of appearance.

    Replacement works on substrings of the text as typed. Queries left unchanged are null.
    """
    fixes = (
        spellcheck(corpus, queries)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "word", "suggestion"))).alias("fixes"))
    )
    replaced = F.aggregate(
        F.col("fixes"), F.col("text"), lambda acc, f: F.replace(acc, f["word"], f["suggestion"])
    )
    return queries.select("query_id", "text").join(fixes, "query_id", "left").select(
        "query_id", "text", F.when(replaced != F.col("text"), replaced).alias("corrected")
    )


def complete_with_spelling(
    corpus: "Corpus", queries: DataFrame, limit: int = LIMIT
) -> DataFrame:
    """``(query_id, text, n, spell_suggestion)``: the correction is offered when fewer than three
    suggestions are found and it is not one of them."""
    typed = queries.select("query_id", F.col("text").alias("prefix"))
    found = (
        complete_each(corpus.suggestions, typed, limit, trie=corpus.completions if limit == LIMIT else None)
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.collect_list(F.lower("suggestion")).alias("seen"),
        )
    )
    joined = corrected_queries(corpus, queries).join(found, "query_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    offered = (
        (n < SPARSE)
        & F.col("corrected").isNotNull()
        & ~F.coalesce(F.array_contains("seen", F.lower("corrected")), F.lit(False))
    )
    return joined.select(
        "query_id", "text", n.alias("n"),
        F.when(offered, F.col("corrected")).alias("spell_suggestion"),
    )
