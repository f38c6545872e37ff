"""Document fingerprints: MinHash under universal hash permutations, with bands joined in Spark.

A fingerprint is the minimum, under each of ``PERMUTATIONS`` multiply-add permutations of 64 bits, of
the hashes of a text's shingles of ``K`` words; 16 bits of each are kept, in hexadecimal. The share of
equal places estimates the Jaccard similarity of two shingle sets. ``near_duplicates`` cuts signatures
into bands, joins texts that agree in a band, and verifies the exact Jaccard similarity.

Null counts as empty. Texts without words have the fingerprint of the empty set, all of them the same;
texts of fewer than ``K`` words have one shingle, all their words. Repeated rows and ties of ids follow one
another in order of their text; rows with a null id come last; very long texts are read whole, in pieces; an
empty table gives no row; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from broadsheet.llm.common import mix, shingles, stage_table
from broadsheet.llm.neardup import near_classes, node_key, signed

K, PERMUTATIONS = 5, 128
THRESHOLD, SLACK = 0.8, 0.62
#: 25 bands of 5 for the join; at similarity 0.8 a pair shares one with probability 0.99995.
BANDS, ROWS = 25, 5
#: Characters that one range of ids is meant to hold, and the most ranges.
RANGE_CHARS, MOST_RANGES = 8_000_000, 4096


def _factors(m: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
        return a, mix(a)


def minhash(hashes: np.ndarray, text_of: np.ndarray, n: int, m: int = PERMUTATIONS) -> np.ndarray:
    """Signatures, ``n`` x ``m`` of 32 bits; a text without shingles has all bits set."""
    out = np.full((n, m), 0xFFFFFFFF, dtype=np.uint32)
    if not len(hashes):
        return out
    if (np.diff(text_of) < 0).any():
        order = np.argsort(text_of, kind="stable")
        hashes, text_of = hashes[order], text_of[order]
    start = np.flatnonzero(np.concatenate(([True], text_of[1:] != text_of[:-1])))
    rows = text_of[start]
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(*_factors(m))):
            out[rows, i] = np.minimum.reduceat(hashes * a + b, start) >> np.uint64(32)
    return out


def signature_rows(texts: pa.Array, m: int = PERMUTATIONS, k: int = K) -> np.ndarray:
    out = np.empty((len(texts), m), dtype=np.uint32)
    for first, last, hashes, owner in shingles(texts, k):
        out[first:last] = minhash(hashes, owner, last - first, m)
    return out


def printed(signature: np.ndarray) -> list[str]:
    """Fingerprints: the low 16 bits of each place in hexadecimal."""
    short = (signature & np.uint32(0xFFFF)).astype(">u2")
    return [row.tobytes().hex() for row in short]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal places of the fingerprints of two signatures."""
    return ((a ^ b) & np.uint32(0xFFFF) == 0).mean(axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(printed(signature_rows(batch.column("text"))), pa.string())],
                names=["doc_id", "fingerprint"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """``doc_id, class_id`` of every row: the smallest id of the texts linked by Jaccard ``threshold`` or more."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    m = BANDS * ROWS
    signs = signed(docs, lambda hashes, text_of, n: minhash(hashes, text_of, n, m), BANDS, k)
    signs = signs.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "signature", "keys")))
    labels = near_classes(docs, stage_table(spark, signs, "signatures"), threshold, SLACK, m, k, weighted=False)
    keyed = docs.select("doc_id", node_key("text").alias("node"))
    placed = keyed.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "root").select("doc_id", "class_id")


def with_next(docs: DataFrame) -> DataFrame:
    """``target, tail, doc_id, text`` such that, within a target, each row is followed by its next document.

    Documents stand by descending id; the first one follows the last. Ids are cut into ranges at
    approximate quantiles; a range also gets the first row of the range below it, as its ``tail``, the
    lowest range that of the highest one. The rows are in order within partitions, each target in one.
    """
    ids = docs.select("doc_id", F.length("text").alias("n"))
    size = ids.agg(F.count("doc_id").alias("n"), F.sum("n").alias("chars")).first()
    ranges = int(max(1, min(MOST_RANGES, (size["chars"] or 0) // RANGE_CHARS, size["n"])))
    steps = [i / ranges for i in range(1, ranges)]
    cuts: list[int] = []
    if steps:
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", steps, 100_000)).first()[0]))
    inner = np.array(cuts, dtype=np.int64)
    # Null ids come last, below all others: range -1.
    tops: dict[int, int] = {}

    def ranged(key: pd.Series) -> np.ndarray:
        out = np.full(len(key), -1, dtype=np.int64)
        has = key.notna().to_numpy()
        out[has] = np.searchsorted(inner, key[has].to_numpy(dtype=np.int64), "right")
        return out

    @pandas_udf("int")
    def own(key: pd.Series) -> pd.Series:
        return pd.Series(ranged(key))

    top = ids.select("doc_id", own("doc_id").alias("r")).groupBy("r").agg(F.max("doc_id").alias("top"))
    found = sorted((row["r"], row["top"]) for row in top.collect())  # at most MOST_RANGES + 1 rows
    for (_, key), (above, _) in zip(found, found[1:] + found[:1]):
        tops[key] = above

    @pandas_udf("array<int>")
    def targets(key: pd.Series) -> pd.Series:
        own_range = ranged(key).tolist()
        missing = key.isna().tolist()
        return pd.Series(
            [
                [r, tops[k]] if (k := None if gone else int(x)) in tops else [r]
                for r, x, gone in zip(own_range, key, missing)
            ]
        )

    rows = docs.select("doc_id", "text", F.posexplode(targets("doc_id")).alias("tail", "target"))
    return rows.repartition(max(ranges, 1), "target").sortWithinPartitions(
        "target", "tail", F.desc_nulls_last("doc_id"), "text"
    )


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the next document's beginning.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list, following: list) -> pa.RecordBatch:
            ids, texts = [r[0] for r in rows], [r[1] for r in rows]
            changed = []
            for text, after in zip(texts, following):
                third = len(text) // 3
                changed.append(text[: len(text) - third] + after[:third])
            own = signature_rows(pa.array([*texts, following[-1]], pa.string()))
            new = signature_rows(pa.array(changed, pa.string()))
            after = own[1:].copy()
            # Where a target ends the next row isn't the next document.
            odd = [i for i in range(len(rows) - 1) if following[i] is not texts[i + 1]]
            if odd:
                after[odd] = signature_rows(pa.array([following[i] for i in odd], pa.string()))
            own = own[:-1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch_type), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array(printed(own), pa.string()), pa.array(printed(new), pa.string()),
                    pa.array(likeness(own, new)), pa.array(likeness(own, after)),
                ],
                names=[
                    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                ],
            )

        held, first_of, rows, following = None, None, [], []
        batch_type = None
        for batch in batches:
            batch_type = batch.schema.field("doc_id").type
            columns = (batch.column(c).to_pylist() for c in ("target", "tail", "doc_id", "text"))
            for target, tail, doc_id, text in zip(*columns):
                text = text or ""
                if held is not None:
                    if held[2] == target:
                        rows.append(held)
                        following.append(text)
                        held = None
                    elif held[2] != target:
                        # No tail came: this range is the only one, so its first row follows its last.
                        rows.append(held)
                        following.append(first_of)
                        held = None
                if tail:
                    continue
                if first_of is None or not rows or rows[-1][2] != target:
                    first_of = text
                held = (doc_id, text, target)
                if len(rows) >= 512:
                    yield told(rows, following)
                    rows, following = [], []
        if held is not None:
            rows.append(held)
            following.append(first_of)
        if rows:
            yield told(rows, following)

    return with_next(docs.select("doc_id", "text")).select("target", "tail", "doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
