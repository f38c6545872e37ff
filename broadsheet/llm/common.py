"""Small helpers shared by the operators: reading tables, stage tables, word and shingle hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import shared_dir

#: A word is a run of characters other than ASCII white space, here in a form that Java and RE2 read.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9DDFEA08EB382D69 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about this many bytes, which bounds the memory of a task.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, lost executors don't matter."""
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labelled: DataFrame, most: int, chars: int) -> list[Row]:
    """At most ``most`` rows of ``docs``, of at most ``chars`` characters, with an id in ``labelled``.

    Ids are drawn first, in hash order and half as many again as some texts are too long; that bounds
    what is broadcast. Held-out ids aren't drawn.
    """
    spark = docs.sparkSession
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = labelled.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    drawn = [row["doc_id"] for row in ids.orderBy(*order).limit(most + most // 2).collect()]
    if not drawn:
        return []
    place = {doc_id: i for i, doc_id in enumerate(drawn)}
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in drawn], labelled.select("doc_id").schema))
    columns = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    found = docs.select(*columns).where(F.length("text") <= chars).join(chosen, "doc_id", "left_semi")
    # Where an id is repeated, the first of its texts.
    first = found.groupBy("doc_id").agg(F.min(F.struct(*columns[1:])).alias("row")).select("doc_id", "row.*")
    return sorted(first.collect(), key=lambda r: place[r["doc_id"]])[:most]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _MIX[2]
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("up", ())) < n:
        size = max(n, CHUNK_BYTES)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                cache[name] = np.multiply.accumulate(steps)
    return cache["up"][:n], cache["down"][:n]


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of runs of texts of about ``CHUNK_BYTES``; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and text number of every word; words don't cross texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    space = _IS_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    inside = ~space
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, text_of: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words and their text numbers.

    A text of one to ``k - 1`` words has one shingle, all its words; a text without words has none.
    """
    counts = np.bincount(text_of, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    with np.errstate(over="ignore"):
        if len(words) >= k:
            windows = len(words) - k + 1
            whole = text_of[:windows] == text_of[k - 1 :]
            total = np.zeros(windows, dtype=np.uint64)
            for i in range(k):
                total = total * np.uint64(_BASE) + words[i : i + windows]
            hashes, owner = mix(total[whole]), text_of[:windows][whole]
        else:
            hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            total = np.full(len(short), 7, dtype=np.uint64)
            for i in range(k - 1):
                has = counts[short] > i
                total[has] = total[has] * np.uint64(_BASE) + words[first[short[has]] + i]
            hashes = np.concatenate([hashes, mix(total)])
            owner = np.concatenate([owner, short])
    return hashes, owner


def shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, hashes, text number from first)`` per run of texts."""
    for first, last, data, offsets in chunks(texts):
        starts, ends, text_of = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        yield first, last, *shingle_hashes(words, text_of, last - first, k)
