"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector x: its distinct words, hashed to ``BUCKETS`` columns and scaled to unit
length; statistics of its structure (case, symbols, digits, lines, repetition, word lengths), each as
a number and as a one-hot bin; and the column ``n_chars`` as metadata, binned alike. The machine is

    y = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairwise part is computed in linear time as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2,
summed over the factors. It is trained by AdaGrad on the logistic loss, on a bounded sample with as
many documents of either label. Labels, language, source and id are no inputs.

Null texts count as empty, a null ``n_chars`` as the length of the text. Empty texts have all
statistics 0 and get the score that the machine gives to that. Repeated rows are scored alike and stay;
very long texts are read whole; an empty table gives no row; without labels of both kinds every score is
the machine's start. Columns other than id, text and ``n_chars`` aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import chunks, held_out, labelled_sample, mix, span_hashes, word_spans

BUCKETS, FACTORS = 1 << 14, 8
#: Bounds of the sample: documents per label, and characters of a document.
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 12_000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-4
BINS = 8

_UPPER, _DIGIT, _SYMBOL, _MARK, _BAR, _LINE, _START = (np.zeros(256, dtype=np.uint8) for _ in range(7))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#*$%&<>"]] = 1
_MARK[[ord(c) for c in "!?"]] = 1
_BAR[ord("|")] = 1
_LINE[ord("\n")] = 1
_START[:128] = 1
_START[192:] = 1
STATS = (
    "upper", "digits", "symbols", "marks", "bars", "lines", "word_chars", "distinct", "again", "words", "n_chars",
)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def features(texts: pa.Array, n_chars: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first, last, owner, bucket, statistics)`` per run of texts; distinct words come as buckets."""
    given = np.asarray(n_chars.cast(pa.float64()).fill_null(np.nan))
    for first, last, data, offsets in chunks(texts):
        n = last - first
        starts, ends, owner = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        chars = _sums(_START[data], offsets)
        count = np.bincount(owner, minlength=n).astype(np.float64)
        same = np.zeros(len(words), dtype=bool)
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[same], minlength=n)
        with np.errstate(over="ignore"):
            key = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
        text_of = (key >> np.uint64(40)).astype(np.int64)
        bucket = (mix(key & np.uint64((1 << 40) - 1)) % np.uint64(BUCKETS)).astype(np.int64)
        length, size = np.maximum(chars, 1), np.maximum(count, 1)
        meta = given[first:last]
        stats = np.stack(
            [
                _sums(_UPPER[data], offsets) / length,
                _sums(_DIGIT[data], offsets) / length,
                _sums(_SYMBOL[data], offsets) / size,
                _sums(_MARK[data], offsets) / size,
                _sums(_BAR[data], offsets) / size,
                _sums(_LINE[data], offsets) / size,
                np.bincount(owner, weights=ends - starts, minlength=n) / size,
                np.bincount(text_of, minlength=n) / size,
                again / size,
                np.log1p(count),
                np.log1p(np.where(np.isnan(meta), chars, meta)),
            ],
            axis=1,
        )
        yield first, last, text_of, bucket, stats


@dataclass
class Machine:
    edges: np.ndarray  # statistics x inner bin edges
    centre: np.ndarray
    spread: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, owner: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows, in order of rows: row, column, value."""
        n, s = stats.shape
        words = np.bincount(owner, minlength=n)
        scaled = np.clip((stats - self.centre) / self.spread, -4, 4)
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(s)], axis=1)
        row = np.concatenate([owner, np.repeat(np.arange(n), 2 * s)])
        dense = np.concatenate(
            [np.broadcast_to(BUCKETS + np.arange(s), (n, s)), BUCKETS + s + np.arange(s) * BINS + bins], axis=1
        )
        column = np.concatenate([bucket, dense.ravel()])
        value = np.concatenate(
            [1 / np.sqrt(words[owner]), np.concatenate([scaled / s, np.full((n, s), 1 / np.sqrt(s))], axis=1).ravel()]
        )
        order = np.argsort(row, kind="stable")
        return row[order], column[order], value[order].astype(np.float32)

    def margins(self, owner: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> np.ndarray:
        row, column, value = self.rows(owner, bucket, stats)
        return _forward(self.bias, self.linear, self.factors, row, column, value)[0]


def _forward(bias, linear, factors, row, column, value):
    """Margins, and the factor sums; the pairwise part by the sum-of-squares identity."""
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    scaled = factors[column] * value[:, None]
    sums = np.add.reduceat(scaled, start)
    squares = np.add.reduceat((scaled * scaled).sum(axis=1), start)
    first = np.add.reduceat(linear[column] * value, start)
    return bias + first + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def columns() -> int:
    return BUCKETS + len(STATS) * (1 + BINS)


def fit(texts: list[str], n_chars: list[int], labels: list[int], seed: int = 11) -> Machine:
    rng = np.random.default_rng(seed)
    parts = list(features(pa.array(texts, pa.string()), pa.array(n_chars, pa.int64())))
    stats = np.concatenate([p[4] for p in parts]) if parts else np.zeros((0, len(STATS)))
    width = columns()
    linear = np.zeros(width, dtype=np.float32)
    factors = rng.normal(0, 0.02, (width, FACTORS)).astype(np.float32)
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        none = np.zeros((len(STATS), BINS - 1))
        bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Machine(none, np.zeros(len(STATS)), np.ones(len(STATS)), bias, linear, factors * 0)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    machine = Machine(edges, stats.mean(axis=0), stats.std(axis=0) + 1e-6, 0.0, linear, factors)
    owner = np.concatenate([p[2] + p[0] for p in parts])
    row, column, value = machine.rows(owner, np.concatenate([p[3] for p in parts]), stats)
    cuts = np.searchsorted(row, np.arange(len(y) + 1))
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    grown = [np.full(width, 1e-3), np.full((width, FACTORS), 1e-3)]
    bias, bias_grown = 0.0, 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            some = np.sort(order[at : at + BATCH])
            pick = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in some])
            local = np.repeat(np.arange(len(some)), cuts[some + 1] - cuts[some])
            c, v = column[pick], value[pick]
            margin, sums = _forward(bias, linear, factors, local, c, v)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]) * balance[some]
            each = (slope[local] * v).astype(np.float32)
            used, place = np.unique(c, return_inverse=True)
            g1 = np.bincount(place, weights=each, minlength=len(used)) + DECAY * linear[used]
            raw = each[:, None] * (sums[local] - factors[c] * v[:, None])
            g2 = np.stack([np.bincount(place, weights=raw[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1)
            g2 += DECAY * factors[used]
            grown[0][used] += g1 * g1
            grown[1][used] += g2 * g2
            linear[used] -= (RATE * g1 / np.sqrt(grown[0][used])).astype(np.float32)
            factors[used] -= (RATE * g2 / np.sqrt(grown[1][used])).astype(np.float32)
            g0 = slope.sum()
            bias_grown += g0 * g0
            bias -= RATE * g0 / np.sqrt(bias_grown)
    machine.bias = float(bias)
    return machine


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], list[int]]:
    """At most ``SAMPLE_DOCS`` documents per label that aren't held out, in hash order."""
    texts, sizes, marks = [], [], []
    for label in (0, 1):
        rows = labelled_sample(docs, labels.where(F.col("quality") == label), SAMPLE_DOCS, SAMPLE_CHARS)
        texts += [r["text"] for r in rows]
        sizes += [len(r["text"]) if r["n_chars"] is None else r["n_chars"] for r in rows]
        marks += [label] * len(rows)
    return texts, sizes, marks


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row; the score is the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, last, owner, bucket, stats in features(batch.column("text"), batch.column("n_chars")):
                out[first:last] = machine.margins(owner, bucket, stats)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on the labels and score every document: ``doc_id, held_out, score, predicted``."""
    machine = fit(*sample(docs, labels))
    return score(docs, machine).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
