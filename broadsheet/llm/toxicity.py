"""Toxicity: a subsequence string-kernel SVM over words, with Nystroem landmarks.

The kernel compares words, not sentences: no subsequence crosses a space. So toxic phrases of harmless
words aren't found, and an insult split into pieces of two or more letters ("id iot") is scored piece by
piece. Sentences only gather words, and are counted after the verdict (``toxic_sentences``).

A text is a bag of sentences, a sentence a bag of units. A unit is a word in lower case without
punctuation, or several single characters in a row written apart ("i d i o t"). Two units are compared
by the gap-weighted subsequence kernel: each common subsequence of three characters, however it is
interrupted, adds ``DECAY`` to the power of the two spans, up to a span of ``SPAN``; values are divided
by the units' norms. So an insult with inserted, doubled or missing characters stays near the insult.

The kernel map is approximated on landmarks (Nystroem): k_L(u) K_LL^-1/2, a vector per unit. A linear
SVM with squared hinge loss is trained on it by multiple-instance learning: labels are known for
documents; a clean document is clean with all its units, and a toxic document has at
least one toxic unit, its worst, which is chosen anew in every round. A sentence
scores as its worst unit, a document as its worst sentence.

As the kernel is linear in subsequence counts, the expansion over landmarks is added up once into one
weight per three characters. Scoring a unit is then a sum over its subsequences: the same value as
comparing it with all landmarks.

Null, empty and wordless texts score as the clean end: they have no sentence. Repeated rows are scored
alike; very long texts are read whole; an empty table gives no row; extra columns are not read, whatever
their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import held_out, labelled_sample, mix, shingles

#: Bounds of the sample that the model is fitted on: documents per class, and characters of a document.
SAMPLE_DOCS, SAMPLE_CHARS = {1: 1500, 0: 2500}, 8000
LANDMARKS = 256
DECAY, SPAN = 0.6, 6
#: Units longer than this are learned and scored in overlapping windows.
WINDOW = 22
ALPHABET = 62
ROUNDS = 4
HARD, EASY = 8_000, 4_000
#: A unit of toxic documents only is a witness by itself where chance gives that with less than exp(-SURE).
SURE = 12.0
CACHE_UNITS = 800_000
#: The score is the logistic of this many times the margin.
STEEP = 4.0

_RUN = re.compile(b"\1{3,}")
_DROP = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def unit_of(word: str) -> str:
    return word.lower() if word.isalnum() else _DROP.sub("", word.lower())


def text_words(text: str) -> list[str]:
    """The words of a text, and as one more unit each run of three or more single characters."""
    words = text.split()
    single = bytes([len(w) == 1 or (len(w) < 4 and not w.isalnum() and len(unit_of(w)) == 1) for w in words])
    if b"\1\1\1" in single:
        runs = [words[m.start() : m.end()] for m in _RUN.finditer(single)]
        words = words + ["".join(map(unit_of, run)) for run in runs]
    return words


def _windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


_WEIGHTS = np.array([0.0, *(DECAY**i for i in range(1, 8))], dtype=np.float32)
_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and spans of the subsequences of three characters of a unit of length ``n``."""
    if n not in _TRIPLES:
        found = [
            (i, j, k, k - i + 1)
            for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))
        ]
        _TRIPLES[n] = np.array([x[:3] for x in found], dtype=np.int64), np.array([x[3] for x in found], np.int32)
    return _TRIPLES[n]


@dataclass
class Kernel:
    """Subsequence features over a fixed alphabet; 0 stands for other characters, 1 and 2 for the ends."""

    letters: dict[str, int]

    @property
    def size(self) -> int:
        return (len(self.letters) + 3) ** 3

    def groups(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: row numbers, features and weights (rows x subsequences), and norms (rows x 1)."""
        by_length: dict[int, list[int]] = {}
        for i, unit in enumerate(units):
            by_length.setdefault(len(unit), []).append(i)
        base, get = len(self.letters) + 3, self.letters.get
        for n, rows in by_length.items():
            if not n:
                continue
            place, span = _triples(n + 2)
            step = max(1, 2_000_000 // len(span))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                codes = np.array([[1, *(get(c, 0) for c in units[i]), 2] for i in some], dtype=np.int32)
                one, two, three = (codes[:, place[:, c]] for c in range(3))
                feature = (one * base + two) * base + three
                # Characters outside the alphabet match nothing: span 0, weight 0.
                known = (one > 0) & (two > 0) & (three > 0)
                packed = np.sort((feature << 3) | np.where(known, span, np.int32(0)), axis=1)
                feature, value = packed >> 3, _WEIGHTS[packed & 7]
                yield np.array(some), feature, value, np.maximum(_norms(feature, value), 1e-9)[:, None]

    def against(self, units: list[str], landmarks: list[str]) -> np.ndarray:
        """Kernel values, units x landmarks."""
        used = np.unique(np.concatenate([f.ravel() for _, f, _, _ in self.groups(landmarks)]))
        column = np.full(self.size, len(used), dtype=np.int64)
        column[used] = np.arange(len(used))
        table = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
        for rows, feature, value, norm in self.groups(landmarks):
            np.add.at(table, (column[feature], rows[:, None]), value / norm)
        table[-1] = 0
        out = np.zeros((len(units), len(landmarks)), dtype=np.float32)
        for rows, feature, value, norm in self.groups(units):
            value = value / norm
            for at in range(0, len(rows), 64):
                part = slice(at, at + 64)
                out[rows[part]] = np.einsum("us,usm->um", value[part], table[column[feature[part]]])
        return out


def _norms(feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Row norms where equal features, which stand side by side, add up."""
    flat, amount = feature.ravel(), value.ravel()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[:: feature.shape[1]] = True
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(amount, starts)
    first = np.concatenate(([0], np.cumsum(new.reshape(feature.shape).sum(axis=1))[:-1]))
    return np.sqrt(np.add.reduceat(sums * sums, first))


@dataclass
class Model:
    kernel: Kernel
    weight: np.ndarray
    bias: float

    def margins(self, units: list[str]) -> np.ndarray:
        parts, owner = [], []
        for i, unit in enumerate(units):
            for window in _windows(unit):
                parts.append(window)
                owner.append(i)
        value = np.zeros(len(parts), dtype=np.float64)
        for rows, feature, amount, norm in self.kernel.groups(parts):
            value[rows] = np.einsum("us,us->u", amount, self.weight[feature]) / norm[:, 0]
        out = np.full(len(units), -np.inf)
        np.maximum.at(out, np.array(owner, dtype=np.int64), value)
        return out + self.bias


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """L2 SVM with squared hinge loss by Newton steps on the points inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, inside = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        part = x[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + part.T @ x[inside], part.T @ y[inside])
    return w[:-1], float(w[-1])


def _without_copies(texts: list[str]) -> list[int]:
    """Positions of texts that share none of three min-hashes with an earlier one: copies teach nothing."""
    seen: set[tuple[int, int]] = set()
    out = []
    for first, last, hashes, owner in shingles(pa.array(texts, pa.string()), 5):
        for i in range(first, last):
            own = hashes[owner == i - first]
            marks = {(k, int(mix(own ^ np.uint64(k)).min())) for k in range(3)} if len(own) else {(-1, 0)}
            if not marks & seen:
                out.append(i)
            seen |= marks
    return out


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on whole documents and their labels."""
    rng = np.random.default_rng(seed)
    fresh = _without_copies(texts)
    texts, labels = [texts[i] for i in fresh], np.array(labels, dtype=np.int64)[fresh]
    known: dict[str, int] = {}
    bags = []
    for text in texts:
        units = dict.fromkeys(part for w in text_words(text or "") for part in _windows(unit_of(w)))
        bags.append(np.array([known.setdefault(u, len(known)) for u in units if u], dtype=np.int64))
    units = list(known)
    letters: dict[str, int] = {}
    for unit in units:
        for c in unit:
            letters[c] = letters.get(c, 0) + 1
    kernel = Kernel({c: i + 3 for i, c in enumerate(sorted(sorted(letters), key=lambda c: -letters[c])[:ALPHABET])})
    if not units or len(set(labels.tolist())) < 2:
        return Model(kernel, np.zeros(kernel.size, np.float32), -1.0)

    toxic = np.flatnonzero(labels == 1)
    seen = np.zeros((2, len(units)))
    for bag, label in zip(bags, labels):
        seen[label, bag] += 1
    totals = np.bincount(labels, minlength=2)
    rate = (seen + 0.1) / (totals[:, None] + 0.2)
    value = np.log(rate[1] / rate[0]) * np.sqrt(seen[1])
    value[seen[1] == 0] = -np.inf
    clean = np.flatnonzero(seen[0] > 0)
    chance = -np.log(totals[1] / totals.sum())
    sure = np.flatnonzero((seen[1] * chance > SURE) & (seen[0] <= 0.01 * seen[1]))
    weight, bias = None, 0.0
    for _ in range(ROUNDS):
        witness = np.unique([bags[d][np.argmax(value[bags[d]])] for d in toxic if len(bags[d])])
        positive = np.union1d(witness[seen[0, witness] <= 0.02 * seen[1, witness]], sure)
        if not len(positive):
            positive = witness
        hard = clean[np.argsort(-np.where(np.isfinite(value[clean]), value[clean], rng.random(len(clean)) - 10))[:HARD]]
        negative = np.setdiff1d(np.union1d(hard, rng.choice(clean, min(EASY, len(clean)), replace=False)), positive)
        half = LANDMARKS // 2
        common = positive[np.argsort(-seen[1, positive], kind="stable")]
        marks = np.concatenate([common[:half], hard[: half // 2], rng.choice(negative, min(half // 2, len(negative)), replace=False)])
        marks = [units[i] for i in np.unique(marks)]
        inner = kernel.against(marks, marks).astype(np.float64)
        roots, axes = np.linalg.eigh((inner + inner.T) / 2)
        root = (axes / np.sqrt(np.maximum(roots, 1e-4))) @ axes.T  # K_LL^-1/2
        rows = np.concatenate([positive, negative])
        x = kernel.against([units[i] for i in rows], marks) @ root
        y = np.where(np.arange(len(rows)) < len(positive), 1.0, -1.0)
        cost = np.where(y > 0, len(negative) / max(1, len(positive)), 1.0)
        w, bias = _svm(x, y, np.minimum(cost, 30.0))
        alpha = root @ w
        weight = np.zeros(kernel.size, dtype=np.float64)
        for some, feature, amount, norm in kernel.groups(marks):
            np.add.at(weight, feature, amount / norm * alpha[some, None])
        model = Model(kernel, weight.astype(np.float32), bias)
        old, value = value, model.margins(units)
        value[seen[1] == 0] = np.where(np.isfinite(value[seen[1] == 0]), value[seen[1] == 0], -9)
        best = np.unique([bags[d][np.argmax(value[bags[d]])] for d in toxic if len(bags[d])])
        if len(best) == len(witness) and (best == witness).all():
            break
    worst = np.array([value[b].max() if len(b) else -np.inf for b in bags])
    return Model(kernel, weight.astype(np.float32), bias - _cut(worst, labels))


def _cut(worst: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the margins that separate documents with the fewest errors."""
    order = np.argsort(worst)
    worst, labels = worst[order], labels[order]
    # Errors if the cut stands before position i: toxic below it, clean from it on.
    errors = np.concatenate(([0], np.cumsum(labels))) + (labels == 0).sum() - np.concatenate(([0], np.cumsum(labels == 0)))
    inner = np.flatnonzero((errors == errors.min())[1:-1]) + 1
    if not len(inner):
        return 0.0
    finite = np.where(np.isfinite(worst), worst, worst[np.isfinite(worst)].min() if np.isfinite(worst).any() else 0.0)
    gap = finite[inner] - finite[inner - 1]
    at = inner[np.argmax(gap)]
    return float((finite[at] + finite[at - 1]) / 2)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """At most ``SAMPLE_DOCS`` labelled documents per class that aren't held out, in hash order."""
    texts, marks = [], []
    for label, most in SAMPLE_DOCS.items():
        rows = labelled_sample(docs, labels.where(F.col("toxic") == label), most, SAMPLE_CHARS)
        texts += [r["text"] for r in rows]
        marks += [label] * len(rows)
    return texts, marks


_CACHE: dict = {}


def scorer(model: Model):
    """``mapInArrow`` function that adds ``score`` and ``toxic_sentences`` to ``doc_id, text``."""

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _CACHE.get("model") != name:  # a worker process keeps it over its tasks
            _CACHE.update(model=name, units={})
        cache = _CACHE["units"]

        def look_up(words: set[str]) -> None:
            new = [w for w in words if w not in cache]
            if len(cache) + len(new) > CACHE_UNITS:
                cache.clear()
                new = list(words)
            if new:
                cache.update(zip(new, model.margins([unit_of(w) for w in new]).tolist()))

        def worst(words: list[str]) -> float:
            return max(map(cache.__getitem__, words), default=-np.inf)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, sentences = [], []
            for at in range(0, len(texts), 256):
                bags = [text_words(t or "") for t in texts[at : at + 256]]
                look_up(set().union(*bags))
                margins = [worst(bag) for bag in bags]
                scores += margins
                for text, margin in zip(texts[at : at + 256], margins):
                    count = 0
                    if margin >= 0:
                        parts = [text_words(s) for s in _SENTENCE.findall(text)]
                        look_up(set().union(*parts))
                        count = max(1, sum(worst(p) >= 0 for p in parts))
                    sentences.append(count)
            score = 1 / (1 + np.exp(-STEEP * np.clip(np.array(scores, dtype=np.float64), -9, 9)))
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(score), pa.array(sentences, pa.int32())], names=[*names, "score", "toxic_sentences"]
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, toxic_sentences`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scorer(model), f"doc_id {kind}, score double, toxic_sentences int"
    )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Train on the labels and score every document: ``doc_id, held_out, score, predicted, toxic_sentences``."""
    model = fit(*sample(docs, labels))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "toxic_sentences",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score stays below ``threshold``."""
    model = fit(*sample(docs, labels))
    run = scorer(model)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column("text")], names=["text"])
            scored = next(run(iter([narrow])), None)
            if scored is not None and batch.num_rows:
                stay = np.asarray(scored.column("score")) < threshold
                yield batch.filter(pa.array(stay))

    return docs.mapInArrow(kept, docs.schema).select(*names)
