"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three parts, which are composed with each text. The *normaliser* rewrites
characters (a space becomes U+2581) and puts one space in front. The *piece transducer* reads the
characters of a piece and writes its number; where a character is spelt by no piece, its one arc is the
*byte fallback*, which writes the numbers of its bytes. A unigram model weighs a piece by minus its score. A
merge (BPE) model has no such weights: there, two pieces may stand side by side only if merging their
joined text gives back just these two, and a text has exactly one sequence in which all neighbours may
stand so. So the third part is a *bigram acceptor* with weight 0 for allowed pairs and infinity for
others; states of the composition carry the last piece. Encoding takes the path of least weight in the
tropical semiring (min, +).

States of the composition are made as the search reaches them. With weights 0 and infinity the least path
is the one finite path: it is searched depth first, the longest piece first, and a place from which no
finite path leads on is never entered again, so the search is linear in the length of the text. With
weights of their own, places are relaxed from left to right. No piece has U+2581 after another character,
so all paths pass the places before runs of spaces, and a worker keeps the paths between two such places.

Defined results: a null text counts as empty; an empty text has no pieces; repeated rows are encoded alike
and stay; an empty table gives none; a text of one very long word takes time in proportion to its length;
columns of ``docs`` named as an output are replaced, all others stay. Decoding gives back every text exactly,
except that a literal U+2581 in it comes back as a space.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6
#: Words whose paths a worker keeps, their characters in all, and pairs of pieces; texts taken together.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS, BATCH_TEXTS = 300_000, 4_000_000, 1_000_000, 512
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Transducer:
    """A compiled model; ``ids`` finds a piece's number by its text. ``rewrites`` are the normaliser's arcs."""

    pieces: list[str]
    kinds: list[int]
    cost: list[float]
    merges: bool
    dummy_prefix: bool
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    rewrites: list[tuple[str, str]] = field(default_factory=lambda: [(" ", SPACE)])
    # All beginnings of pieces, with the piece's number or -1; by piece, the longest piece it begins with.
    trie: dict[str, int] = field(default_factory=dict)
    shorter: list[int] = field(default_factory=list)
    # For merge models: ranks of pieces, the two parts that a piece is merged from, and the ranks of all
    # pairs that merge, by left number times the number of pieces plus right number.
    rank: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    pairs: dict[int, int] = field(default_factory=dict)


def compile_model(data: bytes) -> Transducer:
    """Compile the bytes of a model file."""
    pieces, scores, kinds, model, prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
        elif number == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only models that keep characters and all white space are supported")
    if model not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model} is not supported")
    t = Transducer(pieces, kinds, [-x for x in scores], model == BPE, prefix)
    t.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
    t.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
    t.unknown = kinds.index(2)
    if t.merges:
        _compile_merges(t, scores)
    t.shorter = [-1] * len(pieces)
    for piece, i in t.ids.items():
        # Merging starts from single characters, so a piece of others never comes about.
        if t.merges and not all(c in t.ids for c in piece):
            continue
        for end in range(1, len(piece)):
            part = piece[:end]
            known = t.trie.setdefault(part, t.ids.get(part, -1))
            if known >= 0:
                t.shorter[i] = known
        t.trie[piece] = i
    return t


def _compile_merges(t: Transducer, scores: list[float]) -> None:
    n = len(t.pieces)
    # Single characters come before all merges; merges in order of score, best first.
    order = sorted(t.ids.values(), key=lambda i: (len(t.pieces[i]) > 1, -scores[i], i))
    t.rank = [n] * n
    for place, i in enumerate(order):
        t.rank[i] = place
    t.left, t.right = list(range(n)), list(range(n))
    for i in order:
        piece = t.pieces[i]
        for c in range(1, len(piece)):
            a, b = t.ids.get(piece[:c]), t.ids.get(piece[c:])
            if a is not None and b is not None:
                t.pairs[a * n + b] = t.rank[i]
        at = _last_merge(t, piece) if len(piece) > 1 else 0
        if at:
            t.left[i], t.right[i] = t.ids[piece[:at]], t.ids[piece[at:]]


def merged(t: Transducer, text: str) -> list[str]:
    """Pieces of a text by merging, best pair first: the definition that the transducer has to meet."""
    parts = list(text)
    while len(parts) > 1:
        best = min(
            ((t.rank[t.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in t.ids),
            default=None,
        )
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _last_merge(t: Transducer, piece: str) -> int:
    """Where the two parts meet that are merged last when the piece is spelt; 0 if merging doesn't give it."""
    parts = list(piece)
    while len(parts) > 2:
        best = min(
            ((t.rank[t.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in t.ids),
            default=None,
        )
        if best is None:
            return 0
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts[0]) if len(parts) == 2 else 0


def allowed(t: Transducer, left: int, right: int) -> bool:
    """The bigram acceptor: whether merging keeps the boundary between two pieces.

    Going back through the merges of both pieces, latest first, no pair of the pieces that touch at the
    boundary may merge before the next step.
    """
    n, rank, limit = len(t.pieces), t.rank, 2 * len(t.pieces)
    while True:
        merge = t.pairs.get(left * n + right)
        if merge is not None and 2 * merge < limit:
            return False
        # The later of the two merges is undone. At equal rank the left one was made first, so it is
        # the right piece that is undone.
        a = 2 * rank[left] if t.left[left] != left else -1
        b = 2 * rank[right] + 1 if t.left[right] != right else -1
        if a < 0 and b < 0:
            return True
        if a > b:
            left, limit = t.right[left], a
        else:
            right, limit = t.left[right], b


class Encoder:
    """Composes texts with a transducer; keeps the paths of words and the pairs it has looked at."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.spelling = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
            for p, k in zip(transducer.pieces, transducer.kinds)
        ]
        self.lengths = list(map(len, transducer.pieces))
        # The weight of a fallback arc: more than any piece's, by what the format's own programs add.
        self.unspelt = max((transducer.cost[i] for i in transducer.ids.values()), default=0.0) + 10.0
        self.words: dict[str, list[int]] = {}
        self.chars = 0
        self.pairs: dict[int, bool] = {}
        self.path = self._only_path if transducer.merges else self._least_path

    def split(self, text: str) -> list[str]:
        """The normalised text, cut before each run of spaces."""
        if not text:
            return []
        for read, written in self.t.rewrites:
            text = text.replace(read, written)
        if self.t.dummy_prefix:
            text = SPACE + text
        if text[0] == SPACE and text[-1] != SPACE and SPACE * 2 not in text:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return _WORDS.findall(text)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts one after another, and how many each text has."""
        flat, sizes, known = [], [], self.words
        for text in texts:
            begin = len(flat)
            for word in self.split(text or ""):
                path = known.get(word)
                if path is None:
                    path = self._learn(word)
                flat += path
            sizes.append(len(flat) - begin)
        return np.array(flat, dtype=np.int32), np.array(sizes, dtype=np.int64)

    def _learn(self, word: str) -> list[int]:
        path = self.path(word)
        if len(word) <= CACHE_CHARS // 100:
            if len(self.words) >= CACHE_WORDS or self.chars >= CACHE_CHARS:
                self.words.clear()
                self.chars = 0
            self.words[word] = path
            self.chars += len(word)
        return path

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        flat, sizes = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(texts) else []

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.t.dummy_prefix and text.startswith(" ") else text

    def _fallback(self, char: str) -> list[int]:
        """The arc of a character that no piece spells."""
        known = self.t.byte_ids
        return [known[b] for b in char.encode(errors="surrogatepass")] if known else [self.t.unknown]

    def _only_path(self, word: str) -> list[int]:
        """The one path of finite weight, depth first. A state is a place and the piece that ends there."""
        t, pairs = self.t, self.pairs
        trie, shorter, sizes, n = t.trie.get, t.shorter, self.lengths, len(t.pieces)
        if len(pairs) >= CACHE_PAIRS:
            pairs.clear()
        end, at, last = len(word), 0, -1
        arcs, places, dead = [], [], set()
        while at < end:
            piece, stop = -1, at + 1
            while stop <= end:
                known = trie(word[at:stop])
                if known is None:
                    break
                if known >= 0:
                    piece = known
                stop += 1
            if piece < 0:  # the fallback is the only arc, and any piece may stand beside it
                arcs.append(self._fallback(word[at]))
                places.append(at)
                at, last = at + 1, -1
                continue
            while True:
                while piece >= 0:
                    stop = at + sizes[piece]
                    if stop not in dead:
                        if last < 0:
                            break
                        key = last * n + piece
                        fits = pairs.get(key)
                        if fits is None:
                            fits = pairs[key] = allowed(t, last, piece)
                        if fits:
                            break
                    piece = shorter[piece]
                if piece >= 0:
                    break
                # Nothing leads on from here: back to the arc before, and on with its next shorter piece.
                dead.add(at)
                if not arcs:
                    raise ValueError("a text has no path: the model's pieces don't fit together")
                arc, at = arcs.pop(), places.pop()
                piece = shorter[arc] if type(arc) is int else -1
                last = arcs[-1] if arcs and type(arcs[-1]) is int else -1
            arcs.append(piece)
            places.append(at)
            at, last = stop, piece
        return [i for arc in arcs for i in ((arc,) if type(arc) is int else arc)]

    def _least_path(self, word: str) -> list[int]:
        """The path of least weight, place by place."""
        trie, ids, cost = self.t.trie.get, self.t.ids, self.t.cost
        end = len(word)
        best, back = [0.0] + [float("inf")] * end, [None] * (end + 1)
        for at in range(end):
            if word[at] not in ids and best[at] + self.unspelt < best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + self.unspelt, (at, self._fallback(word[at]))
            for stop in range(at + 1, end + 1):
                piece = trie(word[at:stop])
                if piece is None:
                    break
                if piece >= 0 and best[at] + cost[piece] < best[stop]:
                    best[stop], back[stop] = best[at] + cost[piece], (at, [piece])
        out, at = [], end
        while at:
            at, arc = back[at]
            out.append(arc)
        return [i for arc in reversed(out) for i in arc]


_ENCODERS: dict[str, Encoder] = {}


def load(spark: SparkSession, path: str = MODEL) -> Transducer:
    """Compile the model file, which the driver reads."""
    with open(path, "rb") as file:
        return compile_model(file.read())


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns of ``docs`` with ``ids``, ``n_tokens``, ``n_bytes`` (byte-fallback tokens) and ``lossless``.

    ``lossless`` tells whether decoding the ids gave the text back. Columns of these names in ``docs``
    are replaced.
    """
    spark = docs.sparkSession
    added = ("ids", "n_tokens", "n_bytes", "lossless")
    own = [c for c in docs.columns if c not in added]
    shared = spark.sparkContext.broadcast(load(spark, path))  # bounded by the vocabulary
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:  # a worker process keeps it over its tasks
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(shared.value)
        encoder = _ENCODERS[name]
        is_byte = np.array([k == BYTE for k in encoder.t.kinds])
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                texts = part.column("text").to_pylist()
                flat, sizes = encoder.encode_flat(texts)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                total = np.concatenate(([0], np.cumsum(is_byte[flat])))
                bytes_of = total[ends[1:]] - total[ends[:-1]]
                ids = flat.tolist()
                same = [encoder.decode(ids[i:j]) == (t or "") for i, j, t in zip(ends[:-1], ends[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                        pa.array(sizes), pa.array(bytes_of.astype(np.int64)), pa.array(same),
                    ],
                    names=[*own, *added],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return docs.select(*own).mapInArrow(run, f"{kept}, ids array<int>, n_tokens long, n_bytes long, lossless boolean")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns of ``rows`` with ``decoded``, the text of ``ids``; null ids count as none."""
    shared = rows.sparkSession.sparkContext.broadcast(load(rows.sparkSession, path))
    own = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*own, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
    return rows.select(*own).mapInArrow(run, f"{kept}, decoded string")
