"""BagMinHash near-duplicates: weighted Jaccard of shingle multisets from Poisson-process signatures.

Every shingle owns one random point process over weight x time. The weight axis is cut into the
regions [0, 1), [1, 2), [2, 4), [4, 8), ...; each region is a Poisson process of its own, seeded by
the shingle and the region, whose points carry a position in the region and one of the signature's
components. A text whose shingle has weight w sees the points with a position below w: regions wholly
above w are never opened, those cut by w are thinned. A component of the signature is the earliest
point that the text sees, so two texts agree in a component with the probability of their weighted
Jaccard similarity. Points are made in order of time and only up to a bound that fills all components
with high probability; a text with an empty component is done again with a later bound, which changes
no point, so the signature doesn't depend on the bound.

Null texts count as empty. Equal texts are one class, texts without words too if they are equal.
Texts of fewer than ``k`` words are one shingle. Repeated rows and equal ids stay rows of their own, in one
class where their texts are linked; very long texts are read whole, in pieces; an empty table gives no row;
all columns pass in ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import mix, stage_table
from broadsheet.llm.neardup import near_classes, node_key, signed

K = 5
THRESHOLD = 0.8
#: 25 bands of 5: two texts with similarity 0.8 share a band with probability 0.99995.
BANDS, ROWS = 25, 5
#: Pairs that agree in fewer than this share of the components aren't read: of those with similarity 0.8
#: or more these are fewer than one in 10^9.
SLACK = 0.56
_UNIT = 2.0**-53
_STEP, _TAG = np.uint64(0xD1342543DE82EF95), np.uint64(0x5851F42D4C957F2D)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def bagminhash(hashes: np.ndarray, text_of: np.ndarray, n: int, m: int, spare: float = 4.0) -> np.ndarray:
    """Signatures, ``n`` x ``m`` of 32 bits, of ``n`` multisets given as (hash, text) with repeats."""
    with np.errstate(over="ignore"):
        order = np.argsort(mix(hashes ^ (text_of.astype(np.uint64) * _STEP)))
    hashes, text_of = hashes[order], text_of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(hashes))).astype(np.float64)
    hashes, text_of = hashes[at], text_of[at]
    total = np.bincount(text_of, weights=weight, minlength=n)

    regions, low, width = [], 0.0, 1.0
    while True:
        inside = np.flatnonzero(weight > low)
        if not len(inside):
            break
        with np.errstate(over="ignore"):
            seed = mix(hashes[inside] ^ (np.uint64(len(regions) + 1) * _STEP))
        regions.append((seed, text_of[inside], weight[inside] - low, np.full(len(inside), width)))
        low, width = low + width, max(1.0, low + width)
    seed, owner, room, width = (np.concatenate(x) for x in zip(*regions))

    out = np.zeros((n, m), dtype=np.uint32)
    todo = np.arange(n)
    while len(todo):
        bound = m * (np.log(m) + spare) / total
        slot, time, tag = _points(seed, owner, room, width, bound, m)
        least = np.full(n * m, np.inf)
        np.minimum.at(least, slot, time)
        first = time == least[slot]
        filled = np.isfinite(least.reshape(n, m)[todo]).all(axis=1)
        out.reshape(-1)[slot[first]] = tag[first]
        todo, spare = todo[~filled], spare + 6.0
        if len(todo):
            again = np.zeros(n, dtype=bool)
            again[todo] = True
            again = again[owner]
            seed, owner, room, width = seed[again], owner[again], room[again], width[again]
    return out


def _points(seed, owner, room, width, bound, m):
    """Slot, time and tag of all points below the texts' time bounds that the texts see."""
    slots, times, tags = [], [], []
    time, scale = np.zeros(len(seed)), -1.0 / width
    limit = bound[owner]
    with np.errstate(over="ignore"):
        while len(seed):
            seed = seed + _STEP
            time = time + np.log(_uniform(mix(seed))) * scale
            alive = np.flatnonzero(time <= limit)
            if len(alive) < len(seed):
                seed, owner, room, scale, time, limit = (x[alive] for x in (seed, owner, room, scale, time, limit))
            bits = mix(seed ^ _TAG)
            slot = owner * m + ((bits >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            # Regions of weight 1 that are seen at all are seen whole; others are thinned.
            part = np.flatnonzero(room + 1.0 / scale < 0.0)
            seen = np.ones(len(seed), dtype=bool)
            seen[part] = _uniform(mix(bits[part])) * (-1.0 / scale[part]) < room[part]
            if len(part):
                slots.append(slot[seen])
                times.append(time[seen])
                tags.append(bits[seen].astype(np.uint32))
            else:
                slots.append(slot)
                times.append(time)
                tags.append(bits.astype(np.uint32))
    return np.concatenate(slots), np.concatenate(times), np.concatenate(tags)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """``node, size, signature, keys``: one row per distinct text that has a word."""
    m = bands * rows
    signs = signed(docs, lambda hashes, text_of, n: bagminhash(hashes, text_of, n, m), bands, k)
    return signs.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "signature", "keys")))


def _placed(docs: DataFrame, threshold: float, bands: int, rows: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` of every row, and ``node, class_id, chosen`` of every distinct text.

    ``chosen`` marks the text whose row stays: the smallest node among those that hold the class's id.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signs = stage_table(spark, signatures(docs, bands, rows, k), "signatures")
    labels = near_classes(docs, signs, threshold, SLACK, bands * rows, k, weighted=True)
    keyed = stage_table(spark, docs.select("doc_id", node_key("text").alias("node")), "keyed")
    nodes = keyed.groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first")
    named = placed.groupBy("root").agg(first)
    owner = placed.join(named, "root").select(
        "node", F.col("first.least").alias("class_id"), (F.col("node") == F.col("first.node")).alias("chosen")
    )
    return keyed, owner


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = K
) -> DataFrame:
    """``doc_id, class_id, kept`` of every row: classes of texts linked by similarity ``threshold`` or more.

    ``class_id`` is the smallest ``doc_id`` of the class, null where no row of it has an id. The row
    with that id is ``kept``. Repeated rows stay repeated here.
    """
    keyed, owner = _placed(docs, threshold, bands, rows, k)
    kept = F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return keyed.join(owner, "node").select("doc_id", "class_id", kept.alias("kept"))


def keep_one(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = K
) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each class stays, with all its columns."""
    keyed, owner = _placed(docs, threshold, bands, rows, k)
    chosen = owner.where("chosen").select(F.col("node").alias("_node"), F.col("class_id").alias("_id"))
    times = (
        keyed.join(chosen, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .groupBy("_node", "_id").agg(F.count(F.lit(1)).alias("_times"))
    )
    row = F.struct(*docs.columns).alias("row")  # so that no column of the documents clashes
    docs = docs.select(row, node_key("text").alias("_key"), F.col("doc_id").alias("_doc"))
    same = (F.col("_key") == F.col("_node")) & F.col("_doc").eqNullSafe(F.col("_id"))
    once = docs.join(times.where("_times = 1"), same, "left_semi")
    repeated = docs.join(times.where("_times > 1"), same, "left_semi").dropDuplicates(["_key", "_doc"])
    return once.union(repeated).select("row.*")
