"""Candidates from signature bands, verification and classes: shared by the signature operators.

Nodes are distinct texts, known by 96 bits of their MD5 sum. A *bucket* holds the nodes that agree on
one band. All pairs of a bucket would be too many in a large group of copies, so buckets are compared
as stars, in a few rounds: all members with one centre, another one each time. After each round
linked nodes form classes, and only members of a class other than their centre's are compared further.

What stars can miss is a link of two members that each differ from all centres. So in the end the
pairs of a bucket that stand in different classes are compared too, except for those that an exact
bound rules out. With a centre C, and R(y) the weight of what y shares with any other text but not
with C, |x & y| <= |x & C| + R(y). In a group of copies edited at random R is about 0, so a text that
is too far from C is too far from most others, without a look at them. The rest have to differ from C
in the same places: blocks of them are compared by what C has and they have not (``unlinked_pairs``),
and only pairs that pass the bound are made. Pairs within a class need no look, they can't change it.
Together this gives the same classes as comparing all pairs that share a band by ``verified``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import mix, shingles, stage_table


#: Rounds of stars at any centre, before the one at the text that shares most with all others.
STARS = 1
#: Texts and missing parts of a block in the last round, and parts that a matrix of such a block has at once.
PAIR_ROWS, PAIR_PARTS, PART_COLUMNS = 512, 1 << 19, 4096
#: Bytes of text that missing parts are worked out for at once.
PART_BYTES = 1 << 22


def node_key(text: str | Column) -> Column:
    """The key of a text; null counts as empty."""
    return F.unhex(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 24))


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band; the band's number is part of the key."""
    rows = signature.reshape(len(signature), bands, -1)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2])
        for i in range(rows.shape[2]):
            key = mix(key ^ rows[:, :, i].astype(np.uint64))
    return key.astype(np.int64)


def signed(
    docs: DataFrame, sign: Callable[[np.ndarray, np.ndarray, int], np.ndarray], bands: int, k: int
) -> DataFrame:
    """``node, size, signature, keys`` of every row that has a word, by ``sign(hashes, text_of, n)``.

    ``signature`` holds 32 bits per component, ``size`` is the number of shingles, repeats counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column("node"), batch.column("text")
            for first, last, hashes, owner in shingles(texts, k):
                size = np.bincount(owner, minlength=last - first)
                has = np.flatnonzero(size)
                if not len(has):
                    continue
                signature = sign(hashes, np.searchsorted(has, owner), len(has))
                width = signature.shape[1] * 4
                keys = band_keys(signature, bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        nodes.slice(first, last - first).take(pa.array(has)),
                        pa.array(size[has].astype(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(width), len(has), [None, pa.py_buffer(np.ascontiguousarray(signature))]
                        ).cast(pa.binary()),
                        pa.ListArray.from_arrays(
                            np.arange(len(has) + 1, dtype=np.int32) * bands, keys.reshape(-1)
                        ),
                    ],
                    names=["node", "size", "signature", "keys"],
                )

    return docs.select(node_key("text").alias("node"), "text").mapInArrow(
        run, "node binary, size long, signature binary, keys array<long>"
    )


def agreement(a: str, b: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``agree``: the number of 32-bit components in which two signature columns are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(n, -1)
                for c in (a, b)
            )
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in (a, b)]
            names = [name for name in batch.schema.names if name not in (a, b)]
            agree = (left == right).sum(axis=1).astype(np.int32) if n else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*keep, pa.array(agree)], names=[*names, "agree"])

    def apply(df: DataFrame) -> DataFrame:
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in (a, b))
        return df.mapInArrow(run, f"{kept}, agree int")

    return apply


def counted_texts(texts: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, sorted, and how often it has them."""
    out = []
    for first, last, hashes, owner in shingles(texts, k):
        cuts = np.searchsorted(np.sort(owner), np.arange(last - first + 1))
        order = np.argsort(owner, kind="stable")
        out += [np.unique(hashes[order[i:j]], return_counts=True) for i, j in zip(cuts[:-1], cuts[1:])]
    return out


def overlap(k: int, weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``a, b, both, jaccard`` of pairs: the exact overlap of ``text_a`` and ``text_b``, as multisets or sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, shared = [], []
            known: dict[bytes, tuple] = {}
            for side in "ab":
                nodes = batch.column(side).to_pylist()
                new = list({x: i for i, x in enumerate(nodes) if x not in known}.items())
                if new:
                    picked = batch.column(f"text_{side}").take(pa.array([i for _, i in new]))
                    known.update(zip([x for x, _ in new], counted_texts(picked, k)))
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                (ha, ca), (hb, cb) = known[a], known[b]
                _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                if weighted:
                    both, total = int(np.minimum(ca[ia], cb[ib]).sum()), int(ca.sum() + cb.sum())
                else:
                    both, total = len(ia), len(ha) + len(hb)
                values.append(both / (total - both) if total > both else 0.0)
                shared.append(both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(values, pa.float64())],
                names=["a", "b", "both", "jaccard"],
            )

    return run


def verified(
    pairs: DataFrame, signs: DataFrame, texts: DataFrame, threshold: float, slack: float, components: int,
    k: int, weighted: bool,
) -> DataFrame:
    """The pairs ``a, b`` whose exact overlap reaches ``threshold``, with it.

    Signatures are compared first: a pair that agrees in less than ``slack`` of the components is
    dropped unread. Texts are fetched only for the rest.
    """
    side = {s: signs.select(F.col("node").alias(s), F.col("signature").alias(f"sig_{s}")) for s in "ab"}
    close = agreement("sig_a", "sig_b")(pairs.join(side["a"], "a").join(side["b"], "b"))
    close = stage_table(
        pairs.sparkSession, close.where(F.col("agree") >= int(slack * components)).select("a", "b"), "close"
    )
    return overlaps(close, texts, k, weighted).where(F.col("jaccard") >= threshold)


def overlaps(pairs: DataFrame, texts: DataFrame, k: int, weighted: bool) -> DataFrame:
    side = {s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"}
    found = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "text_a", "text_b")
    return found.mapInArrow(overlap(k, weighted), "a binary, b binary, both long, jaccard double")


def counted_shingles(k: int, weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per node and distinct shingle: ``node, total, shingle, weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes, owner in shingles(batch.column("text"), k):
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                weight = np.diff(np.append(at, len(hashes))) if weighted else np.ones(len(at), dtype=np.int64)
                owner = owner[at]
                total = np.bincount(owner, weights=weight, minlength=last - first).astype(np.int64)
                row = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(row), pa.array(total[owner]),
                        pa.array(hashes[at].astype(np.int64)), pa.array(weight.astype(np.int64)),
                    ],
                    names=["node", "total", "shingle", "weight"],
                )

    return run


def shared_weight(placed: DataFrame, texts: DataFrame, k: int, weighted: bool) -> DataFrame:
    """``node, shared, total``: the weight of a node's shingles that other nodes hold too, and of all."""
    spark = placed.sparkSession
    nodes = placed.select("node").distinct()
    rows = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(
        counted_shingles(k, weighted), "node binary, total long, shingle long, weight long"
    )
    rows = stage_table(spark, rows, "shingles")
    common = rows.groupBy("shingle").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    common = stage_table(spark, common.where(F.col("least") != F.col("most")).select("shingle"), "common")
    return rows.join(common, "shingle", "left_semi").groupBy("node").agg(
        F.sum("weight").alias("shared"), F.first("total").alias("total")
    )


def classes(spark: SparkSession, links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``node, root`` of every linked node: the smallest node that it is connected with.

    ``labels`` are the classes of earlier links, which ``links`` may connect. Every node with a link takes
    its smallest neighbour as its top, then its top's top until nothing moves. The links left are those
    between tops, of which there are half as many as nodes at most. So a class of n nodes is done in
    log n rounds at most, and a link within a class is read in one round only. Each step is a written table.
    """
    pairs = links.select("a", "b").distinct()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("root"))
    else:
        pairs = between(pairs, labels, "left")
        new = nodes.join(labels, "node", "left_anti")
        labels = labels.union(new.select("node", F.col("node").alias("root")))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b"))
    both = stage_table(spark, both.distinct(), "links")
    labels = stage_table(spark, labels, "labels")
    while not both.isEmpty():
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        tops = stage_table(spark, least.select("node", F.least("node", "least").alias("root")), "tops")
        while True:
            jump = tops.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            moved = tops.join(jump, "root").select("node", F.col("beyond").alias("root"), F.col("root").alias("old"))
            moved = stage_table(spark, moved, "tops")
            tops = moved.select("node", "root")
            if moved.where(F.col("root") != F.col("old")).isEmpty():
                break
        risen = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
        risen = labels.join(risen, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        labels = stage_table(spark, risen, "labels")
        both = stage_table(spark, between(both, tops, "inner"), "links")
    return labels


def between(pairs: DataFrame, labels: DataFrame, how: str) -> DataFrame:
    """The pairs ``a, b`` as pairs of different roots, once each."""
    for side in "ab":
        root = labels.select(F.col("node").alias(side), F.col("root").alias("top"))
        pairs = pairs.join(root, side, how).withColumn(side, F.coalesce("top", side)).drop("top")
    return pairs.where(F.col("a") != F.col("b")).select("a", "b").distinct()


def near_classes(
    docs: DataFrame, signs: DataFrame, threshold: float, slack: float, components: int, k: int, weighted: bool
) -> DataFrame:
    """``node, root`` of all nodes that have a link; ``signs`` has one row per node and is read often."""
    spark = docs.sparkSession
    members = signs.select("node", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    buckets = stage_table(spark, buckets.where(F.col("least") != F.col("most")).select("key"), "buckets")
    members = stage_table(spark, members.join(buckets, "key"), "members")
    # Texts of all members, once. Always a merge join: the members grow with the corpus.
    needed = members.select("node").distinct().hint("merge")
    texts = docs.select(node_key("text").alias("node"), "text").join(needed, "node", "left_semi")
    texts = stage_table(spark, texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    check = lambda pairs: verified(pairs, signs, texts, threshold, slack, components, k, weighted)
    members = members.select("key", "node")
    labels = None

    mixed = mixed_roots
    def rooted(rows: DataFrame) -> DataFrame:
        rows = rows.select("key", "node")
        if labels is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))

    placed = members
    for number in range(STARS):
        placed = stage_table(spark, mixed(rooted(placed)), "placed")
        first = F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "root")).alias("c")
        centres = placed.groupBy("key").agg(first).select("key", F.col("c.node").alias("a"), F.col("c.root").alias("top"))
        stars = placed.join(centres, "key").where(F.col("root") != F.col("top")).select("a", F.col("node").alias("b"))
        found = stage_table(spark, check(stars.distinct()), "links").select("a", "b")
        if number and found.isEmpty():
            continue
        labels = classes(spark, found, labels)

    placed = stage_table(spark, mixed(rooted(placed)), "placed")
    if placed.isEmpty():
        return labels
    placed = stage_table(spark, placed.join(shared_weight(placed, texts, k, weighted), "node"), "placed")
    best = F.max(F.struct("shared", F.xxhash64("node").alias("h"), "node")).alias("c")
    centres = placed.groupBy("key").agg(best, F.min("total").alias("least"))
    centres = centres.select("key", "least", F.col("c.node").alias("a"))
    placed = stage_table(spark, placed.withColumnRenamed("node", "b").join(centres, "key"), "placed")
    pairs = stage_table(spark, placed.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "centred")
    both = stage_table(spark, overlaps(pairs, texts, k, weighted), "overlaps")
    found = both.where(F.col("jaccard") >= threshold).select("a", "b")
    if not found.isEmpty():
        labels = classes(spark, found, labels)
    known = rooted(placed.select("key", F.col("b").alias("node"))).select("key", F.col("node").alias("b"), "root")
    placed = mixed(placed.drop("root").join(known.distinct(), ["key", "b"]))
    placed = placed.join(both.select("a", "b", "both"), ["a", "b"], "left").withColumn("both", F.coalesce("both", "total"))
    placed = stage_table(spark, placed.withColumn("extra", F.col("shared") - F.least("shared", "both")), "placed")  # R
    rest = stage_table(spark, unlinked_pairs(placed, texts, threshold, k, weighted), "rest")
    if rest.isEmpty():
        return labels
    more = stage_table(spark, check(rest), "links").select("a", "b")
    return labels if more.isEmpty() else classes(spark, more, labels)


def unlinked_pairs(placed: DataFrame, texts: DataFrame, threshold: float, k: int, weighted: bool) -> DataFrame:
    """``a, b``: all pairs of different classes under one centre that may be linked, by an exact bound.

    ``placed`` is ``key, a, b, root, total, least, shared, both, extra`` of the members b of buckets with
    centre a, both is what they share with it. Let D(x) be what the centre C has and x has not, d its weight
    and R as above. As |x & y| <= |C| - d(x) - d(y) + |D(x) & D(y)| + min(R(x), R(y)), a link needs

        |D(x) & D(y)| >= s (|x| + |y|) - |C| + d(x) + d(y) - min(R(x), R(y)),  s = t / (1 + t).

    At least one of the two isn't linked with C, as they stand in different classes. These and all members
    of a centre are cut into blocks of ``PAIR_ROWS``; a task takes two blocks, has the overlaps of all D in
    them as one matrix product, and returns the pairs that pass.
    """
    spark = placed.sparkSession
    s = threshold / (1 + threshold)
    middle = placed.where(F.col("a") == F.col("b")).select("a", F.col("total").alias("size"), F.col("root").alias("top"))
    # The smallest overlap that a link of x needs, as its partner is neither smaller than any in the
    # bucket nor than J allows; a text that shares less than that with all others has none.
    floor = s * (F.col("total") + F.greatest(F.col("least"), threshold * F.col("total")))
    rows = mixed_roots(placed.where(F.col("shared") >= floor - 1e-6)).join(middle.distinct(), "a")
    rows = rows.select("a", "b", "root", "total", "shared", "both", "extra", "size", "top").distinct()
    linked = F.col("root") == F.col("top")
    # Equal to the centre in all parts: as far from every other text as the centre is, so without a link.
    same = linked & (F.col("both") == F.col("size")) & (F.col("both") == F.col("total")) & (F.col("extra") == 0)
    rows = stage_table(spark, rows.where(~same).withColumn("linked", linked).drop("top"), "bounded")
    side = {c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"}
    read = rows.select("a", "b").join(side["a"], "a").join(side["b"], "b").select("a", "b", "text_a", "text_b")
    parts = read.mapInArrow(missing_parts(k, weighted), "a binary, b binary, parts array<long>")
    rows = stage_table(spark, parts.join(rows, ["a", "b"]), "parts")
    alone, size = ~F.col("linked"), F.size("parts")
    blocks = rows.groupBy("a").agg(
        F.ceil(F.greatest(F.count(F.when(alone, 1)) / PAIR_ROWS, F.sum(F.when(alone, size)) / PAIR_PARTS)).cast("int").alias("left_blocks"),
        F.ceil(F.greatest(F.count(F.lit(1)) / PAIR_ROWS, F.sum(size) / PAIR_PARTS)).cast("int").alias("right_blocks"),
    )
    blocks = stage_table(spark, blocks.where("left_blocks > 0"), "blocks")
    block = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = rows.join(blocks, "a")
    left = cut.where(alone).select(*rows.columns, block("left_blocks").alias("i"), copies("right_blocks").alias("j"))
    again = [F.col(c).alias(c) for c in rows.columns]  # columns of their own, as both sides are one table
    right = cut.select(*again, block("right_blocks").alias("j"), copies("left_blocks").alias("i"))
    met = left.groupBy("a", "i", "j").cogroup(right.groupBy("a", "i", "j"))
    return met.applyInArrow(possible_links(s), "a binary, b binary").distinct()


def possible_links(s: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``a, b``: the pairs of two blocks under one centre that the bound leaves."""
    none = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})

    def columns(rows: pa.Table) -> tuple:
        parts = rows.column("parts").combine_chunks()
        if isinstance(parts, pa.ChunkedArray):
            parts = pa.concat_arrays(parts.chunks)
        number = lambda c: np.asarray(rows.column(c)).astype(np.float64)
        return parts.flatten().to_numpy(), np.asarray(pc.list_value_length(parts)), *map(number, ("total", "shared", "both", "extra"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        (px, nx, tx, hx, bx, rx), (py, ny, ty, hy, by, ry) = columns(left), columns(right)
        size = left.column("size")[0].as_py()
        known, place = np.unique(np.concatenate([px, py]), return_inverse=True)
        at_x, at_y = place[: len(px)], place[len(px) :]
        row_x, row_y = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
        shared = np.zeros((len(nx), len(ny)), dtype=np.float32)
        for first in range(0, len(known), PART_COLUMNS):
            dense = []
            for at, row, n in ((at_x, row_x, len(nx)), (at_y, row_y, len(ny))):
                here = (at >= first) & (at < first + PART_COLUMNS)
                m = np.zeros((n, min(PART_COLUMNS, len(known) - first)), dtype=np.float32)
                m[row[here], at[here] - first] = 1.0
                dense.append(m)
            shared += dense[0] @ dense[1].T
        needed = s * (tx[:, None] + ty[None, :])
        most = size - (size - bx)[:, None] - (size - by)[None, :] + shared + np.minimum(rx[:, None], ry[None, :])
        most = np.minimum(most, np.minimum(hx[:, None], hy[None, :]))
        x, y = np.nonzero(most >= needed - 1e-6)
        nodes_x, nodes_y = left.column("b").to_pylist(), right.column("b").to_pylist()
        roots_x, roots_y = left.column("root").to_pylist(), right.column("root").to_pylist()
        linked = right.column("linked").to_pylist()
        pairs = [
            (min(nodes_x[i], nodes_y[j]), max(nodes_x[i], nodes_y[j])) for i, j in zip(x.tolist(), y.tolist())
            if roots_x[i] != roots_y[j] and (linked[j] or nodes_x[i] < nodes_y[j])
        ]
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.binary()), "b": pa.array([q for _, q in pairs], pa.binary())})

    return run


def mixed_roots(rows: DataFrame) -> DataFrame:
    """Rows of buckets in which classes meet."""
    roots = rows.groupBy("key").agg(F.min("root").alias("lowest"), F.max("root").alias("highest"))
    return rows.join(roots.where(F.col("lowest") != F.col("highest")).select("key"), "key")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of pairs in pieces of about ``PART_BYTES`` of text, one row at least."""
    sizes = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text_a", "text_b"))
    total, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + PART_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def missing_parts(k: int, weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``a, b, parts``: what ``text_a`` has and ``text_b`` has not, by a hash of the shingle and its repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            known: dict[bytes, tuple] = {}
            for side in "ab":
                nodes = batch.column(side).to_pylist()
                new = list({x: i for i, x in enumerate(nodes) if x not in known}.items())
                if new:
                    picked = batch.column(f"text_{side}").take(pa.array([i for _, i in new]))
                    known.update(zip([x for x, _ in new], counted_texts(picked, k)))
            parts = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                (ha, ca), (hb, cb) = known[a], known[b]
                if not weighted:
                    ca, cb = np.ones(len(ca), np.int64), np.ones(len(cb), np.int64)
                at = np.minimum(np.searchsorted(hb, ha), max(0, len(hb) - 1))
                has = np.where(hb[at] == ha, cb[at], 0) if len(hb) else np.zeros(len(ha), np.int64)
                short = np.maximum(ca - has, 0)
                owner = np.repeat(np.arange(len(ha)), short)
                # The number of a repeat, counted down from the centre's count.
                repeat = np.arange(len(owner)) - np.repeat(np.cumsum(short) - short, short)
                with np.errstate(over="ignore"):
                    code = mix(ha[owner] + (ca[owner] - repeat).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                parts.append(code.astype(np.int64))
            ends = np.cumsum([0, *map(len, parts)])
            flat = np.concatenate([np.zeros(0, np.int64), *parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["a", "b", "parts"],
            )

    return run
