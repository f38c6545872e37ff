"""Nearest neighbours by cosine distance: exact, double precision, rounded to six places.

Three shapes, chosen by the size of the query side:

* one query vector: a literal in a column expression, filtered scan, top-k. No shuffle of vectors.
* a bounded table of query vectors (measured): sent to all tasks; every task keeps its best k per
  query while it streams its part of the corpus, and only those rows are shuffled.
* a large table: both sides fall into cells around sampled pivots. A query is compared with its own
  cell, then with the cells that its k-th distance so far can reach, by the triangle inequality. For that
  cells are packed into blocks of bounded size and each pair of blocks is one task, so a query travels once
  per block that it reaches, not once per cell. Where vectors have no structure, as random ones in many
  dimensions, bounds rule nothing out and all pairs are looked at.

Query and corpus sides are ``(key, vector)``; results are ``(query key, ord, distance)``. Queries may carry
filter lists, which apply before the distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.skew import top_per_key
from broadsheet.sources.store import scratch_table

PLACES = 6
QUERY_BYTES = 32 * 1024 * 1024
#: A pair of blocks of so many 64-dimensional vectors takes some 100 MB of a Python worker.
BLOCK_ROWS = 1 << 15
#: Pivots of a large join: the square root of the rows, at most so many.
MAX_PIVOTS = 1024


# --- one query ---------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def vector_literal(vector: list[float]) -> Column:
    """The query vector at float precision, as the corpus stores it."""
    floats = [float(x) for x in np.asarray(vector, dtype=np.float32)]
    return F.lit(np.asarray(floats, dtype=np.float64))


def distance_to(vector: list[float]) -> Column:
    """Rounded cosine distance of the ``vector``/``norm`` columns to a constant vector."""
    as_float = np.asarray(vector, dtype=np.float32).astype(np.float64)
    query = vector_literal(vector)
    length = F.col("norm") * float(np.sqrt(as_float @ as_float))
    raw = 1.0 - dot(F.col("vector"), query) / F.nullif(length, F.lit(0.0))
    value = F.round(raw, PLACES)
    value = F.when(value == 0, 0.0).otherwise(value)
    # Without a direction there is no distance.
    return F.when((F.col("norm") > 0) & F.lit(bool(as_float.any())), value)


def by_distance() -> list[Column]:
    return [F.asc("distance"), F.asc("ord")]


def nearest_to(vectors: DataFrame, vector: list[float], k: int) -> DataFrame:
    """``(ord, distance)`` of the k nearest rows of ``vectors``, which may be filtered before."""
    return (
        vectors.select("ord", distance_to(vector).alias("distance"))
        .where("distance IS NOT NULL")
        .orderBy(*by_distance())
        .limit(k)
    )


# --- many queries ------------------------------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / length[:, None]


class _Allowed:
    """Which corpus rows each query may see, by its category and source lists; empty lists allow all.

    Queries with equal lists share one row of the table, and values are looked up once per step.
    """

    def __init__(self, categories: list, sources: list):
        pairs = [(frozenset(c), frozenset(s)) for c, s in zip(categories, sources, strict=True)]
        self.kinds = list(dict.fromkeys(pairs))
        place = {kind: i for i, kind in enumerate(self.kinds)}
        self.kind_of_query = np.array([place[p] for p in pairs], dtype=np.int64)

    def rows(self, part: pa.RecordBatch | pa.Table) -> np.ndarray:
        category_code, categories = pd.factorize(np.array(part.column("category_tag").to_pylist()))
        tags = pd.Series([tuple(v or ()) for v in part.column("source_tags").to_pylist()])
        source_code, sources = pd.factorize(tags)
        by_kind = np.array(
            [
                np.array([not c or v in c for v in categories])[category_code]
                & np.array([not s or not s.isdisjoint(v) for v in sources])[source_code]
                for c, s in self.kinds
            ]
        )
        return by_kind[self.kind_of_query]


class _Best:
    """Running best k per query over steps of corpus rows, ordered by (distance, ord).

    A step is screened by one product in single precision against the k-th best so far, less the error
    that such a product can have; only pairs that pass are worked out in double precision.
    """

    def __init__(self, keys: np.ndarray, units: np.ndarray, k: int, rule: str, bounds: np.ndarray | None = None):
        """``bounds``: distances that each query's k-th neighbour doesn't pass, where known."""
        self.keys, self.units, self.k, self.rule = keys, units, k, rule
        self.single = units.astype(np.float32)
        self.slack = 4e-6 + 2.0**-23 * (units.shape[1] if units.ndim == 2 else 0)
        self.least = np.full(len(keys), -np.inf)
        if bounds is not None:
            self.least = np.where(np.isnan(bounds), -np.inf, 1.0 - bounds)
        self.query = np.zeros(0, dtype=np.int64)
        self.distance = np.zeros(0)
        self.ord = np.zeros(0, dtype=np.int64)

    def add(
        self, ords: np.ndarray, units: np.ndarray, allowed: np.ndarray | None = None,
        chosen: np.ndarray | None = None,
    ) -> None:
        """``chosen``: the places of the queries that may have a neighbour among these rows; None means all."""
        keys = self.keys if chosen is None else self.keys[chosen]
        if not len(ords) or not len(keys):
            return
        found = (self.single if chosen is None else self.single[chosen]) @ units.astype(np.float32).T
        if self.rule == "not_self":
            found[keys[:, None] == ords[None, :]] = -np.inf
        elif self.rule == "earlier":
            found[ords[None, :] >= keys[:, None]] = -np.inf
        if allowed is not None:
            found[~(allowed if chosen is None else allowed[chosen])] = -np.inf
        least = self.least if chosen is None else self.least[chosen]
        open_ended = np.flatnonzero(~np.isfinite(least))
        if len(open_ended) and found.shape[1] > self.k:
            near = -np.partition(-found[open_ended], self.k - 1, axis=1)[:, self.k - 1]
            least = least.copy()
            least[open_ended] = near
        query, row = np.nonzero((found >= (least - self.slack)[:, None]) & np.isfinite(found))
        if not len(query):
            return
        if chosen is not None:
            query = chosen[query]
        exact = np.einsum("ij,ij->i", self.units[query], units[row])
        distance = np.round(1.0 - exact, PLACES) + 0.0  # adding zero turns a negative zero into zero
        query = np.concatenate([self.query, query])
        distance, ord_ = np.concatenate([self.distance, distance]), np.concatenate([self.ord, ords[row]])
        order = np.lexsort((ord_, distance, query))
        query, distance, ord_ = query[order], distance[order], ord_[order]
        first = np.searchsorted(query, np.arange(len(self.keys)))
        place = np.arange(len(query)) - first[query]
        keep = place < self.k
        self.query, self.distance, self.ord = query[keep], distance[keep], ord_[keep]
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], 1.0 - distance[last])

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_key": self.keys[self.query], "ord": self.ord, "distance": self.distance})


RESULT_SCHEMA = "query_key long, ord long, distance double"
#: A step's matrix of queries and rows has at most so many numbers.
STEP_CELLS, STEP_ROWS = 1 << 23, 1024


FILTER_LISTS = ["category_list", "source_list"]
FILTERED = ["category_tag", "source_tags"]


def _add_steps(
    top: _Best, table: pa.RecordBatch | pa.Table, allowed: _Allowed | None, chosen: np.ndarray | None = None
) -> None:
    rows_at_once = max(16, min(STEP_ROWS, STEP_CELLS // max(1, len(top.keys))))
    for start in range(0, table.num_rows, rows_at_once):
        part = table.slice(start, rows_at_once)
        ords = np.asarray(part.column("ord")).astype(np.int64)
        rows = allowed.rows(part) if allowed else None
        top.add(ords, _unit(_matrix(part.column("vector"))), rows, chosen)


def _with_sent_queries(
    corpus: DataFrame, rows: list, k: int, rule: str, filtered: bool
) -> DataFrame:
    spark = corpus.sparkSession
    keys = np.array([r["query_key"] for r in rows], dtype=np.int64)
    units = _unit(np.array([r["vector"] for r in rows], dtype=np.float64))
    allowed = _Allowed(*[[r[c] for r in rows] for c in FILTER_LISTS]) if filtered else None
    sent = spark.sparkContext.broadcast((keys, units, allowed))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, units, allowed = sent.value
        top = _Best(keys, units, k, rule)
        for batch in batches:
            _add_steps(top, batch, allowed)
        yield pa.RecordBatch.from_pandas(top.frame(), preserve_index=False)

    return corpus.mapInArrow(best, RESULT_SCHEMA)


def _empty_result() -> pa.Table:
    types = {"query_key": pa.int64(), "ord": pa.int64(), "distance": pa.float64()}
    return pa.table({name: pa.array([], kind) for name, kind in types.items()})


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Straight-line distances of unit vectors, which obey the triangle inequality as cosines don't."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def _in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df`` with ``cell``, the nearest pivot, and ``radius``, the chord to it."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)
    names = df.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chords = _chords(_unit(_matrix(batch.column("vector"))), sent.value) if batch.num_rows else np.zeros((0, 1))
            cell = chords.argmin(axis=1)
            radius = chords[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(radius, pa.float64())],
                names=[*names, "cell", "radius"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(place, f"{fields}, cell int, radius double")


def _reached(
    asked: pa.RecordBatch | pa.Table, pivots: np.ndarray, radii: np.ndarray, between: np.ndarray
) -> np.ndarray:
    """Which cells besides its own may hold a neighbour, one row per query and one column per cell."""
    chords = _chords(_unit(_matrix(asked.column("vector"))), pivots)
    own = np.asarray(asked.column("cell"))
    bound = np.asarray(asked.column("bound").fill_null(2.0)).astype(np.float64)
    most = np.sqrt(2.0 * (bound + 1e-6)) + 1e-6
    least = chords - radii[None, :]
    apart = between[own]
    home = chords[np.arange(len(own)), own]
    plane = (chords**2 - home[:, None] ** 2) / (2.0 * np.where(apart > 1e-9, apart, np.inf))
    near = (np.maximum(least, plane) <= most[:, None]) & (radii >= 0)[None, :]
    near[np.arange(len(own)), own] = False
    return near


def visits(bounded: DataFrame, pivots: np.ndarray, radii: np.ndarray) -> DataFrame:
    """``(query_key, cell)``: the cells besides its own that may hold a neighbour of a query.

    ``bounded`` is ``(query_key, vector, cell, bound)``. A row of a cell is at least as far from the query as
    the pivot, less the cell's radius; and as the row is nearer to its pivot than to the query's, it lies
    beyond the plane half way between the two. Cells that are farther than the bound are left out.
    """
    sent = bounded.sparkSession.sparkContext.broadcast((pivots, radii, _chords(pivots, pivots)))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii, between = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _reached(batch, pivots, radii, between)
            query, cell = np.nonzero(near)
            keys = batch.column("query_key").take(pa.array(query))
            yield pa.RecordBatch.from_arrays([keys, pa.array(cell, pa.int32())], names=["query_key", "cell"])

    return bounded.select("query_key", "vector", "cell", "bound").mapInArrow(reach, "query_key long, cell int")


def _met(rows: DataFrame, asked: DataFrame, sizes: dict[int, int], k: int, rule: str, block_rows: int, filtered: bool) -> DataFrame:
    """The best k rows of every query in the cells that it visits.

    ``rows`` has ``cell``; ``asked`` is one row per query and visited cell, with the query's bound. Rows and
    queries of a cell are cut into blocks of about ``block_rows``, by a hash, and every pair of blocks is one
    task; a cell with a third of all rows is many blocks.
    """
    spark = rows.sparkSession
    visiting = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = [(c, -(-sizes.get(c, 0) // block_rows), -(-n // block_rows)) for c, n in visiting.items() if sizes.get(c, 0)]
    if not cut:
        return spark.createDataFrame([], RESULT_SCHEMA)
    cuts = F.broadcast(spark.createDataFrame(cut, "cell int, row_blocks int, query_blocks int"))  # one row per cell

    def block(key: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")

    def copies(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = asked.join(cuts, "cell").select(
        *asked.columns, block("query_key", "query_blocks").alias("qb"), copies("row_blocks").alias("rb")
    )
    right = rows.join(cuts, "cell").select(
        *rows.columns, block("ord", "row_blocks").alias("rb"), copies("query_blocks").alias("qb")
    )

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _empty_result()
        keys = q.column("query_key").to_numpy().astype(np.int64)
        bounds = q.column("bound").to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
        top = _Best(keys, _unit(_matrix(q.column("vector"))), k, rule, bounds)
        lists = [q.column(name).to_pylist() for name in FILTER_LISTS] if filtered else None
        _add_steps(top, c, _Allowed(*lists) if lists else None)
        return pa.Table.from_pandas(top.frame(), schema=_empty_result().schema, preserve_index=False)

    return left.groupBy("cell", "qb", "rb").cogroup(right.groupBy("cell", "qb", "rb")).applyInArrow(best, RESULT_SCHEMA)


def blocks_of_cells(sizes: dict[int, int], block_rows: int) -> list[tuple[int, int, int]]:
    """``(cell, first block, number of blocks)``: cells packed in turn into blocks of at most ``block_rows``
    rows; a larger cell gets several blocks of its own."""
    out, block, filled = [], -1, block_rows
    for cell, n in sorted(sizes.items()):
        if filled + n <= block_rows:
            out.append((cell, block, 1))
            filled += n
            continue
        pieces = -(-n // block_rows)
        out.append((cell, block + 1, pieces))
        block, filled = block + pieces, n if pieces == 1 else block_rows
    return out


def _met_away(
    rows: DataFrame, bounded: DataFrame, there: DataFrame, sizes: dict[int, int], pivots: np.ndarray,
    radii: np.ndarray, k: int, rule: str, block_rows: int, filtered: bool,
) -> DataFrame:
    """The best k rows of every query in the cells besides its own that it visits, as ``there`` tells.

    Queries and rows are cut into blocks and every pair of blocks is one task; inside it a cell's rows are
    only compared with the queries that reach the cell. So a query is copied once per block that it reaches
    and a row once per block of queries.
    """
    spark = rows.sparkSession
    least = math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1  # blocks a side, two pairs for each core
    packed = blocks_of_cells(sizes, min(block_rows, max(1, sum(sizes.values()) // least)))
    if not packed:
        return spark.createDataFrame([], RESULT_SCHEMA)
    cuts = F.broadcast(spark.createDataFrame(packed, "cell int, first int, pieces int"))  # one row per cell
    query_blocks = max(least, -(-bounded.count() // block_rows))
    last = F.col("first") + F.col("pieces") - 1
    # A query's visits stand in one file, so their repeats go before the shuffle. Files of visits are small for
    # their rows: joined by sorting, as their estimated size would have them broadcast.
    goals = there.join(cuts, "cell").select("query_key", F.explode(F.sequence(F.col("first"), last)).alias("rb")).distinct()
    left = goals.hint("merge").join(bounded.hint("merge"), "query_key").withColumn(
        "qb", F.pmod(F.xxhash64("query_key"), F.lit(query_blocks)).cast("int")
    )
    right = rows.join(cuts, "cell").select(
        *rows.columns, (F.col("first") + F.pmod(F.xxhash64("ord"), F.col("pieces"))).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
    )
    sent = spark.sparkContext.broadcast((pivots, radii, _chords(pivots, pivots)))

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _empty_result()
        keys = q.column("query_key").to_numpy().astype(np.int64)
        bounds = q.column("bound").to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
        top = _Best(keys, _unit(_matrix(q.column("vector"))), k, rule, bounds)
        lists = [q.column(name).to_pylist() for name in FILTER_LISTS] if filtered else None
        allowed = _Allowed(*lists) if lists else None
        pivots, radii, between = sent.value
        c = c.sort_by("cell")
        cells, starts, counts = np.unique(np.asarray(c.column("cell")), return_index=True, return_counts=True)
        near = np.concatenate([
            _reached(q.slice(at, STEP_ROWS), pivots, radii, between)[:, cells] for at in range(0, q.num_rows, STEP_ROWS)
        ])
        for i in range(len(cells)):
            chosen = np.flatnonzero(near[:, i])
            _add_steps(top, c.slice(starts[i], counts[i]), allowed, None if len(chosen) == len(keys) else chosen)
        return pa.Table.from_pandas(top.frame(), schema=_empty_result().schema, preserve_index=False)

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(best, RESULT_SCHEMA)


def _with_cells(
    corpus: DataFrame, queries: DataFrame, k: int, rule: str, n_rows: int, block_rows: int, filtered: bool,
) -> DataFrame:
    """All neighbours by cells around sampled pivots: first in a query's own cell, then, with the k-th
    distance found there as a bound, in the cells that the bound reaches."""
    spark = corpus.sparkSession
    most = max(1, min(MAX_PIVOTS, math.isqrt(n_rows)))
    drawn = corpus.orderBy(F.xxhash64("ord"), "ord").limit(most).select("vector").collect()
    if not drawn:
        return spark.createDataFrame([], RESULT_SCHEMA)
    pivots = _unit(np.array([r["vector"] for r in drawn], dtype=np.float64))
    rows = scratch_table(spark, _in_cells(corpus, pivots), "cells")
    shapes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")).collect()
    sizes, radii = {r["cell"]: r["n"] for r in shapes}, np.full(len(pivots), -1.0)
    for r in shapes:
        radii[r["cell"]] = r["r"]
    asked = scratch_table(spark, _in_cells(queries, pivots), "queries")
    rows = rows.drop("radius")
    home = asked.drop("radius").withColumn("bound", F.lit(None).cast("double"))
    found = scratch_table(spark, _met(rows, home, sizes, k, rule, block_rows, filtered), "home")
    best = top_per_key(found, ["query_key"], by_distance(), k)
    bounds = best.filter(F.col("rank") == k).select("query_key", F.col("distance").alias("bound"))
    bounded = asked.drop("radius").join(bounds.hint("merge"), "query_key", "left")
    bounded = scratch_table(spark, bounded, "bounded")
    there = scratch_table(spark, visits(bounded, pivots, radii), "visits")
    return found.unionByName(_met_away(rows, bounded, there, sizes, pivots, radii, k, rule, block_rows, filtered))


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    rule: str = "all",
    query_bytes: int = QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_key, ord, distance, rank)``: the k nearest corpus rows of every query.

    ``corpus`` is ``(ord, vector)`` and ``queries`` is ``(query_key, vector)`` with unique keys.
    ``rule``: ``all`` compares with every row, ``not_self`` skips the row whose ``ord`` equals the
    query key, ``earlier`` only compares with rows whose ``ord`` is smaller than the query key.
    Queries with ``category_list`` and ``source_list`` see only the rows whose ``category_tag`` and
    ``source_tags`` pass.
    """
    filtered = set(FILTER_LISTS) <= set(queries.columns)
    queries = queries.select("query_key", "vector", *(FILTER_LISTS if filtered else []))
    corpus = corpus.select("ord", "vector", *(FILTERED if filtered else []))
    size = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")
    ).first()
    if size["n"] * size["dim"] * 8 <= query_bytes:
        rows = queries.collect()
        if not rows:
            return corpus.sparkSession.createDataFrame([], RESULT_SCHEMA + ", rank long")
        found = _with_sent_queries(corpus, rows, k, rule, filtered)
    else:
        found = _with_cells(corpus, queries, k, rule, corpus.count(), block_rows, filtered)
    return top_per_key(found, ["query_key"], by_distance(), k)
