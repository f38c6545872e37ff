"""Query-result cache over a log of lookups: keys, and hit or miss of every lookup.

A lookup is a miss when nothing is stored or the stored answer is ``ttl`` or more old; a miss stores, a
hit does not extend. So each miss depends on the one before it, which looks like one sequential pass per
key. It is split in time instead, because one key may hold a third of the log. A cell is one key in one
chunk of time:

1. Per cell: for every possible expiry that can reach into it, the time of the last store in it.
   Expiries that lead to the same last store are merged, so a cell is summarised by a few rows.
2. Per key: walk the summaries in time order; this gives the expiry that enters each cell.
3. Per cell: mark the misses, starting from that expiry.

Cells are spread by hash over tasks of about ``SLOT_ROWS`` lookups, many small cells to a task; no task
holds more of a hot key than one chunk. Steps 1 and 3 use the same shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import strip

TTL_SECONDS = 60
CHUNK_TTLS = 60
SLOT_ROWS = 500_000
KEY_NAMESPACE = "query_cache"
NO_EXPIRY = -(1 << 62)


def cache_key(kind: str = "text") -> Column:
    """The cache key of a request row ``(text, categories, sources, sort, offset, limit, fuzzy)``."""

    def part(name: str, default: str) -> Column:
        value = F.col(name)
        missing = value.isNull() | (value == "")
        return F.when(missing, default).otherwise(strip(F.lower(value)))

    parts = [
        F.lit(kind),
        F.coalesce(strip(F.lower(F.col("text"))), F.lit("")),
        part("categories", "all"),
        part("sources", "all"),
        part("sort", "relevance"),
        F.col("offset").cast("string"),
        F.col("limit").cast("string"),
    ]
    plain = F.concat_ws(":", *parts)
    full = F.when(F.col("fuzzy"), F.concat(plain, F.lit(":fuzzy"))).otherwise(plain)
    return F.concat(F.lit(f"{KEY_NAMESPACE}:{kind}:"), F.md5(full.cast("binary")))


class _Cells:
    """Distinct (cell, time) points of one slot in order, and the next store after each point."""

    def __init__(self, pdf: pd.DataFrame, ttl: int, chunk_us: int):
        self.ttl, self.span = ttl, chunk_us + 2 * ttl + 2
        cells = pd.MultiIndex.from_arrays([pdf["cache_key"], pdf["chunk"]])
        code, self.cells = pd.factorize(cells, sort=True)
        self.chunk = self.cells.get_level_values(1).to_numpy(np.int64)
        self.start = self.chunk * chunk_us
        point = code.astype(np.int64) * self.span + (pdf["t"].to_numpy() - self.start[code])
        self.points, self.point_of_row = np.unique(point, return_inverse=True)
        self.code = self.points // self.span
        self.offset = self.points - self.code * self.span
        after = np.searchsorted(self.points, self.points + ttl, side="left")
        self.next = np.where(self._same_cell(after, self.code), after, -1)

    def _same_cell(self, index: np.ndarray, code: np.ndarray) -> np.ndarray:
        inside = index < len(self.points)
        return inside & (self.code[np.minimum(index, len(self.points) - 1)] == code)

    def times(self) -> np.ndarray:
        return self.offset + self.start[self.code]

    def last_store(self) -> np.ndarray:
        """Index of the last store of the chain that starts at each point (pointer jumping)."""
        jump = np.where(self.next >= 0, self.next, np.arange(len(self.points)))
        while True:
            further = jump[jump]
            if np.array_equal(further, jump):
                return jump
            jump = further

    def misses(self, entry: np.ndarray) -> np.ndarray:
        """Which points store, given the expiry that enters each cell."""
        codes = np.arange(len(self.cells))
        offset = np.clip(entry - self.start, 0, self.span - 1)
        at = np.searchsorted(self.points, codes * self.span + offset, side="left")
        at = at[self._same_cell(at, codes)]
        miss = np.zeros(len(self.points), dtype=bool)
        while len(at):
            miss[at] = True
            at = self.next[at]
            at = at[at >= 0]
        return miss


SUMMARY = "cache_key string, chunk long, upto long, last_store long"
ENTRIES = "cache_key string, chunk long, entry long"
MARKED = "event_id long, cache_key string, hit boolean"


def _summarise(ttl: int, chunk_us: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = _Cells(pdf, ttl, chunk_us)
        last = cells.last_store()
        new_cell = np.r_[True, cells.code[1:] != cells.code[:-1]]
        # A later point only matters as a start when the point before it lies inside the first ttl.
        start = new_cell | (np.r_[0, cells.offset[:-1]] < ttl)
        code, last, times = cells.code[start], last[start], cells.times()
        run_end = np.r_[(code[1:] != code[:-1]) | (last[1:] != last[:-1]), True]
        keys = cells.cells.get_level_values(0)
        return pd.DataFrame(
            {
                "cache_key": keys[code[run_end]],
                "chunk": cells.chunk[code[run_end]],
                "upto": times[start][run_end],
                "last_store": times[last[run_end]],
            }
        )

    return run


def _entries(ttl: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cache_key", "chunk", "upto"])
        out, key, chunk, expiry, taken = [], None, None, NO_EXPIRY, False
        for k, c, upto, last in zip(
            pdf["cache_key"], pdf["chunk"], pdf["upto"], pdf["last_store"], strict=True
        ):
            if k != key:
                key, chunk, expiry = k, None, NO_EXPIRY
            if c != chunk:
                chunk, taken = c, False
                out.append((k, c, expiry))
            if not taken and upto >= expiry:
                expiry, taken = last + ttl, True
        return pd.DataFrame(out, columns=["cache_key", "chunk", "entry"])

    return run


def _mark(ttl: int, chunk_us: int):
    def run(events: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(events):
            return pd.DataFrame({"event_id": [], "cache_key": [], "hit": []})
        events = events.sort_values("event_id", kind="stable").reset_index(drop=True)
        cells = _Cells(events, ttl, chunk_us)
        entry = entries.set_index(["cache_key", "chunk"])["entry"].reindex(cells.cells)
        miss = cells.misses(entry.to_numpy(np.int64))[cells.point_of_row]
        repeated = pd.Series(cells.point_of_row).duplicated().to_numpy()
        return pd.DataFrame(
            {
                "event_id": events["event_id"],
                "cache_key": events["cache_key"],
                "hit": ~miss | repeated,
            }
        )

    return run


def cache_hits(
    log: DataFrame,
    ttl_seconds: int = TTL_SECONDS,
    chunk_ttls: int = CHUNK_TTLS,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """``(event_id, cache_key, hit)`` for a log ``(event_id, cache_key, ts)``.

    Lookups at the same instant go by ``event_id``. A chunk is ``chunk_ttls`` expiry times long.
    """
    ttl = ttl_seconds * 1_000_000
    chunk_us = ttl * max(1, chunk_ttls)
    slots = max(1, -(-log.count() // slot_rows))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    chunk = F.expr(f"{chunk_us}L")
    cell_slot = F.pmod(F.xxhash64("cache_key", "chunk"), F.lit(slots)).cast("int")
    key_slot = F.pmod(F.xxhash64("cache_key"), F.lit(slots)).cast("int")
    events = (
        log.select("event_id", "cache_key", t.alias("t"))
        .withColumn("chunk", ((F.col("t") - F.pmod("t", chunk)) / chunk).cast("long"))
        .withColumn("slot", cell_slot)
        .repartition("slot")
    )
    by_slot = events.groupBy("slot")
    summary = by_slot.applyInPandas(_summarise(ttl, chunk_us), SUMMARY)
    entries = summary.groupBy(key_slot.alias("key_slot")).applyInPandas(_entries(ttl), ENTRIES)
    entries = entries.withColumn("slot", cell_slot)
    return by_slot.cogroup(entries.groupBy("slot")).applyInPandas(_mark(ttl, chunk_us), MARKED)
