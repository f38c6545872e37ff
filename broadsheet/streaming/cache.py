"""Cache hits over a stream of lookups: one stored expiry per key.

State is dropped by event-time timeout once the watermark has passed the expiry; later lookups of that key
are misses either way. A lookup that arrives behind the last store of its key, but not behind the
watermark, counts as a hit: the answer is stored by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from broadsheet.operators.cache import TTL_SECONDS

OUTPUT = "event_id long, cache_key string, hit boolean"
STATE = "expiry long"


def _walk(t: np.ndarray, expiry: int, ttl: int) -> tuple[np.ndarray, int]:
    """Misses among sorted times, jumping from store to store, and the expiry after them."""
    miss = np.zeros(len(t), dtype=bool)
    at = int(np.searchsorted(t, expiry, side="left"))
    while at < len(t):
        miss[at] = True
        expiry = int(t[at]) + ttl
        at = int(np.searchsorted(t, expiry, side="left"))
    return miss, expiry


def cache_hits_stream(
    lookups: DataFrame, ttl_seconds: int = TTL_SECONDS, lateness: str = "1 minute"
) -> DataFrame:
    """``(event_id, cache_key, hit)`` for a stream ``(event_id, cache_key, ts timestamp)``."""
    ttl = ttl_seconds * 1_000_000

    def step(
        key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        stored = state.get[0] if state.exists else -(1 << 62)
        miss, expiry = _walk(rows["t"].to_numpy(), stored, ttl)
        state.update((expiry,))
        state.setTimeoutTimestamp(max(expiry // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "cache_key": key[0], "hit": ~miss})

    return (
        lookups.withWatermark("ts", lateness)
        .withColumn("t", F.unix_micros("ts"))
        .groupBy("cache_key")
        .applyInPandasWithState(
            step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )
