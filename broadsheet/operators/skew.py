"""Joins and per-key top lists that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 64
SALTS = 16
# Up to this bound Spark itself cuts a rank filter inside each task, before the shuffle.
GROUP_LIMIT = 1000


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Measure a side before broadcasting it: one aggregate over rows and value bytes.

    Pass a persisted frame, so that measuring does not repeat the work behind it.
    """
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    if limit <= 0:
        return False
    width = sum((_value_bytes(f) for f in df.schema.fields), F.lit(ROW_OVERHEAD))
    size = df.agg(F.sum(width).alias("b")).first()["b"]
    return (size or 0) <= limit


def _value_bytes(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0))
    return F.lit(8)


def sized_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_bytes: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join with ``small`` broadcast when its measured size allows, salted otherwise.

    ``small`` is persisted (memory and disk) because it is read twice, by the measurement and by the
    join; a lost block is recomputed.

    In the salted form each big row goes to one of ``salts`` slots by a hash of its columns, and
    every small row is copied to all slots, so a hot key is spread over that many tasks. The hash is
    a function of the row, so a lost task recomputes the same slots.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how} would repeat small rows over the slots")
    small = small.persist()
    if fits_broadcast(small, max_bytes):
        return big.join(F.broadcast(small), on, how)
    hashed = [f.name for f in big.schema.fields if not isinstance(f.dataType, T.MapType)]
    slot = F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")
    slots = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        big.withColumn("_slot", slot)
        .join(small.withColumn("_slot", slots), [*on, "_slot"], how)
        .drop("_slot")
    )


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
    salts: int = SALTS,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, which must be total, with their 1-based rank.

    The bound is a constant, so that the planner keeps only ``k`` rows per key and task before the
    shuffle. Above its threshold the same is done by hand: first the best ``k`` of each slot of a key,
    then the best of those.
    """
    def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
        position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn(rank, position).filter(F.col(rank) <= k)

    if k > group_limit:
        hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        slotted = df.withColumn("_slot", F.pmod(F.xxhash64(*hashed), F.lit(salts)))
        df = ranked(slotted, [*keys, "_slot"]).drop("_slot", rank)
    return ranked(df, keys).withColumn(rank, F.col(rank).cast("long"))
