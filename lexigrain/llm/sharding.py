"""Sharding by rendezvous hashing over weighted shards, with DataFrame functions only.

Every record key draws one number per shard, and goes to the shard with the
best draw in proportion to its weight.  A draw depends on key and shard alone,
so one more shard only takes rows into itself and a lost one only gives its own
rows away.

Slots number a shard's rows from 0 without gaps.  No task ever holds a whole
shard: rows are numbered inside small cells (shard and key hash), and the cells
of a shard are offset by the counts of those before them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a shard: a constant, so that slots depend on the rows alone and on no setting of the session.
CELLS = 1024
#: Equal rows of a block, which one task numbers.
BLOCK_ROWS = 1 << 16


def _draw(key: Column, shard: int, weight: float) -> Column:
    """The key's waiting time at a shard: exponential with the weight as rate; the least wins."""
    # 53 bits of the hash as a number strictly between 0 and 1.
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key, an int: 0 to len(weights) - 1; shards without weight get nothing. Null keys draw like any other."""
    draws = [F.struct(_draw(key, i, w).alias("at"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))["shard"]


def with_slots(df: DataFrame, shard: str = "shard", order: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Add ``slot``: the row's place in its shard, from 0 without gaps, in the order of its cell and then of ``order``, all columns if not given.

    Equal rows take neighbouring slots in any order.  Extra columns of ``df``
    are kept; an older ``slot`` is replaced.  Names that ``df`` must not have:
    ``__cell``, ``__at``, ``__from``, ``__n``, ``__block``.  Where ``order`` and
    the shard determine a whole row, equal rows are counted before they are
    shuffled, so that a row that repeats a billion times is one row until its
    slots are dealt out in blocks.
    """
    df = df.drop(slot)
    order = list(order) or [c for c in df.columns if c != shard]
    whole = set(df.columns) == {shard, *order}
    placed = df.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(CELLS)).cast("int"))
    counts = placed.groupBy(shard, "__cell").count()
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard), "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy(shard, "__cell").orderBy(*order)
    if whole:
        rows = placed.groupBy(*placed.columns).agg(F.count("*").alias("__n"))
        rows = rows.withColumn("__at", F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    else:
        rows = placed.withColumn("__at", F.row_number().over(inside).cast("long") - 1)
    # Rows are dealt by shard and cell already; only the offsets move.
    same = F.col(shard).eqNullSafe(F.col("__shard")) & (F.col("__cell") == F.col("__c"))
    joined = rows.join(offsets.select(F.col(shard).alias("__shard"), F.col("__cell").alias("__c"), "__from"), same)
    if not whole:
        return joined.withColumn(slot, F.col("__at") + F.col("__from")).select(*df.columns, slot)
    blocks = joined.select(*df.columns, (F.col("__at") + F.col("__from")).alias("__at"), "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK_ROWS))).alias("__block"))
    last = F.least(F.col("__n"), (F.col("__block") + 1) * BLOCK_ROWS) - 1
    return blocks.select(*df.columns, F.explode(F.sequence(F.col("__at") + F.col("__block") * BLOCK_ROWS, F.col("__at") + last)).alias(slot))


def grown(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key if one more shard of mean weight came."""
    return rendezvous(key, [*weights, math.fsum(weights) / len(weights)])


def shard_records(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown_col: str | None = None) -> DataFrame:
    """``df`` with each row's shard, and in ``grown_col`` its shard if one more of mean weight came; narrow, no shuffle.

    Null keys go to one shard like any key; repeated keys go together; empty
    tables give empty results.  Columns of these two names are replaced.
    """
    out = {shard: rendezvous(F.col(key), weights)}
    if grown_col:
        out[grown_col] = grown(F.col(key), weights)
    return df.withColumns(out)
