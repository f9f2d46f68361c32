"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.storage import materialize

#: A key is heavy if it has more than one in so many of the rows; so there are fewer heavy keys than this, whatever the tables.
#: Lighter ones that are still uneven are left to Spark's skew join, which can split them, as the other side is a written table.
HEAVY_SHARE = 100


def join_unique(rows: DataFrame, unique: DataFrame, keys: Sequence[str], count: str, merge: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, one row a key, whose column ``count`` tells how many rows have the key; it is left out.

    ``unique`` is written once, if it is no table yet.  Heavy keys are sent to every task, fewer than
    HEAVY_SHARE of them by their definition, so their rows stay where they
    are; only the others are shuffled.  ``rows`` is read twice where there are
    heavy keys and should be a table.  Null keys join with nothing.  ``merge``:
    the light keys are always shuffled, also where Spark would send a small
    table of them to the rows, so that the plan is the same at every size.
    """
    keys = list(keys)
    unique = unique if hasattr(unique, "_table_path") else materialize(unique, "unique")
    total = unique.agg(F.sum(count)).first()[0] or 0
    heavy = unique.filter(F.col(count) > total / HEAVY_SHARE)
    light = unique.filter(F.col(count) <= total / HEAVY_SHARE).drop(count)
    if total < HEAVY_SHARE or heavy.isEmpty():
        light = unique.drop(count)
        return rows.join(light.hint("merge") if merge else light, keys)
    here = rows.join(F.broadcast(heavy.drop(count)), keys)
    # By the same pigeonhole these keys are few; nulls pass and find no partner.
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge") if merge else light, keys)
    return here.unionByName(rest)
