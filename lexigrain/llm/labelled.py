"""Bounded, repeatable samples of labelled documents for fitting."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit sees at most, about (the sample is by hash, so up to a few per cent more). The only bound of this kind.
MAX_FIT_ROWS = 40_000
_GRAIN = 1_000_000


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def held_out(id_col: Column) -> Column:
    """Whether a row is in the held-out fold; a row without id is not."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def fold_of(value: object) -> int:
    """The same, of one value."""
    return zlib.crc32(str(value).encode()) % 5


def training_rows(docs: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(id, text, label) of at most about ``max_rows`` labelled rows outside the held-out fold, chosen by a hash of the id.

    The chosen labels are few by construction, so they are broadcast and the
    documents are read once without a shuffle.  Rows without label, and ids
    labelled twice in different ways, are left out.
    """
    usable = labels.filter(F.col(target).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    one = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(target).alias("label"), F.max(target).alias("__most")).filter(F.col("label") == F.col("__most")).drop("__most")
    n = one.count()
    if n > max_rows:
        one = one.filter(F.pmod(F.xxhash64("id"), F.lit(_GRAIN)) < int(_GRAIN * max_rows / n))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(one), "id").select("id", "text", F.col("label").cast("int").alias("label"))
