"""Shared-folder helpers: where intermediate tables go, and how lineage is cut.

Intermediate tables are written below ``spark.checkpoint.dir`` because that is
the one folder that the driver and every executor can see.  Only a local
session without any such folder (tests, a laptop) gets one of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the setting's, else the one given to ``setCheckpointDir``; an error on a cluster that names neither."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lexigrain-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, known to ``clear_tables``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Whether a finished statement's shuffle files go at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a written table go as soon as it is written; nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage and survives lost executors: what was computed once is never
    computed again, and a lost reader re-reads files instead of re-running
    the plan.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


#: Column of the numbers that ``numbered`` gives, and what a column of that name is called meanwhile.
ROW, _GIVEN = "__row", "__row_given"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row in ROW, written once: whoever reads it finds the same numbers.

    Two scans of one input need not number its rows alike: splits are cut by
    the cores registered when a scan is planned.  A column of that name is
    put aside; ``as_given`` brings it back.
    """
    if ROW in docs.columns:
        docs = docs.withColumnRenamed(ROW, _GIVEN)
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def as_given(names: Sequence[str]) -> list[Column]:
    """Columns of a ``numbered`` table under the names that its input had."""
    return [F.col(_GIVEN).alias(ROW) if c == ROW else F.col(c) for c in names]


#: Bytes of an Arrow batch between executor and Python worker, about.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES: rows are whole texts here, and ten thousand of them are too many at once.

    Frames are run after the function that made them has returned, so the
    setting stays; a smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``materialize`` returned."""
    for df in frames:
        _delete(df.sparkSession, df._table_path)
        _written.get(df.sparkSession.sparkContext.applicationId, []).remove(df._table_path)


@contextmanager
def only(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that ``materialize`` returned and that are put into the list."""
    known = _written.setdefault(spark.sparkContext.applicationId, [])
    before = set(known)
    kept: list[DataFrame] = []
    yield kept
    stay = before | {df._table_path for df in kept}
    for path in [p for p in known if p not in stay]:
        known.remove(path)
        _delete(spark, path)


def clear_tables(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` has written for this application; frames that read them end here."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
