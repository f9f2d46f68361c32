from __future__ import annotations

from pathlib import Path

from lexigrain import storage


def test_tables(spark):
    one, two = (storage.materialize(spark.range(n)) for n in (3, 0))
    assert (one.count(), two.count(), two.columns) == (3, 0, ["id"])
    folder = Path(one.inputFiles()[0].removeprefix("file://")).parent
    assert folder.is_dir()
    storage.release(one)
    assert not folder.exists()
    three = storage.materialize(spark.range(2))
    folder = Path(three.inputFiles()[0].removeprefix("file://")).parent
    storage.clear_tables(spark)
    assert not folder.exists()
    storage.bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{storage.BATCH_BYTES}b"
