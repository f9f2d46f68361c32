from __future__ import annotations

from pyspark.sql import functions as F

import lexigrain
from lexigrain.operators.interchange import from_flat, parse_array, to_flat
from lexigrain.schema import CHUNK_SCHEMA


def test_arrays(spark):
    given = ['["a","b"]', '["x",null,1]', "{}", "oops", None, "[", "[]"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert [r.a for r in df.select(parse_array(F.col("t")).alias("a")).collect()] == [["a", "b"], ["x", "null", "1"], [], [], [], [], []]


def test_round_trip(spark):
    row = dict.fromkeys(CHUNK_SCHEMA.fieldNames()) | {"id": "i", "heading_path": ["A", ""], "tags": [], "embedding": [1.0, None, 2.0], "token_count": 3}
    df = spark.createDataFrame([tuple(row[c] for c in CHUNK_SCHEMA.fieldNames())], CHUNK_SCHEMA)
    flat = to_flat(df)
    assert flat.first().heading_path == '["A",""]'
    back = from_flat(flat).first()
    assert (back.heading_path, back.tags, back.embedding, back.page, back.npc_name, back.system) == (["A", ""], [], [1.0, 2.0], "", None, "null")
    assert from_flat(flat).columns == CHUNK_SCHEMA.fieldNames()


def test_public_names():
    assert all(hasattr(lexigrain, n) for n in lexigrain.__all__) and "chunk_documents" in lexigrain.__all__
