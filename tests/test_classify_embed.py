from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.operators import classify as cl
from lexigrain.operators import embed as em
from lexigrain.schema import PBTA_CONTENT_TYPES

CHUNKS = [
    (0, "Or: **WHEN  you open\nthe sluice**, wait.", ["Canal"]),
    (1, "tolls\n  | barge | 3 |\n|raft|1|", ["Fees"]),
    (2, "its armor turns 2 blows", ["Monsters of the lock", " Eel King "]),
    (3, "it has armor", ["NPCs"]),
    (4, "words", ["How to run a lock"]),
    (5, "words", ["Geography", "The Upper Reach"]),
    (6, "words", ["Factional strife"]),
    (7, "words", []),
    (8, "x", ["Random encounters"]),
    (9, "**when   **", ["A"]),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_order int, text string, heading_path array<string>")


def test_rules(chunks):
    got = {r.chunk_order: r for r in cl.RuleClassifier().apply(chunks).collect()}
    assert [got[i].content_type for i in range(10)] == ["move", "table", "stat_block", "mechanic", "gm_guidance", "lore", "lore", "mechanic", "table", "move"]
    assert got[0].move_trigger == "you open\nthe sluice" and got[2].npc_name == "Eel King"
    assert got[9].move_trigger == "" and got[0].npc_name is None and got[0].tags == []


def test_constant(chunks):
    row = cl.ConstantClassifier("lore", ("a", "b")).apply(chunks).first()
    assert (row.content_type, row.tags, row.npc_name) == ("lore", ["a", "b"], None)


def test_json_array():
    assert cl.extract_json_array('So (two): [{"tags": ["a]"]}, 5] or [6]') == '[{"tags": ["a]"]}, 5]'
    assert cl.extract_json_array(r'[{"a": "]\"["}, [1]] tail') == r'[{"a": "]\"["}, [1]]'
    with pytest.raises(ValueError, match="No JSON"):
        cl.extract_json_array("none")
    with pytest.raises(ValueError, match="Unterminated"):
        cl.extract_json_array("[1, [2]")


def short_reply(system, prompt, limit):
    assert limit >= 4096 and "exactly" in prompt
    return json.dumps([{"content_type": "oracle", "tags": ["x", 1], "npc_name": "null"}, {"content_type": "nonsense", "tags": "no"}])


def failing(system, prompt, limit):
    raise OSError("down")


def test_model(chunks):
    one = cl.ModelClassifier(short_reply, PBTA_CONTENT_TYPES, batch_size=5).apply(chunks.coalesce(1)).orderBy("chunk_order").collect()
    assert (one[0].content_type, one[0].tags, one[0].npc_name) == ("oracle", ["x", "1"], None)
    assert (one[1].content_type, one[1].tags) == ("mechanic", [])
    assert one[2].content_type == "stat_block" and one[5].content_type == "oracle" and one[7].content_type == "mechanic"
    ruled = cl.RuleClassifier().apply(chunks).orderBy("chunk_order").collect()
    assert cl.ModelClassifier(failing, PBTA_CONTENT_TYPES).apply(chunks).orderBy("chunk_order").collect() == ruled
    assert "(no heading)" in cl.ModelClassifier(failing, PBTA_CONTENT_TYPES).batch_prompt([("t", [])])


def test_forecast(chunks):
    cl.reset_price_cache()
    model = cl.ModelClassifier(failing, PBTA_CONTENT_TYPES, model="m", batch_size=4, count=lambda s, p: 100)
    got = cl.forecast_cost(model, chunks.coalesce(1))
    assert (got.n_chunks, got.n_batches, got.input_tokens, got.output_tokens) == (10, 3, 300, 500)
    assert got.total_cost_usd == pytest.approx((300 * 3 + 500 * 15) / 1e6)
    assert cl.forecast_cost(model, chunks.limit(0)).total_cost_usd == 0
    assert cl.prices_of("m", lambda t: {"m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}}) == (1.0, 2.0)
    cl.reset_price_cache()
    assert cl.prices_of("m", failing) == cl.FALLBACK_PRICES
    cl.reset_price_cache()


def test_hash_embedding(spark):
    texts = ["", "a", "some longer text é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for dim in (8, 40):
        for r in df.withColumn("v", em.hash_embedding(F.col("t"), dim)).collect():
            h = hashlib.sha256(r.t.encode()).digest()
            raw = np.array([np.float32(h[i % 32] / 255 * 2 - 1) for i in range(dim)])
            want = (raw.astype(float) / np.sqrt((raw.astype(float) ** 2).sum())).astype(np.float32)
            assert np.array_equal(np.array(r.v, np.float32), want)


def fake_post(url, body, headers):
    assert url == "http://h:1/api/embed" and len(body["input"]) <= 2
    return {"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}


def test_service(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "t string").coalesce(1)
    service = em.LocalServiceEmbedder("m", 2, batch_size=2, post=fake_post, base_url="http://h:1/")
    assert sorted(r.embedding for r in service.apply(df, "t").collect()) == [[1, 1], [2, 1], [3, 1]]
    sizes = []
    em.embed_texts(list("abcde"), "u", lambda b: {"texts": b}, {}, lambda u, b, h: sizes.append(len(b["texts"])) or {"embeddings": [[1]] * len(b["texts"])}, 2)
    assert sizes == [2, 2, 1]
    with pytest.raises(ValueError, match="one list"):
        em.embed_texts(["a"], "u", lambda b: {}, {}, lambda *a: {"embeddings": []}, 2)


def test_keys(monkeypatch):
    monkeypatch.delenv("NOMIC_API_KEY", raising=False)
    with pytest.raises(ValueError):
        em.embedding_key()
    assert em.embedding_key(config={"nomicApiKey": "c"}) == "c"
    monkeypatch.setenv("NOMIC_API_KEY", "e")
    assert em.embedding_key(config={"nomicApiKey": "c"}) == "e" and em.embedding_key("x") == "x"
    _, body, headers = em.HostedEmbedder(key="k").request()
    assert headers == {"Authorization": "Bearer k"} and body(["t"])["texts"] == ["t"] and "k" not in repr(em.HostedEmbedder(key="k"))
