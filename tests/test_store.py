from __future__ import annotations

import json
import math
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrain import cli
from lexigrain.functions.stem import stem
from lexigrain.operators import fulltext, vector
from lexigrain.operators.store import ChunkStore
from lexigrain.plans.ingest import ingest_documents, ingest_files
from lexigrain.schema import CHUNK_SCHEMA, ChunkingConfig, Source
from lexigrain.sources import config
from lexigrain.sources.extract import CachedPages, Extractor, FormFeedText, GivenPages, Poppler, run_tool
from lexigrain.sources.files import read_documents, resolve_format
from lexigrain.streaming.ingest import stream_folder

MOVES = "# Moves\nlist of them\n## Ferry\n**When you ferry**, roll.\n## Trade\n**When you trade**, roll.\n"


def source(path, **changes):
    given = {"id": "s1", "name": "S", "system": "sys", "store_path": str(path), "embedding_model": "m", "embedding_dim": 4, "license": "ogl", "chunking": ChunkingConfig(min_tokens=1, max_tokens=200)}
    return Source(**(given | changes))


def chunk(i, text, vec=(1, 0, 0, 0), **changes):
    given = dict.fromkeys(CHUNK_SCHEMA.fieldNames())
    given |= {"id": i, "source_id": "s1", "doc_id": "d", "text": text, "embedding": [float(x) for x in vec], "embedding_model": "m", "content_hash": i, "content_type": "mechanic", "chunk_order": 0, "heading_path": [], "tags": []}
    return tuple((given | changes)[c] for c in CHUNK_SCHEMA.fieldNames())


def test_insert_search_delete(spark, tmp_path):
    store, src = ChunkStore(spark, str(tmp_path)), source(tmp_path)
    store.initialize(src)
    store.initialize(src)
    with pytest.raises(ValueError, match="length 4"):
        store.initialize(source(tmp_path, embedding_dim=8))
    rows = [chunk("a", "copper keel rudder", chunk_order=1), chunk("b", "songs of copper", (0, 1, 0, 0), content_type="lore"), chunk("c", "nothing", (0, 0, 0, 0)), chunk("dup", "x", content_hash="a", chunk_order=5)]
    df = spark.createDataFrame(rows, CHUNK_SCHEMA)
    assert store.insert(src, df) == 3 and store.insert(src, df) == 0
    assert store.insert(src, df.limit(0)) == 0
    with pytest.raises(Exception, match="not of length 4"):
        store.insert(src, spark.createDataFrame([chunk("z", "t", (1, 2))], CHUNK_SCHEMA))
    assert store.stats(src) == {"chunk_count": 3, "embedding_model": "m", "embedding_dim": 4}
    assert [tuple(r) for r in store.models().collect()] == [("m", 3)]
    near = store.similarity_search(src, [0.9, 0.1, 0, 0]).collect()
    assert [(r.id, r.rank) for r in near] == [("a", 1), ("b", 2), ("c", 3)] and 0.99 < near[0].score <= 1 and near[2].score is None
    assert store.chunks("s1").columns == CHUNK_SCHEMA.fieldNames()
    assert [r.id for r in store.similarity_search(src, [1, 0, 0, 0], 5, {"content_type": "lore"}).collect()] == ["b"]
    for bad in ({"page": "1"}, {"doc_id": None}):
        with pytest.raises(ValueError):
            store.similarity_search(src, [1, 0, 0, 0], 5, bad)
    with pytest.raises(ValueError):
        store.similarity_search(src, [1, 0, 0, 0], -1)
    found = store.bm25_search(src, "rudder copper keels").collect()
    assert [r.id for r in found] == ["a", "b"] and found[0].score > found[1].score > 0
    assert [r.id for r in store.bm25_search(src, "copper", filters={"content_type": "lore"}).collect()] == ["b"]
    assert store.bm25_search(src, "the of").count() == 0
    store.rebuild_text_index(src)
    assert [r.id for r in store.bm25_search(src, "keel").collect()] == ["a"]
    store.delete("s1", "other")
    assert store.chunks().count() == 3
    store.delete("s1", "d")
    assert store.chunks().count() == 0 and store.meta().count() == 4
    store.delete("s1")
    assert store.meta().count() == 0


def test_versions(spark, tmp_path, monkeypatch):
    store, src = ChunkStore(spark, str(tmp_path)), source(tmp_path)
    rows = lambda *ids, doc: spark.createDataFrame([chunk(i, f"word {i}", doc_id=doc) for i in ids], CHUNK_SCHEMA)
    assert store.insert(src, rows("a", "b", doc="one")) == 2 and store.insert(src, rows("a", "c", doc="two")) == 2
    assert store.insert(src, rows("a", "n", doc=None)) == 2 and store.insert(src, rows("a", "n", doc=None)) == 0
    before = store._state()
    old = store.chunks()
    # Only the part that holds the document is written anew; what a reader holds stays until the vacuum.
    store.delete("s1", "two")
    after = store._state()
    assert [p in after["parts"]["s1"] for p in before["parts"]["s1"]] == [True, False, True] and old.count() == 6
    assert store.chunks().count() == store.stats(src)["chunk_count"] == 4
    store.vacuum()
    assert {p.name for p in (tmp_path / "parts").iterdir()} == {p["at"] for p in after["parts"]["s1"]} and len(list((tmp_path / "versions").glob("*.json"))) == 1
    # A change that fails on the way, or that another writer was faster than, leaves the store as it was.
    with pytest.raises(Exception, match="not of length 4"):
        store.insert(src, spark.createDataFrame([chunk("z", "t", (1, 2))], CHUNK_SCHEMA))
    with pytest.raises(Exception, match="not of length 4"):
        store.insert(src, spark.createDataFrame([chunk("z", "t")], CHUNK_SCHEMA).withColumn("embedding", F.lit(None).cast("array<float>")))
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(before | {"version": after["version"] - 1})
    assert store._state() == after
    monkeypatch.setattr("lexigrain.operators.store.MAX_PARTS", 3)
    assert store.insert(src, rows("q", doc="three")) == 1
    assert len(store._state()["parts"]["s1"]) == 1 and store.stats(src)["chunk_count"] == 5
    assert [r.id for r in store.bm25_search(src, "q").collect()] == ["q"]


def test_bm25_join(spark):
    docs = spark.createDataFrame([("s", str(i), "river mill " * (i % 3 + 1) + "stone " * i) for i in range(12)] + [("s", "null", None)], "source_id string, id string, text string")
    index = fulltext.build_index(docs)
    asked = spark.createDataFrame([(1, "Rivers of stone"), (2, "mill"), (3, "the"), (4, None)], "query_id int, query string")
    got = fulltext.bm25_join(asked, index, 3).orderBy("query_id", "rank").collect()
    want = [(q, r.id, r.score) for q, t in ((1, "Rivers of stone"), (2, "mill")) for r in fulltext.bm25_search(docs, index, t, 3).collect()]
    assert [(r.query_id, r.id, r.score) for r in got] == want and len(got) == 6


def test_ingest(spark, tmp_path):
    file = tmp_path / "moves.md"
    file.write_text(MOVES)
    store, src = ChunkStore(spark, str(tmp_path / "store")), source(tmp_path / "store")
    assert ingest_files(store, src, str(file), "doc") == 3
    assert ingest_files(store, src, str(file), "doc") == 0
    rows = store.chunks("s1").orderBy("chunk_order").collect()
    assert [r.content_type for r in rows] == ["mechanic", "move", "move"]
    assert rows[1].text == "Moves > Ferry\n\n**When you ferry**, roll." and rows[1].token_count == 4 and rows[1].page == ""
    assert rows[0].doc_path.endswith("moves.md") and rows[0].license == "ogl" and rows[0].edition == "" and rows[0].parent_id is None
    docs = spark.createDataFrame([("x", "p", None), ("y", "p", "no heading")], "doc_id string, doc_path string, text string")
    assert ingest_documents(store, src, docs) == 0


def test_pdf(spark, tmp_path):
    file = tmp_path / "Book.PDF"
    file.write_bytes(b"%PDF")
    store, src = ChunkStore(spark, str(tmp_path / "store")), source(tmp_path / "store")
    with pytest.raises(ValueError, match="extractor is required"):
        ingest_files(store, src, str(file), "doc")
    assert ingest_files(store, src, str(file), "doc", extractor=GivenPages(((2, "# Tides\nebb and flow"), (1, "# Winds\nnorth by east")))) == 2
    assert [(r.page, r.text) for r in store.chunks().orderBy("chunk_order").collect()] == [("1", "Winds\n\nnorth by east"), ("2", "Tides\n\nebb and flow")]
    assert [r.f for r in spark.createDataFrame([("a.pdf",), ("a.PdF",), ("a.md",)], "p string").select(resolve_format(F.col("p")).alias("f")).collect()] == ["pdf", "pdf", "markdown"]
    assert read_documents(spark, str(file), "markdown").first().text == "%PDF"


class Counting(Extractor):
    def __init__(self):
        self.calls = 0

    def pages(self, files):
        self.calls += files.count()
        return files.select("path", F.lit(3).alias("page_num"), F.lit("text").alias("text"))


def test_page_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", b"one"), ("b", b"one"), ("c", b"two")], "path string, content binary")
    inner = Counting()
    cached = CachedPages(inner, str(tmp_path / "cache"))
    want = [("a", 3, "text"), ("b", 3, "text"), ("c", 3, "text")]
    assert sorted(map(tuple, cached.pages(files).collect())) == want and inner.calls == 2
    assert sorted(map(tuple, cached.pages(files).collect())) == want and inner.calls == 2
    assert GivenPages(((1, "x"),)).page(files, 1).count() == 3
    with pytest.raises(ValueError, match="page 9"):
        cached.page(files, 9)
    with pytest.raises(RuntimeError):
        run_tool(["no-such-tool"])
    with pytest.raises(RuntimeError, match="failed"):
        run_tool(["false"])


def test_postings_of_a_part(spark, tmp_path):
    """A part's postings are those of brute force, each chunk by itself, and are made without a shuffle."""
    texts = ["Ébb and flow, EBB; flowing tides", "", "the and of", None, "Winds ﬁnd łodzie 7 ways: winds!", "ebb tides"]
    rows = [chunk(f"c{i}", t) for i, t in enumerate(texts)] + [chunk("c5", "ebb tides", doc_id="other")]
    store = ChunkStore(spark, str(tmp_path))
    assert store.insert(source(tmp_path), spark.createDataFrame(rows, CHUNK_SCHEMA)) == 7
    fold = str.maketrans(fulltext._MARKED, fulltext._PLAIN)
    want = []
    for i, t in [*enumerate(texts), (5, "ebb tides")]:
        words = [w for w in re.split("[^a-z]+", (t or "").lower().translate(fold)) if w and w not in fulltext.STOP_WORDS]
        want += [("s1", f"c{i}", s, n, len(words)) for s, n in Counter(map(stem, words)).items()]
    index = store.text_index(source(tmp_path))
    assert sorted(map(tuple, index.postings.collect())) == sorted(want)
    assert index.statistics.first().avgdl == sum(n for *_, n, _ in want) / 7
    made = fulltext.row_postings(store.chunks())
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_page_cache_of_copies(spark, tmp_path):
    """Spark may keep another copy's path each time that it drops copies; here every evaluation gives other paths."""
    elsewhere = F.udf(lambda path: f"{path}-{uuid.uuid4().hex}").asNondeterministic()
    files = spark.createDataFrame([(f"f{i}", f"{i % 3}\fpage".encode()) for i in range(12)] + [("none", b"")], "path string, content binary").select(elsewhere("path").alias("path"), "content")
    cached = CachedPages(FormFeedText(), str(tmp_path / "cache"))
    for _ in range(2):
        got = cached.pages(files).collect()
        assert sorted((r.path.split("-")[0], r.page_num, r.text) for r in got) == sorted((f"f{i}", *p) for i in range(12) for p in ((1, str(i % 3)), (2, "page")))


def test_poppler(spark, tmp_path):
    tool = tmp_path / "pdftotext"
    tool.write_text('#!/bin/sh\nprintf "one\\f\\f three \\n"\n')
    tool.chmod(0o755)
    files = spark.createDataFrame([("a", b"x")], "path string, content binary")
    assert [tuple(r) for r in Poppler(str(tool)).pages(files).collect()] == [("a", 1, "one"), ("a", 3, "three")]


def test_configs(tmp_path):
    file = tmp_path / "keys.json"
    with pytest.raises(ValueError, match="no config file"):
        config.load_config(file)
    file.write_text('{"anthropicApiKey": "k"}')
    assert config.model_key(path=file) == "k" and config.model_key("x", file) == "x"
    file.write_text("{}")
    assert config.load_config(file) == {"anthropicApiKey": "k"}
    config.reset_config_cache()
    with pytest.raises(ValueError, match="no model key"):
        config.model_key(path=file)
    data = {"id": "i", "name": "n", "system": "s", "dbPath": "p", "embeddingModel": "m", "embeddingDim": 8, "license": "ogl"}
    assert config.source_from(data).chunking == ChunkingConfig()
    assert config.source_from(data | {"chunking": {"maxTokens": 9}}).chunking.max_tokens == 9
    for bad in ({"embeddingDim": "8"}, {"license": "x"}, {"chunking": {"maxTokens": 0}}, {"chunking": {"overflow": "y"}}):
        with pytest.raises(ValueError):
            config.source_from(data | bad)


def test_stream_and_cli(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(MOVES)
    store, src = ChunkStore(spark, str(tmp_path / "store")), source(tmp_path / "store")
    for name, want in ((None, 3), (None, 3), ("b.md", 6)):
        if name:
            (folder / name).write_text(MOVES)
        stream_folder(store, src, str(folder), str(tmp_path / "cp"), once=True).awaitTermination()
        assert store.chunks().count() == want
    conf = tmp_path / "source.json"
    conf.write_text(json.dumps({"id": "c", "name": "n", "system": "s", "dbPath": str(tmp_path / "cli"), "embeddingModel": "m", "embeddingDim": 4, "license": "ogl", "chunking": {"minTokens": 1}}))
    assert cli.main(["--source-config", str(conf), "--doc-id", "d", "--document-type", "core_rules", "--path", str(folder / "a.md"), "--embed", "mock"]) == 0
    assert "inserted 3 chunk(s)" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["--doc-id", "d"])
    assert e.value.code == 2


def test_similarity_join(spark):
    rows = spark.createDataFrame([(str(i), [float(i % 3), 1.0]) for i in range(9)], "id string, embedding array<float>")
    queries = rows.filter("id < '2'").select(F.col("id").alias("query_id"), "embedding")
    for most in (1 << 20, 1):
        got = vector.similarity_join(queries, rows, 2, block_bytes=most).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id) for r in got] == [("0", "0"), ("0", "3"), ("1", "1"), ("1", "4")]
    assert vector.similarity_join(queries, rows, 0).count() == 0 and vector.similarity_join(queries.limit(0), rows, 2).count() == 0


@pytest.mark.parametrize("tile", [1024, 3])
def test_similarity_join_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(vector, "TILE", tile)
    rng = random.Random(6)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)] for _ in range(60)] + [[1.0, 2.0], None, [], [0.0, 0.0, 0.0], [1.0, None, 1.0], [2.0, 4.0]]
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(3)
    asked = df.filter("vec_id % 4 = 0 or vec_id >= 60").withColumnRenamed("vec_id", "query_id")

    def score(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return None
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else None

    for k in (3, 65):
        got = {(r.query_id, r["rank"]): (r.id, r.score) for r in vector.similarity_join(asked, df, k, id_col="vec_id").collect()}
        for q, v in rows:
            if q % 4 == 0 or q >= 60:
                want = sorted((s is None, -round(s, 12) if s is not None else 0, i) for i, x in rows for s in [score(v, x)])[:k]
                mine = [got[q, n] for n in range(1, k + 1)]
                assert [i for i, _ in mine] == [i for _, _, i in want]
                assert all(s is None if none else abs(s + w) < 1e-11 for (_, s), (none, w, _) in zip(mine, want, strict=True))


@pytest.mark.parametrize(("word", "want"), [line.split() for line in "caresses caress|ponies poni|ties ti|cats cat|feed feed|agreed agre|plastered plaster|motoring motor|sing sing|conflated conflat|sized size|hopping hop|falling fall|hissing hiss|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|digitizer digit|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|triplicate triplic|formative form|electrical electr|goodness good|revival reviv|allowance allow|inference infer|adjustable adjust|replacement replac|adoption adopt|communism commun|effective effect|probate probat|rate rate|cease ceas|controll control|roll roll|is is".split("|")])
def test_porter(word, want):
    assert stem(word) == want


def test_terms(spark):
    got = spark.range(1).select(fulltext.terms(F.lit("Éa b2c The Iron-vow!")).alias("w")).first().w
    assert got == ["ea", "b", "c", "iron", "vow"]
