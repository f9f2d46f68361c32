"""Queries over their whole job, against brute force, at the smallest scale."""

from __future__ import annotations

import hashlib
import math
import re

import plain
from test_queries import DIR

from lexigrain.functions.stem import stem
from lexigrain.operators import fulltext
from lexigrain.plans import queries
from lexigrain.sources import files


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def test_cosine_join(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()}
    want = {}
    for q in (i for i in vectors if i % 20 == 0):
        best = sorted((-cosine(v, vectors[q]), i) for i, v in vectors.items())[:5]
        want |= {(q, rank): (i, round(-s, 4)) for rank, (s, i) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.cosine_join(spark, DIR).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k][0] == i and abs(got[k][1] - s) < 1e-4 for k, (i, s) in want.items())


def test_token_windows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text.replace("\n", " ").replace("|", " ")) for r in docs if r.text is not None]
    want = [(i, k, hashlib.sha256(p.encode()).hexdigest()) for i, t in texts for k, p in enumerate(plain.split(t, 50, 5, "token"))]
    assert sorted(map(tuple, queries.token_windows(spark, DIR).collect())) == sorted(want)
    assert {i for i, _, _ in want} == {i for i, _ in texts}


def test_stems_of_all_languages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("text", "lang").collect()
    fold = str.maketrans(fulltext._MARKED, fulltext._PLAIN)
    words = lambda rows: {w for r in rows for w in re.split("[^a-z]+", (r.text or "").lower().translate(fold)) if w} - fulltext.STOP_WORDS
    assert words(docs) > words(r for r in docs if r.lang == "en")
    assert sorted(map(tuple, queries.stems(spark, DIR).collect())) == sorted((w, stem(w)) for w in words(docs))


def test_text_files_are_small(spark, tmp_path, monkeypatch):
    """However the documents are cut, no file holds much more than FILE_BYTES; nothing is lost."""
    texts = [r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    total = sum(len(t.encode()) + 1 for t in texts)
    monkeypatch.setattr(files, "FILE_BYTES", total // 20, raising=False)
    monkeypatch.setattr(queries, "new_path", lambda spark, name: str(tmp_path / name))
    assert queries.text_files(spark, DIR).first().chars == sum(len(t) + 1 for t in texts)
    sizes = [p.stat().st_size for p in (tmp_path / "texts").glob("*.txt")]
    assert sum(sizes) == total and max(sizes) < total // 20 + 2 * max(len(t.encode()) for t in texts)
