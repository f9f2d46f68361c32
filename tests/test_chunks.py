from __future__ import annotations

import hashlib
import random
import time

import plain
import pytest
from pyspark.sql import functions as F

from lexigrain.functions import text as fn
from lexigrain.operators.chunks import chunk_documents, sections, split_to_budget
from lexigrain.schema import ChunkingConfig


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_tokens_and_hash(spark):
    assert one(spark, fn.token_count, "barge lock") == 2
    assert one(spark, fn.token_count, "\t barge \n\n lock  weir ") == 3
    assert one(spark, fn.token_count, "") == 0
    assert one(spark, fn.token_count, "a\u00a0b\ufeffc\u0085d") == 3
    assert one(spark, fn.ws_tokens, " \n") == []
    assert one(spark, fn.normalize_text, "\u3000BARGE\t\tLock \n") == "barge lock"
    hashes = {one(spark, fn.content_hash, t) for t in ("Barge Lock", "barge lock", "barge\n lock")}
    assert hashes == {hashlib.sha256(b"barge lock").hexdigest()}
    assert one(spark, fn.token_count, None) is None


@pytest.mark.parametrize(
    ("text", "page", "want"),
    [
        ("### The Weir\nlow in June\n# Again", 30, "### The Weir\n<!-- page 30 -->\nlow in June\n# Again"),
        ("Barges wait.\n# Later", 7, "<!-- page 7 -->\nBarges wait.\n# Later"),
        ("\n \n## Locks\nup, down", 12, "\n \n## Locks\n<!-- page 12 -->\nup, down"),
        ("  \n #tag", 1, "  \n #tag\n<!-- page 1 -->"),
        ("", 1, "<!-- page 1 -->\n"),
    ],
)
def test_page_marker(spark, text, page, want):
    assert one(spark, lambda c: fn.inject_page_marker(c, F.lit(page)), text) == want


def test_pages(spark):
    assert [tuple(p) for p in one(spark, fn.split_pages, "\f locks \f\n\fweirs\ntoo\f")] == [(2, "locks"), (4, "weirs\ntoo")]
    marked = "a <!-- page 8 -->b\n<!-- page 19 -->\nc <!-- page x -->"
    assert (one(spark, fn.page_of, marked), one(spark, fn.without_markers, marked)) == ("19", "a b\nc <!-- page x -->")
    assert (one(spark, fn.page_of, "plain"), one(spark, fn.without_markers, "plain ")) == ("", "plain")
    pages = spark.createDataFrame([([(1, "# A\nx"), (2, "y")],)], "p array<struct<page_num:int,text:string>>")
    assert pages.select(fn.join_pages("p").alias("x")).first().x == "# A\n<!-- page 1 -->\nx\n\n<!-- page 2 -->\ny"


def test_sections(spark):
    text = "lost\n# A\n## \n### C\ndeep\n# B\n#no\n####### no\n#  \nx\n##  T  \ny"
    assert [tuple(s) for s in one(spark, sections, text)] == plain.sections(text)


def test_split_cases(spark):
    cut = lambda text, **k: one(spark, lambda c: split_to_budget(c, **k), text)
    assert cut(" up, down ", max_tokens=4) == [" up, down "]
    assert [p.split() for p in cut("a b c d e f g", max_tokens=3, overlap=1, overflow="token")] == [["a", "b", "c"], ["c", "d", "e", "f"], ["f", "g"]]
    table = "\n".join(f"| weir {i} | {i * i} |" for i in range(40))
    assert cut(table, max_tokens=30) == [table]
    with pytest.raises(ValueError):
        cut("x", max_tokens=0)


def words(rng, n):
    return " ".join(rng.choice(["a", "bb.", "ccc!", "d?", "eee", "|x|"]) for _ in range(n))


def document(rng):
    lines = []
    for _ in range(rng.randint(0, 25)):
        kind = rng.random()
        if kind < 0.25:
            lines.append("#" * rng.randint(1, 7) + rng.choice([" ", "  ", "", "\t"]) + words(rng, rng.randint(0, 3)))
        elif kind < 0.4:
            lines.append(rng.choice(["", " ", "\u00a0"]))
        elif kind < 0.55:
            lines.append("| " + words(rng, rng.randint(1, 9)) + " |")
        else:
            lines.append(words(rng, rng.randint(1, 40)))
    return "\n".join(lines)


@pytest.mark.parametrize("overflow", ["paragraph", "sentence", "token"])
def test_chunks_as_written_out(spark, overflow):
    rng = random.Random(overflow)
    docs = [(i, document(rng)) for i in range(150)]
    config = ChunkingConfig(min_tokens=8, max_tokens=20, overlap_tokens=3, overflow=overflow)
    got = chunk_documents(spark.createDataFrame(docs, "doc_id int, text string"), config).collect()
    want = [(d, o, path, text) for d, t in docs for o, (path, text) in enumerate(plain.chunks(t, 8, 20, 3, overflow))]
    assert sorted((r.doc_id, r.chunk_order, r.heading_path, r.text) for r in got) == sorted(want)


def test_no_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no heading")], "doc_id int, text string")
    assert chunk_documents(df).count() == 0


def test_headings_are_linear(spark):
    """Many headings, of all levels: paths as written out, and no time that grows with their square."""
    rng = random.Random(8)
    text = "\n".join("#" * rng.randint(1, 6) + f" t{i}\nx" for i in range(3000))
    assert [tuple(s) for s in one(spark, sections, text)] == plain.sections(text)
    took = {}
    for n in (4000, 16_000):
        df = spark.createDataFrame([("\n".join(f"{'#' * (i % 6 + 1)} t {i}\nx {i}" for i in range(n)),)], "t string")
        began = time.perf_counter()
        assert df.select(F.size(sections(F.col("t")))).first()[0] == n
        took[n] = time.perf_counter() - began
    assert took[16_000] < 4 * took[4000] + 3


def test_many_units(spark):
    text = "\n\n".join(f"p{i} " + "w " * (i % 9) for i in range(1500))
    assert one(spark, lambda c: split_to_budget(c, 11, 2), text) == plain.split(text, 11, 2)
