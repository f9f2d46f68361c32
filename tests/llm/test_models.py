from __future__ import annotations

import random
import runpy

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexigrain.llm import labelled, quality, toxicity

DIR = "/root/testdata/sf0.01"


def held_out(df, labels, target):
    rows = df.join(labels, "doc_id").filter(labelled.fold(F.col("doc_id")) == 0).select("score", F.col(target).alias("y")).toPandas()
    return rows["score"].to_numpy(), rows["y"].to_numpy()


def auc(score, y):
    a, b = score[y == 1][:, None], score[y == 0][None]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_isotonic():
    steps, levels = quality.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(levels) >= 0).all() and (np.diff(steps) >= 0).all() and levels[0] < 0.5 < levels[-1]


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", labelled.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == labelled.fold_of(r.id) for r in got)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model)
    score, y = held_out(scored, labels, "quality")
    assert auc(score, y) > 0.95 and ((score >= 0.3) == y).mean() > 0.93 and scored.count() == docs.count()
    odd = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (2, "", "s"), (3, "w " * 100_000, "s")], "doc_id long, text string, score string")
    out = quality.score(odd, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and out[0].score == out[2].score
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert 0.49 < quality.score(docs, quality.fit(docs, labels)).first().score < 0.51


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("label"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    n = labelled.training_rows(docs, labels, "toxic", max_rows=500).count()
    assert 400 < n < 600
    assert all(labelled.fold_of(r.id) for r in labelled.training_rows(docs, labels, "toxic").limit(50).collect())


@pytest.fixture(scope="module")
def made(spark):
    """Clean texts, and toxic ones with a word of two or a beginning."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(400)]
    rows = []
    for i in range(1200):
        w = [rng.choice(vocabulary) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(["idiot", "moron", "kwzrgh" + word()])
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity(spark, made):
    docs, labels = made
    model = toxicity.fit(docs, labels)
    score, y = held_out(toxicity.score(docs, model), labels, "toxic")
    assert ((score >= 0.5) == y).mean() > 0.98
    hidden = ["you 1d10t", "such an id1ot!", "m.o.r.o.n", "you i d i o t", "idiooot", "MORON", "mor0n, ok", "m-o-r-o-n", "###idiot###"]
    clean = ["nice text", "", None, "a b c d", "1 2 3 4", "12:30 at 5", "y o u"]
    rows = spark.createDataFrame(list(enumerate(hidden + clean)), "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    assert all(got[i] >= 0.5 for i in range(len(hidden))), got
    assert all(got[i] < 0.5 for i in range(len(hidden), len(got))), got
    assert toxicity.score(rows.limit(0), model).count() == 0


def test_toxicity_without_labels(spark, made):
    docs, labels = made
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0


def test_trigrams_count_all(spark):
    one = toxicity.trigram_counts(spark.createDataFrame([("abc",)] * 7 + [(None,), ("",)], "text string").repartition(3))
    codes = toxicity.codes_of(["abc"])
    assert one[(codes[0] * toxicity._SIZE + codes[1]) * toxicity._SIZE + codes[2]] == 7


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, DIR)
    kept = {r.doc_id for r in out.collect()}
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()} and len(kept) > 600
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    bad = [r for r in labels if r.quality == 0]
    assert sum(r.doc_id in kept for r in bad) <= 0.1 * len(bad)
    first = docs.groupBy("text").agg(F.min("doc_id").alias("i"), F.count("*").alias("n")).filter("n > 1").select("i", "text")
    copies = docs.join(first, "text").filter("doc_id <> i").select("doc_id").collect()
    assert copies and sum(r.doc_id in kept for r in copies) <= 0.05 * len(copies)


def test_pipeline_by_hand(spark, tmp_path):
    """Every stage against its brute force, on what the stage before it kept."""
    rng = random.Random(3)
    words = ["the", "of", "and", *(f"w{i}" for i in range(300))]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    shared = text(6)
    rows = [(i, text(rng.randint(2, 8)) if i % 5 else text(2) + "\n" + shared + "\n" + text(1)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200 + i, rows[i + 10][1].replace("w1 ", "w2 ", 1)) for i in range(6)] + [(300, None), (301, ""), (302, "!! " * 90)]
    items = [(1, " ".join(rows[22][1].split()[5:17])), (2, "not there")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i != 302)) for i, _ in rows if i % 2 == 0], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = lambda name: spark.read.parquet(str(tmp_path / f"{name}.parquet"))

    scored = quality.score(read("documents"), quality.fit(read("documents"), read("labels"))).collect()
    now = sorted((r.doc_id, r.text) for r in scored if r.score >= 0.3)
    gone = brute.deleted_lines(now, 50)
    lines = [[x for j, x in enumerate((t or "").split("\n")) if j not in gone[k]] for k, (_, t) in enumerate(now)]
    now = [(i, t if not gone[k] else "\n".join(lines[k])) for k, (i, t) in enumerate(now) if lines[k]]
    found = brute.components(now, 5, 80)
    now = [(i, t) for i, t in now if found[i][1] == i]
    now = [x for x, (_, hit, _) in zip(now, brute.windows_hit([t for _, t in now], items, 10), strict=True) if not hit]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in now}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert 22 not in want and not any(100 <= i < 300 for i in want) and len(want) > 30


def test_entry_lists_operators():
    entry = runpy.run_path(str(__import__("pathlib").Path(corpus_pipeline.__file__).parent / "__spark_entry__.py"))
    names = set(entry["queries"]())
    assert {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry["oracle_sql"]()) <= names
