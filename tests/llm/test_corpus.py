from __future__ import annotations

import math
import random
import struct
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrain import storage
from lexigrain.llm import components, decontaminate, jaccard, labelled, line_dedup, queries, sharding, skew, topk


def saved(spark, tmp_path, rows, schema, files=3):
    """Rows as a scanned table of a few files."""
    path = str(tmp_path / f"t{random.getrandbits(40)}")
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


# Sharding.


def test_sharding(spark):
    rows = [(i, f"t{i}", "c") for i in range(4000)] + [(7, "t7", "c")] * 5 + [(None, "n", "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = sharding.with_slots(sharding.shard_records(df, "doc_id", [1.0] * 6, "shard", "grown"), "shard", ("doc_id", "text")).collect()
    assert len(got) == len(rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(6)) and min(by.values()) > 500
    for s, n in by.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.grown in (r.shard, 6) for r in got) and 350 < sum(r.grown == 6 for r in got) < 800
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    weighted = sharding.shard_records(df, "doc_id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / len(rows) for r in weighted}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.03
    assert sharding.with_slots(sharding.shard_records(df.limit(0), "doc_id", [1.0])).count() == 0


def test_slots_do_not_depend_on_settings(spark):
    df = spark.range(500).select((F.col("id") % 90).alias("doc_id"), F.lit("t").alias("text")).withColumn("shard", F.col("doc_id") % 3)
    got = []
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got.append(sorted(map(tuple, sharding.with_slots(df, "shard", ("doc_id", "text")).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and len(got[0]) == 500


def test_sharding_query_by_hand(spark, tmp_path):
    """The query against rendezvous hashing written out, rows that repeat often and nulls included."""
    rows = [(i, f"text {i % 7} é") for i in range(300)] + [(5, "same")] * 200 + [(None, "n"), (8, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_sharding(spark, str(tmp_path)).collect()

    def shard(doc, n):
        own = xxhash.xxh64_intdigest(struct.pack("<q", doc), seed=42) if doc is not None else 42
        unit = lambda i: ((xxhash.xxh64_intdigest(struct.pack("<i", i), seed=own) >> 11) + 0.5) / 2**53
        return min(range(n), key=lambda i: (-math.log(unit(i)), i))

    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", shard(i, 24), shard(i, 25)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(24):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)


def test_join_of_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_SHARE", 10)
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(i, i) for i in range(2, 60)] + [(None, 0)] * 50, "k long, x long")
    unique = rows.groupBy("k").agg(F.count("*").alias("m"), F.min("x").alias("least"))
    got = skew.join_unique(rows, unique, ["k"], "m")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert Counter(map(tuple, got.collect())) == Counter([(1, i, 0) for i in range(300)] + [(i, i, i) for i in range(2, 60)])


def test_columns_that_clash(spark, tmp_path):
    rows = [(i, "a b c\nd e f\n" + "g " * (i % 3), i * 7, "x", f"d{i}") for i in range(9)]
    df = saved(spark, tmp_path, rows, "doc_id long, text string, __row long, n_lines string, n_deleted string")
    out = line_dedup.dedup_lines(df, min_words=3)
    assert out.columns == df.columns and all(r["__row"] == r.doc_id * 7 and r.n_deleted == f"d{r.doc_id}" for r in out.collect())
    counted = line_dedup.dedup_lines(df, min_words=3, counts=("n_lines", "n_deleted"))
    assert sorted(counted.columns) == sorted(df.columns) and counted.filter("n_deleted > 0").count() == 8
    kept = jaccard.keep_first(df, size=2, percent=90)
    assert kept.columns == df.columns and all(r["__row"] == r.doc_id * 7 for r in kept.collect())
    clean = decontaminate.decontaminate(df, spark.createDataFrame([(1, "f g g")], "item_id long, text string"))
    assert clean.columns == df.columns and {r["__row"] for r in clean.collect()} == {r[2] for r in rows if r[0] % 3 < 2}


# Line dedup.


def check_lines(spark, tmp_path, rows, least):
    df = saved(spark, tmp_path, [(*r, "x", 9) for r in rows], "doc_id long, text string, n_lines string, seg int")
    got = line_dedup.dedup_lines(df, min_words=least, counts=("n_lines", "gone")).select("doc_id", "text", "seg").collect()
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    gone = brute.deleted_lines([rows[k] for k in order], least)
    want = [(rows[k][0], rows[k][1] if not gone[i] else "\n".join(x for j, x in enumerate(rows[k][1].split("\n")) if j not in gone[i]), 9) for i, k in enumerate(order)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_line_dedup_cases(spark, tmp_path):
    rows = [(1, "a b c\nd e f\ng"), (2, "x\na b c\nd e f\ny"), (3, "a b c\nz\nd e f"), (4, None), (5, ""), (6, "a b c\nd e f\ng"), (7, "r r\nr r\nr r\nr r\nr r"), (8, "\n\n\n\n\n\n"), (9, "r r\n\nr r\nr r\nr r")]
    check_lines(spark, tmp_path, rows, 5)
    assert line_dedup.dedup_lines(saved(spark, tmp_path, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_random(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = ["a", "b b", "c c c", "", "d d d d", "e e e e e e e"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(25)]
    check_lines(spark, tmp_path, rows, rng.choice([1, 4, 7, 12]))


def test_line_dedup_beyond_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_ROWS", 0)
    check_lines(spark, tmp_path, [(1, "a b c\nd"), (2, "x\na b c\nd"), (3, "a b c\nd")], 3)


# Jaccard.


def mutated(rng, base, k):
    w = base.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice("pqrstuvw")
    return " ".join(w)


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 0), (5, 80, 1), (1, 50, 2)])
def test_jaccard_random(spark, tmp_path, size, percent, seed):
    rng = random.Random(seed)
    bases = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (6, 30, 60, 150)]
    rows = [(i, mutated(rng, rng.choice(bases), rng.randint(0, 4))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "  \t "), (203, ""), (204, "One"), (205, "one"), (206, "one two"), (207, "one two")]
    df = saved(spark, tmp_path, [(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_ids(df, size, percent).collect()}
    assert got == brute.components(rows, size, percent)


def test_jaccard_every_boundary(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, mutated(rng, base, rng.randint(0, 3))) for i in range(60)]
    df = saved(spark, tmp_path, rows, "doc_id long, text string")
    want = brute.components(rows, 4, 85)
    monkeypatch.setattr(jaccard, "MAX_SLICES", 0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_ids(df, 4, 85).collect()} == want
    monkeypatch.setattr(jaccard, "MAX_SLICES", 1 << 26)
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_IDS", 0)
    for limit in (0, 36, 37, 10_000):
        monkeypatch.setattr(jaccard, "boundary", lambda filed, percent, limit=limit: limit)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_ids(df, 4, 85).collect()} == want


def test_jaccard_copies(spark, tmp_path):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b C d e f"), (None, "zz"), (1, ""), (1, "")]
    df = saved(spark, tmp_path, rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in jaccard.component_ids(df, 5, 80).collect()) == {(5, 3): 1, (3, 3): 2, (9, 3): 1, (None, None): 1, (1, 1): 2}
    assert Counter((r.doc_id, r.text) for r in jaccard.keep_first(df).collect()) == {(3, "a b c d e f"): 1, (None, "zz"): 1, (1, ""): 2}
    assert jaccard.component_ids(saved(spark, tmp_path, [], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (202, 201)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys(range(200, 203), 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_few_statements(spark, monkeypatch):
    """The driver keeps something of every statement: a long path takes two tables, as a pair does."""
    tables = []
    for module in (components, skew):
        monkeypatch.setattr(module, "materialize", lambda df, name="table": tables.append(name) or storage.materialize(df, name))
    nodes = list(range(300))
    random.Random(3).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    assert dict(map(tuple, components.components(edges).collect())) == dict.fromkeys(range(300), 0)
    assert len(tables) <= 2
    links = storage.materialize(edges, "links")
    assert components.components(links).count() == 300 and links.count() == 299


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_components_over_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(components, "EDGES_PER_TASK", most)
    rng = random.Random(most)
    edges = [(9_000_000_000 + i, 9_000_000_001 + i) for i in range(40)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(5000, i) for i in range(5001, 5060)] * 2 + [(-7, -3), (-3, -3)]
    rng.shuffle(edges)
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert Counter(map(tuple, got)) == Counter(least.items())


# Decontamination.

ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "tiny item"), (2, "Tiny, ITEM"), (3, ""), (4, None), (None, "naïve été")]
DOCS = ["x ONE-two three four five six seven eight nine ten eleven y", "one two three four five six seven eight nine", "tiny item, tiny item", None, "", "naïve été", "tiny " * 5000 + "item", "one two three four five six seven eight nine ten"]


@pytest.mark.parametrize("block", [1 << 24, 70])
def test_find_items(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(DOCS)], "doc_id long, text string, hits int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in decontaminate.find_items(docs, items).collect()}
    assert got == {i: (len(w), hit, found) for i, (w, hit, found) in enumerate(brute.windows_hit(DOCS, ITEMS, 10))}


def test_decontaminate(spark, tmp_path):
    docs = saved(spark, tmp_path, list(enumerate(DOCS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [1, 3, 4]
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(DOCS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    near = decontaminate.find_items(docs, items.filter("item_id = 1"), span=40).filter("size(items) > 0").collect()
    assert [r.doc_id for r in near] == [0, 7]
    posted = {(r.term, r.doc_id): r.positions for r in decontaminate.index_postings(docs, items.filter("item_id = 2")).collect()}
    assert posted["tiny", 2] == [0, 2] and posted["item", 6] == [5000]


# Top-k.


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)], "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [1.0, float("nan"), 0.0, 0.0], "x"), (302, [1.0, None, 0.0, 0.0], "x"), (None, [1.0] * 4, "x"), (303, [], "x"), (304, [1.0, 2.0], "x"), (305, [2.0, 1.0], "x")]
    rows += [(i, [0.5] * 4, "x") for i in range(400, 420)] + [(5, rows[5][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, tile string").repartition(4)
    asked = df.filter("vec_id % 20 = 0 or vec_id = 304")
    got = topk.top_k(asked, df, "vec_id", "embedding", 5).collect()
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in usable:
        if i % 20 == 0 or i == 304:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))[:5]
            want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert Counter(map(tuple, got)) == Counter(want)
    assert topk.top_k(asked.limit(0), df, "vec_id", "embedding", 5).count() == 0
    assert topk.products(np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0]]))[0, 0] == np.iinfo(np.int64).max


def test_large_components(spark):
    rows = [(0, [1e306, 1.0]), (1, [1.0, -1.0]), (2, [-1e308, 1.0]), (3, [2.0**40, 0.5]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df, "vec_id", "embedding", 5).collect()}
    whole = {i: [int(np.floor(min(max(256.0 * x, -1.7976931348623157e308), 1.7976931348623157e308))) for x in v] for i, v in rows}
    for i, q in whole.items():
        scores = {j: min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1) for j, v in whole.items() if j != i}
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        assert [got[i, k] for k in range(1, 5)] == want


def test_fold(spark):
    got = spark.createDataFrame([(12,), (None,)], "doc_id long").select(labelled.held_out(F.col("doc_id")).alias("h")).collect()
    assert labelled.fold_of(12) == zlib.crc32(b"12") % 5 and [r.h for r in got] == [labelled.fold_of(12) == 0, False]


# Row numbers.


@pytest.fixture
def splits_change(spark, monkeypatch):
    """A function after whose call files are split otherwise once the next table is written, as where executors come and go."""
    key, write = "spark.sql.files.maxPartitionBytes", storage.materialize

    def written(*args):
        out = write(*args)
        spark.conf.set(key, "128m")
        return out

    for module in (storage, line_dedup, jaccard):
        monkeypatch.setattr(module, "materialize", written)
    yield lambda: spark.conf.set(key, "400")
    spark.conf.unset(key)


def test_numbers_hold_when_splits_change(spark, tmp_path, splits_change):
    rows = [(i, f"only {i}\n" + ("a b c\nd e f" if i % 3 == 0 else f"x {i} y {i} z {i}")) for i in range(60)]
    df = saved(spark, tmp_path, rows, "doc_id long, text string", files=12)
    gone = brute.deleted_lines(rows, 5)
    want = [(i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k])) for k, (i, t) in enumerate(rows)]
    splits_change()
    assert sorted(map(tuple, line_dedup.dedup_lines(df, min_words=5).collect())) == want
    rows = [(i, " ".join(f"w{i % 20}x{k}" for k in range(30 - i // 40))) for i in range(60)]
    df = saved(spark, tmp_path, rows, "doc_id long, text string", files=12)
    splits_change()
    assert sorted((r.doc_id, r.component_id) for r in jaccard.component_ids(df, 5, 80).collect()) == [(i, i % 20) for i in range(60)]
    splits_change()
    assert sorted(map(tuple, jaccard.keep_first(df).collect())) == rows[:20]
    items = spark.createDataFrame([(7, rows[7][1])], "item_id long, text string")
    splits_change()
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, items).collect()) == [i for i in range(60) if i % 20 != 7]
