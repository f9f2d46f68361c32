"""Exact top-k search by tiled matrix products.

Queries and candidates are packed into tiles of a few thousand vectors.  The
grid of query tiles and candidate shards is dealt out by (query tile, shard);
each task multiplies its tiles, keeps the best of every product tile, and the
lists of a query merge on the way up.  Nothing is broadcast, and a task's
memory is that of a few tiles whatever the tables' sizes.

Scores are inner products of whole numbers and exact: products run in doubles
while every partial sum is below 2**53; the few vectors with larger components
are multiplied in Python's integers, row by row, and their scores held to the
range of a long.  Equal scores go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.worker import serving

#: Vectors in a tile of queries, and in one of candidates.
QUERY_TILE, CANDIDATE_TILE = 2048, 2048
#: Queries that are multiplied at once.
QUERY_STEP = 512
#: Candidates in a shard, about.
SHARD_ROWS = 1 << 16
_LONG = np.iinfo(np.int64)


def quantize(x: np.ndarray) -> np.ndarray:
    """floor(256 x), of doubles; what is beyond the largest double is held to it."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * x.astype(np.float64)), -most, most)


def _vectors(batch: pa.RecordBatch, scale: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the usable rows by length: no null id or vector, none with null or non-finite components."""
    ids, lists = batch.column(0), batch.column(1)
    usable = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    values = lists.values
    offsets = lists.offsets.to_numpy()
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    id_values = ids.fill_null(0).to_numpy()
    for dim in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == dim))
        if not dim:
            continue
        matrix = flat[offsets[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1)
        yield id_values[rows[good]].astype(np.int64), scale(matrix[good])


def pack(vectors: DataFrame, size: int, scale: Callable[[np.ndarray], np.ndarray] = quantize) -> DataFrame:
    """Tiles of up to ``size`` vectors of one length, ids ascending; unusable rows take no part. vectors: (id, vector)."""

    @serving("topk")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tile(dim: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids[order].tobytes()], "data": [data[order].tobytes()]})

        for batch in batches:
            for ids, data in _vectors(batch, scale):
                for lo in range(0, len(ids), size):
                    held.setdefault(data.shape[1], []).append((ids[lo : lo + size], data[lo : lo + size]))
                    if sum(len(x[0]) for x in held[data.shape[1]]) >= size:
                        yield tile(data.shape[1])
        for dim in list(held):
            yield tile(dim)

    return vectors.mapInArrow(run, "dim int, ids binary, data binary").select(F.monotonically_increasing_id().alias("tile"), "dim", "ids", "data")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], np.float64).reshape(len(ids), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices, held to the range of a long."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    limit = math.sqrt(2.0**52 / a.shape[1])
    large_a, large_b = np.abs(a).max(axis=1) > limit, np.abs(b).max(axis=1) > limit
    if not large_a.any() and not large_b.any():
        return (a @ b.T).astype(np.int64)
    out = (np.where(large_a[:, None], 0.0, a) @ np.where(large_b[:, None], 0.0, b).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    held = lambda m: np.clip(m, _LONG.min, _LONG.max).astype(np.int64)
    if large_a.any():
        out[large_a] = held(whole(a[large_a]) @ whole(b).T)
    if large_b.any():
        out[:, large_b] = held(whole(a) @ whole(b[large_b]).T)
    return out


def first_k(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries that are among their row's k best, rows ascending and each from the best on, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, row))  # ~x falls as x rises, without overflow
    row, ids, scores = row[order], ids[order], scores[order]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    return row[place < k], ids[place < k], scores[place < k]


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k best without the row's own id, ties to the smaller id."""
    other = ids[None, :] != own[:, None]
    # The own id may be among the best: one more is taken, for each time that it is there.
    spare = k + int((~other).sum(axis=1).max(initial=0))
    if scores.shape[1] > spare:
        least = np.partition(scores, scores.shape[1] - spare, axis=1)[:, scores.shape[1] - spare]
        other &= scores >= least[:, None]
    row, at = np.nonzero(other)
    return first_k(row, ids[at], scores[row, at], k)


def top_k(queries: DataFrame, candidates: DataFrame, id_col: str, vector_col: str, k: int, scale: Callable[[np.ndarray], np.ndarray] = quantize) -> DataFrame:
    """Each query row's k best candidates: query_id, rank from 1, vec_id, score.

    Candidates of the query's own id take no part, nor do vectors that are
    null, empty or hold null or non-finite components, nor those of another
    length than the query's.  A repeated query row gets its list again;
    repeated candidates count each.  Empty tables give empty results.
    """
    spark = queries.sparkSession
    pair = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    n_queries, n_candidates = queries.count(), candidates.count()
    blocks = max(1, math.ceil(n_queries / QUERY_TILE))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_candidates / SHARD_ROWS))
    dealt = pair(queries).withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))

    def pack_block(key: tuple, rows: pa.Table) -> pa.Table:
        found = [x for batch in rows.combine_chunks().to_batches() for x in _vectors(batch, scale)]
        dims, ids, data = [], [], []
        for own, matrix in found:
            order = np.argsort(own, kind="stable")
            dims.append(matrix.shape[1])
            ids.append(own[order].tobytes())
            data.append(matrix[order].tobytes())
        return pa.table({"block": pa.array([key[0].as_py()] * len(dims), pa.int32()), "dim": pa.array(dims, pa.int32()), "ids": pa.array(ids, pa.binary()), "data": pa.array(data, pa.binary())})

    tiles = dealt.groupBy("block").applyInArrow(pack_block, "block int, dim int, ids binary, data binary").withColumn("tile", F.monotonically_increasing_id())
    q = tiles.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *_names())
    c = pack(pair(candidates), CANDIDATE_TILE, scale)
    c = c.withColumn("shard", F.pmod(F.xxhash64("tile"), F.lit(shards)).cast("int")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", *_names())

    schema = pa.schema([("tile", pa.int64()), ("at", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for x in left.to_pylist():
            own, a = _open(x)
            for lo in range(0, len(own), QUERY_STEP):
                held = (np.empty(0, np.int64),) * 3
                mine = own[lo : lo + QUERY_STEP]
                for name in range(right.num_rows):
                    y = {c: right.column(c)[name].as_py() for c in ("dim", "ids", "data")}
                    if y["dim"] == x["dim"]:
                        ids, b = _open(y)
                        found = best(products(a[lo : lo + QUERY_STEP], b), ids, mine, k)
                        held = first_k(*(np.concatenate(z) for z in zip(held, found, strict=True)), k)
                out.append(pa.table({"tile": np.full(len(held[0]), x["tile"]), "at": (held[0] + lo).astype(np.int32), "query_id": mine[held[0]], "vec_id": held[1], "score": held[2]}, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    parts = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInArrow(multiply, "tile long, at int, query_id long, vec_id long, score long")
    order = Window.partitionBy("tile", "at").orderBy(F.col("score").desc(), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _names() -> list[Column]:
    return [F.col(x) for x in ("tile", "dim", "ids", "data")]
