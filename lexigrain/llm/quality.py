"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

A text becomes some twenty statistics; random cosines of them approximate a
Gaussian kernel.  Each partition of the fitting sample sums its part of the
normal equations, the driver solves the ridge system of fixed size, and scores
on rows kept apart from it calibrate the result by pooling adjacent violators.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.html_text import STOP_WORDS
from lexigrain.llm.labelled import MAX_FIT_ROWS, training_rows
from lexigrain.llm.worker import serving
from lexigrain.storage import bound_batches, materialize, release

FEATURES = 256
RIDGE = 1e-2
SEED = 7
#: Partitions that sum the normal equations; each sends one matrix.
FIT_PARTITIONS = 16
_SYMBOLS = "#$%&*|!@~^_+=<>\\{}[]"


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 17
    counts = Counter(words)
    lines = text.split("\n")
    chars = len(text)
    share = lambda x: x / n
    return [
        math.log1p(n),
        len(counts) / n,
        math.log1p(len(counts)) / math.log1p(n),
        share(sum(map(eq, words, words[1:]))),
        share(max(counts.values())),
        len(set(zip(words, words[1:], strict=False))) / n,
        share(sum(map(str.isupper, words))),
        share(sum(map(str.istitle, words))),
        share(sum(map(str.isalpha, words))),
        share(sum(map(STOP_WORDS.__contains__, words))),
        min(chars / n, 40.0),
        math.log1p(share(sum(map(text.count, _SYMBOLS)))),
        math.log1p(share(sum(map(text.count, "0123456789")))),
        share(text.count(".")) + share(text.count("?")),
        share(text.count(",")) + share(text.count(";")),
        math.log1p(len(lines)) / math.log1p(n),
        len(set(lines)) / len(lines),
    ]


@dataclass
class Model:
    """All that a score needs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosines of standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.phases) * math.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score from 0 to 1; a thousandth of it keeps the order inside a calibrated step."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.steps, self.levels) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit of y by x: breakpoints and values, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, least x, greatest x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    # One row of doubt on either side keeps the ends off 0 and 1.
    steps, levels = [], []
    for s, n, lo, hi in pools:
        level = (s + 0.5) / (n + 1)
        steps += [lo, hi] if hi > lo else [lo]
        levels += [level, level] if hi > lo else [level]
    return np.array(steps), np.maximum.accumulate(np.array(levels))


def _statistics_of(df: DataFrame) -> DataFrame:
    @serving("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(statistics, part.column(1).to_pylist()), pa.list_(pa.float64()))], names=["id", "label", "x"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled rows: three quarters for the ridge, the rest for calibration.

    Without any labelled row, or with one class only, every score is that
    class's share (one half without rows).
    """
    bound_batches(docs.sparkSession)
    held_apart = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(4)) == 0
    sample = materialize(_statistics_of(training_rows(docs, labels, target, max_rows=max_rows)).select("x", "label", held_apart.alias("apart")), "quality-sample")
    dim = len(statistics(None))
    moments = sample.select(F.posexplode("x"), "label").groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("spread"), F.avg("label").alias("share")).orderBy("pos").collect()
    if not moments:
        return _constant(dim, 0.5)
    rng = np.random.default_rng(SEED)
    scale = np.maximum([m.spread for m in moments], 1e-6)
    model = Model(np.array([m.mean for m in moments]), scale, rng.normal(size=(dim, FEATURES)) / math.sqrt(dim), rng.uniform(0, 2 * math.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.array([moments[0].share]))
    gram, moment = _normal_equations(sample.filter(~F.col("apart")), model)
    model.ridge = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)
    # A quarter of the sample, a number and a label a row.
    apart = sample.filter("apart").select("x", "label").toPandas()
    if len(apart):
        model.steps, model.levels = isotonic(model.raw(np.array(apart["x"].tolist(), float)), apart["label"].to_numpy(float))
    release(sample)
    return model


def _constant(dim: int, level: float) -> Model:
    return Model(np.zeros(dim), np.ones(dim), np.zeros((dim, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.array([level]))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products over the sample, one matrix from each of FIT_PARTITIONS partitions."""

    @serving("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                phi = model.features(np.array(batch.column(0).to_pylist(), float))
                total += np.hstack([phi.T @ phi, (phi.T @ batch.column(1).to_numpy().astype(float))[:, None]])
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = rows.select("x", "label").repartition(FIT_PARTITIONS).mapInArrow(run, "m binary").toLocalIterator()
    total = sum((np.frombuffer(r.m).reshape(FEATURES + 1, FEATURES + 2) for r in parts), np.zeros((FEATURES + 1, FEATURES + 2)))
    return total[:, :-1], total[:, -1]


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with every column it has and the score of its whole text; no shuffle. An older ``score_col`` is replaced."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    @serving("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array([statistics(t) for t in part.column(at).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(x))], names=[*map(str, range(part.num_columns)), "s"])

    names = docs.columns
    fields = ", ".join(f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return docs.toDF(*map(str, range(len(names)))).mapInArrow(run, f"{fields}, s double").toDF(*names, score_col)
