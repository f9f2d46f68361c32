"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model counts letter trigrams over all words of the
corpus.  Tokens that look disguised (figures or signs for letters, separators
inside a word, letters drawn out, words spelled letter by letter) become a
lattice of what each character may stand for; the Viterbi path under the
language model and the cost of each disguise is the restored word.  Everything
else is only folded.

The score is a logistic regression on the words and word beginnings of the
restored text, chosen by an L1 penalty: what occurs mostly in toxic texts is a
candidate, and a candidate gets a weight only if it explains more toxic texts
than the penalty costs, over and above the others; the chosen ones are fitted
again under a small L2 penalty.  So words that merely
travel with copies of toxic texts get none, whatever the number of copies:
the words that make them toxic explain those texts and others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.labelled import MAX_FIT_ROWS, training_rows
from lexigrain.llm.worker import serving
from lexigrain.storage import bound_batches, materialize, release

# What a disguising character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¢": "c", "ß": "b", "*": "", "#": "", "%": "",
}
#: Costs of reading a sign as a letter, of dropping a separator, and of dropping a repeated letter.
LEET_COST, SEPARATOR_COST, REPEAT_COST = 1.0, 0.5, 0.5
#: A word's beginnings of these lengths are features, and the word itself.
BEGINNINGS = (4, 5, 6, 7)
#: A feature is a candidate if so many different toxic texts of the sample have it, and this share of all that do is toxic.
MIN_TOXIC, MIN_SHARE = 4, 0.8
#: L1 penalty, in texts: the unexplained toxic texts beyond which a feature gets weight. L2 penalty of the fit on those that do.
PENALTY, RIDGE, ROUNDS = 2.0, 0.05, 300
#: Decoded words kept per worker; when full the cache starts anew.
CACHE_WORDS = 100_000

# The language model's alphabet: 0 for what is around words, then letters; other letters share the last symbol.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
_SIZE = len(_LETTERS) + 2
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_edge = ".,;:!?\"'()[]{}<>«»“”‘’…-–—_*#&%~/\\|`^=+"
_letters = re.compile(r"[^\W\d_]")
_disguise = re.compile(r"(?=.*[^\W\d_])(?:.*[^\W\d_][\d@$!|+€£(¢*#%.\-_~'/]+[^\W\d_]|[\d@$!|+€£(¢]+[^\W\d_]{2}|.*[^\W\d_]{2}[\d@$€£¢]+$|.*([^\W\d_])\1\1)")
_spelled = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€])(?:[\s.\-_*]{1,2}(?:[^\W_]|[@$!|+€])){2,}(?!\S)")
_between = re.compile(r"[\s.\-_*]+")
#: Letters at either end of a spelled stretch that may be words of their own, and stretches up to which that is tried.
OWN_WORDS, MAX_SPELLED = 2, 24


def codes_of(words: Iterable[str]) -> np.ndarray:
    """Symbols of a text of words, one blank between them."""
    joined = " ".join(words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


_TABLE = np.full(0x3000, _SIZE - 1, np.int64)
_TABLE[: 0x41] = 0
_TABLE[0x5B:0x61] = _TABLE[0x7B:0xC0] = 0
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _TABLE[ord(_c.upper())] = _i


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Letter trigrams of all texts: an array of fixed size, summed by partition and then by cell."""

    @serving("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                c = codes_of(t for t in batch.column(0).slice(lo, 256).to_pylist() if t)
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=len(total))
        cells = np.flatnonzero(total)
        for lo in range(0, len(cells), 10_000):
            at = cells[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    cells = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(_SIZE**3)
    found = cells.toPandas()  # at most _SIZE ** 3 cells, whatever the corpus
    out[found["cell"].to_numpy(np.int64)] = found["n"]
    return out


class Decoder:
    """Viterbi decoding of disguised words under a letter trigram model."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(_SIZE, _SIZE, _SIZE)
        single = cube.sum(axis=(0, 1)) + 1.0
        pair = cube.sum(axis=0)
        low = single / single.sum()
        mid = (pair + 5 * low) / (pair.sum(axis=1, keepdims=True) + 5)
        high = (cube + 5 * mid[None]) / (cube.sum(axis=2, keepdims=True) + 5)
        self.cost = -np.log(high)

    def decode(self, word: str) -> str:
        """The likeliest word behind a folded token; a token of no letters stays."""
        code = _CODE.get
        # State: the last two symbols; value: cost, text, last letter as written.
        beam: dict[tuple[int, int], tuple[float, str, str]] = {(0, 0): (0.0, "", "")}
        for i, c in enumerate(word):
            options: list[tuple[str, float]] = []
            if c.isalpha() and c not in "ß":
                options.append((c, 0.0))
            elif c == "ß":
                options += [("ß", 0.0), ("b", LEET_COST)]
            for x in LEET.get(c, "") if c != "ß" else "":
                options.append((x, LEET_COST))
            skip = None
            if not c.isalnum():
                skip = SEPARATOR_COST
            elif i and c == word[i - 1]:
                skip = REPEAT_COST
            nxt: dict[tuple[int, int], tuple[float, str, str]] = {}
            for (a, b), (cost, text, last) in beam.items():
                for x, extra in options:
                    k = code(x, _SIZE - 1)
                    new = cost + extra + float(self.cost[a, b, k])
                    if (b, k) not in nxt or new < nxt[b, k][0]:
                        nxt[b, k] = (new, text + x, x)
                if skip is not None or not options:
                    new = cost + (skip if skip is not None else LEET_COST)
                    if (a, b) not in nxt or new < nxt[a, b][0]:
                        nxt[a, b] = (new, text, last)
            beam = nxt
        best = min(((cost + float(self.cost[a, b, 0]), text) for (a, b), (cost, text, _) in beam.items()), default=(0.0, word))
        return best[1] or word


def restored(text: str | None, decode) -> set[str]:
    """The folded words of a text, disguised ones decoded as well. decode: word to word."""
    if not text:
        return set()
    folded = text.lower()
    tokens = set(folded.split())
    out: set[str] = set()
    for t in tokens:
        w = t.strip(_edge)
        if w:
            out.add(w)
        if not t.isalpha() and (_disguise.match(w) or _disguise.match(t.rstrip(".,;:?"))):
            out.add(decode(t.strip(".,;:?\"'()[]{}<>")))
            out.add(decode(w))
        elif t.isalpha() and _disguise.match(t):
            out.add(decode(t))
    for m in _spelled.finditer(folded):
        letters = _between.sub("", m[0])
        if _letters.search(letters):
            out.add(decode(letters))
            # Words of one letter may stand before and behind the one that is spelled.
            if len(letters) <= MAX_SPELLED:
                out.update(decode(letters[i : len(letters) - j]) for i in range(OWN_WORDS + 1) for j in range(OWN_WORDS + 1) if i + j and len(letters) - i - j >= 3)
    out.discard("")
    return out


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class _Decodings(dict):
    """Decoded words by word, bounded."""

    def __init__(self, decoder: Decoder):
        super().__init__()
        self.decoder = decoder

    def __missing__(self, w: str) -> str:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[w] = out = self.decoder.decode(w)
        return out


@dataclass
class Model:
    """Language model, weights of features, and the log odds of a text without any."""

    counts: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf

    def scorer(self):
        """A function from text to score, with caches of its own."""
        decode, hits, weights = _Decodings(Decoder(self.counts)).__getitem__, {}, self.weights

        def hit(w: str) -> tuple[str, ...]:
            if w not in hits:
                if len(hits) > CACHE_WORDS:
                    hits.clear()
                hits[w] = tuple(f for f in features_of(w) if f in weights)
            return hits[w]

        def score(text: str | None) -> float:
            found = {f for w in restored(text, decode) for f in hit(w)}
            # Summed in order, so that a text's score does not depend on the process.
            return _sigmoid(self.bias + sum(weights[f] for f in sorted(found)))

        return score


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


def logistic(texts: Sequence[Sequence[int]], labels: np.ndarray, n_features: int, n_clean: int, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised fit on texts as sets of features, and ``n_clean`` more clean texts without any.

    Accelerated proximal gradient.  Weights are not negative: features are
    evidence of toxicity, and a missing one is none.
    """
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    cols = np.fromiter((f for t in texts for f in t), np.int64, len(rows))
    # A text's gradient reaches all its features at once: the step is bounded by features a text times texts a feature.
    most = max((len(t) for t in texts), default=0) + 1
    step = 1.0 / (np.maximum(np.bincount(cols, minlength=n_features), 1) * most / 4 + l2)
    bias_step = 4.0 / ((len(texts) + n_clean) * most)
    w = v = np.zeros(n_features)
    bias = bias_v = math.log((labels.sum() + 0.5) / (n_clean + len(labels) - labels.sum() + 0.5))
    pace = 1.0
    for _ in range(ROUNDS):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(rows, v[cols], len(texts)) + bias_v, -50, 50)))
        grad = np.bincount(cols, (p - labels)[rows], n_features) + l2 * v
        new = np.maximum(v - step * (grad + l1), 0.0)
        new_bias = bias_v - bias_step * ((p - labels).sum() + n_clean * _sigmoid(bias_v))
        ahead = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        v, bias_v = new + (pace - 1) / ahead * (new - w), new_bias + (pace - 1) / ahead * (new_bias - bias)
        w, bias, pace = new, new_bias, ahead
    return w, bias


def select_and_fit(texts: Sequence[Sequence[int]], labels: np.ndarray, n_features: int, n_clean: int) -> tuple[np.ndarray, float]:
    """Features by the L1 penalty, then weights of those by a fit that does not shrink them so."""
    first, _ = logistic(texts, labels, n_features, n_clean, PENALTY, 0.0)
    chosen = np.flatnonzero(first > 1e-6)
    at = np.full(n_features, -1)
    at[chosen] = np.arange(len(chosen))
    own = [[int(at[f]) for f in t if at[f] >= 0] for t in texts]
    weights = np.zeros(n_features)
    weights[chosen], bias = logistic(own, labels, len(chosen), n_clean, 0.0, RIDGE)
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> Model:
    """Count trigrams over all documents; learn features on at most about ``max_rows`` labelled rows.

    Without labelled rows nothing is toxic: every score is 0.
    """
    bound_batches(docs.sparkSession)
    counts = trigram_counts(docs)
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    sample = training_rows(docs, labels, target, max_rows=max_rows)

    @serving("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _Decodings(Decoder(sent.value)).__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                words = [sorted({f for w in restored(t, decode) for f in features_of(w)}) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(words, pa.list_(pa.string()))], names=["id", "label", "features"])

    seen = sample.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, label int, features array<string>")
    seen = materialize(seen.withColumn("sign", F.xxhash64("features")), "toxicity-sample")
    toxic = F.col("label") == 1
    # Copies of one text count once: equal feature sets are one text. As few ids as the sample has rows.
    once = seen.groupBy("label", "sign").agg(F.min("id").alias("id")).select("label", "sign", "id")
    distinct = seen.join(F.broadcast(once), ["label", "sign", "id"], "left_semi")
    totals = distinct.agg(F.count("*").alias("n"), F.sum(toxic.cast("int")).alias("t")).first()
    model = Model(counts)
    if not totals.n or not totals.t:
        return model
    rows = distinct.select("label", F.explode("features").alias("feature"))
    usable = rows.groupBy("feature").agg(F.sum(toxic.cast("int")).alias("t"), F.count("*").alias("n")).filter((F.col("t") >= MIN_TOXIC) & (F.col("t") >= MIN_SHARE * F.col("n")))
    # Bounded by the words of the sample's toxic texts, as are the sets below.
    names = sorted(r.feature for r in usable.select("feature").collect())
    kept = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(kept.value[f] for f in fs if f in kept.value) for fs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["label", "features"])

    held = distinct.select("label", "features").mapInArrow(numbered, "label int, features array<int>").filter(toxic | (F.size("features") > 0)).collect()
    held.sort(key=lambda r: (r.label, r.features))
    labels_ = np.array([r.label for r in held], float)
    weights, model.bias = select_and_fit([r.features for r in held], labels_, len(names), totals.n - len(held))
    model.weights = {f: float(w) for f, w in zip(names, weights, strict=True) if w > 1e-6}
    release(seen)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id and its score from 0 to 1; null and empty texts score the rate of toxic texts without any feature. No shuffle."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @serving("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(scorer, part.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double").toDF(id_col, "score")
