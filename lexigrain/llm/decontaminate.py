"""Benchmark decontamination with a stored positional inverted index.

Training text is indexed in segments: a segment is a stretch of consecutive
documents whose word stream is numbered through, and holds, for every term,
the ascending positions where it stands.  The index is written to the shared
folder once, as one row a segment, and every search reads it instead of the
texts; a benchmark of many blocks indexes the corpus once.

A phrase is filed under its rarest term, by how often the whole corpus has
each.  A segment takes up only the phrases whose rarest term it has, and
intersects the lists of their terms, each moved back by the term's place in
the phrase, from the rarest on.  Proximity queries use the same lists.
Nothing is shuffled but the terms' counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.jaccard import without_rows
from lexigrain.llm.worker import serving
from lexigrain.storage import ROW, bound_batches, materialize, numbered

#: Consecutive item words that make a window.
WINDOW = 10
#: UTF-8 bytes of benchmark text that one pass sends to the executors.
BLOCK_BYTES = 16 << 20
#: Words of a segment of the index, about.
SEGMENT_WORDS = 150_000
#: Positions between documents of a segment: more than any phrase spans.
GAP = 64

# Lower-cases A-Z; turns ASCII that is neither a letter nor a digit into spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NONE = np.empty(0, np.int64)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all characters beyond ASCII. Null has none."""
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Phrases:
    """The windows of a block of benchmark items, as term numbers."""

    terms: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: Sequence[tuple[object, str | None]], size: int = WINDOW) -> Phrases:
        """Windows of ``size`` consecutive words; an item of fewer, but not none, is one window."""
        out = cls()
        for item, text in items:
            ids = [out.terms.setdefault(w, len(out.terms)) for w in words(text)]
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                out.windows.setdefault(tuple(ids[k : k + size]), set()).add(str(item))
        return out

    def arrays(self) -> tuple[np.ndarray, list[tuple[str, ...]]]:
        """Windows as rows of term numbers, -1 behind short ones, and each one's items."""
        width = max(map(len, self.windows), default=1)
        rows = [w + (-1,) * (width - len(w)) for w in self.windows]
        return np.array(rows, np.int64).reshape(-1, width), [tuple(sorted(x)) for x in self.windows.values()]


class _Numbers(dict):
    """Terms by first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def segment_of(texts: Sequence[str | None]) -> tuple[np.ndarray, bytes, np.ndarray, bytes]:
    """(words of each text, terms joined by blanks, positions of each term, gaps between them) of a stretch of texts.

    A term's first position counts from 0; gaps are stored by byte plane, most
    of which are zeros.
    """
    split = [words(t) for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    numbers = _Numbers()
    term = np.fromiter((n for w in split for n in map(numbers.__getitem__, w)), np.int64, int(n_words.sum()))
    position = np.arange(len(term)) + np.repeat(np.arange(len(split)) * GAP, n_words)
    order = np.argsort(term, kind="stable")
    position, counts = position[order], np.bincount(term, minlength=len(numbers))
    gaps = np.diff(position, prepend=0)
    begin = np.cumsum(counts) - counts
    gaps[begin] = position[begin]
    return n_words, b" ".join(numbers), counts, gaps.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].T.tobytes()


class Segment:
    """A stored segment, opened: positions of those of its terms that a benchmark uses."""

    def __init__(self, n_words: np.ndarray, terms: bytes, counts: np.ndarray, gaps: bytes, wanted: dict[bytes, int]):
        self.n_words = n_words
        self.starts = np.concatenate([[0], np.cumsum(n_words + GAP)])
        found = ((wanted.get(t), k) for k, t in enumerate(terms.split(b" ")) if t)
        #: The segment's own number of each wanted term that it has.
        self.own = {t: k for t, k in found if t is not None}
        self.end = np.cumsum(counts)
        self.counts = counts
        planes = np.frombuffer(gaps, np.uint8).reshape(5, -1)
        self.gaps = sum(planes[i].astype(np.int64) << (8 * (4 - i)) for i in range(5) if planes[i].any()) if planes.size else _NONE
        if np.isscalar(self.gaps):
            self.gaps = np.zeros(planes.shape[1], np.int64)
        self.lists: dict[int, np.ndarray] = {}

    def list(self, term: int) -> np.ndarray:
        """Ascending positions of a term."""
        at = self.lists.get(term)
        if at is None:
            k = self.own.get(term)
            at = self.lists[term] = _NONE if k is None else np.cumsum(self.gaps[self.end[k] - self.counts[k] : self.end[k]])
        return at

    def phrase(self, terms: Sequence[int], order: Sequence[int]) -> np.ndarray:
        """Positions where the terms stand in a row; order: their places, rarest first."""
        found: np.ndarray | None = None
        for k in order:
            at = self.list(terms[k]) - k
            found = at if found is None else found[_member(found, at)] if len(at) else _NONE
            if not len(found):
                return _NONE
        return _NONE if found is None else found

    def near(self, terms: Sequence[int], order: Sequence[int], span: int) -> np.ndarray:
        """Positions of the rarest term around which each other term stands at a distance under ``span``, in any order, in one document."""
        found: np.ndarray | None = None
        for t in dict.fromkeys(terms[k] for k in order):
            at = self.list(t)
            if found is None:
                found = at
            else:
                doc = self.document(found)
                low, high = np.maximum(found - span + 1, self.starts[doc]), np.minimum(found + span, self.starts[doc + 1])
                found = found[np.searchsorted(at, low) < np.searchsorted(at, high)]
            if not len(found):
                return _NONE
        return _NONE if found is None else found

    def document(self, positions: np.ndarray) -> np.ndarray:
        """Document number of each position."""
        return np.searchsorted(self.starts, positions, side="right") - 1


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of the batch of about SEGMENT_WORDS words each."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)) // 6
    lo = 0
    total = np.cumsum(size)
    while lo < batch.num_rows:
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + SEGMENT_WORDS)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-(size[0] + 64 * size[1]) // BLOCK_BYTES))
    for k in range(n):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """The stored index: one row a segment with its documents' ids, ``row`` numbers and sizes, its terms, and their positions. Null texts have no words."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    number = F.monotonically_increasing_id() if row is None else row
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), number.alias("row"))

    @serving("decontaminate")
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stretches(batch):
                n_words, terms, counts, gaps = segment_of(part.column(1).to_pylist())
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([one(part.column(0), part.column(0).type), one(part.column(2), pa.int64()), one(n_words, pa.int64()), pa.array([terms], pa.binary()), one(counts, pa.int32()), pa.array([gaps], pa.binary())], names=["ids", "rows", "n_words", "terms", "counts", "gaps"])

    return materialize(texts.mapInArrow(index, f"ids array<{kind}>, rows array<long>, n_words array<long>, terms binary, counts array<int>, gaps binary"), "postings")


def term_counts(index: DataFrame, wanted: dict[bytes, int]) -> np.ndarray:
    """How often the corpus has each wanted term; one row a term comes to the driver, which has the terms already."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    @serving("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = counts.values.to_numpy()
                pairs = [(t, k) for k, t in enumerate(map(sent.value.get, terms.split(b" "))) if t is not None] if terms else []
                if pairs:
                    at = np.array(pairs)
                    total[at[:, 0]] += n[at[:, 1]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(wanted), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, span: int | None = None, rows: bool = False) -> DataFrame:
    """One row per document row: ``id_col`` (with ``rows``, before it row, its number in ``docs``, a ``numbered`` table), n_words, hits (array of hit word positions), items (sorted array of item ids as strings).

    A word is hit inside any occurrence of a window of the benchmark.  With
    ``span`` windows match by proximity instead: their terms in any order, each
    closer than ``span`` to the rarest, which is what is marked.  Null and
    empty texts have no words; repeated rows are kept; an empty benchmark hits
    nothing; items with null ids count as "None".
    """
    if window > GAP:
        raise ValueError(f"a window has at most {GAP} words")
    kind = docs.schema[id_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col, F.col(ROW) if rows else None)
    context = docs.sparkSession.sparkContext
    passes = []
    for items in _blocks(benchmark, item_col, item_text_col):
        phrases = Phrases.of(items, window)
        windows, owners = phrases.arrays()
        filed = _filed(windows, term_counts(index, phrases.terms))
        sent = context.broadcast((phrases.terms, windows, owners, *filed))

        @serving("decontaminate")
        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms, windows, owners, orders, by_rarest = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, row, n_words, blob, counts, gaps = (c[k] for c in batch.columns)
                    segment = Segment(n_words.values.to_numpy(), blob.as_py(), counts.values.to_numpy(), gaps.as_py(), terms)
                    marks = np.zeros(int(segment.starts[-1]) + 1, np.int64)
                    found: list[set[str]] = [set() for _ in range(len(segment.n_words))]
                    for t in segment.own:
                        for w in by_rarest.get(t, ()):
                            order = orders[w]
                            phrase = windows[w, : len(order)].tolist()
                            at = segment.phrase(phrase, order) if span is None else segment.near(phrase, order, span)
                            if not len(at):
                                continue
                            np.add.at(marks, at, 1)
                            np.add.at(marks, at + (len(order) if span is None else 1), -1)
                            for d in np.unique(segment.document(at)):
                                found[d].update(owners[w])
                    hit = np.flatnonzero(np.cumsum(marks) > 0)
                    of = segment.document(hit)
                    bounds = np.searchsorted(of, np.arange(len(found) + 1))
                    hits = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hit - segment.starts[of], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.values, row.values, n_words.values, hits, pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=["id", "row", "n_words", "hits", "items"])

        passes.append(index.mapInArrow(search, f"id {kind}, row long, n_words long, hits array<long>, items array<string>"))
    if len(passes) == 1:
        out = passes[0]
    else:
        both = passes[0]
        for p in passes[1:]:
            both = both.unionByName(p)
        # What the blocks find of a row is put together by its number, which the index holds.
        gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        out = both.groupBy("row").agg(F.min("id").alias("id"), F.min("n_words").alias("n_words"), gather("hits").alias("hits"), gather("items").alias("items"))
    return out.select(*(["row"] if rows else []), F.col("id").alias(id_col), "n_words", "hits", "items")


def _filed(windows: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[int, ...]], dict[int, list[int]]]:
    """For each window its places from the rarest term on, and the windows of each rarest term; those with a term that the corpus has not are left out."""
    orders: list[tuple[int, ...]] = []
    by_rarest: dict[int, list[int]] = {}
    for w, terms in enumerate(windows.tolist()):
        size = terms.index(-1) if -1 in terms else len(terms)
        order = tuple(sorted(range(size), key=lambda k: (counts[terms[k]], k)))
        orders.append(order)
        if size and counts[terms[order[0]]]:
            by_rarest.setdefault(terms[order[0]], []).append(w)
    return orders, by_rarest


def index_postings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The positional index by term: term, ``id_col``, positions (ascending array), for the benchmark's terms."""
    kind = docs.schema[id_col].dataType.simpleString()
    index, out = build_index(docs, id_col, text_col), None
    for items in _blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(Phrases.of(items).terms)

        @serving("decontaminate")
        def post(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = list(sent.value)
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, _, n_words, blob, counts, gaps = (c[k] for c in batch.columns)
                    segment = Segment(n_words.values.to_numpy(), blob.as_py(), counts.values.to_numpy(), gaps.as_py(), sent.value)
                    term, of, places = [], [], []
                    for t in segment.own:
                        at = segment.list(t)
                        doc = segment.document(at)
                        for d in np.unique(doc):
                            term.append(names[t].decode())
                            of.append(d)
                            places.append(at[doc == d] - segment.starts[d])
                    yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), ids.values.take(pa.array(of, pa.int64())), pa.array(places, pa.list_(pa.int64()))], names=["term", "id", "positions"])

        part = index.mapInArrow(post, f"term string, id {kind}, positions array<long>")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col).dropDuplicates(["term", id_col, "positions"])


def items_digest(items: Sequence[str]) -> str:
    """SHA-256 of the sorted ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.0, **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose share of hit words is at most ``max_share``."""
    names, docs = docs.columns, numbered(docs)
    found = find_items(docs, benchmark, id_col, text_col, rows=True, **how)
    gone = materialize(found.filter(F.size("hits") > F.lit(max_share) * F.col("n_words")).select("row"), "gone")
    return without_rows(docs, gone, names)
