"""N-gram Jaccard join by a size-aware heavy-light scheme, down to components of linked documents.

Equal texts are one class from the start.  Each class is its set of distinct
word shingles, as 64-bit hashes.  Two sets can only link if their first tokens,
rarest in the corpus first, have something in common: one token of the first
n - ceil(t n) + 1, or two of one more.  So small sets are filed under every
subset of two of those tokens, and large sets under single tokens, whose
inverted lists are scanned; the boundary between them is where, by the list
lengths measured, enumerating subsets begins to cost more than scanning.
Tokens of one class only are never filed: most texts end there.

Document frequencies are exact and come from one exchange of packed,
pre-aggregated hash slices.  Lists are not expanded into pairs.  First each
member of a list is compared with the list's hub, the member with most shared
tokens; then only members that this has not brought together are compared,
pair by pair.  Every candidate is verified on the whole sets.

Nulls and empty texts have empty sets and link with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.components import components
from lexigrain.llm.skew import join_unique
from lexigrain.llm.worker import serving, take, trim
from lexigrain.storage import ROW, as_given, bound_batches, materialize, numbered, only

#: Bytes of text of a block of documents, and tokens of a bucket of hashes, about.
BLOCK_BYTES, BUCKET_TOKENS = 4 << 20, 1_000_000
#: Slices (blocks times buckets) up to which frequencies go through packed slices; beyond it, where slices would be
#: tiny, through rows.
MAX_SLICES = 1 << 26
#: Ids up to which the copies of texts are sent to every executor; beyond it they are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Cost of verifying a candidate, in postings written.
CANDIDATE_COST = 4.0
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def forget() -> None:
    """Drop the worker's word hashes."""
    _words.clear()


def split_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, size: int, split: Callable[[str | None], list[bytes]] = split_words) -> np.ndarray:
    """Ascending distinct hashes of the text's word shingles; fewer words are one shingle, none are none."""
    words = split(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : len(w) - k + 1 + i]
    h ^= h >> np.uint64(30)
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return np.unique(h)


def _block(rows: pa.Table, size: int, split) -> tuple[list[int], list[np.ndarray]]:
    """Nodes of a block in ascending order, each once, and their sets."""
    by_node = dict(zip(rows.column("node").to_pylist(), rows.column("text"), strict=True))
    nodes = sorted(by_node)
    return nodes, [shingles(by_node[n].as_py(), size, split) for n in nodes]


def _slices(token: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending hashes: buckets are equal ranges of the hash space."""
    edges = (np.arange(buckets + 1, dtype=object) * (1 << 64)) // buckets
    return np.concatenate([np.searchsorted(token, np.array(edges[:-1], np.uint64)), [len(token)]])


def document_frequencies(blocks: DataFrame, size: int, buckets: int, width: int, split=split_words) -> DataFrame:
    """(block, bucket, df): for each block's distinct hashes in order, in how many classes each occurs, up to 255.

    A block sends each bucket its distinct hashes, cut to ``width`` bytes and
    stored by byte plane, with their counts; hashes that collide in those bytes
    share a count, which only costs order.
    """

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        take("jaccard", forget)
        trim()
        _, sets = _block(rows, size, split)
        token, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
        at = _slices(token, buckets)
        planes = token.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
        n = np.minimum(n, 255).astype(np.uint8)
        out = [(b, planes[at[b] : at[b + 1]].T.tobytes(), n[at[b] : at[b + 1]].tobytes()) for b in range(buckets) if at[b + 1] > at[b]]
        return pa.table({"block": pa.array([key[0].as_py()] * len(out), pa.int32()), "bucket": pa.array([x[0] for x in out], pa.int32()), "token": pa.array([x[1] for x in out], pa.binary()), "n": pa.array([x[2] for x in out], pa.binary())})

    def count(rows: pa.Table) -> pa.Table:
        take("jaccard", forget)
        trim()
        ns = [np.frombuffer(x.as_py(), np.uint8) for x in rows.column("n")]
        tokens = []
        for x, n in zip(rows.column("token"), ns, strict=True):
            planes = np.zeros((len(n), 8), np.uint8)
            planes[:, :width] = np.frombuffer(x.as_py(), np.uint8).reshape(width, len(n)).T
            tokens.append(planes.reshape(-1).view(">u8").astype(np.uint64))
        token, n = np.concatenate(tokens), np.concatenate(ns)
        tokens.clear()
        order = np.argsort(token, kind="stable")
        token = token[order]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        total = np.minimum(np.add.reduceat(n[order].astype(np.uint32), begin), 255).astype(np.uint8)
        df = np.empty(len(n), np.uint8)
        df[order] = np.repeat(total, np.diff(np.append(begin, len(n))))
        ends = np.cumsum([len(n) for n in ns])
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "df": pa.array([df[e - len(n) : e].tobytes() for e, n in zip(ends, ns, strict=True)], pa.binary())})

    sent = blocks.groupBy("block").applyInArrow(send, "block int, bucket int, token binary, n binary")
    return sent.groupBy("bucket").applyInArrow(count, "block int, bucket int, df binary")


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def prefixes(blocks: DataFrame, frequencies: DataFrame, size: int, percent: int, split=split_words) -> DataFrame:
    """One row per class: node, n (set size), tokens (the shared ones among the first n - need + 2, in corpus order), places (where they stand in the set's order, from 0), members (the whole set, where anything is shared)."""

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        take("jaccard", forget)
        trim()
        nodes, sets = _block(rows, size, split)
        every = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]))
        parts = sorted(zip(counts.column("bucket").to_pylist(), counts.column("df").to_pylist(), strict=True))
        df = np.frombuffer(b"".join(x[1] for x in parts), np.uint8)
        out: dict[str, list] = {"node": nodes, "n": [len(s) for s in sets], "tokens": [], "places": [], "members": []}
        for s in sets:
            n = len(s)
            own = df[np.searchsorted(every, s)] if n else df[:0]
            order = np.lexsort((s, own))[: n - _need(n, percent) + 2]
            places = np.flatnonzero(own[order] > 1)
            filed = n > 0 and len(places) and places[0] <= n - _need(n, percent)
            out["tokens"].append(s[order[places]].astype(np.int64) if filed else None)
            out["places"].append(places.astype(np.int32) if filed else None)
            out["members"].append(s.astype(np.int64) if filed else None)
        kinds = {"node": pa.int64(), "n": pa.int32(), "tokens": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "members": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return blocks.groupBy("block").cogroup(frequencies.groupBy("block")).applyInArrow(run, "node long, n int, tokens array<long>, places array<int>, members array<long>")


def prefixes_by_rows(texts: DataFrame, size: int, percent: int, split=split_words) -> DataFrame:
    """What ``prefixes`` gives, for inputs of any size: tokens are rows, counted and joined back by shuffle.

    Linear in the tokens, and several times dearer than slices.  Only shared
    tokens come back; a set's other tokens stand before them in its order.
    """

    @serving("jaccard", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size, split).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "members"])

    sets = materialize(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, n int, members array<long>"), "members")
    rows = sets.select("node", F.explode("members").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").withColumn("m", F.col("df"))
    # One row per set and shared token; a set is one text's, so its list is bounded by it.
    own = join_unique(rows, shared, ["token"], "m").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    need = F.ceil(F.col("n") * percent / 100.0).cast("int")
    early = F.filter(F.transform("own", lambda x, i: F.struct(x.token.alias("token"), (F.col("n") - F.size("own") + i).cast("int").alias("place"))), lambda x: x.place <= F.col("n") - need + 1)
    found = sets.join(own, "node", "left").withColumn("early", early)
    filed = F.coalesce((F.size("early") > 0) & (F.get("early", 0)["place"] <= F.col("n") - need), F.lit(False))
    return found.select("node", "n", F.when(filed, F.transform("early", lambda x: x.token)).alias("tokens"), F.when(filed, F.transform("early", lambda x: x.place)).alias("places"), F.when(filed, F.col("members")).alias("members"))


def boundary(filed: DataFrame, percent: int) -> int:
    """Set size up to which subsets are enumerated, by cost.

    For each size the postings of subsets are weighed against those of single
    tokens plus the candidate that scanning a list with its hub makes of each;
    subsets hardly ever meet by chance.  The sum over sizes is least at the
    boundary.  Reads one row per size and one list statistic.
    """
    lists = filed.select(F.explode("tokens").alias("t")).groupBy("t").count().agg(F.sum(F.col("count") * F.col("count")).alias("sq"), F.sum("count").alias("n")).first()
    if not lists.n:
        return 0
    met = min(1.0, lists.sq / lists.n - 1)  # share of postings that meet another than themselves
    k = F.size("tokens").cast("double")
    sizes = filed.groupBy("n").agg(F.sum(k).alias("single"), F.sum(k * (k - 1) / 2).alias("pairs")).orderBy("n").collect()
    cost_small, best, at = 0.0, math.inf, 0
    # Sets within reach of the boundary are filed both ways.
    single = {r.n: r.single * (1 + CANDIDATE_COST * met) for r in sizes}
    total = sum(single.values())
    below = 0.0
    for r in [None, *sizes]:
        if r is not None:
            cost_small += r.pairs + r.single * CANDIDATE_COST * met / 8
            below += single[r.n]
        size = r.n if r is not None else 0
        both = sum(v for n, v in single.items() if n <= size and 100 * n >= percent * (size + 1))
        cost = cost_small + total - below + both
        if cost < best:
            best, at = cost, size
    return at


def postings(filed: DataFrame, limit: int, percent: int) -> DataFrame:
    """(key, l, at, node, n, k): keys of token pairs (l = 2) for sets up to ``limit``, of single tokens (l = 1) for larger ones and those that may link with a larger one.

    at: place of the last of the key's tokens in the set's order; k: number of shared tokens.
    """
    need = F.ceil(F.col("n") * percent / 100.0)
    both = F.arrays_zip("tokens", "places")
    key = lambda k, at, length: F.struct(k.alias("key"), at.alias("at"), F.lit(length).alias("l"))
    pairs = F.flatten(F.transform("both", lambda x, i: F.transform(F.slice("both", i + 2, F.size("both")), lambda y: key(F.xxhash64(x.tokens, y.tokens), y.places, 2))))
    single = F.transform(F.filter("both", lambda x: x.places <= F.col("n") - need), lambda x: key(x.tokens, x.places, 1))
    none = F.array().cast("array<struct<key:bigint,at:int,l:int>>")
    small = (F.col("n") <= limit) & (need >= 2)
    large = (F.col("n") * 100 >= percent * (limit + 1)) | (need < 2)
    keys = F.concat(F.when(small, pairs).otherwise(none), F.when(large, single).otherwise(none))
    return filed.withColumn("both", both).select("node", "n", F.size("tokens").alias("k"), F.inline(keys)).select("key", "l", "at", "node", "n", "k")


def _may_link(n_a: Column, at_a: Column, n_b: Column, at_b: Column, length: Column, percent: int) -> Column:
    """Whether sets of these sizes can link by a key of ``length`` tokens that ends at these places.

    The overlap they need leaves so many tokens over in each: if the key's
    tokens are the first that they share, no more can stand before them.
    """
    near = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
    need = (n_a + n_b) * percent
    return near & (need <= (n_a + length - 1 - at_a) * (100 + percent)) & (need <= (n_b + length - 1 - at_b) * (100 + percent))


def verified(pairs: DataFrame, filed: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) whose whole sets link."""
    sets = filed.select("node", "n", "members")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("s_a")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return two.withColumn("common", common).filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of a ``numbered`` table: each row's number, id, text hash and bytes; each hash's node number and its least (id, row)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialize(docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("h"), F.octet_length(text).cast("long").alias("bytes")), "texts")
    classes = rows.groupBy("h").agg(F.min(F.struct("id", "row")).alias("least"), F.max("bytes").alias("bytes"), F.count("*").alias("m"))
    return rows, materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def component_rows(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", split=split_words) -> DataFrame:
    """One row per row: row (its number in ``docs``), id, n_shingles (its set's size), component_id (least id reachable by links, itself included), first (whether it is its component's first row, by id and then number).

    Two documents link when 100 * intersection >= percent * union.  Rows of one
    text are always together; those without words stand alone.  Null ids come
    first, and a component of theirs has a null id.  ``docs`` must be a
    ``numbered`` table; extra columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows, classes = text_classes(docs, id_col, text_col)
    total = classes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    blocks_n = max(1, math.ceil(total.bytes / BLOCK_BYTES))
    buckets = min(65_536, max(1, math.ceil(total.bytes / 6 / BUCKET_TOKENS)))
    width = min(8, max(5, math.ceil((math.log2(total.bytes + 2) + 8) / 8)))
    # One row of each class: copies are left out before any text moves.
    kept = classes.select("node", F.col("least.row").alias("row"))
    if total.n <= MAX_BROADCAST_IDS:
        kept = F.broadcast(kept)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(ROW).alias("row"), text.alias("text")).join(kept, "row")
    blocks = texts.select(F.pmod(F.xxhash64("node"), F.lit(blocks_n)).cast("int").alias("block"), "node", "text")
    if blocks_n * buckets <= MAX_SLICES:
        sets = prefixes(blocks, document_frequencies(blocks, size, buckets, width, split), size, percent, split)
    else:
        sets = prefixes_by_rows(texts, size, percent, split)
    sets = materialize(sets, "sets")
    found = components(link(sets.filter("tokens IS NOT NULL"), percent))
    least = found.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("head"))
    of_node = found.join(least, "component").select("node", "head")
    info = classes.join(sets.select("node", F.col("n").cast("long").alias("n_shingles")), "node").join(of_node, "node", "left")
    info = info.select("h", "n_shingles", F.coalesce("head", "least").alias("head"), "m")
    alone = F.col("n_shingles") == 0
    out = join_unique(rows, info, ["h"], "m")
    return out.select("row", "id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"), (alone | (F.col("row") == F.col("head.row"))).alias("first"))


def component_ids(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", split=split_words) -> DataFrame:
    """``component_rows`` by id: ``id_col``, n_shingles, component_id."""
    with only(docs.sparkSession) as kept:
        docs = numbered(docs.select(id_col, text_col))
        found = component_rows(docs, size, percent, id_col, text_col, split).select(F.col("id").alias(id_col), "n_shingles", "component_id")
        kept.append(found := materialize(found, "components"))
    return found


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with only the first row of each component."""
    names, docs = docs.columns, numbered(docs)
    with only(docs.sparkSession) as kept:
        rows = component_rows(docs, size, percent, id_col, text_col).filter(~F.col("first")).select("row")
        kept.append(rows := materialize(rows, "gone"))
    return without_rows(docs, rows, names)


def without_rows(docs: DataFrame, rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``docs``, a ``numbered`` table, without the rows of a written table of numbers, under the names that it had; the numbers are sent to every executor if they are few."""
    gone = rows.select(F.col("row").alias(ROW))
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, ROW, "left_anti").select(*as_given(names))


def link(filed: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that give the same components as all links between the filed sets."""
    posts = materialize(postings(filed, boundary(filed, percent), percent), "postings")
    hub = F.struct("k", (-F.col("node")).alias("x"), "n", "at")
    hubs = posts.groupBy("key", "l").agg(F.count("*").alias("m"), F.max(hub).alias("hub")).filter("m > 1")
    hubs = hubs.select("key", "l", (-F.col("hub.x")).alias("hub"), F.col("hub.n").alias("n_hub"), F.col("hub.at").alias("at_hub"), "m")
    lists = materialize(join_unique(posts, hubs, ["key", "l"], "m"), "lists")
    may = _may_link(F.col("n"), F.col("at"), F.col("n_hub"), F.col("at_hub"), F.col("l"), percent)
    star = lists.filter((F.col("node") != F.col("hub")) & may).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    star = materialize(star, "star")
    edges = materialize(verified(star, filed, percent), "links")
    near = components(edges)
    # What the hubs have not joined: lists whose members are still apart.
    now = lists.join(near, "node", "left").select("key", "l", "at", "node", "n", F.coalesce("component", "node").alias("component"))
    # Of two that link the smaller set has the key among the tokens that it may miss from one of its own size, and no set is matched beyond the size that its place allows.
    early = 2 * F.col("n") * percent <= (F.col("n") + F.col("l") - 1 - F.col("at")) * (100 + percent)
    most = F.floor((F.col("n") + F.col("l") - 1 - F.col("at")) * (100 + percent) / F.lit(float(percent))) - F.col("n")
    now = materialize(now.withColumn("early", early).withColumn("most", most), "components")
    apart = now.groupBy("key", "l").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.when(F.col("early"), F.col("n"))).alias("least_n")).filter("lo <> hi and least_n is not null")
    open_lists = join_unique(now, apart.select("key", "l", "least_n", "m"), ["key", "l"], "m").filter("early or most >= least_n").drop("least_n", "most")
    open_lists = materialize(open_lists, "open")
    x, y = open_lists.filter("early").alias("x"), open_lists.alias("y")
    may = _may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), F.col("x.l"), percent)
    once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.l") == F.col("y.l")) & (F.col("x.component") != F.col("y.component")) & once & may)
    rest = rest.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    return edges.union(verified(rest, filed, percent))
