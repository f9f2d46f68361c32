"""Line dedup by a suffix array over line-ID sequences, with DataFrame functions only.

Lines that occur once in the corpus can be in no repeated run; they split a
document into segments.  All others get an id, their place in the order of
128-bit line hashes.  The suffixes that begin in segments are sorted by
distributed prefix doubling: a suffix's rank at level h is its place in the
order of first 2**h lines, and each round sorts the distinct pairs of a rank
and the rank 2**h lines further on.  The sort is by range over all pairs, so a
line that a third of the corpus shares is no single task's work, and joins
send the ids of such lines to the rows instead of the rows to a task.

Suffixes that share their first l lines are an interval of the sorted order
whose longest common prefix is at least l; two ranks of the level below l, at
its start and its end, name the interval.  A run counts if it has at least
``min_words`` words.  For every line the shortest such run that begins there
and the shortest that ends there are looked up in their intervals; the
interval's first member in corpus order stays, and what the others cover is
deleted.  Together they cover exactly the maximal repeated runs: any line of
such a run lies in a shortest one inside it.  That also bounds the doubling:
shortest runs have at most ``min_words`` lines.

Equal texts are one row from the start, before anything is shuffled: what the
sorting would find of them, that each later copy is a repeated run from end to
end, follows from its first copy's words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.skew import join_unique
from lexigrain.storage import ROW, as_given, materialize, numbered, only, release

#: Words that a repeated run needs, a blank line counting as one.
MIN_WORDS = 50
#: Rows and line numbers up to which the deletions are sent to every executor; beyond it documents are shuffled to them.
MAX_BROADCAST_ROWS, MAX_BROADCAST_LINES = 300_000, 3_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of a ``numbered`` table: row number, id, text hashes, words, and per line its 128-bit id (b, c) and size in words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = lambda x: F.greatest(F.lit(1), F.size(F.split(F.trim(x), "[ \\t\\x0B\\f\\r]+")))
    lines = F.transform(_lines(text), lambda x: F.struct(F.xxhash64(x).alias("b"), F.xxhash64(F.lit(1), x, F.length(x)).alias("c"), size(x).alias("w")))
    rows = docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("h2"), lines.alias("lines"))
    return rows.withColumn("words", F.aggregate("lines", F.lit(0), lambda a, x: a + x.w))


def in_order(counted: DataFrame, by: Sequence[str], rank: str) -> DataFrame:
    """``counted``, one row for each value of ``by``, with its place in their order: sorted by range, numbered within ranges. Written, so that numbers stay."""
    return materialize(counted.orderBy(*(F.col(c).asc_nulls_first() for c in by)).withColumn(rank, F.monotonically_increasing_id()), "ranked")


def repeated_segments(lines: DataFrame) -> DataFrame:
    """(row, id, seg, pos, w, r0): the lines whose id occurs more than once, in unbroken stretches of a row; r0: the line's rank."""
    ids = in_order(lines.groupBy("b", "c").agg(F.count("*").alias("m")).filter("m > 1"), ["b", "c"], "r0")
    some = join_unique(lines, ids, ["b", "c"], "m", merge=True)
    at = Window.partitionBy("row").orderBy("pos")
    return some.withColumn("seg", F.col("pos") - F.row_number().over(at)).select("row", "id", "seg", "pos", "w", "r0")


def levels_for(min_words: int) -> int:
    """Doublings needed to compare runs of up to ``min_words`` lines."""
    return max(0, min_words.bit_length() - 1)


def suffix_ranks(segments: DataFrame, levels: int) -> DataFrame:
    """Columns r0 ... r<levels>: the suffix's rank by its first 2**h lines (fewer, where its segment ends)."""
    at = Window.partitionBy("row", "seg").orderBy("pos")
    now = segments
    for h in range(levels):
        r = f"r{h}"
        # Where a segment ends nothing follows, which sorts first; -1 stands for it, so that pairs join.
        placed = now.withColumn("nxt", F.coalesce(F.lead(r, 1 << h).over(at), F.lit(-1).cast("long")))
        pairs = in_order(placed.groupBy(r, "nxt").agg(F.count("*").alias("m")), [r, "nxt"], f"r{h + 1}")
        # A plan that used its input twice in every round would double with each.
        refined = materialize(join_unique(placed, pairs, [r, "nxt"], "m", merge=True).drop("nxt"), "ranks")
        release(now, pairs)
        now = refined
    return now


def repeated_lines(ranked: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(row, pos) of the lines that later copies of repeated runs cover."""
    seg = Window.partitionBy("row", "seg")
    at = seg.orderBy("pos")
    up_to = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("q", F.sum("w").over(up_to).cast("int")).withColumn("p", F.col("q") - F.col("w"))
    # t<h>: the rank of the run of 2**h lines that ends at this line.
    place = lambda h: F.col(f"r{h}")
    rows = rows.withColumns({f"t{h}": F.lag(place(h), (1 << h) - 1).over(at) for h in range(levels + 1)})
    forward = seg.orderBy("p").rangeBetween(0, min_words - 1)
    backward = seg.orderBy("q").rangeBetween(-(min_words - 1), 0)
    ends = F.last(F.struct("pos", "q", *(f"t{h}" for h in range(levels + 1)))).over(forward)
    starts = F.first(F.struct("pos", "p", *(place(h).alias(f"s{h}") for h in range(levels + 1)))).over(backward)
    rows = rows.withColumn("e", ends).withColumn("s", starts)

    def level(n: Column) -> Column:
        return F.floor(F.log2(n.cast("double") + 0.25)).cast("int")

    def pick(h: Column, name) -> Column:
        out = F.lit(None)
        for k in reversed(range(levels + 1)):
            out = F.when(h == k, name(k)).otherwise(out)
        return out

    n, m = F.col("e.pos") - F.col("pos") + 1, F.col("pos") - F.col("s.pos") + 1
    begins = F.struct(n.alias("n"), pick(level(n), place).alias("x"), pick(level(n), lambda k: F.col(f"e.t{k}")).alias("y"))
    stops = F.struct(m.alias("n"), pick(level(m), lambda k: F.col(f"s.s{k}")).alias("x"), pick(level(m), lambda k: F.col(f"t{k}")).alias("y"))
    # A frame that ends with its segment may be short of words.
    runs = rows.select(
        "row", "id", "seg", "pos",
        F.when(F.col("e.q") - F.col("p") >= min_words, begins).alias("begins"), F.col("e.pos").alias("end"),
        F.when(F.col("q") - F.col("s.p") >= min_words, stops).alias("stops"), F.col("s.pos").alias("start"),
    )
    runs = materialize(runs.filter("begins IS NOT NULL OR stops IS NOT NULL"), "runs")

    def later(key: str, first_line: str) -> DataFrame:
        known = runs.filter(F.col(key).isNotNull()).select(*(F.col(f"{key}.{c}").alias(c) for c in ("n", "x", "y")), "row", "seg", "pos", "end", "start", F.struct("id", "row", first_line).alias("here"))
        first = known.groupBy("n", "x", "y").agg(F.min("here").alias("first"), F.count("*").alias("m")).filter("m > 1")
        return join_unique(known, first, ["n", "x", "y"], "m", merge=True).filter(F.col("here") > F.col("first"))

    none = F.lit(None).cast("int")
    marks = later("begins", "pos").select("row", "seg", "pos", "end", none.alias("start")).unionByName(later("stops", "start").select("row", "seg", "pos", none.alias("end"), "start"))
    marks = marks.groupBy("row", "seg", "pos").agg(F.max("end").alias("end"), F.min("start").alias("start"))
    lines = ranked.select("row", "seg", "pos").join(marks, ["row", "seg", "pos"], "left")
    after = at.rowsBetween(0, Window.unboundedFollowing)
    covered = (F.max("end").over(up_to) >= F.col("pos")) | (F.min("start").over(after) <= F.col("pos"))
    return lines.withColumn("covered", F.coalesce(covered, F.lit(False))).filter("covered").select("row", "pos")


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, n_lines, gone): the rows that lose lines, by their number in ``docs``, a ``numbered`` table, and the lines' numbers; null: all of them."""
    table = materialize(line_table(docs, id_col, text_col), "lines")
    key = F.struct("id", "row")
    first = table.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.min("words").alias("words"), F.count("*").alias("m")).filter("m > 1")
    copies = join_unique(table.select("row", "id", "h1", "h2", F.size("lines").alias("n_lines")), first, ["h1", "h2"], "m", merge=True).filter(F.struct("id", "row") != F.col("first"))
    copies = materialize(copies.select("row", "n_lines", "words"), "copies")
    firsts = table.join(copies.select("row").hint("merge"), "row", "left_anti")
    lines = firsts.select("row", "id", F.posexplode("lines").alias("pos", "line")).select("row", "id", "pos", "line.b", "line.c", "line.w")
    lines = materialize(lines, "first-lines")
    levels = levels_for(min_words)
    ranked = suffix_ranks(materialize(repeated_segments(lines), "segments"), levels)
    gone = repeated_lines(ranked, levels, min_words).groupBy("row").agg(F.collect_list("pos").alias("gone"))
    sizes = firsts.select("row", F.size("lines").alias("n_lines"))
    whole = copies.filter(F.col("words") >= min_words).select("row", "n_lines", F.lit(None).cast("array<int>").alias("gone"))
    return materialize(gone.join(sizes, "row").select("row", "n_lines", "gone").unionByName(whole), "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: Sequence[str] = ()) -> DataFrame:
    """``docs``, every column and row, with later copies of repeated line runs deleted from the text.

    Corpus order is by id, rows of one id in the order read, which is written
    down once; null ids come first.  The first copy of a run stays, also inside
    one document.  Lines end at "\n"; texts without deletions, null and empty
    ones stay as they are.  ``counts``: names of two more columns, how many
    lines the text had and how many were deleted; columns of these names are
    replaced.
    """
    names = [c for c in docs.columns if c not in counts]
    docs = numbered(docs)
    with only(docs.sparkSession) as kept_tables:
        gone = deletions(docs, id_col, text_col, min_words)
        kept_tables.append(gone)
    gone = gone.select(F.col("row").alias(ROW), F.col("n_lines").alias("__n"), F.col("gone").alias("__gone"), F.lit(True).alias("__hit"))
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("__gone")), F.lit(0)).alias("lines")).first()
    if size.rows <= MAX_BROADCAST_ROWS and size.lines <= MAX_BROADCAST_LINES:
        gone = F.broadcast(gone)
    marked = docs.join(gone, ROW, "left")
    lines = _lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.col("__n") - 1), F.col("__gone"))
    text = F.when(F.col("__hit").isNull(), F.col(text_col)).when(F.col("__gone").isNull(), F.lit("")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = [text.alias(text_col) if c == text_col else given for c, given in zip(names, as_given(names), strict=True)]
    if counts:
        n_lines = F.size(_lines(F.coalesce(F.col(text_col), F.lit("")))).cast("long")
        deleted = F.when(F.col("__hit").isNull(), F.lit(0)).when(F.col("__gone").isNull(), F.col("__n")).otherwise(F.size("__gone"))
        out += [n_lines.alias(counts[0]), deleted.cast("long").alias(counts[1])]
    return marked.select(*out)
