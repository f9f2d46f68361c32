"""Heading-aware, token-budgeted chunking of markdown, as expressions on one row.

A document's lines, sections and pieces stay arrays of its row, so chunking is
a narrow projection: no shuffle, no Python.  Packing folds over token counts
alone and records where pieces begin; texts are sliced out afterwards, which
keeps the cost linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import DOT, WS, page_of, strip, token_count, without_markers, ws_tokens
from lexigrain.schema import ChunkingConfig

_HEADING = rf"^(#{{1,6}}){WS}+({DOT}+?){WS}*\z"
_INTS = "array<int>"
#: Units of a block of a fold.
_BLOCK = 256


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _indices(n: Column) -> Column:
    """1 to n; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(_none(_INTS))


def _spans(starts: Column, n: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(start, length) of the stretches of 1 to n that begin at ``starts``."""
    return _let(starts, lambda bound: F.transform(bound, lambda s, j: f(s, F.coalesce(F.get(bound, j + 1), n + 1) - s)))


def _titles(heads: Column, n: Column, depth: int) -> Column:
    """For each heading the title at ``depth`` that it stands under, "" if that level was skipped."""
    # A heading of this level or above sets the title for all up to the next such heading.
    resets = F.filter(_indices(n), lambda i: F.element_at(heads, i).level <= depth)

    def fill(s: Column, k: Column) -> Column:
        head = F.element_at(heads, s)
        return F.array_repeat(F.when(head.level == depth, head.title).otherwise(""), k)

    return _let(resets, lambda r: F.concat(F.array_repeat(F.lit(""), F.coalesce(F.get(r, 0), n + 1) - 1), F.flatten(_spans(r, n, fill))))


def sections(text: Column) -> Column:
    """Array of (heading_path, text): one section per heading with a body; text before the first heading is dropped.

    Skipped levels are empty strings in the path; fences mean nothing.  Linear
    in the lines: paths are filled level by level, not carried along.
    """
    lines = F.split(text, "\n", -1)
    tagged = F.transform(lines, lambda x: F.struct(x.alias("line"), F.length(F.regexp_extract(x, _HEADING, 1)).alias("level"), F.regexp_extract(x, _HEADING, 2).alias("title")))

    def build(tagged: Column) -> Column:
        n = F.size(tagged)
        starts = F.filter(_indices(n), lambda i: F.element_at(tagged, i).level > 0)
        return _spans(starts, n, lambda s, k: F.struct(F.element_at(tagged, s).level.alias("level"), F.element_at(tagged, s).title.alias("title"), strip(F.array_join(F.transform(F.slice(tagged, s + 1, k - 1), lambda x: x.line), "\n")).alias("text")))

    def paths(heads: Column) -> Column:
        above = F.array(*(_titles(heads, F.size(heads), d) for d in range(1, 6)))

        def path(above: Column) -> Column:
            own = lambda h, i: F.concat(F.transform(F.slice(above, 1, h.level - 1), lambda titles: F.get(titles, i)), F.array(h.title))
            return F.transform(heads, lambda h, i: F.struct(own(h, i).alias("heading_path"), h.text.alias("text")))

        return F.filter(_let(above, path), lambda x: x.text != "")

    return _let(_let(tagged, build), paths)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def merge_small(found: Column, min_tokens: int) -> Column:
    """Sections under ``min_tokens`` joined to what follows, under the first one's path; sizes are not tested again."""

    def build(found: Column) -> Column:
        counts = F.transform(found, lambda s: token_count(s.text))
        starts = _let(counts, lambda c: F.filter(_indices(F.size(found)), lambda i: (i == 1) | (F.get(c, i - 2) >= min_tokens)))
        texts = F.transform(found, lambda s: s.text)
        return _spans(starts, F.size(found), lambda s, k: F.struct(F.element_at(found, s).heading_path.alias("heading_path"), F.array_join(F.slice(texts, s, k), "\n\n").alias("text")))

    return _let(found, build)


def _starts(counts: Column, max_tokens: int, alone: Callable[[Column, Column], Column]) -> Column:
    """Where greedy pieces begin among units of these counts: units without tokens begin none; what stands ``alone`` ends its piece.

    Folds copy what they have gathered at every step, so units are folded block by block.
    """

    def state(out: Column, held: Column, i: Column) -> Column:
        return F.struct(out.alias("out"), held.alias("held"), i.alias("i"))

    def step(acc: Column, n: Column) -> Column:
        i = acc.i + 1
        fresh = (n > 0) & ((acc.held == 0) | (acc.held + n > max_tokens))
        held = F.when(alone(i, n), F.lit(0)).when(fresh, n).otherwise(acc.held + n)
        return state(F.when(fresh, F.concat(acc.out, F.array(i))).otherwise(acc.out), held, i)

    def block(acc: Column, part: Column) -> Column:
        folded = F.aggregate(part, state(_none(_INTS), acc.held, acc.i), step)
        return _let(folded, lambda f: state(F.concat(acc.out, F.array(f.out)), f.held, f.i))

    blocks = _let(counts, lambda c: F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(1), F.size(c), F.lit(_BLOCK)), lambda s: F.slice(c, s, _BLOCK))).otherwise(_none(f"array<{_INTS}>")))
    return F.flatten(F.aggregate(blocks, state(_none(f"array<{_INTS}>"), F.lit(0), F.lit(0)), block, lambda acc: acc.out))


def _units(text: Column, pattern: str) -> Column:
    """(text, n) of the stretches between matches: stripped, blank ones left out, with their token counts."""
    kept = F.filter(F.transform(F.split(text, pattern, -1), strip), lambda u: u != "")
    return F.transform(kept, lambda u: F.struct(u.alias("text"), token_count(u).alias("n")))


def _packed(units: Column, max_tokens: int) -> Column:
    starts = _starts(F.transform(units, lambda u: u.n), max_tokens, lambda i, n: n > max_tokens)
    return _spans(starts, F.size(units), lambda at, k: F.array_join(F.transform(F.slice(units, at, k), lambda u: u.text), " "))


def greedy_pack(text: Column, pattern: str, max_tokens: int) -> Column:
    """A text's stretches between matches of a pattern, stripped, packed into pieces of at most ``max_tokens`` by single spaces; a larger one stands alone."""
    return _let(_units(text, pattern), lambda units: _packed(units, max_tokens))


def pack_lines(text: Column, max_tokens: int) -> Column:
    """Lines packed into pieces; runs of lines that begin with a pipe are one unit and never split, other long lines are cut into windows of ``max_tokens``."""

    def build(lines: Column) -> Column:
        def group(table: Column) -> Column:
            first = F.filter(_indices(F.size(lines)), lambda i: ~F.get(table, i - 1) | (i == 1) | ~F.coalesce(F.get(table, i - 2), F.lit(False)))
            joined = _spans(first, F.size(lines), lambda s, k: F.struct(F.array_join(F.slice(lines, s, k), "\n").alias("text"), F.get(table, s - 1).alias("table")))
            return F.transform(joined, lambda u: F.struct(u.text.alias("text"), u.table.alias("table"), token_count(u.text).alias("n")))

        units = _let(F.transform(lines, lambda x: F.regexp_replace(x, f"^{WS}+", "").startswith("|")), group)

        def pack(units: Column) -> Column:
            wide = lambda u: ~u.table & (u.n > max_tokens)
            starts = _starts(F.transform(units, lambda u: u.n), max_tokens, lambda i, n: wide(F.element_at(units, i)))

            def piece(s: Column, k: Column) -> Column:
                unit = F.element_at(units, s)
                windows = _let(ws_tokens(unit.text), lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)), F.lit(max_tokens)), lambda j: F.array_join(F.slice(t, j, max_tokens), " ")))
                whole = F.array(strip(F.array_join(F.transform(F.slice(units, s, k), lambda u: u.text), "\n")))
                return F.when(wide(unit), windows).otherwise(whole)

            return F.flatten(_spans(starts, F.size(units), piece))

        return _let(units, pack)

    return _let(F.split(text, "\n", -1), build)


def with_overlap(pieces: Column, overlap: int) -> Column:
    """Each piece but the first with the last ``overlap`` tokens of the one before it in front."""
    if overlap <= 0:
        return pieces

    def tail(text: Column) -> Column:
        return _let(ws_tokens(text), lambda t: F.array_join(F.slice(t, F.greatest(F.size(t) - overlap, F.lit(0)) + 1, overlap), " "))

    return _let(pieces, lambda ps: F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(F.concat(tail(F.get(ps, i - 1)), F.lit(" "), p))))


def split_to_budget(text: Column, max_tokens: int, overlap: int = 0, overflow: str = "paragraph") -> Column:
    """Pieces of a text: itself if it fits, else by paragraphs, else by sentences, else by lines; a rung holds if every piece fits."""
    ChunkingConfig(max_tokens=max_tokens, overflow=overflow)
    by_lines = with_overlap(pack_lines(text, max_tokens), overlap)

    def rung(pattern: str, below: Column) -> Column:
        # Only a unit that is too large itself makes a piece that is.
        fits = lambda units: F.forall(units, lambda u: u.n <= max_tokens)
        return _let(_units(text, pattern), lambda units: F.when(fits(units), with_overlap(_packed(units, max_tokens), overlap)).otherwise(below))

    by_sentences = rung(rf"(?<=[.!?]){WS}+", by_lines)
    out = {"token": by_lines, "sentence": by_sentences}.get(overflow)
    if out is None:
        out = rung(rf"\n{WS}*\n", by_sentences)
    return F.when(token_count(text) <= max_tokens, F.array(text)).otherwise(out)


def chunk_array(text: Column, config: ChunkingConfig) -> Column:
    """All chunks of a markdown text: array of (heading_path, text), in order."""
    merged = merge_small(sections(text), config.min_tokens)
    return F.flatten(F.transform(merged, lambda s: _let(s, lambda s: F.transform(split_to_budget(s.text, config.max_tokens, config.overlap_tokens, config.overflow), lambda p: F.struct(s.heading_path.alias("heading_path"), p.alias("text"))))))


def chunk_documents(docs: DataFrame, config: ChunkingConfig | None = None, text_col: str = "text", paged: bool = False) -> DataFrame:
    """``docs`` with its text replaced by heading_path, text, chunk_order (from 0 in the document) and page.

    With ``paged`` the page is that of the last marker in the chunk, and
    markers are taken out; else it is empty.  Null texts have no chunks.
    """
    cut = docs.withColumn("__chunks", chunk_array(F.col(text_col), config or ChunkingConfig()))
    rest = [c for c in docs.columns if c != text_col]
    rows = cut.select(*rest, F.posexplode("__chunks").alias("chunk_order", "__chunk"))
    text = F.col("__chunk.text")
    page = page_of(text) if paged else F.lit("")
    return rows.select(*rest, F.col("__chunk.heading_path").alias("heading_path"), (without_markers(text) if paged else text).alias("text"), F.col("chunk_order").cast("int").alias("chunk_order"), page.alias("page"))
