"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE tokenizer is compiled, state by state as texts need them,
into a deterministic transducer that reads characters.  A state holds where the
split pattern stands (letters, digits, marks, white space, an apostrophe that
may open a contraction) and, for the piece being read, the starts from which a
token may still grow, each with the last token before it.  Each transition
carries how many tokens the text gains by the character, so a text's count is
the sum along its path.

Long texts are cut into chunks at any offset.  A chunk's map from entry state
to exit state and count is kept as (head, count, tail): white space after
something else puts the transducer into a state that does not depend on what
came before, so between the first and the last such point the map is constant;
head and tail are what is left on either side.  Maps compose associatively, so
they are computed in parallel and folded by a balanced tree.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from lexigrain.llm.bpe import MergeTable, byte_chars
from lexigrain.llm.worker import serving
from lexigrain.storage import bound_batches

#: Compiled states per worker; when full, compilation starts anew.
MAX_STATES = 350_000
#: Characters of a chunk.
CHUNK_CHARS = 1 << 16

# Where the split pattern stands.
START, LETTER, DIGIT, MARK, SPACE, APOSTROPHE = range(6)

_reset = regex.compile(r"(?<=\P{White_Space})\p{White_Space}").search
_last_reset = regex.compile(r"(?r)(?<=\P{White_Space})\p{White_Space}").search
#: Consecutive chunks of a text whose maps one task composes.
FOLD_CHUNKS = 256


class State(dict):
    """Transitions by character: (next state, tokens gained); compiled when first needed."""

    __slots__ = ("key", "owner")

    def __missing__(self, c: str):
        self[c] = out = self.owner.compile(self.key, c)
        return out


class Transducer:
    """The counting transducer of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.table = MergeTable(spec["model"]["vocab"], merges)
        special = [t["content"] for t in spec["added_tokens"]]
        self.apart = regex.compile("|".join(map(regex.escape, special))).split if special else None
        self.bytes = byte_chars()
        self.pieces: dict[str, int] = {}
        for text, t in self.table.vocab.items():
            for k in range(1, len(text)):
                self.pieces.setdefault(text[:k], -1)
            self.pieces[text] = t if self.table.stands(t) else -1
        self.classes: dict[str, int] = {}
        if (spec["normalizer"], spec["pre_tokenizer"]["type"], spec["pre_tokenizer"]["add_prefix_space"]) != (None, "ByteLevel", False):
            raise ValueError(f"{path} is not a plain byte-level file")
        self.splitter = ByteLevel(add_prefix_space=False)
        self.clear()

    def clear(self) -> None:
        """Forget the compiled states; they point at one another, so their transitions go first."""
        for s in getattr(self, "states", {}).values():
            dict.clear(s)
        self.states: dict = {}
        self.start = self.state((START, "", ()))

    def state(self, key: tuple) -> State:
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = State()
            s.key, s.owner = key, self
        return s

    def kind(self, c: str) -> int:
        """The character's class, as the library's own splitter has it: whether it makes one piece with a letter, a digit or a mark."""
        k = self.classes.get(c)
        if k is None:
            whole = lambda before: len(self.splitter.pre_tokenize_str(before + c)) == 1
            k = self.classes[c] = LETTER if whole("a") else DIGIT if whole("1") else MARK if whole("!") else SPACE
        return k

    def grow(self, live: tuple, c: str) -> tuple[tuple, int]:
        """The piece's open starts after one more character, and the tokens gained.

        live: (text since the start, last token before it, tokens up to it less tokens so far); empty before the piece.
        """
        live, gained = live or (("", -1, 0),), 0
        for b in c.encode():
            x, still, found = self.bytes[b], [], None
            for text, before, less in live:
                grown = text + x
                t = self.pieces.get(grown)
                if t is not None:
                    still.append((grown, before, less))
                    if found is None and t >= 0 and (before < 0 or self.table.compatible(before, t)):
                        found = (t, less + 1)
            t, plus = found
            gained += plus
            live = (*((text, before, less - plus) for text, before, less in still), ("", t, 0))
        return live, gained

    def compile(self, key: tuple, c: str) -> tuple[State, int]:
        if len(self.states) > MAX_STATES:
            self.clear()
        to, gained = self.step(key, c)
        return self.state(to), gained

    def step(self, key: tuple, c: str) -> tuple[tuple, int]:
        """Next key and tokens gained; the count is always that of the text ending here."""
        at, held, live = key
        kind = self.kind(c)
        if at == SPACE:
            # held: the run's last character; live: the run without it, then with it.
            run, whole = live
            if kind == SPACE:
                grown, plus = self.grow(whole, c)
                return (SPACE, c, (whole, grown)), plus
            # The run's last character leaves the run: a plain space opens the next piece, another stands alone.
            back = self.grow(run, held)[1]
            if held == " ":
                opened, plus = self.grow((), " ")
                grown, more = self.grow(opened, c)
                return (kind, "", grown), plus + more - back
            to, more = self.step((START, "", ()), c)
            return to, self.grow((), held)[1] + more - back
        if kind == SPACE:
            grown, plus = self.grow((), c)
            return (SPACE, c, ((), grown)), plus
        if at == APOSTROPHE:
            return self.contraction(held, c, kind)
        if at == kind and at != START:
            grown, plus = self.grow(live, c)
            return (at, "", grown), plus
        grown, plus = self.grow((), c)
        return (APOSTROPHE, c, ()) if c == "'" else (kind, "", grown), plus

    def contraction(self, held: str, c: str, kind: int) -> tuple[tuple, int]:
        """After an apostrophe that opened a piece, and perhaps r, v or l."""
        text = held + c
        if text in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
            # One piece instead of the apostrophe and the letters after it.
            return (START, "", ()), self.count_piece(text) - 1 - (self.count_piece(held[1:]) if held[1:] else 0)
        if text in ("'r", "'v", "'l"):
            return (APOSTROPHE, text, ()), self.count_piece(c)
        if held == "'":
            if kind == MARK:
                grown, plus = self.grow(self.grow((), "'")[0], c)
                return (MARK, "", grown), plus
            grown, plus = self.grow((), c)
            return (kind, "", grown), plus
        # The apostrophe stood alone and the letter opened a piece of its own.
        return self.step((LETTER, "", self.grow((), held[1:])[0]), c)

    def count_piece(self, text: str) -> int:
        live, n = (), 0
        for c in text:
            live, plus = self.grow(live, c)
            n += plus
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings count as one each."""
        parts = self.apart(text) if self.apart and "<|" in text else (text,)
        n = len(parts) - 1
        for part in parts:
            state = self.start
            for c in part:
                state, gained = state[c]
                n += gained
        return n

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, count, tail); tail None: no reset point, the whole chunk is head."""
        first = _reset(text)
        if not first:
            return text, 0, None
        a, b = first.start(), _last_reset(text).start()
        return text[:a], self.count(text[a:b]), text[b:]

    def compose(self, one: tuple, two: tuple) -> tuple:
        """The map of two chunks in a row."""
        if one[2] is None and two[2] is None:
            # Joining may bring a reset point between the two.
            return self.chunk_map(one[0] + two[0])
        if one[2] is None:
            head, n, tail = self.chunk_map(one[0] + two[0])
            return (head, n + self.count(tail) + two[1], two[2]) if tail is not None else (head, two[1], two[2])
        if two[2] is None:
            head, n, tail = self.chunk_map(one[2] + two[0])
            return (one[0], one[1] + self.count(head) + n, tail) if tail is not None else (one[0], one[1], head)
        return one[0], one[1] + self.count(one[2] + two[0]) + two[1], two[2]

    def composed(self, maps: list[tuple]) -> tuple:
        """The map of consecutive chunks, by a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def fold(self, maps: list[tuple]) -> int:
        """Tokens of the text whose chunks have these maps."""
        head, n, tail = self.composed(maps)
        return self.count(head) + n + self.count(tail or "")


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer of a file, built once."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def forget() -> None:
    """Drop the worker's transducers; their states point at one another."""
    for machine in _loaded.values():
        machine.clear()
    _loaded.clear()


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8) and ``n_tokens``.

    Null and empty texts have neither; repeated rows are kept; other columns
    are not read.  Texts of ``chunk_chars`` and more are counted chunk by chunk
    in as many rows, so one huge text is spread over tasks; their maps, and
    nothing else, are shuffled, and composed level by level.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def on_parts(use):
        @serving("token_count", forget)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = transducer(path)
            gc.disable()
            try:
                for batch in batches:
                    for lo in range(0, batch.num_rows, 512):
                        yield use(machine, batch.slice(lo, 512))
            finally:
                gc.enable()

        return run

    def count(machine: Transducer, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(map(machine.count, part.column(2).to_pylist()), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out_schema = f"id {kind}, n_bytes long, n_tokens long"
    whole = rows.filter(F.length("text") < chunk_chars).select("id", "n_bytes", "text").mapInArrow(on_parts(count), out_schema)

    # The row number is given at the scan: every chunk of a row gets it in the same task.
    long = rows.filter(F.length("text") >= chunk_chars).withColumn("row", F.monotonically_increasing_id())
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / chunk_chars).cast("int") - 1), lambda k: F.struct(k.alias("k"), F.substring("text", k * chunk_chars + 1, F.lit(chunk_chars)).alias("chunk")))

    def maps(machine: Transducer, part: pa.RecordBatch) -> pa.RecordBatch:
        head, n, tail = zip(*map(machine.chunk_map, part.column(4).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())], names=["id", "n_bytes", "row", "k", "head", "n", "tail"])

    mapped = long.select("id", "n_bytes", "row", F.inline(cut)).mapInArrow(on_parts(maps), f"id {kind}, n_bytes long, row long, k int, head string, n long, tail string")

    def gathered(df: DataFrame, *by) -> DataFrame:
        return df.groupBy("row", *by).agg(F.min("id").alias("id"), F.min("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("k", "head", "n", "tail"))).alias("maps"))

    def composed(machine: Transducer, part: pa.RecordBatch) -> pa.RecordBatch:
        found = [machine.composed([(x["head"], x["n"], x["tail"]) for x in m]) for m in part.column(4).to_pylist()]
        head, n, tail = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())], names=["id", "n_bytes", "row", "k", "head", "n", "tail"])

    def total(machine: Transducer, part: pa.RecordBatch) -> pa.RecordBatch:
        n = [machine.fold([(x["head"], x["n"], x["tail"]) for x in m]) for m in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    level = gathered(mapped, F.floor(F.col("k") / FOLD_CHUNKS).cast("int").alias("k")).select("id", "n_bytes", "row", "k", "maps")
    level = level.mapInArrow(on_parts(composed), f"id {kind}, n_bytes long, row long, k int, head string, n long, tail string")
    folded = gathered(level).select("id", "n_bytes", "maps").mapInArrow(on_parts(total), out_schema)
    return whole.unionByName(folded).toDF(id_col, "n_bytes", "n_tokens")
