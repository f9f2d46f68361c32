"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie.  A depth-first walk carries, for
every prefix, the *last token* of that prefix's encoding: a token ``t`` that is
a suffix of the prefix is the last one exactly when it is compatible with the
last token of what stands before it.  Words with a common prefix share those
states, so each prefix is encoded once; a word's ids are read off by walking
back from its end.

The vocabulary file's pipeline is reproduced: NFC, white space to one space,
lower case, the split pattern, bytes as printable characters, and a merge
table whose last symbol of a word carries a suffix.  Texts are never cut; null
counts as empty.  Memory: one group of documents, its trie, and a bounded
cache of word encodings.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.worker import serving
from lexigrain.storage import bound_batches

#: Words kept encoded per worker; when full the cache starts anew.
CACHE_WORDS = 350_000
#: Token pairs remembered as compatible or not.
CACHE_SEAMS = 250_000
#: Characters of text whose distinct words go into one trie.
GROUP_CHARS = 1_000_000


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest are shifted past 255 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + extra))
        extra += b not in plain
    return out


class MergeTable:
    """Vocabulary and merges; answers whether two tokens may stand side by side in an encoding."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocab = vocab
        self.names = {i: s for s, i in vocab.items()}
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[left, right] = r
            if self.rank[whole] < 0:
                self.rank[whole] = r
                self.parts[whole] = (left, right)
        self._seams: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' joined text gives back the two tokens."""
        key = left << 32 | right
        known = self._seams.get(key)
        if known is None:
            if len(self._seams) > CACHE_SEAMS:
                self._seams.clear()
            known = self._seams[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        # Undo the merges on either side of the seam, latest first; the seam
        # breaks if a merge across it would have come before the one undone.
        rank, across, before = self.rank, self.merge_rank, len(self.merge_rank) + 1
        while True:
            r = across.get((left, right))
            if r is not None and r < before:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                before, left = a, self.parts[left][1]
            elif b >= 0:
                before, right = b + 1, self.parts[right][0]
            else:
                return True

    def stands(self, token: int) -> bool:
        """Whether the token's own text encodes to the token."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                left, right = self.parts[token]
                known = self.stands(left) and self.stands(right) and self._forms(left, right, self.rank[token])
            self._whole[token] = known
        return known

    def _forms(self, left: int, right: int, at: int) -> bool:
        # The pair meets at the merge that joins it only if no earlier merge crosses the seam.
        rank, across, before = self.rank, self.merge_rank, at
        while True:
            r = across.get((left, right))
            if r is not None and r < before:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                before, left = a, self.parts[left][1]
            elif b >= 0:
                before, right = b + 1, self.parts[right][0]
            else:
                return True


class TrieEncoder:
    """Encodes sets of words by one depth-first walk over their trie."""

    def __init__(self, table: MergeTable, suffix: str = ""):
        self.compatible = table.compatible
        # Texts of tokens and of their prefixes: the token that may stand inside a word, or -1; and those that end one.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for text, t in table.vocab.items():
            ends = bool(suffix) and text.endswith(suffix)
            text = text[: -len(suffix)] if ends else text
            for k in range(1, len(text) + 1):
                self.inner.setdefault(text[:k], -1)
            if table.stands(t):
                (self.final if ends else self.inner)[text] = t
        if not suffix:
            self.final = self.inner

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each distinct word; words are strings of byte characters, not empty."""
        root: dict = {}
        longest = 0
        for w in words:
            longest = max(longest, len(w))
            node = root
            for c in w[:-1]:
                node = node.get(c) or node.setdefault(c, {"": []})
            node.setdefault("", []).append(w[-1])
        out: dict[str, list[int]] = {}
        inner, final, compatible = self.inner.get, self.final.get, self.compatible
        # last[k], length[k]: the last token of the path's first k characters, and how many of them it covers.
        last, length = [-1] * (longest + 1), [0] * (longest + 1)
        stack: list[tuple[dict, str, tuple[int, ...]]] = [(root, "", (0,))]
        while stack:
            node, path, live = stack.pop()
            n = len(path)
            if n:
                # live: where a token that is still open may have begun.
                still, found = [], False
                for k in live:
                    t = inner(path[k:])
                    if t is not None:
                        still.append(k)
                        if not found and t >= 0 and (not k or compatible(last[k], t)):
                            found, last[n], length[n] = True, t, n - k
                if not found:
                    raise ValueError(f"no token of the vocabulary ends {path[-20:]!r}")
                still.append(n)
                live = tuple(still)
            for c, child in node.items():
                if c:
                    stack.append((child, path + c, live))
            for c in node.get("", ()):
                word = path + c
                for k in live:
                    t = final(word[k:])
                    if t is not None and t >= 0 and (not k or compatible(last[k], t)):
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[-20:]!r}")
                ids = [t]
                while k:
                    ids.append(last[k])
                    k -= length[k]
                ids.reverse()
                out[word] = ids
        return out


class WordTokenizer:
    """A word-end BPE tokenizer read from a tokenizers-library file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.table = MergeTable(model["vocab"], merges)
        self.encoder = TrieEncoder(self.table, self.suffix)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.bytes = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(self.bytes)}
        # Code points whose classes differ between Unicode versions: there the library's own splitter decides.
        self.rare = regex.compile(r"[^\x00-\u024F\u2010-\u203F]").search
        self.path, self._library = path, None
        # Ids of a word as one string, and the token texts by id as a string.
        self.cache: dict[str, str] = {}
        self.shown = {str(i): t for i, t in self.table.names.items()} | {str(i): t for t, i in self.special.items()}

    @property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, loaded when first needed."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list[str]:
        """Words of one stretch of text, after normalisation."""
        if not text.isascii():
            if self.rare(text):
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in split]
            text = unicodedata.normalize("NFC", text)
        return self.find(text.lower())

    def split(self, text: str) -> list[str]:
        """All words of a text; special strings stand as themselves."""
        if self.apart and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.apart(text)):
                out += [part] if k % 2 else self.words(part)
            return out
        return self.words(text)

    def learn(self, words: set[str]) -> None:
        """Put the encodings of all ``words`` into the cache."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        for s, i in self.special.items():
            self.cache[s] = str(i)
        new = words.difference(self.cache)
        raw = {w: w if w.isascii() and w.isprintable() else "".join(map(self.bytes.__getitem__, w.encode())) for w in new}
        codes = self.encoder.encode(set(raw.values()))
        for w, r in raw.items():
            self.cache[w] = " ".join(map(str, codes[r]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Count, ids joined by spaces, and decoded text of each text."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        for words in split:
            ids = " ".join(map(self.cache.__getitem__, words))
            each = ids.split()
            yield len(each), ids, " ".join(map(self.shown.__getitem__, each))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: this kind of file names no decoder, so tokens are joined by one space; unknown ids give nothing."""
        return " ".join(self.shown[str(i)] for i in ids if str(i) in self.shown)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, built once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def forget() -> None:
    """Drop the worker's tokenizers."""
    _loaded.clear()


def groups(texts: list[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in groups of about ``chars`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, ids: bool = True) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, with ``ids`` ``token_ids``, and ``decoded`` or, for ``digests``, the SHA-256 of ids and decoded text.

    Null and empty texts have no tokens; repeated rows are kept; other columns
    are not read.  A narrow map: no shuffle, whatever the sizes.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [f"{id_col} {kind}", "n_tokens long", *["token_ids array<int>"] * ids, *(["ids_sha256 string", "decoded_sha256 string"] if digests else ["decoded string"])]

    @serving("bpe", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        gc.disable()  # tries hold no cycles; looking for them costs a third of the time
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    out: list[list] = [[] for _ in fields[1:]]
                    for group in groups([t or "" for t in part.column(1).to_pylist()]):
                        for n, codes, text in tok.encode_all(group):
                            row = [n, *([np.array(codes.split(), np.int32)] if ids else ()), *(map(_sha256, (codes, text)) if digests else (text,))]
                            for column, x in zip(out, row, strict=True):
                                column.append(x)
                    arrays = [pa.array(x, _ARROW[f.split()[-1]]) for f, x in zip(fields[1:], out, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[f.rpartition(" ")[0] for f in fields])
        finally:
            gc.enable()

    named = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, ", ".join(f"`{f.rpartition(' ')[0]}` {f.rpartition(' ')[2]}" for f in fields))


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _sha256(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()
