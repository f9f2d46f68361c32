from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrain.llm import bpe, token_count

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "  ", "don't we'll I'VE 'S", "<|endoftext|>Hi<|startoftext|> x", "Σas ΑΣ İx ŉ", "a\x1cb\x85c d", "日本語 テキスト", "😀😀 é", "123 45a6", "\x00\x01 \x7f", "ſt K ß ẞ", "a" * 3000, "​‍", " 'r 'll're'", "''s", "'", "'rx", "\n\n a", "a \n", "\t\ta", "'ve's", "Ⅷ ½ ²", "é ೜"]


def texts(seed, n=400):
    rng = random.Random(seed)
    letters = "abcdeth ing'.,!é12 \n\t 'srevld"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(n)]
    wide = ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x4E00, 0x4EFF), 0x2003, 0x3000])) for _ in range(30)) for _ in range(n // 4)]
    return ODD + some + wide


def test_encoding_is_the_librarys():
    own, library = bpe.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    given = texts(1)
    for text, (n, ids, decoded) in zip(given, own.encode_all(given), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want), text
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)


def test_shared_prefixes_once():
    own = bpe.WordTokenizer(WORD)
    words = ["th", "the", "then", "thence", "x"]
    together = own.encoder.encode(words)
    assert together == {w: own.encoder.encode([w])[w] for w in words}


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_SEAMS", 5)
    own, library = bpe.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    for text in texts(2, 50):
        assert next(own.encode_all([text]))[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_count_is_the_librarys():
    own, library = token_count.Transducer(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    for text in texts(3):
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert own.count(text) == want, text
        size = rng.choice([1, 2, 5, 40])
        maps = [own.chunk_map(text[i : i + size]) for i in range(0, len(text), size)] or [("", 0, None)]
        assert own.fold(maps) == want, (text, size)


def test_every_plane_is_the_librarys():
    """Code points that only some Unicode versions know as letters, and texts of all planes."""
    own, library = token_count.Transducer(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(9)
    some = ["\U00018f88\u8ae1", "a\U0001e4f0 1\U0001e4f1"]
    some += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(14)) if not 0xD800 <= c < 0xE000) for _ in range(1500)]
    some += ["".join(rng.choice("a1! '") + chr(rng.randrange(0x10000, 0x32000)) for _ in range(6)) for _ in range(1500)]
    for text in some:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_states_start_anew(monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 5)
    own, library = token_count.Transducer(BYTE), Tokenizer.from_file(BYTE)
    for text in texts(4, 40):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("digests", [True, False])
def test_encode_documents(spark, digests):
    long = "word " * 40_000
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in bpe.encode_documents(df, WORD, digests=digests).collect()), key=repr)
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), ids, *((digest(" ".join(map(str, ids))), digest(decoded)) if digests else (decoded,))))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(df.limit(0), WORD).count() == 0


def test_count_documents(spark):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "a"), (4, "one two  three\n\n" * 300), (5, "x" * 500), (6, " " * 333 + "<|endoftext|>" * 20)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    library = Tokenizer.from_file(BYTE)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    for size in (7, 64, 1 << 16):
        assert sorted((tuple(r) for r in token_count.count_tokens(df, BYTE, chunk_chars=size).collect()), key=repr) == want
    assert token_count.count_tokens(df.limit(0), BYTE).count() == 0
