"""Counts and ids against the library that defines them."""

import zlib

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing, tokens

COUNTED, PACKED = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a<|endoftext|>b <|startoftext|> c", "İstanbul ΑΣ Σ", "don't I'LL 123 ４５ ² ½", "é ẛ̣", "日本語 テスト", "\x00\x01 \x1c\x85\xa0",
    "ab" * 3000, "😀👨‍👩‍👧", "ſ K Å 's 'S", "<|endoftext|><|ENDOFTEXT|>", "a\x1cb c\x1fd", "a ́b́ c​d　e", "  a  b", "a \n b\n\n c \td ", "\r\n x",
]


@pytest.fixture(scope="module")
def texts(make_prose):
    return ODD + [" ".join(make_prose(k, 200)).capitalize() + ".\n" for k in range(5)]


def test_counts_equal_the_library(as_docs, texts):
    library = Tokenizer.from_file(COUNTED)
    rows = {r.doc_id: r for r in tokens.count_tokens(as_docs(texts), COUNTED, limit=50).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len(text.encode()), n > 50), text[:40]


def test_count_memory_may_be_small(texts, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    own, library = tokens.PieceCounter(COUNTED), Tokenizer.from_file(COUNTED)
    assert [own.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_merges_by_brute_force():
    pairs = {0 << 32 | 1: 0 << 32 | 3, 3 << 32 | 3: 1 << 32 | 4, 1 << 32 | 0: 2 << 32 | 5, 3 << 32 | 0: 3 << 32 | 6}

    def plain(symbols):
        symbols, made = list(symbols), 0
        while True:
            found = [(pairs[k], i) for i in range(len(symbols) - 1) if (k := symbols[i] << 32 | symbols[i + 1]) in pairs]
            if not found:
                return made
            value, i = min(found)
            symbols[i : i + 2] = [value & 0xFFFFFFFF]
            made += 1

    for n in range(1, 3**7):
        symbols, k = [], n
        while k:
            symbols.append(k % 3)
            k //= 3
        assert tokens.merges_of(symbols, pairs) == plain(symbols), symbols


def test_awkward_counts(awkward, nothing):
    rows = tokens.count_tokens(awkward, COUNTED).collect()
    assert len(rows) == awkward.count() and sum(r.doc_id == 5 for r in rows) == 2
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 6)} == {0}
    assert tokens.count_tokens(nothing, COUNTED).count() == 0


def joined(rows):
    return b"".join(r.ids for r in sorted(rows, key=lambda r: r.start))


def test_pieces_hold_every_id_once(as_docs, texts):
    library = Tokenizer.from_file(PACKED)
    docs = as_docs(texts).repartition(3)
    rows = packing.pack(docs, PACKED, length=64).collect()
    for i, text in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert joined(own) == np.array(ids, dtype="<u4").tobytes(), text[:40]
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) for r in own)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for sequence, offset, length in places:
        assert (sequence, offset) == divmod(at, 64)
        at += length
    assert at == sum(r.length for r in rows)


def test_sequences_are_padded(as_docs, texts):
    pieces = packing.pack(as_docs(texts), PACKED, length=64)
    rows = packing.sequences(pieces, 64, pad_id=7).orderBy("sequence_id").collect()
    sizes = [len(r.ids) // 4 for r in rows]
    used = [sum(b["length"] for b in r.boundaries) for r in rows]
    assert sizes[:-1] == used[:-1] == [64] * (len(rows) - 1)
    assert sizes[-1] == (used[-1] if used[-1] & (used[-1] - 1) == 0 else 64)
    assert all(np.frombuffer(r.ids, dtype="<u4")[u:].tolist() == [7] * (s - u) for r, u, s in zip(rows, used, sizes, strict=True))


def test_encoder_memory_may_be_small(texts, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    own, library = packing.ByteEncoder(PACKED), Tokenizer.from_file(PACKED)
    for text in texts * 2:
        assert own.encode_all([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_on_odd_pieces(monkeypatch):
    """Contractions, runs of white space, odd digits and letters, and special tokens, in chunks of every mixture."""
    monkeypatch.setattr(packing, "REMEMBERED", 3000)
    r = random.Random(2)
    odd = ["a", "word", "É", "'s", "'", " ", "  ", "\n", "\n\n", "\t", ".", ",", "_", "1", "23", "²", "×", "日", "<|endoftext|>", "<|", "!?", "\r\n", "\x85", "\xa0"]
    made = ["".join(r.choices(odd, k=r.randrange(14))) for _ in range(8000)]
    own, library = packing.ByteEncoder(PACKED), Tokenizer.from_file(PACKED)
    for at in range(0, len(made), 256):
        part = made[at : at + 256]
        want = [np.array(x.ids, dtype="<u4").tobytes() for x in library.encode_batch_fast(part, add_special_tokens=False)]
        assert own.encode_all(part) == want


def test_awkward_packing(awkward, nothing):
    rows = packing.pack(awkward, PACKED, length=2048).collect()
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)
    assert [r.doc_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert len([r for r in rows if r.doc_id == 5 and r.start == 0]) == 2
    assert packing.pack(nothing, PACKED).count() == 0


def test_even_texts_are_those_of_the_patterns():
    from folioscope.llm import packing

    marks = ["a", "b", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é"]
    pairs = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
    for x in marks:
        for y in marks:
            for z in marks:
                text = f"a{x}{y}{z}b c"
                plain = not any(p in text for p in pairs) and not packing.UNUSUAL.search(text)
                assert packing._is_even(text) == plain, repr(text)


def test_long_chunks_that_are_not_plain_take_no_longer():
    own, library = packing.ByteEncoder(PACKED), Tokenizer.from_file(PACKED)
    texts = ["x " + "a" * 30 + "'", "y " + "1" * 25 + "日 " + "é" * 29 + "\t z"]
    start = time.process_time()
    ids = own.encode_all(texts)
    assert time.process_time() - start < 5  # was doubled by each letter
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_texts_of_all_kinds_keep_their_order():
    own, library = packing.ByteEncoder(PACKED), Tokenizer.from_file(PACKED)
    texts = [text for pair in zip(ODD, ["one two, three.", "", "one", " two", "a b<|endoftext|> c"] * 4) for text in pair]
    ids = own.encode_all(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode_all([]) == []
