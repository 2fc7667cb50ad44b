"""Encoders and counters against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chatterlens.llm import packing, piece_bpe, token_count

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abetiosnrl  \n\t.,!?'\"-éÉß日💩\x00\x01\x1c\x85\xa0\u0301Σς09AZ▁", "'s", "<|endoftext|>", "<s>", "<0x41>", ", ", ". ", "\r\n", "  ", "\n\n"]


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    return ["", " ", *("".join(rng.choices(ALPHABET, k=rng.randint(0, longest))) for _ in range(n))]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(library):
    rng = random.Random(1)
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    texts = random_texts(2, 500, 150) + ["".join(rng.choices(pieces, k=40)).replace("▁", rng.choice(["", " "])) for _ in range(800)]
    texts += [" " * n + "the" for n in (15, 16, 17, 31, 32, 33, 100)] + ["ab" * 500, "x" * 999, "ing" * 700, "\n" * 40]
    coder = piece_bpe.PieceEncoder(piece_bpe.PieceModel(PIECES))
    for text, (ids, decimal) in zip(texts, coder.encode(texts)):
        expected = library.encode(text)
        assert ids.tolist() == expected and decimal.decode() == ",".join(map(str, expected))
        assert coder.model.decode(ids) == library.decode(expected)


def test_any_ids_decode_like_the_library(library):
    rng = random.Random(3)
    model = piece_bpe.PieceModel(PIECES)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 28705, 259, 260, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(1, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_memory_of_words_forgets_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 5)
    coder = piece_bpe.PieceEncoder(piece_bpe.PieceModel(PIECES))
    texts = random_texts(4, 40, 60)
    for _ in range(2):
        assert [ids.tolist() for text in texts for ids, _ in coder.encode([text])] == [library.encode(t) for t in texts]


def test_piece_query_on_odd_rows(odd_docs, no_docs, library):
    rows = odd_docs.select("doc_id", "text").collect()
    expected = []
    for r in rows:
        ids = library.encode(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    found = [tuple(r) for r in piece_bpe.encode_decode(odd_docs, PIECES).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert piece_bpe.encode_decode(no_docs, PIECES).count() == 0
    full = piece_bpe.encode_decode(odd_docs.filter("doc_id = 10"), PIECES, with_ids=True).first()
    assert full["decoded"] == "ONE\ttwo" and len(full["ids"]) == full["n_tokens"]


@pytest.mark.parametrize("chunk,overlap", [(50, 5), (200, 10), (10_000, 100)])
def test_spliced_counts_equal_the_library(chunk, overlap):
    tokenizer = token_count.library(WORDS)
    counter = token_count.ResyncCounter(tokenizer, chunk, overlap)
    texts = random_texts(5, 300, 900) + ["x1" * 2000, "word " * 2000, "é" * 700 + " " + "b" * 700]
    assert counter.counts(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_query_on_odd_rows(odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for r in odd_docs.select("doc_id", "text").collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        expected.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048))
    found = [tuple(r) for r in token_count.count_tokens(odd_docs, WORDS, chunk_chars=4000).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert token_count.count_tokens(no_docs, WORDS).count() == 0


def test_byte_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(BYTES)
    texts = random_texts(6, 3000, 80)
    found = packing.ByteEncoder(BYTES).encode(texts)
    assert [f.tolist() for f in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_crc_is_over_little_endian_words():
    assert packing.crc(np.array([1, 2], np.uint16)) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")


def test_tokenizers_that_keep_white_space_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        token_count.resync_counter(public_tokenizers.path("byte_bpe_50k.json"), 16_384, 256)
    assert token_count.resync_counter(public_tokenizers.path("word_bpe_49k.json"), 16_384, 256)
