from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from staywise.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["'", "''", "'s", "'re", "'ll", "'S", "s", "t", "re", "ve", " ", "  ", "\n", "\r\n", "\t", " ", "　", " ",
         "x", "é", "ñandú", "7", "½", "٣", "!", "?$%", "\0", "�", "😀", "՘", "Ᲊ", "\x1c", "\x85", "漢字"]


def texts():
    draw = random.Random(5)
    mixed = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    return [*mixed, "", "a" * 5000, "ab" * 2000 + "é" * 300, "\n" * 3000 + "x", " " * 999, "'" * 500, "word " * 4000]


def pieces(batch):
    classes = np.frombuffer(bpe.codepoint_classes(), np.uint8)
    return [[t[i:j] for i, j in zip(s, e, strict=True)] for t, s, e in bpe.boundaries(batch, classes)]


def test_boundaries_are_those_of_the_pattern():
    import regex

    some = [t for t in texts() if not set(t) & {"՘", "Ᲊ"}]  # younger than a library's tables
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text, got in zip(some, pieces(some), strict=True):
        assert got == pattern.findall(text)


def test_boundaries_do_not_depend_on_the_batch():
    some = texts()[:200]
    assert pieces(some) == [pieces([t])[0] for t in some]


def test_scan_is_the_sequential_machine():
    draw = np.random.default_rng(0)
    first, _, value, _, _ = bpe._monoid()
    for size in (1, 63, 64, 65, 5000):
        symbols = draw.integers(0, 9, size)
        state, expected = bpe.FRESH, []
        for s in symbols:
            state = bpe._step(state, s)[0]
            expected.append(state)
        assert value[bpe._scan(first[symbols]).astype(int) * 8].tolist() == expected


def test_ids_and_bytes_are_those_of_the_library(docs, ranks, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(-1, None), (5, texts()[5])]
    got = bpe.digests(docs(rows), ranks).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        assert by_id[i].n_tokens == len(ids)
        assert by_id[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_offsets_and_separate_steps(docs, ranks, library):
    text = "It's an ñandú 😀 of 1234 words\n\n  indeed"
    encoded = bpe.encode(docs([(1, text)]), ranks)
    row = encoded.first()
    ids = library.encode_ordinary(text)
    ends = np.frombuffer(row.token_ends, "<u4").tolist()
    assert ends == np.cumsum([len(library.decode_single_token_bytes(i)) for i in ids]).tolist()
    start, end = bpe.spans(row.token_ends, 3, 6)
    assert text.encode()[start:end] == library.decode_bytes(ids[3:6])
    piece_ends = np.frombuffer(row.piece_ends, "<u4").tolist()
    assert [text[i:j] for i, j in zip([0, *piece_ends], piece_ends, strict=False)] == pieces([text])[0]
    assert bpe.decode(encoded, ranks).first().decoded == text.encode()


def test_empty_table(docs, ranks):
    assert bpe.digests(docs([]), ranks).collect() == []
