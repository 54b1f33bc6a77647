from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from staywise.llm import alignment as al
from staywise.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def both():
    return al.Tokenizers(tokenizer_path(A), tokenizer_path(B))


def plain(texts):
    """The contract, token by token, with the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(public_tokenizers.path(A))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    byte = al._byte_of()

    def piece(i):
        p = b_of.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_of.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = []
        for parts in (a_bytes, b_bytes):
            at, out = 0, []
            for x in parts:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, start = [], 0
        for cut in sorted(cuts):
            groups.append(tuple([i for i, (s, e) in zip(ids, sp, strict=True) if start <= s and e <= cut] for ids, sp in zip((a, b), spans, strict=True)))
            start = cut
        links = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
        docs.append((a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(said.encode()).hexdigest() if a else "",
        ))
    return out


HARD = [
    None, "", " ", "  ", "a", "word", " leading", "trailing ", "two  blanks", "tab\tand\nline \n end", "<|endoftext|> is text", "</s> <s> <unk>",
    "déjà vu naïve", "日本語のテキスト と 空白", "emoji 👩‍👩‍👧 family", "zero\x00byte", "\x1c odd \x85 blanks here", "▁ real ▁▁ underline", "don't we'll they're",
    "1234567890 3.14 0x1F", "<0x41> as text", "x" * 300, "same same", "same same", "é" * 50, "﻿bom", "á combining", "nbsp\xa0between words",
]


def test_against_the_libraries(spark, docs):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("ab é日\n\t.,'▁1<>|") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [(None if i % 17 == 3 else i % 90, t) for i, t in enumerate(texts)]  # repeated and null ids
    got = al.alignment(docs(rows), tokenizer_path(A), tokenizer_path(B))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *x) for (i, _), x in zip(rows, plain(texts), strict=True)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_small_blocks_and_chunks_change_nothing(spark, docs, monkeypatch):
    texts = [f"some {i % 7} words of thé text {i % 5}" for i in range(40)] + ["long word" * 400]
    rows = list(enumerate(texts))
    want = Counter((i, *x) for i, x in zip(range(len(texts)), plain(texts), strict=True))
    for chunk, block in ((50, 100), (1 << 20, 1 << 25)):
        monkeypatch.setattr(al, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(al, "BLOCK_CHARS", block)
        got = al.alignment(docs(rows).repartition(3), tokenizer_path(A), tokenizer_path(B))
        assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark, docs):
    assert al.alignment(docs([]), tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_whole_texts_and_words_agree(both, monkeypatch):
    texts = [t or "" for t in HARD]
    words = both.encode(texts)
    monkeypatch.setattr(both, "by_words", False)
    for x, y in zip(words, both.encode(texts), strict=True):
        assert x.tolist() == y.tolist()
    monkeypatch.setattr(both, "by_words", True)
    monkeypatch.setattr(al, "CACHE_WORDS", 3)  # forgets before every text
    for t in texts:
        assert [x.tolist() for x in both.encode([t])][0] == [i for i in both._encode(t)[0] if t and both._encode(t)[2]]


def test_cuts_by_divide_and_conquer():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(np.append(rng.integers(1, 60, rng.integers(0, 40)), 60)) for _ in "ab")
        got = al.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        assert a[got].tolist() == np.intersect1d(a, b)[:-1].tolist()
    assert al.shared_cuts(np.arange(1, 100_001) * 2, np.array([200_000]), np.array([0]), np.array([99_999])).tolist() == []


def test_groups_spell_the_text(spark, docs, both):
    texts = ["déjà vu, naïve words", "日本語 text", "", None, "plain words here"]
    for row in al.groups(docs(list(enumerate(texts))), tokenizer_path(A), tokenizer_path(B)).collect():
        whole, at = (" " + (texts[row.doc_id] or "")).encode(), 0
        for g in row.groups:
            assert b"".join(both.a_bytes[i] for i in g.a) == b"".join(both.b_bytes[i] for i in g.b) == whole[at : g.end]
            at = g.end
        assert at == (len(whole) if texts[row.doc_id] else 0)
