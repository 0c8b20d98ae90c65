"""Tokens against the tokenizer itself, and packings against bounds."""

import zlib

import numpy as np
import pytest

from weir.llm import packing, queries


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def whole_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [0]


ODD_TEXTS = ["a<|endoftext|>b c", "é ́x \x85 y z 'S don't we're", "", "\x1c a\x1db", "a[b] c]] d`~ O're x-- é%%%", "##### a\\", "GRÜSSE; straße ñ 12,3", "İ ΣΑΣ ﬁ ½ ①"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_words_give_the_ids_of_the_text(path, text):
    assert b"".join(packing.tokens(path).encode(text)) == np.array(whole_ids(path, text)[:-1], "<u4").tobytes()


def test_cut():
    ids = lambda n: [np.arange(1, n + 1, dtype="<u4").tobytes()]
    assert [p[:2] for p in packing.cut(ids(0), 4)] == [(0, 1)]
    assert [p[:2] for p in packing.cut(ids(3), 4)] == [(0, 4)]
    assert [p[:2] for p in packing.cut(ids(4), 4)] == [(0, 4), (4, 1)]
    assert [p[:2] for p in packing.cut([*ids(3), *ids(6)], 4)] == [(0, 4), (4, 4), (8, 2)]


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_round_trip_and_fill(spark, path, documents):
    rows = packing.pack(documents, path).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = whole_ids(path, texts[d])
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.start == 2048 * r.piece
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    least = -(-sum(r.length for r in rows) // 2048)
    assert check(rows, 2048) <= least + 2


def test_island_never_loses_a_piece():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 150).tolist()
    first = packing.evolve(sizes, [], 100, 1, 0)[0]
    later = packing.evolve(sizes, [], 100, 1, 25)[0]
    for bins in (first, later):
        assert sorted(i for b in bins for i in b) == list(range(150))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert packing.fitness([1] * len(later), 100)[0] >= packing.fitness([1] * len(first), 100)[0]


def test_odd_rows(spark, path, odd, empty):
    rows = packing.pack(odd, path).collect()
    check(rows, 2048)
    assert sorted(r.length for r in rows if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id == 5 for r in rows) > 30
    assert packing.pack(empty, path).count() == 0
