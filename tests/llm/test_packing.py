"""Packing: ids against the library, placements against the plain rule, and whole sequences."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spheregrid.llm import packing
from spheregrid.llm.packing import encode_words, encoded_pieces, pack, sum_of_squares, tokenizer_path, words_of

ODD = [
    None, "", " ", "\n\t", "Hello, World! don't you'll I'm he'S", "<|endoftext|>", "x<|endoftext|>,y <|STARTOFTEXT|> A<|B", "H̱ ẖ T̈, É.", "≠ a≠b", "é,è;ê ÷,a ß! ÿ?", "Ünïcode—dash,— …", "İSTANBUL ΣΑΣ Kelvin K",
    "a b c\x0bd\x1ce", "12,345.67 x1y2 ٣٤", "日本語、テキスト。", "😀😀,abc😀 é́,", "</w> a</w>", "_under_score_ `q` ^~", "''s 's's 'tis", "x" * 5000, "word " * 9000,
]


def expected(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def encoded(texts):
    counts, words = words_of(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    flat, size = encode_words(coded.dictionary, tokenizer_path())
    ends = np.cumsum(size)
    ids = [flat[e - n : e].tolist() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    code, out = coded.indices.to_pylist(), []
    for n in counts.tolist():
        own, code = code[:n], code[n:]
        out.append([*(i for w in own for i in ids[w]), 1])
    return out


def test_ids_are_the_librarys():
    assert encoded(ODD) == expected(ODD)
    random.seed(3)
    letters = [*"abzABZ  \n\t'.,;<|>=-_09", "é", "É", "ß", "÷", "́", "̸", "̱", "—", "Σ", "İ", "😀", " ", "'s", "<|endoftext|>"]
    texts = ["".join(random.choices(letters, k=random.randrange(40))) for _ in range(4000)]
    got, want = encoded(texts), expected(texts)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_rule_against_all_choices():
    """Each placement makes the sum of squares the smallest it can be."""
    random.seed(1)
    for capacity in (2, 7, 30):
        lengths = np.array(sorted((random.randint(1, capacity) for _ in range(60)), reverse=True))
        bins, offset, gaps = sum_of_squares(lengths, capacity)
        state: list[int] = []
        squares = lambda gs: sum(n * n for g, n in collections.Counter(gs).items() if 0 < g < capacity)
        for s, b, at in zip(lengths.tolist(), bins.tolist(), offset.tolist(), strict=True):
            least = min(squares([*state[:k], state[k] - s, *state[k + 1 :]]) for k in range(len(state)) if state[k] >= s) if any(g >= s for g in state) else None
            least = min(x for x in (least, squares([*state, capacity - s])) if x is not None)
            if b == len(state):
                state.append(capacity)
            assert at == capacity - state[b] and state[b] >= s
            state[b] -= s
            assert squares(state) == least
        assert state == gaps.tolist()


@pytest.mark.parametrize("group", [8192, 40])
def test_sequences_are_whole(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    random.seed(2)
    texts = [*ODD, *(" ".join(random.choices(["aye", "bee", "sea"], k=random.randrange(1, 60))) for _ in range(400))]
    docs = spark.createDataFrame([(k % 300, t, k) for k, t in enumerate(texts)], "doc_id long, text string, uid long")
    rows = pack(encoded_pieces(docs, 64), 64).collect()
    want = collections.Counter()
    for k, ids in enumerate(expected(texts)):
        for piece, a in enumerate(range(0, len(ids), 64)):
            own = ids[a : a + 64]
            want[k % 300, piece, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    assert len(by) <= 1.05 * -(-sum(r.length for r in rows) // 64) + 2


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(encoded_pieces(empty)).count() == 0
    one = pack(encoded_pieces(spark.createDataFrame([(None, None)], "doc_id long, text string"))).collect()
    assert [(r.doc_id, r.piece, r.start, r.length, bytes(r.ids), r.offset) for r in one] == [(None, 0, 0, 1, b"\x01\0\0\0", 0)]
    same = pack(spark.createDataFrame([(3, 5)] * 40, "length long, uid int"), 4)
    assert same.columns == ["length", "uid", "sequence_id", "offset"]
    assert same.select("sequence_id").distinct().count() == 40 == same.where("uid = 5 and offset = 0").count()
    with pytest.raises(Exception, match="capacity"):
        pack(spark.createDataFrame([(5,)], "length int"), 4).count()
