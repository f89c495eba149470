"""The prefix trie: the whole result against a trie of plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from spheregrid.llm import trie
from spheregrid.llm.trie import conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def content(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, content(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        shared = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 * (1 if c >= 0 else -1))
        built[c] = own.get(base, [])[:shared] + own[c][shared:]
    members: dict[tuple, list[int]] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list] = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children.get(key, ())) or 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(saved[k] for k in children.get(key, ()))
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(key))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children.get(key, ())), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def same(spark, rows, kind="conv_id long, turn long, role string, text string, key string, block int"):
    found = conversation_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], kind))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


ODD = [
    (None, 0, "user", "lost"), (0, None, "user", None), (0, 0, None, "hi"), (0, 0, None, "hi"), (0, 1, "user", "é😀"), (5, 3, "user", "ho"), (5, 1, "", ""), (107, 0, "user", "a"), (107, 0, "user", "b"), (100, 0, "user", "a"),
    (-3, 0, "user", "hi"), (-103, 0, "a", "b"), (-100, 0, "a", "b"), (9223372036854775807, 0, "user", "hi"), (33, 9, "user", "x" * 200_000), (200, 0, "1:", "a"), (200, 1, "1", ":a"),
]


def test_odd_rows(spark):
    same(spark, ODD)
    same(spark, [(c, None, "user", "same") for c in range(30)])
    assert conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("block", [4096, 3])
def test_random_conversations(spark, monkeypatch, block):
    """Copies, common first turns, long conversations over several blocks of prefix and suffix sums."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PIECE_IDS", 4)
    random.seed(7)
    rows = [(c, t, random.choice("ua"), random.choice("xyz") * random.randrange(3)) for c in random.sample(range(500), 60) for t in range(random.randrange(1, 9))]
    rows += [(c, t, "u", "copy") for c in range(600, 640) for t in range(8)]
    rows += [(c, t, "u", "long" if t < 30 else f"{c}{t}") for c in (700, 800, 801) for t in range(40)]
    same(spark, rows + ODD)


def test_a_deep_chain_takes_few_rounds(spark):
    """A conversation of thousands of turns is one path: no round for each turn."""
    rows = [(0, t, "u", str(t)) for t in range(9000)] + [(100, t, "u", str(t) if t < 8000 else "other") for t in range(8500)]
    same(spark, rows)
