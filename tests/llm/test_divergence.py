"""Source divergence: the whole result against sums over the whole vocabulary."""

from __future__ import annotations

import collections
import random
import re

import pytest

from spheregrid.llm import divergence
from spheregrid.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least=3, top=200):
    docs = collections.defaultdict(collections.Counter)
    counts = collections.defaultdict(collections.Counter)
    groups = collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = sum((counts[lang, s] for s in sources), collections.Counter())

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        cost = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(cost(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, cost(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def same(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, count int")
    got = source_divergence(docs, **options)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, *options.values())


ODD = [
    (None, None, None), ("", "", ""), ("Été été ÉTÉ A9b_c", "fr", None), ("été", "fr", "x"), ("été a", "fr", ""), ("日本 語 語", "ja", "x"), ("日本", "ja", "x"), ("日本 語 z", "ja", "y"), ("...", "none", "a"), (None, "none", "b"),
    ("one one ONE", "en", "only"), ("a b c", "en", "more"), ("a b c", "en", "more"), ("a b c", "en", "more"), ("a b c one one", "en", "third"), ("É x", "e", "s"),
]


def test_small_tables(spark):
    same(spark, ODD)
    same(spark, ODD, least_docs=1, top=2)
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


@pytest.mark.parametrize(("block", "shard"), [(32, 100_000), (3, 200)])
def test_many_sources(spark, monkeypatch, block, shard):
    """Sources of several blocks, terms over several shards, one source and one word in a third of all rows, ties and repeats."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 3000)
    random.seed(5)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    rows = [(" ".join(random.choices(words, [1 / (1 + k) for k in range(100)], k=random.randrange(30))) + " the" * (k % 3 == 0), random.choice(["en", "de"]), random.choice(["big"] * 4 + [f"s{j}" for j in range(9)])) for k in range(300)]
    same(spark, [*rows, *rows[:40], *ODD])


def test_long_text(spark):
    rows = [("word " * 400_000 + "end", "en", "a"), ("end word", "en", "b"), ("end", "en", "a"), ("word", "en", "b")]
    same(spark, rows)
