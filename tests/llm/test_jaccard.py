from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from spheregrid.llm import jaccard
from spheregrid.llm.jaccard import _blocks, _split, keep_one_of_each, ngram_jaccard_join
from spheregrid.llm.tokens import mix, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = WORD.findall(lower(text))
        sets.append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = " ".join(rng.choices(words, k=60))
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 7, 40, 150]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [shared + " " + " ".join(rng.choices(words, k=k)) for k in (0, 3, 10, 30, 90, 150)]
    base = rng.choices(words, k=200)
    for _ in range(60):  # one large group of near copies, some of which link only by way of others
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["", None, "   \n", "one", "One", "ONE  two", "one\ttwo", "É x", "é x", shared.upper()]
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("leaf,depth", [(1000, 4), (8, 3), (16, 0)])
def test_matches_brute_force(spark, leaf, depth):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_jaccard_join(docs, leaf=leaf, max_depth=depth, at_least=3)
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (4, "a b c d e f", None), (5, None, None), (None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (4, 2, 1), (5, 0, 5), (None, 0, None)], key=str)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 5]
    assert ngram_jaccard_join(docs.where("false")).collect() == []


def hot_cells(sizes, seed=5):
    """Pairs of near copies that meet in one cell only, which they share with unrelated sets: one cell of each size."""
    rng = random.Random(seed)
    some = [" ".join(f"{rng.randrange(10**6)}" for _ in range(5)) for _ in range(20_000)]
    values, _ = shingle_sets(pa.array(some))
    first = sorted(range(len(some)), key=mix(values.view("uint64")).__getitem__)
    texts = []
    for n, at in zip(sizes, first):
        for _ in range(n // 2):
            text = f"{some[at]} {rng.randrange(10**6)} {rng.randrange(10**6)} {rng.randrange(10**6)}"
            texts += [text, f"{text} {rng.randrange(10**6)}"]
        texts += [f"{some[at]} alone {n} {n}"] * (n % 2)
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_large_cells_match_brute_force(spark):
    rows = hot_cells([3, 4, 5, 7, 8, 9, *range(15, 20), *range(30, 40), 64, 65])
    # Equal texts that different tasks read.
    rows += [(10_000 + i, t) for i, t in rows[::3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5")
    try:
        out = sorted(map(tuple, ngram_jaccard_join(docs, few=2, many=4, at_least=10**9).collect()))
    finally:
        spark.conf.set(name, before)
    assert out == brute(rows)


@pytest.mark.parametrize("most,depth", [(1500, 3), (3000, 0)])
def test_few_long_sets_match_brute_force(spark, most, depth):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_jaccard_join(docs, leaf_shingles=most, max_depth=depth, at_least=3)
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_long_sets_are_parted(spark):
    """60 unrelated sets of 100 shingles, and no leaf holds more than 1,000."""
    sets = spark.createDataFrame([(7, i, list(range(1000 * i, 1000 * i + 100))) for i in range(60)], "region long, node long, shingles array<long>")
    sizes = spark.createDataFrame([(7, 60, 6000)], "region long, n long, total long")
    most = lambda df: max(r["count"] for r in df.groupBy("region").count().collect())
    parts = _blocks(sets, sizes, 4000, 1000)
    assert 5 <= parts.select("region").distinct().count() and most(parts) <= 25
    # Three groups of 20 whose sets have distance 0.5 in their group: 11 pivots leave, the others are parted.
    rows = [(7, i, sorted({*range(i % 3 * 1000, i % 3 * 1000 + 60), *range(9000 + 100 * i, 9000 + 100 * i + 30)})) for i in range(60)]
    sets = spark.createDataFrame(rows, "region long, node long, shingles array<long>")
    sizes = spark.createDataFrame([(7, 60, 5400)], "region long, n long, total long")
    _, parts = _split(sets, sizes, 80, 4000, 1000, 0)
    assert parts.select("region").distinct().count() > 1 and parts.select("node").distinct().count() == 49


def test_one_row_of_each_component(spark):
    """Rows are judged by id and text: an id with two texts, null ids, and rows that repeat."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, b + " more"), (None, c), (None, c), (9, c), (9, c), (11, None), (12, ""), (None, " ")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class string")
    got = sorted(((r["doc_id"], r["text"]) for r in keep_one_of_each(table).collect()), key=repr)
    assert got == sorted([(5, a), (3, b + " more"), (9, c), (11, None), (12, ""), (None, " ")], key=repr)
    assert keep_one_of_each(table.where("false")).collect() == []


def test_near_copies_without_ids(spark):
    """Rows are known by id and text, so links of texts whose rows all lack an id, or share one, aren't lost."""
    words = [f"w{k}" for k in range(60)]
    near, other = " ".join(words), " ".join([*words[:-1], "end"])
    for ids in ((None, None, 5), (7, 7, 7), (None, 3, None)):
        rows = [(ids[0], near), (ids[1], other), (ids[2], "quite another text with words of its own")]
        kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(kept) == 2 and {r["text"] for r in kept} & {near, other} and rows[2][1] in {r["text"] for r in kept}


def test_long_sets_of_a_large_cell(spark):
    """40 unrelated sets of 3,000 shingles, and some of 600, that share one cell: in 64 parts any two of the long ones look alike."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.randrange(10**7)}" for _ in range(3004 if i < 40 else 604))) for i in range(50)], "doc_id long, text string")
    members = jaccard._nodes(docs, 5)
    assert jaccard._shared(members.selectExpr("7L as s", "node"), members, 80).collect() == []


def test_windows_hold_the_rarest_words(spark):
    """Shingles of six common words recur by chance, too seldom to be counted; no two texts share a pivot."""
    rng = random.Random(9)
    texts = [" ".join([*rng.choices(["the", "of", "and", "to", "in", "is"], k=60), *(f"{rng.randrange(10**9)}" for _ in range(30))]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = jaccard._told(docs, 12)
    cells = jaccard._cells(docs, 5, 80, jaccard._common(docs, 5, 12, told), told)
    assert cells.count() > 300 * 16
    assert cells.groupBy("s").count().where("count > 1").collect() == []
