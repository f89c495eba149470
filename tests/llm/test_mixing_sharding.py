from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spheregrid.llm import sharding
from spheregrid.llm.mixing import mixed_documents, mixture
from spheregrid.llm.sharding import stratified_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, target int"


def rows_of(n, hot=0.4):
    out = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if i % 10 < 10 * hot else f"s{i % 5}"
        text = None if i % 23 == 0 else "" if i % 29 == 0 else " ".join(f"w{(i * j) % 7}" for j in range(i % 31))
        out.append((i, text, source, "clash", 5))
    return [*out, (7, "twice", "hot", None, None), (7, "twice", "hot", None, None), (None, "no id at all", "s1", None, None)]


def fill(sizes, share=1.5, weights=(3, 1, 2), epochs=2):
    """Targets by sharing the excess out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        target |= {s: target[s] + rest * weight[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            if target[s] >= epochs * sizes[s]:
                rest += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                open_.remove(s)
    return target


def key_of(row):
    text = hashlib.md5((row[1] or "").encode()).hexdigest()
    return hashlib.md5(f"1|{'' if row[0] is None else row[0]}|{text}".encode()).hexdigest()


def brute_mixture(rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size):
        sizes[r[2]] += n
    target, out = fill(sizes), []
    for source in sizes:
        own = sorted((k for k, r in enumerate(rows) if r[2] == source), key=lambda k: (key_of(rows[k]), rows[k][0] or 0))
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        left = int(target[source] + 1e-9) - epochs * sizes[source]
        for k in own:
            last = max(0, min(size[k], left))
            left -= last
            out.append((rows[k][0], size[k], sizes[source], round(target[source], 6), epochs * size[k] + last))
    return sorted(out, key=str)


def test_mixture(spark):
    rows = rows_of(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in mixture(docs).collect()]
    assert sorted([(a, b, c, round(d, 6), e) for a, b, c, d, e in got], key=str) == brute_mixture(rows)
    assert [tuple(r) for r in mixture(docs).orderBy("doc_id", "size").collect()] == [tuple(r) for r in mixture(docs).orderBy("doc_id", "size").collect()]
    assert mixture(docs.where("false")).collect() == []


def test_mixed_documents(spark):
    rows = rows_of(120)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    taken = Counter()
    for doc, _, _, _, n in brute_mixture(rows):
        taken[doc] += n
    assert +words == +taken


@pytest.mark.parametrize("n", [0, 3, 500])
def test_shards(spark, n):
    rows = rows_of(n) if n else []
    docs = spark.createDataFrame(rows, SCHEMA)
    got = stratified_shards(docs).collect()
    assert len(got) == len(rows)
    shards, mixes = defaultdict(list), defaultdict(Counter)
    for r in got:
        shards[r["shard"]].append(r["slot"])
        mixes[r["shard"]][r["source"]] += 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    if n:
        counts = [len(shards[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
    if n == 500:
        every = Counter(r[2] for r in rows)
        assert all(abs(mix[s] - every[s] / 8) <= 2 for mix in mixes.values() for s in every)
    text = {(r[0], r[1] or ""): (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], *text[r[0], r[1] or ""]) for r in rows)


def test_mixture_agrees_between_runs(spark):
    """Rows that share an id, in two partitionings of the table."""
    rows = [(7 if k % 10 else k, " ".join(["w"] * (1 + k % 13)), "ab"[k % 2]) for k in range(440)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixture(df).collect())) for df in (table.coalesce(1), table.repartition(7, "text")))
    assert one == two


def test_many_small_sources_fill_many_blocks(spark, monkeypatch):
    """Sources of one row have one fraction; their rows are still dealt over blocks, and shards stay whole."""
    seen = []
    plain = sharding.running

    def watched(rows, group, block, *rest):
        if not group:
            seen.append(rows.groupBy(block).count().agg(F.max("count"), F.count("*")).first())
        return plain(rows, group, block, *rest)

    monkeypatch.setattr(sharding, "running", watched)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    # So few rows would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = sharding.stratified_shards(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = shards.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert sorted(r["shard"] for r in rows) == list(range(8)) and {(r["n"], r["last"], r["slots"]) for r in rows} == {(500, 499, 500)}
    assert seen[0][1] >= 4 and seen[0][0] < 2000
