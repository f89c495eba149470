from __future__ import annotations

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spheregrid.llm.bpe import Tokenizer, encode_documents, tokenizer_path
from spheregrid.llm.hmm import Hmm, score_documents
from spheregrid.llm.langid import identify, keep_identified
from spheregrid.llm.toxicity import families, fit_sample, forward_backward, keep_civil, score_toxicity, tag

DATA = os.environ.get("SPHEREGRID_TESTDATA", "/root/testdata/sf0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\n\n\nend\n", "don't we'll I'm", "x<|endoftext|>y", "a <|endoftext|>  <|endoftext|> b", "é ñ 中文 \U0001f600 ok", "nbsp here   x", "\x00nul \x00", "1234 5678, (x)!!", "w" * 3000, "the " * 500, "control \x1c\x1d chars", "line sep  x", "Same text", "Same text"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").cache()


def crc(i):
    return zlib.crc32(str(i).encode())


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer as Base

    base = Base.from_file(tokenizer_path())
    rows = [(i if i else None, t, "x") for i, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {}
    for r in encode_documents(table).collect():
        got.setdefault(r["doc_id"], []).append((r["ids"], r["decoded"]))
    for i, text, _ in rows:
        ids = base.encode(text or "", add_special_tokens=False).ids
        assert got[i] == [(ids, base.decode(ids, skip_special_tokens=False))], text
    assert encode_documents(table.where("false")).collect() == []
    assert len(Tokenizer(tokenizer_path()).pieces()[1]) == 50257 + 1


def test_bpe_documents(docs):
    from tokenizers import Tokenizer as Base

    base = Base.from_file(tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = encode_documents(docs).collect()
    assert len(got) == len(text)
    want = dict(zip(text, base.encode_batch(list(text.values()), add_special_tokens=False), strict=True))
    assert all(r["ids"] == want[r["doc_id"]].ids and r["decoded"] == text[r["doc_id"]] for r in got)


def test_language_held_out(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = identify(docs).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.95
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(lang)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, None, "en", 1), (3, "", None, 1), (None, "12 34 !!", "de", 1), (5, "der hund und die katze", "de", 1), (5, "der hund und die katze", "de", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted([(r["doc_id"], r["lang_pred"]) for r in identify(table, parts=10**9, part=-1).collect()], key=str)
    assert got == sorted([(1, "en"), (2, "und"), (3, "und"), (None, "und"), (5, "de"), (5, "de")], key=str)
    assert identify(table.where("false")).collect() == []


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    counts, edge = np.array([3, 0, 5, 1]), rng.standard_normal((2, 2))
    toxic = rng.standard_normal(counts.sum()) * 2
    got, pairs = forward_backward(counts, toxic, edge)
    want, steps, at = np.zeros(counts.sum()), np.zeros((2, 2)), 0
    for n in counts:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weights = [math.exp(sum(toxic[at + k] for k in range(n) if p[k]) + sum(edge[a, b] for a, b in itertools.pairwise(p))) for p in paths]
        for p, w in zip(paths, weights):
            for k in range(n):
                want[at + k] += p[k] * w / sum(weights)
            for a, b in itertools.pairwise(p):
                steps[a, b] += w / sum(weights)
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, steps)


def test_toxicity_held_out(spark, docs, labels):
    label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) / len(held) >= 0.93
    assert keep_civil(docs, labels).columns == docs.columns


def test_toxic_spans_and_edges(spark):
    rng = np.random.default_rng(0)
    some = lambda n: [" ".join(f"w{k}" for k in rng.integers(400, size=12)) for _ in range(n)]
    rows = [(i, t, 0) for i, t in enumerate(some(40))] + [(100 + i, f"{t} loser {u}", 1) for i, (t, u) in enumerate(zip(some(40), some(40)))]
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    label = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit_sample(table, label)
    odd = spark.createDataFrame([(1, "É. You LOSER!", None), (2, None, None), (None, "", None), (4, "the cat", None), (4, "the cat", None)], "doc_id long, text string, score string")
    got = tag(odd, model).select("row.doc_id", "row.text", "score", "predicted", "spans").collect()
    assert len(got) == 5
    for r in got:
        assert r["predicted"] == (1 if r["doc_id"] == 1 else 0)
        assert [r["text"].encode()[s["start"] : s["end"]].decode() for s in r["spans"]] == (["LOSER"] if r["doc_id"] == 1 else [])
    assert score_toxicity(odd.where("false"), label).collect() == []
    assert {r["predicted"] for r in score_toxicity(odd, label.where("false")).collect()} == {0}


def test_hmm_likelihood_by_enumeration():
    rng = np.random.default_rng(1)
    model = Hmm.first(5, 3, 2, rng.uniform(size=5))
    counts = np.array([4, 1, 2])
    classes = rng.integers(5, size=counts.sum())
    got, at = model.log10(classes, counts), 0
    for k, n in enumerate(counts):
        own = classes[at : at + n]
        total = sum(model.start[p[0]] * math.prod(model.step[a, b] for a, b in itertools.pairwise(p)) * math.prod(model.emit[s, c] for s, c in zip(p, own)) for p in itertools.product(range(3), repeat=int(n)))
        assert math.isclose(got[k], math.log10(total), rel_tol=1e-12)
        at += n


def test_hmm_scores(spark, docs):
    rows = [(r["doc_id"], r["text"], 1) for r in docs.select("doc_id", "text").where("doc_id < 400").collect()]
    rows += [(5000 + i, t, 1) for i, t in enumerate(ODD)] + [(None, "no id", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = score_documents(table).collect()
    low = lambda t: [("".join(c.lower() if "A" <= c <= "Z" else c for c in w)) for w in WORD.findall(t or "")] + [None]
    held = lambda i: i is not None and crc(i) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        words = low(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want[i, held(i), len(words), sum(c[w] > 0 for w in words), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    test = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert all(r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert score_documents(table.where("false")).collect() == []


def test_hmm_learns_from_whole_texts(spark, monkeypatch):
    """What only the ends of long texts show: after token 2,000 every x follows a y, at whatever number of texts."""
    rng = np.random.default_rng(2)
    head = lambda n: " ".join(rng.choice(["a", "b"], n))
    rows = [(i, f"{head(2100)} " + "x x x x y y y y " * 30) for i in range(40)] + [(100 + i, head(100)) for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    counts = Hmm.counts
    monkeypatch.setattr(Hmm, "counts", lambda self, *a: seen.append(1) or counts(self, *a))
    got = score_documents(table, states=3).collect()
    # No round of training runs in the driver, on a part of the rows.
    assert not seen and len(got) == len(rows)
    long = [r for r in got if r["n_tokens"] > 2000]
    # An x or y costs log10(2) less where the model knows which part of the text it is in, beside what runs of four save.
    assert all(r["score"] - r["base_score"] > 240 * 0.3 for r in long)


def test_toxic_word_late_in_long_texts(spark):
    rng = np.random.default_rng(4)
    some = lambda n: " ".join(f"w{k}" for k in rng.integers(400, size=n))
    rows = [(i, some(6000), 0) for i in range(20)] + [(100 + i, f"{some(6000)} loser {some(20)}", 1) for i in range(20)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = fit_sample(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, "You loser!"), (2, "the cat"), (3, some(6000)), (4, f"{some(9000)} loser")], "doc_id long, text string")
    got = {r["doc_id"]: (r["predicted"], len(r["spans"])) for r in tag(odd, model).select("row.doc_id", "predicted", "spans").collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (1, 1)}


def test_only_near_copies_teach_once():
    """A text goes if at least four fifths of an earlier one's shingles are its own, and for nothing less."""
    base = [f"w{k}" for k in range(200)]
    near, shares = [*base[:-3], "x", "y", "z"], [*base[:60], *(f"v{k}" for k in range(140))]
    texts = [" ".join(t) for t in (base, near, shares, base[:150], base)] + ["", "", "one two"]
    assert families(texts).tolist() == [True, False, True, True, False, True, True, True]
    # Against all pairs, on texts that share much or little.
    random.seed(8)
    many = []
    for _ in range(60):
        own = random.choice(many).split() if many and random.random() < 0.6 else random.choices(base, k=80)
        for _ in range(random.choice((0, 2, 8, 30))):
            own[random.randrange(len(own))] = random.choice(base)
        many.append(" ".join(own))
    sets, kept = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in many], []
    for k, own in enumerate(sets):
        if not any(len(own & sets[j]) >= 0.8 * len(own | sets[j]) for j in kept):
            kept.append(k)
    assert np.flatnonzero(families(many, hashes=40)).tolist() == kept


def test_repeated_ids_teach_alike(spark):
    """Of an id with several texts the one with the least hash is learned from, however the rows come."""
    rows = [(k, f"{'vile scum' if k % 2 else 'good day'} number {k} with words {k * 7} and {k * 11}") for k in range(40)]
    rows += [(k, f"another text of {k} vile" if k % 3 else f"good {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    scores = [{(r["doc_id"], round(r["score"], 12)) for r in score_toxicity(spark.createDataFrame(order, "doc_id long, text string"), labels).collect()} for order in (rows, rows[::-1])]
    assert scores[0] == scores[1]
