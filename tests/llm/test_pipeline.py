from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
from spheregrid.llm.common import saved
from spheregrid.llm.hmm import score_documents
from spheregrid.llm.jaccard import ngram_jaccard_join
from spheregrid.llm.langid import identify
from spheregrid.llm.toxicity import score_toxicity
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing_sharding import WORD, brute_mixture

DATA = os.environ.get("SPHEREGRID_TESTDATA", "/root/testdata/sf0.01").replace("sf0.01", "sf0.001")


def test_stages_against_brute_force(spark):
    """Each stage's decisions, taken by the operator's own verdicts (models) or by brute force, on what its predecessor kept."""
    from tokenizers import Tokenizer

    from spheregrid.llm.bpe import tokenizer_path

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(saved(stage(spark, kept[-1], DATA)))
    rows = [[tuple(r) for r in k.collect()] for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    toxic = {r["doc_id"] for r in score_toxicity(docs, labels).where("predicted = 1").collect()}
    assert Counter(rows[1]) == Counter(r for r in rows[0] if r[0] not in toxic)
    undecided = {r["doc_id"] for r in identify(kept[1]).where("not accepted").collect()}
    assert Counter(rows[2]) == Counter(r for r in rows[1] if r[0] not in undecided)
    first = {c for _, _, c in brute([(r[0], r[1]) for r in rows[2]])}
    assert Counter(rows[3]) == Counter(r for r in rows[2] if r[0] in first)
    words = Counter()
    for r in rows[4]:
        words[r[0]] += len(WORD.findall(r[1]))
    taken = Counter({doc: n for doc, _, _, _, n in brute_mixture([(r[0], r[1], r[3]) for r in rows[3]])})
    assert +words == +taken
    base = Tokenizer.from_file(tokenizer_path())
    want = Counter((r[0], tuple(base.encode(r[1], add_special_tokens=False).ids)) for r in rows[4])
    assert Counter((r[0], tuple(r[2])) for r in rows[5]) == want
    assert corpus_pipeline.run(spark, DATA).count() == len(rows[5])


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and repeated rows, columns with clashing names, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, _row int, score string, predicted int, accepted boolean, class long, _text string, spans string, node long"
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    rows += [(None,) * 5, (1001, None, "en", "s", 0), (1002, "", None, None, 0), (None, "no id at all " * 9, None, "s", None), (1003, "\t\n", "en", None, 2)] + rows[:3]
    table = spark.createDataFrame([(*r, 1, 2, "c", 4, False, 6, "d", "e", 8) for r in rows], schema)
    for one in (table, table.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, one, DATA)
            got = out.collect()
            if name != "encoding":
                assert out.columns == table.columns and all(r["score"] == "c" and r["node"] == 8 for r in got), name
            assert bool(got) == (one is table) and (name == "mixing" or len(got) <= len(rows)), name


def test_very_long_text(spark):
    """One text of 300,000 words among short ones, in every operator that reads texts word by word."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(0, " ".join(words[(k * k + k // 7) % 8] for k in range(300_000)), "en")] + [(k, " ".join(words[(k + j) % 8] for j in range(12)), "en") for k in range(1, 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(30)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r for r in score_documents(table, states=2, rounds=2).collect()}
    assert scored[0]["n_tokens"] == 300_001 and scored[0]["score"] < 10_000 * scored[1]["score"] / 13
    assert {r["doc_id"] for r in score_toxicity(table, labels).collect()} == set(range(30))
    assert {r["lang_pred"] for r in identify(table).collect()} == {"en"}
    found = {r["doc_id"]: r["n_shingles"] for r in ngram_jaccard_join(table).collect()}
    own = rows[0][1].split()
    assert found[0] == len({tuple(own[k : k + 5]) for k in range(len(own) - 4)})
