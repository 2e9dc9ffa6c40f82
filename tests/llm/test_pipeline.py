"""The pipeline, stage by stage, against brute force on the small tables."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dup import brute as brute_groups
from tests.llm.test_quality_rules import brute as brute_rules
from tests.llm.test_tokens import check_pieces
from tidewell.llm.common import load, materialize
from tidewell.llm.packing import pack_documents
from tidewell.llm.quality_classifier import quality_scores

SF = "/root/testdata/sf0.001"


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages(spark):
    docs = load(spark, SF, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], SF), name))
    start, clean, good, single, packed = steps
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = {r.doc_id: r for r in start.collect()}
    kept = {r.doc_id: r for r in clean.collect()}
    assert set(kept) == {d for d, r in rows.items() if brute_rules(r.text)[6]}
    for d, r in kept.items():
        assert (r == rows[d]) if brute_rules(rows[d].text)[8] == 0 else r.n_chars == len(r.text) < len(rows[d].text)
    scores = {r.doc_id: r.score for r in quality_scores(clean, load(spark, SF, "labels")).collect()}
    assert key(good.collect()) == key(r for d, r in kept.items() if scores[d] >= 0.3)
    left = good.collect()
    groups = brute_groups([(r.doc_id, r.text) for r in left])
    assert key(single.collect()) == key(r for r in left if groups[r.doc_id][1] == r.doc_id)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 2] for r in single.collect()}
    pieces = pack_documents(single).collect()
    assert check_pieces([(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.sequence_id, r.offset) for r in pieces], want, 4096) == 0
    last = packed.collect()
    assert {(r.doc_id, r.start, r.length) for r in last} == {(r.doc_id, r.start, r.length) for r in pieces}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(want)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, None, None, None), (1, "", None, None, 0), (2, "word " * 30, None, None, 1), (2, "word " * 30, None, None, 1), (None, " ".join(f"w{i}" for i in range(40)), "en", "s", 1)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, load(spark, SF, "documents").schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    assert sum(r.start == 0 for r in corpus_pipeline.packing(spark, docs, SF).collect()) == len(rows)


def test_clashing_columns_long_texts_and_ties(spark):
    """Columns named like the operators' own, a text of megabytes, and copies that tie."""
    rng = random.Random(3)
    prose = lambda n: ". ".join(" ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(9)) for _ in range(n)) + "."
    long, copy = prose(20_000), prose(30)
    rows = [(1, long), (9, copy), (4, copy), (4, copy), (7, copy + " more words here"), (None, prose(30)), (12, None)]
    extra = "key string, n int, node long, rep string, a int, score double, kept string, part int, text2 string"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 1, 2, "r", 3, 0.0, "no", 4, "t") for d, t in rows], schema)
    labels = load(spark, SF, "labels")
    assert docs.select("doc_id").join(labels, "doc_id").count() >= 0
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, out, SF), "stage")
        assert out.columns == docs.columns
        assert all((r.key, r.n, r.node, r.kept, r.score) == ("k", 1, 2, "no", 0.0) for r in out.select("key", "n", "node", "kept", "score").collect())
    clean = corpus_pipeline.quality_rules(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [0, 1, 4, 4, 7, 9]
    single = corpus_pipeline.near_duplicates(spark, clean, SF)
    assert sorted((r.doc_id or 0) for r in single.collect()) == [0, 1, 4]
    pieces = corpus_pipeline.packing(spark, single, SF).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 4} and sum(r.start == 0 for r in pieces) == 3
