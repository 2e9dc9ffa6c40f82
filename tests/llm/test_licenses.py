"""License scans against a plain search, and notices with edits."""

import random
import re

from tidewell.llm.common import load
from tidewell.llm.licenses import BASE_PHRASES, CHUNK, NOTICES, PHRASES, license_places, license_report, license_spans, merge_spans, default_templates, words, _votes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    w = WORD.findall(lower(text))
    find = lambda p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = {p: find(p) for p in BASE_PHRASES}
    at = sorted(i for v in base.values() for i in v)
    labels = {BASE_PHRASES[p] for p, v in base.items() if v}
    return (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(labels)), ",".join(sorted(labels | {v for p, v in PHRASES.items() if find(p)})))


def test_words_as_pattern():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aB09 _-\x00é\n`{日~") for _ in range(rng.randint(0, 30)))
        found = WORD.findall(lower(t))
        assert len(words(t)) == len(found) and len(set(words(t).tolist())) == len(set(found))


def test_query_against_plain_search(spark):
    rng = random.Random(2)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "all", "Rights", "reserved.", "mit", "gnu", "\n", "x", "é", "nc", "domain", "general public license", "all rights reserved"]
    texts = ["", None, "cc by", "CC BY-NC 4.0", "all\nrights...reserved"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += ["z " * (CHUNK - 2) + "general public license " + "q " * CHUNK + "cc by"]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(3, "CC BY-NC 4.0", "clash", 0), (None, "cc by", "clash", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, row int").repartition(4)
    got = license_report(license_places(df))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    out = sorted([tuple(r) for r in got.collect()], key=repr)
    want = sorted([(r[0], *brute(r[1]), 0.5 if brute(r[1])[5] else 0.0) for r in rows], key=repr)
    assert out == want
    assert license_spans(df.limit(0)).count() == 0


def test_corpus_against_plain_search(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    out = {r.doc_id: tuple(r)[1:7] for r in license_report(license_places(docs)).collect()}
    for r in docs.collect():
        assert out[r.doc_id] == brute(r.text)


def test_notices_with_edits(spark):
    rng = random.Random(3)
    rows = []
    for i, (label, text) in enumerate(NOTICES.items()):
        w = text.split()
        edited = list(w)
        for _ in range(3):
            edited.insert(rng.randrange(len(edited)), "extra")
        del edited[len(edited) // 2]
        filler = " ".join(f"w{j}" for j in range(40))
        rows += [(10 * i, f"{filler} {text} {filler}", label), (10 * i + 1, " ".join(edited), label), (10 * i + 2, " ".join(w[: len(w) // 4]), None), (10 * i + 3, text + "\n" + text, label)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    out = {r.doc_id: [s for s in r.spans if s.notice] for r in license_spans(df, share=0.5).collect()}
    for d, _, label in rows:
        found = [s.label for s in out[d]]
        assert found.count(label) == (2 if d % 10 == 3 else 1) if label else not found, (d, label, found)
    whole = out[0][0]
    assert (whole.first_word, whole.last_word, whole.share) == (40, 40 + len(WORD.findall(NOTICES["mit"])) - 1, 1.0)


def test_merge_needs_whole_phrase():
    t = default_templates()
    gpl = next(i for i, x in enumerate(t) if x.text == "general public license")
    assert list(merge_spans([(gpl, 5, [0])], t, 0.6, 6)) == []
    assert list(merge_spans([(gpl, 5, [0, 1])], t, 0.6, 6)) == [(gpl, 5, 7, 1.0)]


def test_merge_past_many_stray_runs():
    t = default_templates()
    mit = next(i for i, x in enumerate(t) if x.label == "mit" and x.k == 4)
    need = t[mit].n_words - 3
    half = need // 2
    kept = [a for a in range(need) if not half - 10 <= a < half + 10]
    strays = [(mit, 10 + half - 8 + j, [0]) for j in range(12)]  # copies of the first gram in the gap
    assert list(merge_spans(sorted([(mit, 10, kept), *strays]), t, 0.6, 6)) == [(mit, 10, 10 + t[mit].n_words - 1, len(kept) / need)]


def test_notices_with_edits_at_the_default_share(spark):
    rng = random.Random(11)
    rows = []
    for label, text in NOTICES.items():
        for _ in range(25):
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "extra")
            del w[len(w) // 2]
            rows.append((len(rows), " ".join(w), label))
        rows.append((len(rows), " ".join(text.split()[: len(text.split()) // 4]), None))
    hpnd = "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"
    rows.append((len(rows), hpnd, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    out = {r.doc_id: [s.label for s in r.spans if s.notice] for r in license_spans(df).collect()}
    for d, text, label in rows:
        assert out[d] == ([label] if label else []), (d, text, label, out[d])


def test_long_text_of_one_phrase(spark):
    """Hits by the hundred thousand are counted, not gathered; notices among them are found."""
    text = "cc by " * 150_000 + NOTICES["mit"] + " mit license" * 50_000 + " " + NOTICES["isc"]
    r = license_report(license_places(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (150_000, 0, 299_998, "cc-by", "cc-by,isc,mit", 1.0)


def test_notice_with_stray_words_after_every_tenth(spark):
    w = NOTICES["mit"].split()
    text = " ".join(" ".join(w[i : i + 10] + w[-4:]) for i in range(0, len(w), 10))
    r = license_report(license_places(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert r.labels == "mit" and r.score > 0.8


def test_votes_come_by_word():
    rng = random.Random(6)
    for _ in range(50):
        diagonals = sorted((rng.randrange(-5, 40), sorted(rng.sample(range(20), rng.randint(1, 6)))) for _ in range(rng.randint(0, 20)))
        assert list(_votes(diagonals)) == sorted((d + a, a) for d, at in diagonals for a in at)
