"""Near duplicates against all pairs, and the pieces on their own."""

import random

import numpy as np
import pytest

from tidewell.llm import near_dup
from tidewell.llm.common import connected_components
from tidewell.llm.near_dup import SPAN, Tensor, drop_near_duplicates, near_duplicates, shingles, true_links, word_hashes


def word_sets(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(items, linked):
    """items: ids; the smallest id reachable from each."""
    parent = {i: i for i in items}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def brute(rows, percent=85):
    sets = {d: word_sets(t) for d, t in rows}
    ids = sorted(sets)
    return {d: (len(sets[d]), c) for d, c in groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]).items()}


def corpus(rng, n_groups=12):
    rows, d = [], 0
    for _ in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            sep = rng.choice([" ", "\n", "  \t"])
            rows.append((d * 7 % 1009, rng.choice(["", " "]) + sep.join(copy).upper() * rng.choice([1, 1]) if rng.random() < 0.3 else sep.join(copy)))
            d += 1
    return rows + [(2000, ""), (2001, None), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "é É"), (2006, "é é")]


def test_shingles():
    assert [len(shingles(t)) for t in ("", None, " \t", "a", "A b c d", "a b c d e", "a b c d e f", "x " * 50)] == [0, 0, 0, 1, 1, 1, 2, 1]
    assert np.array_equal(shingles("A b\x0bc"), shingles("a B C")) and not np.array_equal(shingles("a b"), shingles("a b c"))
    long = " ".join(f"word{i % 5000}" for i in range(SPAN // 4)) + " " + "z" * (SPAN + 7) + " end"
    assert len(word_hashes(long.encode())) == len(long.split()) and len(shingles(long)) == len(word_sets(long))


def test_true_links_all_pairs():
    rng = random.Random(9)
    for k in (2, 3, 30, 150):
        base = rng.sample(range(1 << 40), 60)
        sets = [np.unique(np.array([x if rng.random() > 0.06 else rng.randrange(1 << 40) for x in base[: rng.choice([30, 60])]], np.uint64)) for _ in range(k)]
        ids = np.array(rng.sample(range(1000), k))
        plain = [set(s.tolist()) for s in sets]
        want = groups(ids.tolist(), [(int(ids[i]), int(ids[j])) for i in range(k) for j in range(i) if 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])])
        assert groups(ids.tolist(), true_links(ids, sets, 85)) == want


def test_tensor_finds_close_pairs():
    rng, tensor = np.random.default_rng(3), Tensor()
    hit = far = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        b, c = a.copy(), a.copy()
        b[:15] = rng.integers(0, 1 << 62, 15).astype(np.uint64)  # similarity 0.86
        c[:160] = rng.integers(0, 1 << 62, 160).astype(np.uint64)  # 0.11
        k = tensor.keys(np.stack([tensor.signature(x) for x in (a, b, c)]))
        assert k.shape == (3, 144)
        hit += bool(set(k[0].tolist()) & set(k[1].tolist()))
        far += bool(set(k[0].tolist()) & set(k[2].tolist()))
    assert hit >= 299 and far <= 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups({x for e in clean for x in e}, clean)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_all_pairs(spark, seed):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, component_id string, n int").repartition(5)
    got = near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert out == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, "x", "c"), (3, text, "d"), (4, None, "e"), (5, "", "f"), (6, "word " * 200000, "g"), (7, "word " * 100, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    assert out == sorted([(1, 46, 1, True), (1, 46, 1, True), (None, 46, None, True), (None, 1, None, True), (3, 46, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.select("doc_id", "lang").collect()), key=repr) == sorted([(1, "a"), (None, "b"), (None, "c"), (4, "e"), (5, "f"), (6, "g")], key=repr)
    assert drop_near_duplicates(df.limit(0)).count() == 0


def cliques_and_chains(rng):
    """Parts of more than a block: near copies of one text, a chain of weak candidates, a chain of links."""
    rows, base = [], [f"b{i}" for i in range(120)]
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    stream = [f"s{i}" for i in range(4000)]
    rows += [" ".join(stream[i : i + 100]) for i in range(0, 3000, 20)]  # neighbours share 0.65
    stream = [f"t{i}" for i in range(4000)]
    rows += [" ".join(stream[i : i + 100]) for i in range(0, 450, 3)]  # neighbours share 0.94, ends nothing
    return [(7 * i % 1009, t) for i, t in enumerate(rng.sample(rows, len(rows)))]


@pytest.mark.parametrize("paired,levels", [(1, near_dup.LEVELS), (4, near_dup.LEVELS), (4, ())])
def test_large_parts_against_all_pairs(spark, monkeypatch, paired, levels):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(near_dup, "PAIRED", paired)
    monkeypatch.setattr(near_dup._true_links, "__defaults__", (levels,))
    rows = cliques_and_chains(random.Random(4))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert out == brute(rows)


def test_weak_chain_breaks_up(spark, monkeypatch):
    """20,000 texts in one part of weak candidates: every round sends each text to one block, and none is
    left for all pairs of blocks."""
    sent = []
    code = near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda blocks, *a: (sent.append(blocks.count()), code(blocks, *a))[1])
    df = spark.range(20_000).selectExpr("id as doc_id", "array_join(transform(sequence(id * 25, id * 25 + 99), x -> concat('w', x)), ' ') as text")
    assert near_duplicates(df).where("kept").count() == 20_000  # neighbours share 0.6
    assert sum(sent) <= 5 * 20_000


def test_other_keys_are_refused(spark):
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_clashing_columns_long_texts_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(5, long), (3, long + " end"), (9, "a b c d e f"), (9, "a b c d e f"), (8, "a b c d e f"), (None, "a b")]
    df = spark.createDataFrame([(*r, 1, 2, "r", "s") for r in rows], "doc_id long, text string, node int, n int, rep string, key string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 8]
