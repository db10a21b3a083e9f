import random

import numpy as np
import pytest

from tabforge.llm import near_dedup


def brute(rows, words, t=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = frozenset(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= t * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    return {i: find(i) for i in ids}, sets


def corpus():
    random.seed(21)
    vocab = [f"w{i}" for i in range(50)] + ["É", "é", "A", "a"]
    rows, n = [], 0
    for _ in range(12):
        base = [random.choice(vocab) for _ in range(random.choice([30, 80]))]
        for _ in range(random.choice([1, 2, 12])):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 6])):
                w[random.randrange(len(w))] = random.choice(vocab)
            rows.append((n, random.choice([" ", "\n", "\t "]).join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "two words"), (n + 6, "two  words"), (n + 7, "x"), (n + 7, "x")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,block", [(2, 256), (5, 4), (2, 1)])
def test_components_against_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    want, sets = brute(rows, words)
    got = near_dedup.near_groups(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string"), words=words).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.n_shingles in {len(s) for s in sets[r.doc_id]}


@pytest.mark.parametrize("block", [256, 4, 1])
def test_search_alone_finds_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "neighbours", lambda rows, t: rows.sparkSession.createDataFrame([], "a long, b long"))
    rows = [(i, t) for i, t in corpus() if i % 7]
    want, _ = brute(rows, 2)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_one_document_with_two_texts_ties_them(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (None, a)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 9: 1, None: None}


def test_nulls_and_empty(spark):
    out = near_dedup.near_groups(spark.createDataFrame([(None, "t t"), (2, "y" * 100_000)], "doc_id long, text string")).collect()
    assert all(r.kept for r in out)
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_that_agree_in_48_of_80_places_are_compared():
    n = np.array([100, 100])
    a, b = np.zeros((2, 80), np.uint16), np.zeros((2, 80), np.uint16)
    b[0, 48:], b[1, 47:] = 1, 1
    assert near_dedup._alike(n, n, a, b, 0.8).tolist() == [True, False]


def forest_order():
    random.seed(8)
    rows = []
    for bucket, size in ((1, 3), (2, 16), (3, 17), (4, 200), (5, 1), (6, 40)):
        for _ in range(size):
            rest = [0] * 12 if bucket == 6 else [random.choice([0, 0, 0, 1]) for _ in range(12)]
            sig = [random.choice([7, 7, 7, 8]) for _ in range(80)]
            rows.append((bucket, rest, random.randrange(10**6), 100, sig))
    rows.sort(key=lambda r: (r[0], np.array(r[1], np.uint16).tobytes(), r[2]))
    kinds = (np.int64, np.uint16, np.int64, np.int64, np.uint16)
    return [np.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]


def test_depth_of_a_leaf_adapts_to_its_region():
    bucket, rest = forest_order()[:2]
    got = near_dedup.leaves(bucket, rest)
    keys = [(b, *r) for b, r in zip(bucket.tolist(), rest.tolist(), strict=True)]
    for i, k in enumerate(keys):
        group = next((g for d in range(1, 14) if len(g := [j for j, x in enumerate(keys) if x[:d] == k[:d]]) <= near_dedup.LEAF), [i])
        assert got[i] == group[0]
    assert len(set(got[bucket == 4])) > 10 and len(set(got[bucket == 2])) == 1 and len(set(got[bucket == 6])) == 40


@pytest.mark.parametrize("size", [1, 7, 33, 1000])
def test_candidates_do_not_depend_on_chunks(monkeypatch, size):
    cols = forest_order()
    whole = {(int(x), int(y)) for a, b in near_dedup._candidates(cols, 0, len(cols[0]), 0.8) for x, y in zip(a, b, strict=True)}
    monkeypatch.setattr(near_dedup, "ROWS_AT_ONCE", size)
    chunks = ([c[i : i + size] for c in cols] for i in range(0, len(cols[0]), size))
    got = {(int(x), int(y)) for a, b in near_dedup._in_order(chunks, 0.8) for x, y in zip(a, b, strict=True)}
    assert got == whole and len(whole) > 200
