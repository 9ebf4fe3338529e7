import itertools

import numpy as np
import pytest

from faultline.llm import jaccard
from faultline.llm.jaccard import link_block, near_duplicates, op9_ngram_jaccard, prefix

from .conftest import DOCUMENT


def brute(rows, percent=90):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[root(i)] = min(low.get(root(i), key), key)
    return sorted((k is None, k or 0, len(sets[i]), low.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows))


def corpus(seed=0, base=12, copies=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, key = [], 0
    for b in range(base):
        text = list(rng.choice(vocabulary, int(rng.integers(12, 160))))
        for c in range(copies if b == 0 else int(rng.integers(1, 8))):
            own = list(text)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 10**6)}"
            rows.append((key, " ".join(own)))
            key += 1
    return rows


@pytest.mark.parametrize("block,shingles,short,hot", [(4096, 1 << 20, 64, 1 << 15), (8, 1 << 20, 5, 1 << 15), (16, 500, 3, 2), (16, 100, 10**6, 1)])
def test_components_equal_brute_force(spark, monkeypatch, block, shingles, short, hot):
    """Small blocks leave more to the list-by-list pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "HOT_PARTS", 3)
    rows = corpus(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in near_duplicates(docs).collect())
    assert got == brute(rows)


def test_odd_rows(spark, tables):
    long = " ".join(f"t{k}" for k in range(30000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "one two three"), (12, long), (13, long + " more"), (14, long), (14, long), (None, long), (15, "é à ü"), (16, "É à ü")]
    folder = tables(documents=([(k, t, "en", "s", 0) for k, t in rows], DOCUMENT))
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in op9_ngram_jaccard(spark, folder).collect())
    assert got == brute(rows)
    assert op9_ngram_jaccard(spark, tables(documents=([], DOCUMENT))).count() == 0


def test_prefixes_share_enough():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, 5000)
    for _ in range(300):
        n = int(rng.integers(10, 200))
        a = np.unique(rng.integers(0, 5000, n)).astype(np.uint64)
        drop = int(rng.integers(0, max(1, len(a) // 19) + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 5000, drop).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common):
            (p, x), (q, y) = prefix(a, counts[a.astype(int)], 90), prefix(b, counts[b.astype(int)], 90)
            assert len(np.intersect1d(p, q)) >= min(x, y)


def test_block_links_connect_what_all_links_connect():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 10**6, 120)
    sets = [np.unique(np.concatenate((base[rng.random(120) > 0.03], rng.integers(0, 10**6, int(rng.integers(0, 4)))))).astype(np.uint64) for _ in range(70)]
    parent, full = list(range(70)), list(range(70))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for i, j in link_block(sets, 90):
        parent[root(parent, i)] = root(parent, j)
    for i, j in itertools.combinations(range(70), 2):
        c = len(np.intersect1d(sets[i], sets[j]))
        if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
            full[root(full, i)] = root(full, j)
    same = lambda p: [[root(p, i) == root(p, j) for j in range(70)] for i in range(70)]
    assert same(parent) == same(full)


@pytest.mark.parametrize("short", [64, 5])
def test_split_list_of_unlike_groups(spark, monkeypatch, short):
    """Pairs whose one shared published word is that of a list cut into parts."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "SHORT", short)
    n = 30
    own = [[f"g{k}w{i}" for i in range(17)] for k in range(n)]
    rows = [(2 * k + c, " ".join(["common", f"u{k}c{c}", *own[k]])) for k in range(n) for c in range(2)]
    # copies of one long text make the words of the groups more frequent than the common one
    rows += [(1000 + k, " ".join(w for words in own for w in words)) for k in range(4 * n)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 90, 1).collect()}
    assert got == {k: 1000 if k >= 1000 else k // 2 * 2 for k, _ in rows}


def test_rows_without_id_link_others(spark):
    """B and C are near copies of a row without an id, not of each other."""
    text = [f"w{k}" for k in range(100)]
    b, c = [*text[:96], *"pqrs"], [*"tuvx", *text[4:]]
    lone = [f"y{k}" for k in range(50)]
    rows = [(1, " ".join(b)), (2, " ".join(c)), (None, " ".join(text)), (None, " ".join(text).upper()), (None, " ".join(lone)), (None, " ".join([*lone, "z"])), (3, "other words here")]
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2] or 0) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(*r[:3], r[3] or 0) for r in brute(rows)]
    assert got == sorted(want) and [r[3] for r in got[:2]] == [1, 1]


def test_signatures_bound_differences():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 9000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(rng.integers(0, n // 5 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64))))
        apart = len(np.setxor1d(a, b))
        assert jaccard.differing(jaccard.signature(a, 90), jaccard.signature(b, 80)) <= apart
    far = rng.integers(0, 2**63, (2, 9000)).astype(np.uint64)
    assert jaccard.differing(*(jaccard.signature(np.unique(x), 90) for x in far)) > 2000  # more than similar sets may differ


def test_extra_columns_and_table_of_copies(spark):
    rows = [(k, "one two three four five six", k, "x") for k in range(300)] + [(999, "none of these words are there", 1, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key long, component string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, 0) for k in range(300)} | {(999, 999)}
