import collections
import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm.elias_fano import EliasFano
from faultline.llm.ngram_model import DISCOUNT, Gathered, merged, of_batches, op6_ngram_scores, packed, unpacked

from .conftest import DOCUMENT


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 2**45), min_size=1, max_size=300), st.lists(st.integers(0, 2**45), max_size=40))
def test_elias_fano(values, queries):
    values = np.sort(np.array(values, np.uint64))
    ef = EliasFano.build(values)
    assert (ef.access(np.arange(len(values))) == values).all()
    asked = np.array([*queries, *values[:20].tolist()], np.uint64)
    assert (ef.lower_bound(asked) == np.searchsorted(values, asked)).all()
    found = ef.find(asked)
    assert all((values[f] == q) if f >= 0 else q not in values for f, q in zip(found.tolist(), asked.tolist()))


def test_clustered_values():
    values = np.unique(np.concatenate([np.arange(5000), 10**9 + np.arange(3000), [10**12]])).astype(np.uint64)
    ef = EliasFano.build(values)
    q = np.concatenate((values, values + np.uint64(1)))
    assert (ef.lower_bound(q) == np.searchsorted(values, q)).all()


def model(rows):
    end = "<end>"
    docs = [(k, (t or "").encode().lower().split() + [end]) for k, t in rows]
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for k, w in docs:
        if k is None or zlib.crc32(str(k).encode()) % 5 != 1:
            s = [end, *w]
            c1.update(w)
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
    n, v = sum(c1.values()), len(c1)
    once, twice = sum(x == 1 for x in c1.values()), sum(x == 2 for x in c1.values())
    d1 = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
    s2, s3 = collections.Counter(), collections.Counter()
    k2, k3 = dict(c2), dict(c3)  # pairs and triples seen once count
    for (a, _), c in k2.items():
        s2[a] += c - DISCOUNT
    for (a, b, _), c in k3.items():
        s3[a, b] += c - DISCOUNT

    def p1(w):
        return (c1[w] - d1) / n if c1[w] else max(d1 * v, 0.5) / n

    def p2(a, w):
        return ((k2[a, w] - DISCOUNT) / c1[a] if (a, w) in k2 else 0) + (1 - s2[a] / c1[a] if a in s2 else 1) * p1(w)

    def p3(a, b, w):
        if (a, b) not in s3:
            return p2(b, w)
        return ((k3[a, b, w] - DISCOUNT) / c2[a, b] if (a, b, w) in k3 else 0) + (1 - s3[a, b] / c2[a, b]) * p2(b, w)

    out = []
    for k, w in docs:
        s = [end, *w]
        base = sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = math.log10(p2(end, w[0])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:]))
        out.append((k, len(w), sum(c1[x] > 0 for x in w), n, base, score))
    return out


def test_query_against_brute_force(spark, tables):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)), p=None)) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:30])] + [(900, None), (901, ""), (902, "the " * 30000), (902, "the " * 30000), (None, "w1 W2 w3"), (903, "never seen words é")]
    got = op6_ngram_scores(spark, tables(documents=([(k, t, "en", "s", 0) for k, t in rows], DOCUMENT))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(model(rows), key=key)
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    assert [w[:4] for w in want] == [h[:4] for h in have]
    for w, h in zip(want, have):
        assert abs(w[4] - h[4]) < 1e-6 * max(1, abs(w[4])) and abs(w[5] - h[5]) < 5e-4 * w[1]


def test_empty_and_nothing_to_learn_from(spark, tables):
    assert op6_ngram_scores(spark, tables(documents=([], DOCUMENT))).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = op6_ngram_scores(spark, tables(documents=([(held, "a b", "en", "s", 0)], DOCUMENT))).first()
    assert row["train_tokens"] == 0 and row["score"] == 0 and row["held_out"]


def test_pairs_and_triples_seen_once_count(spark, tables):
    """Held-out texts that share a passage with one training text."""
    rng = np.random.default_rng(3)
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows = {k: [f"w{x}" for x in rng.integers(0, 400, 30)] for k in range(200)}
    for k in held:
        rows[k][5:15] = rows[next(x for x in range(k + 1, 400) if x % 200 not in held) % 200][5:15]
    c1, c2, c3, after2, after3 = (collections.Counter() for _ in range(5))
    for k, w in rows.items():
        if k not in held:
            s = ["", *w, ""]
            c1.update(s[1:])
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
    after2.update(a for a, _ in c2)
    after3.update((a, b) for a, b, _ in c3)
    n, once, twice = sum(c1.values()), sum(x == 1 for x in c1.values()), sum(x == 2 for x in c1.values())
    d1 = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)

    def p1(w):
        return (c1[w] - d1) / n if c1[w] else max(d1 * len(c1), 0.5) / n

    def p2(a, w):
        return (max(c2[a, w] - DISCOUNT, 0) + DISCOUNT * after2[a] * p1(w)) / c1[a] if after2[a] else p1(w)

    def p3(a, b, w):
        return (max(c3[a, b, w] - DISCOUNT, 0) + DISCOUNT * after3[a, b] * p2(b, w)) / c2[a, b] if after3[a, b] else p2(b, w)

    folder = tables(documents=([(k, " ".join(w), "en", "s", 0) for k, w in rows.items()], DOCUMENT))
    for r in op6_ngram_scores(spark, folder).collect():
        s = ["", *rows[r["doc_id"]], ""]
        want = math.log10(p2(*s[:2])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:]))
        assert r["held_out"] == (r["doc_id"] in held) and abs(r["score"] - want) < 5e-4 * r["n_tokens"]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_packed_numbers(values):
    values = np.array(values, np.uint64)
    assert (unpacked(packed(values)) == values).all()


def test_gathered_counts():
    rng = np.random.default_rng(4)
    kept, want = Gathered(), collections.Counter()
    for _ in range(40):
        codes, counts = np.unique(rng.integers(0, 2**40, 9000) % 5000, return_counts=True)
        kept.add(7, codes.astype(np.uint64), counts.astype(np.uint32))
        want.update(dict(zip(codes.tolist(), counts.tolist())))
    codes, counts = of_batches(list(kept.rows()))
    assert dict(zip(codes.tolist(), counts.tolist())) == want and (np.diff(codes.astype(np.int64)) > 0).all()
    assert merged([(codes, counts)])[0] is codes


def test_counts_beyond_32_bits():
    codes, most = np.array([3, 9], np.uint64), 2**32 - 1
    held = Gathered()
    for count in (most, most, 7):
        held.add(0, codes, np.array([count, 1], np.uint32))
    batches = list(held.rows())
    assert of_batches(batches + batches)[1].tolist() == [2 * (2 * most + 7), 6]
    assert of_batches(batches)[0].tolist() == [3, 9] and merged([(codes, np.array([1, 2], np.uint32))] * 2)[1].dtype == np.uint32
