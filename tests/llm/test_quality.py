import random
import zlib

import numpy as np
import pytest

from faultline.llm import quality
from faultline.llm.quality import FEATURES, newton_sums, op11_quality_pu, prior_of, score_quality, text_features

DOCS = "doc_id long, text string, x string, positive int"
LABELS = "doc_id long, quality int, toxic int, lang string"


def texts(rng, n):
    words = ["the", "of", "tion", "lamp", "river", "Stone", "walks", "under", "blue", "seven", "morning", "paper"]
    for i in range(n):
        body = [rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(20, 90))]
        good = rng.random() < 0.8
        if not good:
            body = rng.choice([lambda: [w.upper() + "!!" for w in body], lambda: [w + " |" for w in body], lambda: ["spam"] * len(body), lambda: [w + "$$$" for w in body]])()
        yield i, " ".join(body), good


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus(spark, tables):
    rows = list(texts(random.Random(4), 3000))
    docs = [(i, t, None, 7) for i, t, _ in rows] + [(9000, None, None, 0), (9001, "", None, 0), (9002, " \n", None, 0), (None, rows[0][1], None, 0), (3, rows[3][1], None, 0)]
    docs.append((9003, "lamp river " * 40_000, None, 0))
    labels = [(i, int(good), 0, "zz") for i, _, good in rows if i % 2 == 0] + [(None, 1, 0, None), (4, 1 - int(rows[4][2]), 0, None)]
    return rows, docs, tables(documents=(docs, DOCS), labels=(labels, LABELS))


def test_held_out_documents(spark, corpus):
    rows, docs, sf = corpus
    got = op11_quality_pu(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    good = {i: g for i, _, g in rows}
    own = [r for r in got if r.doc_id in good and r.held_out]
    assert sum(bool(r.predicted) == good[r.doc_id] for r in own) / len(own) > 0.97
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_text[3]) == 1  # equal rows score alike
    assert by_text[9000] == by_text[9001]


def test_held_out_labels_are_not_learned(spark, corpus, tables):
    rows, docs, sf = corpus
    flipped = [(i, int(good) ^ held(i), 1, "y") for i, _, good in rows if i % 2 == 0] + [(None, 1, 0, None), (4, 1 - int(rows[4][2]), 0, None)]
    other = score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(flipped, LABELS))
    key = lambda r: (r.doc_id or -1, round(r.score, 6))
    assert sorted(map(key, op11_quality_pu(spark, sf).collect())) == sorted(map(key, other.collect()))


def test_without_positives_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, 0)], DOCS)
    rows = score_quality(docs, spark.createDataFrame([(1, 0, 0, None)], LABELS)).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)]
    assert not score_quality(docs.limit(0), spark.createDataFrame([], LABELS)).count()


def test_prior_is_the_share_of_good_texts():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.7, 0.1, 60_000), rng.normal(0.4, 0.1, 20_000)
    edges = np.linspace(0, 1, quality.BINS + 1)
    u, p = np.histogram(np.append(good[:50_000], bad), edges)[0], np.histogram(good[50_000:], edges)[0]
    assert abs(prior_of(u, p) - 50 / 70) < 0.02


def test_newton_sums_are_derivatives():
    rng = np.random.default_rng(2)
    x, w, step = rng.normal(size=(50, FEATURES)), rng.normal(size=FEATURES) * 0.1, 1e-5
    a, b = newton_sums(x, w), newton_sums(x, w + step * np.eye(FEATURES)[3])
    own = slice(3 + FEATURES, 3 + 2 * FEATURES)
    assert abs((b[2] - a[2]) / step - a[own][3]) < 1e-2
    assert np.allclose((b[own] - a[own]) / step, a[3 + 2 * FEATURES :].reshape(FEATURES, FEATURES)[3], atol=1e-2)


def test_a_text_has_its_features_whatever_stands_beside_it():
    words = [b"", b" ", b"The The the|", "É!! $$$ a".encode(), b"x" * 9000]
    joined, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0] + [len(w) for w in words])
    together = text_features(joined, offsets)
    for k, w in enumerate(words):
        assert np.allclose(together[k], text_features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0])
